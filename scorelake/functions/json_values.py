"""One rule for reading JSON that models and people write: what Python's reader takes, no more and no less.

Spark's parser follows the same grammar but stops at the end of the first value, and has no NaN. So a text is parsed as the first
element of a list that ends with a mark: unless the list then has exactly those two elements, the text is no single value. NaN and
infinities are found by a pattern that walks over strings, so that what a string says stays as it is.

Repeated keys keep their last value if ``spark.sql.variant.allowDuplicateKeys`` is on, see ``session.configure``; else such a text
counts as no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.staging import let

END = "end of value"
#: Up to a NaN or an infinity where a value may stand; possessive, so that no text makes it go back.
_TO_NUMBER = r'(?s)\G((?:[^"NI-]|-(?!Infinity)|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(NaN|-?Infinity)'
#: Stands before the name of such a number while it is a string.
_NAMED = "\\u0007number "
_SPELLED = r'"\\u0007number (NaN|-?Infinity)"'
_DECODED = "^\x07number (NaN|-?Infinity)$"


def _named(text: Column) -> Column:
    """Whether a number that is none may be in a text: a quick look ahead of the pattern."""
    return F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))


def _replace_numbers(text: Column, by: str) -> Column:
    return F.when(_named(text), F.regexp_replace(text, _TO_NUMBER, by)).otherwise(text)


def _single(text: Column) -> Column:
    mark = F.when(F.contains(text, F.lit(END)), F.md5(text)).otherwise(F.lit(END))
    parts = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), "$", "array<variant>")
    whole = lambda p: (F.size(p) == 2) & (F.try_variant_get(F.get(p, F.lit(1)), "$", "string") == mark)
    return let(parts, lambda p: F.when(whole(p), F.get(p, F.lit(0))))


def json_value(text: Column | str) -> Column:
    """A JSON text as a variant, null for other texts. NaN and infinities, which a variant has no name for, are JSON nulls in it."""
    text = F.col(text) if isinstance(text, str) else text
    return let(let(text, lambda t: _replace_numbers(t, "$1null")), _single)


def elements(text: Column) -> Column:
    """The elements of a JSON list as texts, strings without their quotes; null for other texts.

    What lies inside an element keeps its spelling and the order of its keys. A NaN or an infinity in it is a marked string until
    ``spelled`` is applied to what is finally kept.
    """
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

    def listed(t: Column) -> Column:
        is_list = F.startswith(F.ltrim(t, F.lit(" \t\r\n")), F.lit("["))
        return F.when(is_list & json_value(t).isNotNull(), _replace_numbers(t, rf'$1"\{_NAMED}$2"'))

    return F.from_json(let(text, listed), "array<string>", options)


def spelled(text: Column) -> Column:
    """Text from ``elements``, or a field of one, with numbers that are none spelled as they were."""
    back = F.regexp_replace(F.regexp_replace(text, _SPELLED, "$1"), _DECODED, "$1")
    return F.when(_named(text), back).otherwise(text)
