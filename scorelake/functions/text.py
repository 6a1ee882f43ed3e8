"""String expressions whose results match Python's string methods. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.staging import let

# The characters that str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

_UNPRINTABLE = r"[\x00-\x1F\x7F-\xA0\xAD\u1680\u2000-\u200F\u2028-\u202F\u205F-\u206F\u3000\uFEFF]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace on both sides (plain trim only removes spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def strip_long(c: Column | str) -> Column:
    """As ``strip`` for long texts, most of which have nothing to trim: trimming looks at every character, this at two."""
    c = _col(c)
    edge = lambda t, at: F.contains(F.lit(WHITESPACE), F.substring(t, at, 1))
    return let(c, lambda t: F.when(edge(t, 1) | edge(t, -1), strip(t)).otherwise(t))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(WHITESPACE))


def icontains(hay: Column | str, needle: Column | str) -> Column:
    """Case-insensitive contains. A missing text counts as empty, an empty needle is in everything."""
    return F.contains(
        F.lower(F.coalesce(_col(hay), F.lit(""))), F.lower(F.coalesce(_col(needle), F.lit("")))
    )


def fixed(c: Column, digits: int) -> Column:
    """Decimal text of a double, rounded half-even on its binary value as Python formatting does.

    Spark's formatter is right everywhere but at half of the last digit itself (0.05 with one digit), which is given.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    value = c.cast("double")
    half = 0.5 / 10**digits
    text = F.call_function("format_number", value, F.lit(pattern))
    for edge in (half, -half):
        text = F.when(value == edge, f"{edge:.{digits}f}").otherwise(text)
    return text


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(fixed(c.cast("double") * F.lit(100.0), digits), F.lit("%"))


def py_round(c: Column, digits: int) -> Column:
    """Round like Python's round(x, n). Use it on summaries; it goes through decimal text."""
    return fixed(c, digits).cast("double")


def shorten(c: Column, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def split_list(c: Column | str, drop_empty: bool = True) -> Column:
    """Comma-separated text to a list of stripped items."""
    items = F.transform(F.split(_col(c), ","), strip)
    return F.filter(items, lambda t: t != "") if drop_empty else items


def json_quote(c: Column) -> Column:
    """A string as JSON text, non-ASCII characters kept, control characters in lower-case hex."""

    def escaped(packed: Column) -> Column:
        quoted = F.substring(packed, F.lit(2), F.length(packed) - 2)
        # Spark writes \u001F where Python writes \u001f; only texts that hold such a mark are rewritten.
        lowered = quoted
        for digit in "ABCDEF":
            lowered = F.regexp_replace(
                lowered, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}"
            )
        return F.when(quoted.rlike(r"\\u00[01][A-F]"), lowered).otherwise(quoted)

    plain = F.concat(F.lit('"'), c, F.lit('"'))
    return F.when(c.rlike(r'["\\\x00-\x1F]'), let(F.to_json(F.array(c)), escaped)).otherwise(plain)


def ascii_json(c: Column) -> Column:
    """Escape the non-ASCII characters of JSON text as \\uXXXX, astral ones as surrogate pairs."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code.cast("long"))), 4, "0"))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        above = code - 0x10000
        return (
            F.when(code < 128, ch)
            .when(code < 0x10000, unit(code))
            .otherwise(
                F.concat(
                    unit(F.lit(0xD800) + F.shiftright(above, 10)),
                    unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))),
                )
            )
        )

    escaped = F.array_join(F.transform(F.split(c, ""), escape), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), escaped).otherwise(c)


def _hidden(body: Column) -> Column:
    """Spell out control characters and blanks other than the space with their hex codes."""

    def show(ch: Column) -> Column:
        code = F.ascii(ch)
        digits = F.lower(F.hex(code.cast("long")))
        return (
            F.when(~ch.rlike(_UNPRINTABLE), ch)
            .when(code < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .otherwise(F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        )

    spelled = F.array_join(F.transform(F.split(body, ""), show), "")
    return F.when(body.rlike(_UNPRINTABLE), spelled).otherwise(body)


def py_repr(c: Column) -> Column:
    """A string between quotes as Python's repr shows it: single quotes unless only those occur inside."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    body = _hidden(body)
    has_single, has_double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (
        F.when(has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def repr_list(items: Column) -> Column:
    """A list of strings as Python shows it."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, py_repr), ", "), F.lit("]"))


def strip_fence(c: Column | str) -> Column:
    """Remove a leading code-fence line and, if the text then ends with a fence, that one too."""

    def inner(text: Column) -> Column:
        cut = F.locate("\n", text)
        body = F.when(cut == 0, F.lit("")).otherwise(F.substring(text, cut + 1, F.length(text)))
        return let(
            body,
            lambda b: F.when(
                F.endswith(b, F.lit("```")), strip(F.substring(b, F.lit(1), F.length(b) - 3))
            ).otherwise(b),
        )

    return let(strip_long(c), lambda t: F.when(F.startswith(t, F.lit("```")), inner(t)).otherwise(t))


def strip_fence_lines(c: Column | str) -> Column:
    """Remove a leading fence line and a last line that is only a fence."""

    def inner(lines: Column) -> Column:
        last_is_fence = strip(F.element_at(lines, -1)) == "```"
        count = F.size(lines) - F.when(last_is_fence, 2).otherwise(1)
        return F.array_join(F.slice(lines, F.lit(2), F.greatest(count, F.lit(0))), "\n")

    breaks = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
    return let(
        strip_long(c),
        lambda t: F.when(F.startswith(t, F.lit("```")), let(F.split(t, breaks), inner)).otherwise(t),
    )
