"""Stable keys of prompt variables: a short hash of their sorted JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.json_values import json_value
from scorelake.functions.staging import let, stage
from scorelake.functions.text import json_quote


def _object_text(entries: Column, value) -> Column:
    body = F.array_join(
        F.transform(entries, lambda e: F.concat(json_quote(e["key"]), F.lit(": "), value(e["value"]))), ", "
    )
    return F.concat(F.lit("{"), body, F.lit("}"))


def vars_json(vars_map: Column, sort: bool = True) -> Column:
    """JSON text of a string map with ', ' and ': ' separators, keys sorted unless told otherwise."""
    entries = F.map_entries(vars_map)
    return _object_text(F.array_sort(entries) if sort else entries, json_quote)


def json_map_text(json_map: Column) -> Column:
    """JSON text of a map whose values are JSON text already, in map order."""
    return _object_text(F.map_entries(json_map), lambda v: F.coalesce(v, F.lit("null")))


def _plain_json(text: Column) -> Column:
    """Sorted JSON text of an object of strings, whole numbers, booleans and nulls; null for any other."""

    def write(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        return F.when(kind == "STRING", json_quote(value.cast("string"))).when(
            kind.isin("BIGINT", "BOOLEAN", "VOID"), F.to_json(value)
        )

    values = F.map_entries(F.transform_values(json_value(text).cast("map<string,variant>"), lambda _, v: write(v)))
    return let(
        F.array_sort(values),
        lambda entries: F.when(
            F.forall(entries, lambda e: e["value"].isNotNull()), _object_text(entries, lambda v: v)
        ),
    )


def with_canonical_json(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Add the sorted JSON text of an object given as JSON.

    The usual objects are written in the JVM. Only those with fractions, lists or objects inside are handed to Python;
    all others reach it as nulls.
    """

    @F.pandas_udf("string")
    def sort_keys(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        )

    staged = stage(df, "_plain", _plain_json(text))
    rest = sort_keys(F.when(F.col("_plain").isNull(), text))
    return staged.withColumn(name, F.coalesce("_plain", rest)).drop("_plain")


def short_hash(canonical_text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(canonical_text, 256), 1, 16)


def vars_key(vars_map: Column) -> Column:
    return short_hash(vars_json(vars_map))


def canonical_args(arguments: Column) -> Column:
    """Tool arguments as a map of canonical JSON text; a JSON null becomes a missing value.

    Numbers lose their spelling (1.0 prints as 1), so equal arguments have equal text.
    """
    return F.transform_values(
        json_value(arguments).cast("map<string,variant>"),
        lambda _, v: F.nullif(F.to_json(v), F.lit("null")),
    )
