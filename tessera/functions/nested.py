"""JSON, array and vector functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull())


def json_type(x: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null where the path leads nowhere."""
    found = F.try_variant_get(F.try_parse_json(x), path, "variant")
    kind = F.schema_of_variant(found)
    return (
        F.when(found.isNull(), None)
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", F.try_variant_get(found, "$", "string"))
        .when(kind == "BIGINT", "integer")
        .when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("real")
    )


def json_array_length(x: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(x, path)).cast("long")


def json_array(*xs: Column) -> Column:
    """A JSON array of values of one type; nulls stay."""
    return F.to_json(F.array(*xs))


def json_object(**fields: Column) -> Column:
    """A JSON object with the fields in the order given; nulls stay."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def json_group_array(x: Column, by: Column) -> Column:
    """All values of a group as a JSON array in the order of `by`; nulls stay."""
    rows = F.array_sort(F.collect_list(F.struct(by.alias("o"), x.alias("v"))))
    return F.to_json(F.transform(rows, lambda r: r["v"]))


def json_group_object(key: Column, x: Column) -> Column:
    """A group's pairs as a JSON object in the order of their (unique) keys."""
    rows = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), x.alias("v"))))
    return F.to_json(F.map_from_entries(rows), {"ignoreNullFields": "false"})


def array_length(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def array_append(a: Column, x: Column) -> Column:
    """A null array counts as empty."""
    return F.when(a.isNull(), F.array(x)).otherwise(F.concat(a, F.array(x)))


def array_prepend(a: Column, x: Column) -> Column:
    return F.when(a.isNull(), F.array(x)).otherwise(F.concat(F.array(x), a))


def array_cat(a: Column, b: Column) -> Column:
    """Both in turn; a null one counts as empty, two nulls as null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def array_remove(a: Column, x: Column) -> Column:
    """Without all elements that equal x; a null x takes the nulls out."""
    return F.filter(a, lambda e: ~e.eqNullSafe(x))


def array_set(a: Column, at: int, x: Column) -> Column:
    """The array with another element at a place from 1."""
    return F.transform(a, lambda e, i: F.when(i == at - 1, x).otherwise(e))


def array_overlap(a: Column, b: Column) -> Column:
    """Whether a non-null element is in both."""
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def string_to_array(x: Column, separator: str | None, null: str | None = None) -> Column:
    """Parts between separators: of an empty text none, without a separator the characters. Parts equal to `null` become null."""
    if separator is None:
        parts = F.split(x, "(?!^)(?!$)")
    else:
        parts = F.split(x, re.escape(separator)) if separator else F.array(x)
    parts = F.when(x == "", F.array().cast("array<string>")).otherwise(parts)
    return parts if null is None else F.transform(parts, lambda p: F.nullif(p, F.lit(null)))


def array_to_string(a: Column, separator: str, null: str | None = None) -> Column:
    """Elements joined; nulls are left out, or written as `null`."""
    return F.array_join(a, separator) if null is None else F.array_join(a, separator, null)


def vector_8bit(v: Column) -> Column:
    """Linear codes 0 to 255 between the least and greatest component: a struct of codes, low and step."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    step = F.when(high > low, (high - low) / 255).otherwise(F.lit(1.0))
    return F.struct(F.transform(v, lambda x: F.round((x.cast("double") - low) / step).cast("int")).alias("codes"), low.alias("low"), step.alias("step"))


def vector_from_8bit(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + c * q["step"])


def vector_1bit(v: Column) -> Column:
    """The sign of each component: 1 if positive, else 0."""
    return F.transform(v, lambda x: (x > 0).cast("int"))


def vector_sparse(v: Column) -> Column:
    """Places (from 0) and values of the components that aren't zero."""
    pairs = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("at"), x.alias("value"))), lambda p: p["value"] != 0)
    return F.struct(F.transform(pairs, lambda p: p["at"]).alias("at"), F.transform(pairs, lambda p: p["value"]).alias("value"))


def vector_concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def vector_text(v: Column) -> Column:
    return F.to_json(v)
