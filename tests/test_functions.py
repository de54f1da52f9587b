"""Functions on literal rows: edge cases that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, nested, text
from tessera.functions import scalar as S
from tessera.operators import constraints, incremental, relational


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def ntz(x):
    return F.lit(x).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("fmt", "args", "want"),
    [("%05d", [42], "00042"), ("%,d", [1234567], "1,234,567"), ("%q", ["it's"], "it''s"), ("%Q", ["it's"], "'it''s'"), ("%Q", [None], "NULL"), ("%d%%", [None], "0%"), ("%-6s|", ["ab"], "ab    |"), ("%.3s", ["abcdef"], "abc"), ("%c", ["xyz"], "x"), ("%w", ['a"b'], 'a""b'), ("%s", [None], "")],
)
def test_printf(one, fmt, args, want):
    assert value(one, text.printf(fmt, *[F.lit(a).cast("string") if a is None else F.lit(a) for a in args])) == want


def test_printf_rejects_unknown_codes():
    with pytest.raises(ValueError):
        text.printf("%y", F.lit(1))


def test_blobs(one):
    assert value(one, text.char(F.lit(65), F.lit(0x1F600), F.lit(None))) == "A😀"
    assert value(one, text.unhex(F.lit("4a-4B"), "-")) == b"JK"
    assert value(one, text.unhex(F.lit("4a4"))) is None
    assert value(one, text.zeroblob(F.lit(3))) == b"\0\0\0"
    assert value(one, text.get_byte(F.lit(b"abc"), F.lit(1))) == 98
    assert value(one, text.set_byte(F.lit(b"abc"), F.lit(1), F.lit(120))) == b"axc"
    assert value(one, text.lower_ascii(F.lit("ÀB"))) == "Àb"
    assert value(one, text.quote_identifier(F.lit('a"B'))) == '"a""B"'
    assert value(one, text.type_name(F.lit(None))) == "null"


@pytest.mark.parametrize(
    ("modifiers", "want"),
    [(["+1 months"], "2025-03-03 10:30:00"), (["+1 months", "floor"], "2025-02-28 10:30:00"), (["+1 months", "ceiling"], "2025-03-01 10:30:00"), (["start of month", "-1 days"], "2024-12-31 00:00:00"), (["weekday 5"], "2025-01-31 10:30:00"), (["weekday 1"], "2025-02-03 10:30:00"), (["+01:45"], "2025-01-31 12:15:00"), (["1 year"], "2026-01-31 10:30:00"), (["1.5 hours"], "2025-01-31 12:00:00")],
)
def test_modifiers(one, modifiers, want):
    assert value(one, dates.datetime(ntz("2025-01-31 10:30:00"), *modifiers)) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("2023-02-15 00:00:00", "2023-01-01 00:00:00", "+0000-01-14 00:00:00.000"), ("2023-01-01 00:00:00", "2023-02-15 00:00:00", "-0000-01-14 00:00:00.000"), ("2024-03-01 12:00:00.5", "2023-03-01 13:00:00", "+0000-11-28 23:00:00.500"), ("2020-01-01 00:00:00", "2020-01-01 00:00:00", "+0000-00-00 00:00:00.000")],
)
def test_timediff(one, a, b, want):
    assert value(one, dates.timediff(ntz(a), ntz(b))) == want


def test_times_before_1970(one):
    ts = ntz("1969-12-31 23:59:59.25")
    assert value(one, dates.micros(ts)) == -750_000
    assert value(one, dates.truncated(ts, 1_000_000)) == -1_000_000
    assert value(one, dates.rounded(ts, 1_000_000)) == -1_000_000
    assert value(one, dates.get(ts, "epoch")) == -1


def test_json(one):
    doc = F.lit('{"a":[1,2.5,null],"t":true,"s":"x"}')
    kinds = {"$": "object", "$.a": "array", "$.a[0]": "integer", "$.a[1]": "real", "$.a[2]": "null", "$.t": "true", "$.s": "text", "$.none": None}
    assert {p: value(one, nested.json_type(doc, p)) for p in kinds} == kinds
    assert value(one, nested.json_valid(F.lit("{"))) is False
    assert value(one, nested.json_array_length(doc, "$.a")) == 3
    assert value(one, nested.json_array_length(doc, "$.s")) is None
    assert value(one, nested.json_array(F.lit(1), F.lit(None).cast("int"))) == "[1,null]"


def test_json_groups_keep_nulls(spark):
    df = spark.createDataFrame([("b", None), ("a", 1)], "k string, v int")
    assert tuple(df.agg(nested.json_group_array(F.col("v"), F.col("k")), nested.json_group_object(F.col("k"), F.col("v"))).first()) == ("[1,null]", '{"a":1,"b":null}')


def test_arrays(one):
    none, a = F.lit(None).cast("array<string>"), F.array(F.lit("x"), F.lit(None).cast("string"), F.lit("y"))
    assert value(one, nested.array_append(none, F.lit("z"))) == ["z"]
    assert value(one, nested.array_cat(a, none)) == ["x", None, "y"]
    assert value(one, nested.array_remove(a, F.lit(None).cast("string"))) == ["x", "y"]
    assert value(one, nested.array_set(a, 2, F.lit("w"))) == ["x", "w", "y"]
    assert value(one, nested.array_overlap(a, F.array(F.lit("q"), F.lit(None).cast("string")))) is False
    assert value(one, nested.array_to_string(a, ",")) == "x,y"
    assert value(one, nested.array_to_string(a, ",", "*")) == "x,*,y"
    assert value(one, nested.string_to_array(F.lit("a.b.NA"), ".", "NA")) == ["a", "b", None]
    assert value(one, nested.string_to_array(F.lit("abc"), None)) == ["a", "b", "c"]
    assert value(one, nested.string_to_array(F.lit(""), ",")) == []


def test_scalar_rules(one):
    assert value(one, S.substr(F.lit("hello"), 0, 2)) == "h"
    assert value(one, S.substr(F.lit("hello"), 4, -2)) == "el"
    assert value(one, S.soundex(F.lit(""))) == "?000"
    assert value(one, S.greatest(F.lit(1), F.lit(None).cast("int"))) is None
    assert value(one, S.replace_first(F.lit("a1b2"), "[0-9]", "#")) == "a#b2"


def test_constraints_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (None, 7), (None, 7), (9, 1)], "k int, v int")
    assert constraints.not_null(df, ["k", "v"]).count() == 3
    assert constraints.check(df, F.col("v") > 4).count() == 1
    assert [tuple(r) for r in constraints.unique(df, ["k"]).collect()] == [(1, 2)]
    assert [r["k"] for r in constraints.foreign_key(df, ["k"], df.filter("v = 5").select(F.col("k").alias("id")), ["id"]).collect()] == [9]


def test_change_sets_cancel_out(spark):
    table = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    delta = spark.createDataFrame([("a", -1), ("c", 1), ("c", -1), ("d", 2)], "x string, _weight int")
    assert sorted(r["x"] for r in incremental.apply(table, delta).collect()) == ["a", "b", "d", "d"]


def test_set_operations_run_left_to_right(spark):
    of = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    got = relational.left_to_right(of(1, 2), ("union", of(3)), ("intersect", of(2, 3)), ("except", of(3)))
    assert [r["x"] for r in got.collect()] == [2]
