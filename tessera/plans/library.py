"""Queries over the function library, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dates, nested, text
from tessera.functions import scalar as S
from tessera.operators import constraints, relational
from tessera.sources.tables import table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("SELECT c_custkey, upper(hex(c_name)) AS h, substr(c_name, 1, 0) || c_name AS back, chr(321) || chr(233) AS ch, 'integer' AS ti, 'real' AS tr, 'text' AS tt, printf('%05d|%s|%.2f|%x', c_custkey, c_mktsegment, CAST(c_nationkey AS DOUBLE), c_custkey) AS p FROM customer")
def text_blobs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    h = text.hex_text(c.c_name)
    return c.select("c_custkey", h.alias("h"), text.unhex(h).cast("string").alias("back"), text.char(F.lit(321), F.lit(233)).alias("ch"), text.type_name(c.c_custkey).alias("ti"), text.type_name(c.c_acctbal).alias("tr"), text.type_name(c.c_name).alias("tt"), text.printf("%05d|%s|%.2f|%x", c.c_custkey, c.c_mktsegment, c.c_nationkey, c.c_custkey).alias("p"))


@query("SELECT p_partkey, lower(hex(unhex(md5(p_name)))) AS m, lower(hex(unhex(sha256(p_name)))) AS s, to_base64(encode(p_name)) AS b, url_encode(p_type) AS u, p_name AS n FROM part")
def digest_encode(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.lower(F.hex(text.digest(p.p_name, "md5"))).alias("m"), F.lower(F.hex(text.digest(p.p_name, "sha256"))).alias("s"), text.encode(p.p_name, "base64").alias("b"), F.replace(text.encode(p.p_type, "url"), F.lit("+"), F.lit("%20")).alias("u"), text.decode(text.encode(p.p_name, "base64"), "base64").alias("n"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, '7' AS v FROM orders")
def uuid7_times(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.floor(dates.micros(F.col("o_orderdate")) / 1000)
    made = table(spark, sf, "orders").select("o_orderkey", text.uuid7(ms).alias("u"))
    return made.select("o_orderkey", text.uuid7_ms(F.col("u")).alias("ms"), F.substring("u", 15, 1).alias("v"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS a,"
    " strftime(date_trunc('month', o_orderdate + INTERVAL 10 DAY), '%Y-%m-%d') AS b,"
    " strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS c,"
    " strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS d,"
    " strftime(date_trunc('year', o_orderdate) - INTERVAL 90 MINUTE, '%H:%M:%S') AS e FROM orders"
)
def date_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    ts = o.o_orderdate.cast("timestamp_ntz")
    return o.select("o_orderkey", dates.datetime(ts, "+36 hours").alias("a"), dates.date(ts, "10 days", "start of month").alias("b"), dates.date(ts, "+1 month", "floor").alias("c"), dates.date(ts, "weekday 0").alias("d"), dates.time(ts, "start of year", "-01:30").alias("e"))


@query("SELECT event_id, year(ts) // 100 AS century, quarter(ts) AS q, isoyear(ts) AS iy, week(ts) AS w, isodow(ts) AS i, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 900000000 AS t, (epoch_us(ts) + 450000000) - (epoch_us(ts) + 450000000) % 900000000 AS r FROM events")
def time_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts, quarter_hour = e.ts.cast("timestamp_ntz"), 900_000_000
    return e.select("event_id", dates.get(ts, "century").alias("century"), dates.get(ts, "quarter").alias("q"), dates.get(ts, "isoyear").alias("iy"), dates.get(ts, "week").alias("w"), dates.get(ts, "isodow").alias("i"), dates.micros(ts).alias("us"), dates.truncated(ts, quarter_hour).alias("t"), dates.rounded(ts, quarter_hour).alias("r"))


@query("SELECT event_id, json_valid(props) AS v, 'object' AS o, 'integer' AS k, CAST(NULL AS VARCHAR) AS nothing, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"none\":null}' AS made FROM events WHERE props IS NOT NULL")
def json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("props is not null")
    p = e.props
    return e.select("event_id", nested.json_valid(p).alias("v"), nested.json_type(p).alias("o"), nested.json_type(p, "$.k").alias("k"), nested.json_type(p, "$.missing").alias("nothing"), nested.json_object(id=e.event_id, kind=e.event_type, none=F.lit(None).cast("string")).alias("made"))


@query("SELECT n_regionkey, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o, count(*) AS n FROM nation GROUP BY n_regionkey")
def json_groups(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(nested.json_group_array(F.col("n_nationkey"), F.col("n_nationkey")).alias("a"), nested.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("o"))
    return n.withColumn("n", nested.json_array_length(F.col("a")))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n, array_to_string(string_split(p_type, ' '), '-') AS j, list_append(string_split(p_type, ' '), 'z') AS a, list_prepend('z', string_split(p_type, ' ')) AS p, list_filter(string_split(p_type, ' '), lambda x: x <> string_split(p_type, ' ')[1]) AS r, list_has_any(string_split(p_name, ' '), string_split(p_type, ' ')) AS o FROM part")
def array_edits(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    names, types = nested.string_to_array(p.p_name, " "), nested.string_to_array(p.p_type, " ")
    return p.select("p_partkey", nested.array_length(names).cast("long").alias("n"), nested.array_to_string(types, "-").alias("j"), nested.array_append(types, F.lit("z")).alias("a"), nested.array_prepend(types, F.lit("z")).alias("p"), nested.array_remove(types, F.get(types, F.lit(0))).alias("r"), nested.array_overlap(names, types).alias("o"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits, len(list_filter(embedding, lambda x: x <> 0)) AS filled, true AS close, list_concat(embedding[1:2], embedding[3:4]) AS part FROM embeddings")
def vec_codes(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").withColumn("q", nested.vector_8bit(F.col("embedding")))
    e = F.col("embedding")
    far = F.array_max(F.zip_with(e, nested.vector_from_8bit(F.col("q")), lambda a, b: F.abs(a - b)))
    return v.select("vec_id", nested.vector_1bit(e).alias("bits"), F.size(nested.vector_sparse(e)["at"]).cast("long").alias("filled"), (far <= F.col("q.step") * 0.51).alias("close"), nested.vector_concat(S.vector_slice(e, 0, 2), S.vector_slice(e, 2, 4)).alias("part"))


@query("SELECT 'null' AS broken, count(*) AS n FROM orders WHERE o_custkey IS NULL UNION ALL SELECT 'check', count(*) FROM orders WHERE NOT o_totalprice > 50000 UNION ALL SELECT 'unique', count(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1) t UNION ALL SELECT 'foreign', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    parents = table(spark, sf, "customer").filter("c_nationkey <> 3")
    found = {
        "null": constraints.not_null(o, ["o_custkey"]),
        "check": constraints.check(o, o.o_totalprice > 50000),
        "unique": constraints.unique(o, ["o_custkey"]),
        "foreign": constraints.foreign_key(o, ["o_custkey"], parents, ["c_custkey"]),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("broken"), "n") for k, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("SELECT DISTINCT k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) a WHERE k IN (SELECT s_nationkey FROM supplier) AND k NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def setops_chain(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, c: table(spark, sf, name).select(F.col(c).cast("long").alias("k"))
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("k"))
    return relational.left_to_right(one("nation", "n_nationkey"), ("union", one("region", "r_regionkey").select((F.col("k") + 100).alias("k"))), ("intersect", one("supplier", "s_nationkey")), ("except", rich))


@query("SELECT n_nationkey, string_agg(n_name, '.') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, sum(n_nationkey) FILTER (WHERE n_nationkey % 2 = 0) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS even FROM nation")
def win_moving_concat(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.array_join(F.collect_list("n_name").over(w.rowsBetween(-1, 1)), ".").alias("near"), F.sum(F.when(n.n_nationkey % 2 == 0, n.n_nationkey)).over(w).cast("long").alias("even"))


@query("SELECT o_orderkey, lag(o_totalprice, CAST(o_orderkey % 3 AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders")
def win_lag_by_column(spark: SparkSession, sf: str) -> DataFrame:
    """lag() by a column: the row's number less the offset, joined back to the numbers."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", number.alias("rn"))
    asked = o.select("o_orderkey", "o_custkey", (F.col("rn") - F.col("o_orderkey") % 3).cast("int").alias("rn"))
    return asked.join(o.select("o_custkey", "rn", F.col("o_totalprice").alias("p")), ["o_custkey", "rn"], "left").select("o_orderkey", "p")


@query(
    "SELECT o_orderkey, strftime(make_timestamp(year(o_orderdate), month(o_orderdate), 1, 6, 30, 0), '%Y-%m-%d %H:%M:%S') AS made,"
    " epoch_us(o_orderdate) + 5400000000 AS later, strftime(o_orderdate + INTERVAL 14 MONTH, '%Y-%m-%d') AS months,"
    " CASE WHEN o_orderdate < TIMESTAMP '1995-06-17 00:00:00' THEN -1 WHEN o_orderdate > TIMESTAMP '1995-06-17 00:00:00' THEN 1 ELSE 0 END AS side,"
    " strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17 00:00:00') AS age FROM orders"
)
def time_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    ts = o.o_orderdate.cast("timestamp_ntz")
    day = dates.made(1995, 6, 17)
    made = dates.made(F.year(ts), F.month(ts), 1, 6, 30)
    return o.select(
        "o_orderkey", dates.datetime(made).alias("made"), dates.micros(dates.added(ts, 90 * dates.MINUTE)).alias("later"),
        dates.date(dates.added_date(ts, 1, 2), "floor").alias("months"), dates.compared(ts, day).alias("side"), dates.iso(ts).alias("iso"), dates.between(ts, day).alias("age"),
    )


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) AS us FROM events")
def time_from_unix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    us = dates.micros(e.ts.cast("timestamp_ntz"))
    back = lambda each, unit: dates.micros(dates.from_unix(F.floor(us / each), unit))
    return e.select("event_id", back(1_000_000, "s").alias("s"), back(1000, "ms").alias("ms"), dates.micros(dates.from_unix(us, "us")).alias("us"))


@query(
    "SELECT p_partkey, len(list_filter(['BRASS', 'TIN'], lambda x: x = split_part(p_type, ' ', 3))) > 0 AS one_of, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS inv, CAST(p_size AS BIGINT) << 3 AS l, p_size >> 2 AS r,"
    " CASE WHEN regexp_matches(p_type, '(?i)promo') THEN 1 ELSE 0 END AS m, lcm(p_size, 12) AS c, CAST(round(degrees(radians(p_size))) AS INTEGER) AS d FROM part"
)
def bits_and_any(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size = p.p_size
    third = F.get(nested.string_to_array(p.p_type, " "), F.lit(2))
    return p.select(
        "p_partkey", F.coalesce(F.array_contains(F.array(F.lit("BRASS"), F.lit("TIN")), third), F.lit(False)).alias("one_of"), size.bitwiseAND(12).alias("a"), size.bitwiseOR(3).alias("o"), size.bitwiseXOR(5).alias("x"), F.bitwise_not(size).alias("inv"),
        S.shift_left(size.cast("long"), 3).alias("l"), F.shiftright(size, 2).alias("r"), F.when(p.p_type.rlike("(?i)promo"), 1).otherwise(0).alias("m"), S.lcm(size, F.lit(12)).alias("c"), F.rint(F.degrees(F.radians(size))).cast("int").alias("d"),
    )


@query("SELECT event_id, k.key AS key, k.value::VARCHAR AS value, k.type AS kind FROM events, json_each(props) k WHERE props IS NOT NULL")
def json_each(spark: SparkSession, sf: str) -> DataFrame:
    """The members of each row's top object, by Spark's VARIANT and without Python."""
    e = table(spark, sf, "events").filter("props is not null").select("event_id", F.parse_json("props").alias("v"))
    e.createOrReplaceTempView("_event_variants")
    names = {"BIGINT": "UBIGINT", "STRING": "VARCHAR", "DOUBLE": "DOUBLE", "BOOLEAN": "BOOLEAN"}
    out = spark.sql("SELECT event_id, key, CAST(value AS STRING) AS value, schema_of_variant(value) AS kind FROM _event_variants, LATERAL variant_explode(v)")
    return out.replace(names, subset=["kind"])
