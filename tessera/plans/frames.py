"""Queries built with the DataFrame operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import python as P
from tessera.functions import scalar as S
from tessera.operators import aggregates, fulltext, incremental, relational, windows
from tessera.sources.tables import series, stored_query, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("SELECT p_partkey, p_type ILIKE 'promo%' AS l, regexp_matches(p_brand, '^Brand#[1-3].$') AS g, regexp_matches(p_name, '[aeiou]{2}') AS r FROM part")
def like_glob_regexp(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.like(p.p_type, "promo%").alias("l"), S.glob(p.p_brand, "Brand#[1-3]?").alias("g"), p.p_name.rlike("[aeiou]{2}").alias("r"))


@query("SELECT * FROM (VALUES ('12abc', CAST(12 AS BIGINT)), ('abc', 0), ('  -7.9', -7), ('', 0)) t(x, i)")
def cast_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("12abc",), ("abc",), ("  -7.9",), ("",)], "x string").select("x", S.cast_integer(F.col("x")).alias("i"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey // (o_custkey % 7) END AS d, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey % (o_custkey % 7) END AS m, CAST(o_orderkey + o_custkey AS DOUBLE) AS s FROM orders")
def arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    by = o.o_custkey % 7
    return o.select("o_orderkey", S.divide_integer(o.o_orderkey, by).alias("d"), S.remainder(o.o_orderkey, by).alias("m"), S.add(o.o_orderkey, o.o_custkey).alias("s"))


@query("SELECT p_partkey, greatest(p_size, 25) AS hi, least(p_size, 25) AS lo, concat(p_brand, '-', p_type) AS c, substr(p_name, -3) AS tail, '''' || replace(p_name, '''', '''''') || '''' AS q FROM part")
def scalar_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.greatest(p.p_size, F.lit(25)).alias("hi"), S.least(p.p_size, F.lit(25)).alias("lo"), S.concat(p.p_brand, F.lit("-"), p.p_type).alias("c"), S.substr(p.p_name, -3).alias("tail"), S.quote(p.p_name).alias("q"))


@query("SELECT page_id, regexp_replace(url, '[0-9]+', 'N') AS u FROM pages")
def regexp_replace_first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.replace_first(F.col("url"), "[0-9]+", "N").alias("u"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS s, strftime(CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 1 MONTH + INTERVAL (day(o_orderdate) - 1) DAY AS DATE), '%Y-%m-%d') AS m FROM orders")
def strftime_month_roll(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.strftime("%d/%m/%Y %H:%M", o.o_orderdate).alias("s"), F.date_format(S.month_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd").alias("m"))


@query("SELECT k, CAST(x AS BIGINT) AS x FROM (VALUES ('up', 1, 9, 2), ('down', 9, 1, -4), ('zero', 1, 3, 0)) t(k, a, b, s), LATERAL (SELECT unnest(range(a, b + CASE WHEN s < 0 THEN -1 ELSE 1 END, CASE s WHEN 0 THEN 1 ELSE s END)) AS x)")
def generate_series(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([("up", 1, 9, 2), ("down", 9, 1, -4), ("zero", 1, 3, 0), ("none", 5, 1, 1)], "k string, a int, b int, s int")
    return df.select("k", F.explode(series(F.col("a"), F.col("b"), F.col("s"))).alias("x"))


@query("SELECT o_orderkey, CAST(sum(g) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM (SELECT *, CAST(o_orderkey % 10 AS BIGINT) AS g FROM orders) t")
def win_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("g", F.col("o_orderkey") % 10)
    return windows.groups_frame(o, ["o_custkey"], ["o_orderpriority"], 1, 1, {"n": lambda: F.sum("g")}).select("o_orderkey", "n")


def _exclude(kind: str):
    @query(f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE {kind}) AS BIGINT) AS s FROM orders" if kind == "CURRENT ROW" else None)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        o = table(spark, sf, "orders")
        return windows.excluding_sum(o, "o_orderkey", ["o_custkey"], ["o_orderpriority"], ["o_orderkey"], (-2, 1), kind.lower(), "s").select("o_orderkey", "s")

    name = f"win_exclude_{kind.lower().replace(' ', '_')}"
    QUERIES[name] = QUERIES.pop("run")
    if "run" in ORACLE:
        ORACLE[name] = ORACLE.pop("run")


for _kind in ("CURRENT ROW", "GROUP", "TIES"):
    _exclude(_kind)


@query("SELECT o_custkey, o_orderstatus, CAST(coalesce(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 END), 0) AS DOUBLE) AS t, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS c FROM orders GROUP BY o_custkey, o_orderstatus")
def agg_total_concat(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey", "o_orderstatus").agg(aggregates.total(F.when(F.col("o_orderkey") % 2 == 0, 1)).alias("t"), aggregates.group_concat(F.col("o_orderkey"), F.col("o_orderkey")).alias("c"))


@query("SELECT o_custkey, CAST(coalesce(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 END), 0) AS DOUBLE) AS t, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS c FROM orders GROUP BY o_custkey")
def agg_total_concat_customer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(aggregates.total(F.when(F.col("o_orderkey") % 2 == 0, 1)).alias("t"), aggregates.group_concat(F.col("o_orderkey"), F.col("o_orderkey")).alias("c"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN NULL ELSE 1 END) AS BIGINT) AS low FROM events GROUP BY event_type")
def agg_array_nulls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type").agg(aggregates.array_agg(F.when(~(F.col("value") > 50) | F.col("value").isNull(), 1)).alias("a"))
    return e.select("event_type", F.size("a").cast("bigint").alias("n"), F.size(F.filter("a", lambda x: x.isNotNull())).cast("bigint").alias("low"))


@query("WITH RECURSIVE t(a, b) AS (SELECT n_regionkey, n_nationkey FROM nation UNION SELECT t.a, n.n_nationkey FROM t JOIN nation n ON n.n_regionkey = t.b) SELECT a, b FROM t")
def cte_recursive_union(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("p"), F.col("n_nationkey").alias("c"))
    return relational.recursive_union(n.select(F.col("p").alias("a"), F.col("c").alias("b")), lambda t: t.join(n, t.b == n.p).select("a", F.col("c").alias("b")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders UNION ALL SELECT -o_orderkey - 1, 1.0 FROM orders WHERE o_orderkey % 5 = 0")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    fifth = o.filter("o_orderkey % 5 = 0")
    rows = fifth.select("o_orderkey", F.lit(1.0).alias("p")).union(fifth.select(-F.col("o_orderkey") - 1, F.lit(1.0)))
    return relational.upsert(o, rows, ["o_orderkey"], {"p": lambda old, new: old + new})


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT -1 - o_orderkey, o_custkey FROM orders WHERE o_orderkey < 50")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    few = o.filter("o_orderkey < 50")
    return relational.insert_or_ignore(o, few.union(few.select(-1 - F.col("o_orderkey"), "o_custkey")), ["o_orderkey"])


@query("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return relational.update_from(s, n, ["s_nationkey"], {"s_acctbal": F.lit(0.0)}).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 1000, false)")
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return relational.delete(c, c.c_acctbal < 1000).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1 WHEN c_custkey % 10 = 1 THEN 0 ELSE 1 END AS change FROM (SELECT c_custkey FROM customer WHERE c_custkey % 10 < 2 UNION ALL SELECT -c_custkey - 2 FROM customer WHERE c_custkey % 10 = 4) t")
def cdc_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    b = a.filter("c_custkey % 10 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    b = b.union(a.filter("c_custkey % 10 = 4").select(-F.col("c_custkey") - 2, "c_name", "c_acctbal"))
    return relational.changes(a, b, ["c_custkey"]).select("c_custkey", "change")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")
def ivm_agg_delta(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type")
    state = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
    gone = e.filter("event_id % 7 = 0").withColumn("_weight", F.lit(-1))
    return incremental.aggregate_delta(state, gone, ["event_type"], F.col("event_id"))


@query("SELECT k, c, o, CAST(w AS BIGINT) AS _weight FROM (SELECT c_custkey AS k, c_name AS c, o_orderkey AS o, 1 AS w FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 9 = 0 AND c_custkey % 2 = 1 UNION ALL SELECT c_custkey, c_name, o_orderkey, -1 FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 9 <> 0 AND c_custkey % 2 = 0) t")
def ivm_join_delta(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("c"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    d_left = c.filter("k % 2 = 0").withColumn("_weight", F.lit(-1))
    d_right = o.filter("o % 9 = 0").withColumn("_weight", F.lit(1))
    return incremental.join_delta(c, d_left, o.filter("o % 9 <> 0"), d_right, ["k"]).select("k", "c", "o", "_weight")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    first = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(first.limit(1)))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * q[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x)))), 5) AS c, round(sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - q[i]) * (CAST(embedding[i] AS DOUBLE) - q[i])))), 5) AS l2, round(-list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * q[i])), 5) AS dot FROM embeddings, q")
def vec_distances(spark: SparkSession, sf: str) -> DataFrame:
    v, e, q = _vectors(spark, sf), F.col("embedding"), F.col("q")
    return v.select("vec_id", F.round(S.distance_cos(e, q), 5).alias("c"), F.round(S.distance_l2(e, q), 5).alias("l2"), F.round(S.distance_dot(e, q), 5).alias("dot"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q ORDER BY list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - q[i]) * (CAST(embedding[i] AS DOUBLE) - q[i]))), vec_id LIMIT 10")
def vec_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).withColumn("d", S.distance_l2(F.col("embedding"), F.col("q")))
    return v.orderBy("d", "vec_id").limit(10).select("vec_id")


@query("SELECT vec_id, embedding[2:4] AS s, list_position(list_transform(embedding, lambda x: x > 0), true) AS first_positive, len(embedding) AS n FROM embeddings")
def array_funcs(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    e = v.embedding
    return v.select("vec_id", S.array_slice(e, F.lit(2), F.lit(4)).alias("s"), S.array_position(F.transform(e, lambda x: x > 0), F.lit(True)).cast("int").alias("first_positive"), F.size(e).cast("bigint").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])and([^\\p{L}\\p{N}]|$)')")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.filter(fulltext.match(F.col("text"), every=["the"], none=["and"])).select("doc_id")


@query("""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS r, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (r - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (r - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM c, s WHERE a + b > 0
""")
def fts_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.bm25(table(spark, sf, "documents"), "doc_id", "text", ["the", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query()
def fuzzy_distances(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    x, y = F.col("a"), F.col("b")
    return a.join(b, "n_regionkey").select("a", "b", P.osa_distance(x, y).alias("osa"), P.damerau_levenshtein(x, y).alias("dl"), F.round(P.jaro_winkler_similarity(x, y), 6).alias("jw"), P.hamming(x, y).alias("h"))


@query("SELECT c_custkey, gcd(c_custkey, 36) AS g FROM customer")
def math_gcd(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", S.gcd(F.col("c_custkey"), F.lit(36)).alias("g"))


@query()
def ip_functions(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([("192.168.1.5/24", "192.168.1.77"), ("10.0.0.0/8", "11.0.0.1"), ("2001:db8::/32", "2001:db8::1"), ("bad", "1.1.1.1")], "net string, ip string")
    return df.select("net", P.ip_family(F.col("net")).alias("family"), P.ip_host(F.col("net")).alias("host"), P.ip_masklen(F.col("net")).alias("masklen"), P.ip_network(F.col("net")).alias("network"), P.ip_contains(F.col("net"), F.col("ip")).alias("has"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":0}' AS edited FROM events")
def json_edit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("props is not null")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), P.json_edit_udf("$.k", 0, "set")(F.col("props")).alias("edited"))


@query()
def json_tree(spark: SparkSession, sf: str) -> DataFrame:
    return P.JsonTree(F.lit('{"a":[1,2.5,{"b":null}],"c":"x"}'))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def bound_parameters(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :low", args={"status": "F", "low": 150000})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000")
def positional_parameters(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > ?", args=[150000])


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def create_view(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW solvent AS SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0")
    return spark.sql("SELECT c_nationkey, count(*) AS n FROM solvent GROUP BY c_nationkey")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def create_table_as(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return stored_query(spark, "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")


@query("SELECT o_orderkey, o_totalprice * 2 AS p FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey - 1, o_totalprice * 2 FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 7 = 1")
def ivm_filter_project(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    view = lambda df: incremental.project_delta(incremental.filter_delta(df, F.col("o_totalprice") > 100000), F.col("o_orderkey"), (F.col("o_totalprice") * 2).alias("p"))
    gone = o.filter("o_orderkey % 7 = 0").withColumn(incremental.WEIGHT, F.lit(-1))
    new = o.filter("o_orderkey % 7 = 1").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_totalprice").withColumn(incremental.WEIGHT, F.lit(1))
    now = view(o.withColumn(incremental.WEIGHT, F.lit(1))).drop(incremental.WEIGHT)
    return incremental.apply(now, view(gone.unionByName(new)))


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s_nationkey FROM supplier) t")
def ivm_union_all(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    gone = c.filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k"), F.lit(-1).alias(incremental.WEIGHT))
    new = s.filter("k < 5").withColumn(incremental.WEIGHT, F.lit(1))
    now = c.select(F.col("c_nationkey").alias("k")).unionByName(s.filter("k >= 5"))
    return incremental.apply(now, incremental.union_delta(gone, new))
