"""Queries as SQL: name to the Spark text, with DuckDB's text where the two differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import TABLES, register

#: name -> Spark SQL, or (Spark SQL, DuckDB SQL)
SQL: dict[str, str | tuple[str, str]] = {
    # scans, projection, predicates
    "scan_filter_project": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "constant_row": "SELECT 1 AS one, 'x' AS letter",
    "values_rows": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "point_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7",
    "range_seek": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 500",
    "in_seek": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 9, 100, 100000000)",
    "multi_index_or": "SELECT p_partkey FROM part WHERE p_size = 10 OR p_brand = 'Brand#11' OR (p_size > 40 AND p_retailprice < 1000)",
    "subquery_scan": "SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 1000) t GROUP BY s",
    "predicates_null_safe": "SELECT a, b, a = b AS eq, a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS other, (a > b) IS TRUE AS gt, (a > b) IS FALSE AS not_gt FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL), (3, NULL)) AS t(a, b)",
    "three_valued_logic": "SELECT a, b, a AND b AS both, a OR b AS one, NOT a AS no FROM (VALUES (true, false), (true, NULL), (false, NULL), (NULL, NULL), (false, true)) AS t(a, b)",
    "between_forms": "SELECT count(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 200000) AS inside, count(*) FILTER (WHERE o_totalprice NOT BETWEEN 1000 AND 200000) AS outside FROM orders",
    "in_not_in_null": "SELECT x, x IN (1, NULL) AS i, x NOT IN (1, NULL) AS n FROM (VALUES (1), (2), (NULL)) AS t(x)",
    "row_value_in": "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))",
    "exists_forms": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "scalar_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "case_forms": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS searched, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS simple FROM part",
    "collate_nocase": ("SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15",
    "topk_nulls_last": "SELECT x FROM (VALUES (3), (NULL), (1), (2)) AS t(x) ORDER BY x DESC NULLS LAST LIMIT 3",
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o RIGHT JOIN customer ON c_custkey = o_custkey",
    "join_full": "SELECT a.k AS a, b.k AS b FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_natural": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "join_using": "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)",
    "join_self": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey",
    "join_multiway": "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name",
    "join_correlated": "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = c.c_custkey)",
    # aggregates
    "agg_basic": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, round(avg(l_discount), 6) AS d, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag",
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, coalesce(sum(CAST(o_totalprice AS DOUBLE)), 0.0) AS total FROM orders WHERE o_orderkey < 0",
    "agg_group_by_expression": "SELECT o_totalprice > 150000 AS big, length(o_orderpriority) AS w, count(*) AS n FROM orders GROUP BY o_totalprice > 150000, length(o_orderpriority)",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_extendedprice) FILTER (WHERE l_tax = 0), 2) AS untaxed FROM lineitem GROUP BY l_linestatus",
    "agg_bare_max": ("SELECT o_custkey, max(o_totalprice) AS top, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS top, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey"),
    "agg_group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_mode": ("SELECT c_mktsegment, mode() WITHIN GROUP (ORDER BY c_nationkey) AS m FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, min(c_nationkey) AS m FROM (SELECT c_mktsegment, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1, 2) t WHERE r = 1 GROUP BY c_mktsegment"),
    "agg_percentile_cont": ("SELECT l_returnflag, round(percentile_cont(0.3) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.3), 4) AS p FROM lineitem GROUP BY l_returnflag"),
    "agg_percentile_disc": ("SELECT l_returnflag, percentile_disc(0.7) WITHIN GROUP (ORDER BY l_quantity) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, 0.7) AS p FROM lineitem GROUP BY l_returnflag"),
    "agg_median": "SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY event_type",
    "agg_stddev": "SELECT event_type, round(stddev_samp(value), 6) AS s FROM events GROUP BY event_type",
    "agg_rollup_extra": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    # windows
    "win_rank_family": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 6) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 6) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS t FROM orders",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS b, lead(o_totalprice, 2, 0.0) OVER w AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part",
    "win_default_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part",
    "win_filter": ("SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", "SELECT o_orderkey, CAST(sum(1) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders"),
    "win_over_group": "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey",
    "win_distinct": "SELECT DISTINCT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    # set operations and CTEs
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect_rows": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_rows": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "setops_left_to_right": "SELECT k FROM (SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) a INTERSECT SELECT s_nationkey FROM supplier) b",
    "cte_multi": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), n AS (SELECT o_custkey, count(*) AS c FROM big GROUP BY o_custkey) SELECT n.o_custkey, n.c, b.o_orderkey FROM n JOIN big b ON n.o_custkey = b.o_custkey WHERE n.c > 3",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "values_series": ("SELECT explode(sequence(5, 50, 5)) AS x", "SELECT CAST(x AS INTEGER) AS x FROM generate_series(5, 50, 5) AS t(x)"),
    # functions
    "str_funcs": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, replace(c_name, 'Customer', 'C') AS r, trim('  x ') AS t, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp, reverse(c_mktsegment) AS v, repeat('ab', 3) AS re, substr(c_name, 1, 4) AS s, instr(c_name, '#') AS i, ascii(c_mktsegment) AS a FROM customer",
    "conditional_funcs": "SELECT x, coalesce(x, y) AS c, nullif(x, y) AS n, ifnull(x, 0) AS i FROM (VALUES (1, 2), (NULL, 5), (4, 4)) AS t(x, y)",
    "math_funcs": "SELECT c_custkey, round(abs(c_acctbal), 2) AS a, round(sqrt(abs(c_acctbal)), 6) AS s, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_acctbal / 100000), 6) AS e, round(sin(c_acctbal), 6) AS si, round(power(c_acctbal / 1000, 2), 4) AS p, round(degrees(1.0), 6) AS d FROM customer",
    "date_funcs": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, dayofweek(o_orderdate) - 1 AS w, dayofyear(o_orderdate) AS j, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS som FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd, CAST(dayofweek(o_orderdate) AS INTEGER) AS w, CAST(dayofyear(o_orderdate) AS INTEGER) AS j, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS som FROM orders"),
    "time_trunc": ("SELECT date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm:ss') AS h, count(*) AS n FROM events GROUP BY 1", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, count(*) AS n FROM events GROUP BY 1"),
    "unix_time": ("SELECT event_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS s FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"),
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_group": ("SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"),
    "crypto_digests": ("SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer"),
    "fuzzy_leven": "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "regexp_forms": ("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_like(url, '[0-9]+') AS digits FROM pages", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(url, '[0-9]+') AS digits FROM pages"),
    "math_more": "SELECT p_partkey, CAST(sign(p_size - 25) AS INTEGER) AS sg, round(acos(p_size / 1e2), 9) AS ac, round(asin(p_size / 1e2), 9) AS asi, round(atan(p_size / 1e1), 9) AS ata, round(atan2(p_size, 10), 9) AS at2, round(cos(p_size), 9) AS co, round(tan(p_size / 1e2), 9) AS ta, round(cosh(p_size / 1e2), 9) AS coh, round(sinh(p_size / 1e2), 9) AS sih, round(tanh(p_size / 1e2), 9) AS tah, round(acosh(1 + p_size / 1e2), 9) AS ach, round(asinh(p_size / 1e2), 9) AS ash, round(atanh(p_size / 1e2), 9) AS ath, round(pi(), 9) AS pi, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(radians(p_size), 9) AS ra, p_size % 7 AS md FROM part",
    "math_log_trunc": ("SELECT p_partkey, round(log(3.0D, CAST(p_size AS DOUBLE)), 9) AS l3, CAST(p_retailprice AS BIGINT) AS tr, mod(p_size, 6) AS md, try_divide(p_retailprice, CAST(p_size % 3 AS DOUBLE)) AS q FROM part", "SELECT p_partkey, round(log(3.0, CAST(p_size AS DOUBLE)), 9) AS l3, CAST(trunc(p_retailprice) AS BIGINT) AS tr, mod(p_size, 6) AS md, p_retailprice / nullif(CAST(p_size % 3 AS DOUBLE), 0) AS q FROM part"),
    "scalar_more": ("SELECT c_custkey, octet_length(concat(c_name, 'é')) AS o, concat_ws('-', c_name, NULL, c_mktsegment) AS cw, if(c_acctbal > 0, 'pos', 'neg') AS i, ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt FROM customer", "SELECT c_custkey, CAST(octet_length(encode(c_name || 'é')) AS INTEGER) AS o, concat_ws('-', c_name, NULL, c_mktsegment) AS cw, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS i, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt FROM customer"),
    "like_escape": "SELECT v, v LIKE '10!%%' ESCAPE '!' AS l, v NOT LIKE '1!_%' ESCAPE '!' AS n FROM (VALUES ('10%x'), ('100x'), ('1_0'), (NULL)) AS t(v)",
    "cast_text": ("SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(concat('0', o_orderkey) AS BIGINT) AS b, try_cast(o_orderpriority AS INT) AS bad, CAST(o_orderkey AS DOUBLE) / 4 AS r FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST('0' || o_orderkey AS BIGINT) AS b, TRY_CAST(o_orderpriority AS INTEGER) AS bad, CAST(o_orderkey AS DOUBLE) / 4 AS r FROM orders"),
    "table_statement": ("TABLE region", "SELECT * FROM region"),
    "limit_all": ("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT ALL", "SELECT n_nationkey, n_name FROM nation"),
    "compound_order_limit": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k DESC LIMIT 7 OFFSET 2",
    "win_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS r FROM customer c",
    "agg_percentile": ("SELECT event_type, round(percentile(value, 0.25), 9) AS p25, round(percentile(value, 0.9), 9) AS p90 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY event_type"),
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
    # TPC-H on the columns at hand
    "tpch_q1": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1996-03-15 00:00:00' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 2 GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q7": "SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier, lineitem, orders, customer, nation a, nation b WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = a.n_nationkey AND c_nationkey = b.n_nationkey AND a.n_nationkey < 5 AND b.n_nationkey < 5 AND a.n_nationkey <> b.n_nationkey AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate <= TIMESTAMP '1996-12-31 00:00:00' GROUP BY a.n_name, b.n_name, year(l_shipdate)",
    "tpch_q8": "SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN n2.n_nationkey = 3 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_regionkey = 1 AND s_nationkey = n2.n_nationkey AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00' AND p_type = 'ECONOMY' GROUP BY year(o_orderdate)",
    "tpch_q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-04-01 00:00:00' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-10-01 00:00:00'",
    "tpch_q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)",
    "tpch_q18": "SELECT c_name, o_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, o_orderkey",
}


def spark_text(name: str) -> str:
    text = SQL[name]
    return text if isinstance(text, str) else text[0]


def oracle_text(name: str) -> str:
    text = SQL[name]
    return text if isinstance(text, str) else text[1]


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spark_text(name)
        register(spark, sf_dir, [t for t in TABLES if t in text])
        return spark.sql(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))

    return run
