"""Joins, aggregates, windows, sorts, set operations and predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.registry import query, sql_query, table

# --- predicates and projections ------------------------------------------------------------------------------

sql_query("P1_comparisons", "SELECT l_orderkey, l_linenumber, l_partkey + 1 AS next_part, l_linenumber % 2 AS odd, round(l_quantity * 2 - 1, 2) AS q FROM lineitem WHERE (l_quantity >= 10 AND l_quantity < 20) OR l_linenumber <> 1 AND l_discount <= 0.02 AND l_tax > 0.01")
sql_query("P2_null_and_truth", "SELECT o_orderkey, -o_orderkey AS neg, (o_orderstatus = 'F') IS TRUE AS is_f, (o_totalprice > 100000) IS NOT TRUE AS cheap FROM orders WHERE o_orderpriority IS NOT NULL AND NOT (o_orderstatus = 'P') AND (o_totalprice < 0) IS FALSE")
sql_query("P3_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5, 7) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
sql_query("P4_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%s%' AND p_brand NOT LIKE 'Brand#1_'")
sql_query("P5_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 10 AND 20")
sql_query(
    "P6_case_cast_subquery",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS class, CAST(floor(c_acctbal) AS BIGINT) AS whole FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND lower(c_mktsegment) = 'building'",
)
sql_query("P8_three_valued", "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END > 50 AS big, (CASE WHEN event_type = 'click' THEN NULL ELSE value END > 50) IS NULL AS unknown FROM events WHERE NOT (CASE WHEN event_type = 'view' THEN NULL ELSE value END > 90) OR event_type = 'click'")
sql_query("P9_literal_coercion", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > 2.5 AND l_quantity > 40")
sql_query("P10_constant_predicates", "SELECT n_nationkey FROM nation WHERE 1 = 1 AND (n_regionkey = 2 OR 1 = 2)")
sql_query("P12_scalar_subquery", "SELECT n_name AS nation, n_nationkey * 10 AS k, (SELECT max(s_suppkey) FROM supplier) AS top_supplier FROM nation")


@query("P4_similar_to", "SELECT p_partkey, p_brand FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)[1-3]'")
def similar_to(spark, sf_dir):
    from tidemark.functions.compat import similar_to

    return table(spark, sf_dir, "part").filter(similar_to(F.col("p_brand"), "Brand#(1|2)[1-3]")).select("p_partkey", "p_brand")


@query("P7_filter_fragment", "SELECT event_id, event_type FROM events WHERE lower(event_type) = 'click' AND value > 50")
def filter_fragment(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("lower(event_type) = 'click' AND value > 50").select("event_id", "event_type")


@query("P13_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# --- joins -------------------------------------------------------------------------------------------------


@query("J1_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 150000")
def inner(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.filter("o_totalprice > 150000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("J2_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_outer(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("J3_right_outer", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN (SELECT * FROM customer WHERE c_nationkey < 5) c ON o_custkey = c_custkey")
def right_outer(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), table(spark, sf_dir, "customer").filter("c_nationkey < 5")
    return o.join(c, o.o_custkey == c.c_custkey, "right").select("o_orderkey", "c_custkey")


@query("J3_full_outer", "SELECT c_custkey, p_partkey FROM customer FULL JOIN part ON c_custkey * 2 = p_partkey")
def full_outer(spark, sf_dir):
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    return c.join(p, c.c_custkey * 2 == p.p_partkey, "full").select("c_custkey", "p_partkey")


@query("J4_left_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def left_semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("J5_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def left_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


sql_query("J4_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("J5_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
sql_query("J6_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("J7_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey + b.n_nationkey > 20")


@query("J8_sort_merge", "SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY l_orderkey")
def sort_merge(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return l.hint("merge").join(o, l.l_orderkey == o.o_orderkey).groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("J9_broadcast", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def broadcast(spark, sf_dir):
    """Nation and region have fixed sizes of 25 and 5 rows, so they are sent to all tasks."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("customers"))


sql_query("J10_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
sql_query(
    "J11_nested_correlated",
    "SELECT n_nationkey, coalesce(t.big, 0) AS big FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS big FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE total > 500000 GROUP BY c_nationkey) t ON c_nationkey = n_nationkey",
)
sql_query("J13_self_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
sql_query("J13_using", "SELECT n_regionkey, x.n_nationkey FROM nation x JOIN (SELECT n_regionkey, min(n_nationkey) AS first FROM nation GROUP BY n_regionkey) y USING (n_regionkey)")
sql_query("J13_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
sql_query(
    "J13_lateral",
    "SELECT r_name, t.last_nation FROM region, LATERAL (SELECT max(n_name) AS last_nation FROM nation WHERE n_regionkey = r_regionkey) t",
)

# --- aggregates --------------------------------------------------------------------------------------------


@query("A1_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem")
def global_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query(
    "A2_group_by",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
def group_by(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    figures = (F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))
    return table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(*figures)


@query("A3_min_max", "SELECT o_orderstatus, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first, max(o_orderpriority) AS last_priority FROM orders GROUP BY o_orderstatus")
def min_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderdate").alias("first"), F.max("o_orderpriority").alias("last_priority"))


@query("A4_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY l_returnflag")
def distinct_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("numbers"))


sql_query("A5_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("A6_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS gs FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("A6_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A6_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


sql_query("A7_filter_clause", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS spent FROM events GROUP BY user_id")
sql_query(
    "A8_collect",
    "SELECT n_regionkey, sort_array(collect_list(n_nationkey)) AS keys, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, list_sort(list(n_nationkey)) AS keys, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
sql_query(
    "A8_first_last",
    "SELECT user_id, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id",
    "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id",
)
sql_query(
    "A9_statistics",
    "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag",
)
sql_query("A11_bool_bit", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 400000) AS any_huge, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus")


@query("A10_approximate")
def approximate(spark, sf_dir):
    """Sketches; tests/test_queries.py compares them with exact figures within their errors."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"), F.percentile_approx("l_extendedprice", [0.1, 0.9], 1000).alias("deciles"))


sql_query("A12_two_level", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
sql_query("A14_coalesce_sum", "SELECT coalesce(round(sum(o_totalprice), 2), 0.0) AS total, count(*) AS n FROM orders WHERE o_orderkey < 0")

# --- windows -----------------------------------------------------------------------------------------------


@query("W1_row_number", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events")
def row_number(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("rn"))


sql_query(
    "W2_ranks",
    "SELECT event_id, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)",
)
sql_query(
    "W3_offsets",
    "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2, -1.0) OVER w AS next2, first_value(event_type) OVER w AS ft, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lt, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
sql_query(
    "W3_ignore_nulls",
    "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events",
    "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events",
)
sql_query("W4_aggregates", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, max(o_totalprice) OVER (PARTITION BY o_orderstatus) AS top FROM orders")
sql_query("W5_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS s FROM events")
sql_query("W6_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM orders")


@query("W7_groups_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
def groups_frame(spark, sf_dir):
    """GROUPS is a RANGE over the dense rank."""
    by = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("g", F.dense_rank().over(by.orderBy("event_type")))
    return e.select("event_id", F.count("*").over(by.orderBy("g").rangeBetween(-1, 0)).alias("n"))


@query("W8_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def qualify(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("o_custkey", "o_orderkey")


# --- sorts and limits --------------------------------------------------------------------------------------


@query("O1_order_by", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice ASC, o_orderkey")
def order_by(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_orderpriority"), F.asc("o_totalprice"), "o_orderkey")


@query("O2_limit_offset", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id").offset(100).limit(50)


@query(
    "O3_top_k_htap",
    "WITH activity AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey), per AS (SELECT c_custkey, c_nationkey, c_acctbal, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM customer LEFT JOIN activity ON c_custkey = o_custkey), grp AS (SELECT c_nationkey, avg(n) AS group_n FROM per GROUP BY c_nationkey) SELECT p.c_custkey, p.c_nationkey, p.n, round(p.mean, 2) AS mean, round(p.n - g.group_n, 4) AS above FROM per p JOIN grp g ON p.c_nationkey = g.c_nationkey ORDER BY p.n DESC, p.c_custkey LIMIT 20",
)
def top_k(spark, sf_dir):
    """An aggregate, a left join, an aggregate of its result by group, a join with that, and the first twenty."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    activity = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    per = c.join(activity, c.c_custkey == activity.o_custkey, "left").select("c_custkey", "c_nationkey", "c_acctbal", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
    mean = per.groupBy("c_nationkey").agg(F.avg("n").alias("group_n"))
    out = per.join(mean, "c_nationkey").select("c_custkey", "c_nationkey", "n", F.round("mean", 2).alias("mean"), F.round(F.col("n") - F.col("group_n"), 4).alias("above"))
    return out.orderBy(F.desc("n"), "c_custkey").limit(20)


@query("O4_null_order", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events) t ORDER BY v ASC NULLS LAST, event_id")
def null_order(spark, sf_dir):
    v = F.when(F.col("event_type") != "click", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).orderBy(F.asc_nulls_last("v"), "event_id")


@query("O6_cluster_sort", "SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem")
def cluster_sort(spark, sf_dir):
    """Rows sorted within partitions by clustering keys, as a snapshot is laid out."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return rows.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "l_shipdate")


# --- set operations and structure --------------------------------------------------------------------------

sql_query("U1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("U2_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")


@query("U3_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("U3_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("U3_intersect_all", "SELECT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1 INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2")
def intersect_all(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("k")).intersectAll(l.filter("l_linenumber = 2").select("l_suppkey"))


@query("U3_except_all", "SELECT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2")
def except_all(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("k")).exceptAll(l.filter("l_linenumber = 2").select("l_suppkey"))


sql_query("U4_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS customers FROM per JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql_query("U5_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql_query("U6_derived", "SELECT s.n_name, s.c FROM (SELECT n_name, count(*) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name) s WHERE s.c >= (SELECT avg(c2) FROM (SELECT count(*) AS c2 FROM supplier GROUP BY s_nationkey) t) AND EXISTS (SELECT 1 FROM customer)")
sql_query("S15_values", "SELECT k, v, 1 AS one FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
