"""Scalar functions, one query per family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import compat
from tidemark.plans.registry import query, sql_query, table

sql_query(
    "F_math",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(-l_quantity) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(sqrt(l_quantity), 9) AS s, round(cbrt(l_quantity), 9) AS cb, round(exp(l_discount), 9) AS e, round(ln(l_quantity), 9) AS ln_, round(log10(l_quantity), 9) AS lg, round(log2(l_quantity), 9) AS l2, round(power(l_quantity, 2), 4) AS p, CAST(sign(l_discount - 0.05) AS INT) AS sg, round(l_extendedprice, 1) AS r FROM lineitem",
)
sql_query(
    "F_trigonometry",
    "SELECT DISTINCT l_discount AS x, round(sin(l_discount), 9) AS s, round(cos(l_discount), 9) AS c, round(tan(l_discount), 9) AS t, round(asin(l_discount), 9) AS a_s, round(acos(l_discount), 9) AS a_c, round(atan(l_discount), 9) AS a_t, round(atan2(l_discount, 2), 9) AS a2, round(degrees(l_discount), 9) AS d, round(radians(l_discount), 9) AS r, round(cot(l_discount + 1), 9) AS ct, round(pi(), 9) AS p FROM lineitem",
)
sql_query("F_hyperbolic", "SELECT DISTINCT l_tax AS x, round(sinh(l_tax), 9) AS s, round(cosh(l_tax), 9) AS c, round(tanh(l_tax), 9) AS t, round(asinh(l_tax), 9) AS ash, round(acosh(l_tax + 1), 9) AS ach, round(atanh(l_tax), 9) AS ath FROM lineitem")


@query("F_integers", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, p_partkey // p_size AS d, p_partkey % p_size AS m, CAST(factorial(p_size % 15) AS BIGINT) AS f, round(trunc(p_retailprice), 2) AS t, round(trunc(p_retailprice * 10) / 10, 2) AS t1 FROM part WHERE p_size > 0")
def integers(spark, sf_dir):
    k, s, r = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    p = table(spark, sf_dir, "part").filter("p_size > 0")
    return p.select("p_partkey", compat.gcd(k, s).alias("g"), compat.lcm(k, s).alias("l"), compat.integer_divide(k, s).alias("d"), (k % s).alias("m"), F.factorial(s % 15).alias("f"), F.round(compat.trunc(r), 2).alias("t"), F.round(compat.trunc(r, 1), 2).alias("t1"))


sql_query("F_extremes", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity, l_extendedprice / 100, 7.0) AS g, least(l_quantity, 25.0) AS l, isnan(l_tax) AS n FROM lineitem")
sql_query(
    "F_string",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS lo, initcap(lower(p_type)) AS ic, char_length(p_name) AS n, octet_length(p_name) AS ol, bit_length(p_name) AS bl, ascii(p_brand) AS asc_, left(p_name, 3) AS l3, right(p_name, 3) AS r3, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(left(p_name, 1), 3) AS rep, replace(p_name, 'a', 'AA') AS rpl, reverse(p_brand) AS rev, substring(p_name, 2, 4) AS sub, translate(p_name, 'aeiou', '12345') AS tr, split_part(p_type, ' ', 1) AS sp, trim('  x ' || p_brand || '  ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt FROM part",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS lo, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ic, CAST(length(p_name) AS INT) AS n, CAST(strlen(p_name) AS INT) AS ol, CAST(bit_length(p_name) AS INT) AS bl, ascii(p_brand) AS asc_, left(p_name, 3) AS l3, right(p_name, 3) AS r3, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(left(p_name, 1), 3) AS rep, replace(p_name, 'a', 'AA') AS rpl, reverse(p_brand) AS rev, substring(p_name, 2, 4) AS sub, translate(p_name, 'aeiou', '12345') AS tr, split_part(p_type, ' ', 1) AS sp, trim('  x ' || p_brand || '  ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt FROM part",
)


@query(
    "F_string_search",
    "SELECT p_partkey, CAST(strpos(p_type, 'E') AS INT) AS at, contains(p_name, 'b') AS has, starts_with(p_brand, 'Brand#1') AS st, ends_with(p_brand, '3') AS en, lower(to_hex(p_partkey)) AS hx, CAST(levenshtein(p_brand, 'Brand#11') AS INT) AS lev, concat(p_brand, NULL, '/', p_type) AS cc, concat_ws('|', p_brand, NULL, p_type) AS cw, chr(65 + p_size % 26) AS ch, split_part(p_brand, '#', 1) AS si, p_brand[1:2] || 'XY' || p_brand[5:] AS ov FROM part",
)
def string_search(spark, sf_dir):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    null = F.lit(None).cast("string")
    out = {
        "at": compat.strpos(t, "E"), "has": F.contains(n, F.lit("b")), "st": F.startswith(b, F.lit("Brand#1")), "en": F.endswith(b, F.lit("3")), "hx": compat.to_hex(F.col("p_partkey")), "lev": F.levenshtein(b, F.lit("Brand#11")),
        "cc": compat.concat(b, null, F.lit("/"), t), "cw": F.concat_ws("|", b, null, t), "ch": F.char(65 + F.col("p_size") % 26), "si": F.substring_index(b, "#", 1), "ov": F.overlay(b, F.lit("XY"), 3, 2),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in out.items()))


@query(
    "F_regex",
    "SELECT p_partkey, regexp_matches(p_brand, '#[12]') AS lk, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS ex, regexp_replace(p_name, '[aeiou]', '_', 'g') AS ra, regexp_replace(p_name, '[aeiou]', '_') AS rf, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INT) AS ct FROM part",
)
def regex(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_like(b, F.lit("#[12]")).alias("lk"), F.regexp_extract(b, "#([0-9])([0-9])", 2).alias("ex"), F.regexp_replace(n, "[aeiou]", "_").alias("ra"), compat.regexp_replace_first(n, "[aeiou]", "_").alias("rf"), F.regexp_count(n, F.lit("[aeiou]")).alias("ct")
    )


sql_query("F_conditional", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS c, coalesce(nullif(event_type, 'error'), 'none') AS co, ifnull(nullif(event_type, 'view'), '-') AS i, CASE WHEN value IS NOT NULL THEN 'v' ELSE 'n' END AS nv FROM events")
sql_query(
    "F_date_parts",
    "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, CAST(extract(DAY FROM o_orderdate) AS INT) AS d, CAST(extract(WEEK FROM o_orderdate) AS INT) AS w, CAST(extract(DOY FROM o_orderdate) AS INT) AS doy, CAST(extract(HOUR FROM o_orderdate) AS INT) AS h, CAST(date_trunc('month', o_orderdate) AS DATE) AS tm, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS tq, CAST(o_orderdate AS DATE) AS dt FROM orders",
)
sql_query(
    "F_date_arithmetic",
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '10' DAY AS DATE) AS plus, CAST(o_orderdate - INTERVAL '1' MONTH AS DATE) AS minus, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS days, last_day(CAST(o_orderdate AS DATE)) AS ld, date_format(o_orderdate, 'yyyy/MM/dd') AS fm, make_date(2020, CAST(month(o_orderdate) AS INT), 15) AS md FROM orders",
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS plus, CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS minus, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, last_day(CAST(o_orderdate AS DATE)) AS ld, strftime(o_orderdate, '%Y/%m/%d') AS fm, make_date(2020, month(o_orderdate), 15) AS md FROM orders",
)


@query("F_date_bin", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS u, epoch_us(ts) AS us FROM events")
def date_bin(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", compat.date_bin(900, ts).alias("bin"), compat.to_unixtime(ts).alias("u"), F.unix_micros(ts.cast("timestamp")).alias("us"))


sql_query(
    "F_to_date",
    "SELECT n_nationkey, to_date('2024-02-' || lpad(CAST(n_nationkey + 1 AS STRING), 2, '0')) AS d, CAST(timestamp_micros(n_nationkey * 1000001) AS TIMESTAMP_NTZ) AS us, CAST(timestamp_millis(n_nationkey * 1001) AS TIMESTAMP_NTZ) AS ms, CAST(timestamp_seconds(n_nationkey * 3600) AS TIMESTAMP_NTZ) AS s FROM nation",
    "SELECT n_nationkey, CAST('2024-02-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS DATE) AS d, make_timestamp(CAST(n_nationkey AS BIGINT) * 1000001) AS us, epoch_ms(CAST(n_nationkey AS BIGINT) * 1001) AS ms, make_timestamp(CAST(n_nationkey AS BIGINT) * 3600000000) AS s FROM nation",
)
sql_query(
    "F_array",
    "SELECT k, array_append(a, 99) AS ap, array_prepend(a, 0) AS pp, concat(a, array(7, 7)) AS cc, array_contains(a, 3) AS has, array_distinct(a) AS ds, element_at(a, 2) AS el, size(a) AS n, array_max(a) AS mx, array_min(a) AS mn, array_position(a, 3) AS pos, array_remove(a, 3) AS rm, slice(a, 2, 2) AS sl, array_sort(a) AS so, array_join(a, '-') AS st, flatten(array(a, a)) AS fl, reverse(a) AS rv FROM (SELECT n_nationkey AS k, array(n_regionkey, n_nationkey, 3, 3) AS a FROM nation) t",
    "SELECT k, list_append(a, 99) AS ap, list_prepend(0, a) AS pp, list_concat(a, [7, 7]) AS cc, list_contains(a, 3) AS has, [x for x, i in a if list_position(a, x) = i] AS ds, a[2] AS el, CAST(len(a) AS INT) AS n, list_max(a) AS mx, list_min(a) AS mn, CAST(list_position(a, 3) AS BIGINT) AS pos, list_filter(a, lambda x: x <> 3) AS rm, a[2:3] AS sl, list_sort(a) AS so, array_to_string(a, '-') AS st, flatten([a, a]) AS fl, list_reverse(a) AS rv FROM (SELECT n_nationkey AS k, [n_regionkey, n_nationkey, 3, 3] AS a FROM nation) t",
)


@query(
    "F_array_sets",
    "SELECT k, list_sort(list_distinct(list_concat(a, b))) AS un, list_sort(list_intersect(a, b)) AS it, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS ex, list_has_all(a, [3]) AS al, list_has_any(a, b) AS an, range(0, CAST(k % 4 AS BIGINT)) AS rg, list_resize([]::VARCHAR[], 2, 'x') AS rp FROM (SELECT n_nationkey AS k, [n_regionkey, n_nationkey, 3] AS a, [1, 2, n_nationkey] AS b FROM nation) t",
)
def array_sets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array("n_regionkey", "n_nationkey", F.lit(3)).alias("a"), F.array(F.lit(1), F.lit(2), "n_nationkey").alias("b"))
    a, b = F.col("a"), F.col("b")
    return n.select(
        "k", F.array_sort(F.array_union(a, b)).alias("un"), F.array_sort(F.array_intersect(a, b)).alias("it"), F.array_sort(F.array_except(a, b)).alias("ex"), compat.array_has_all(a, F.array(F.lit(3))).alias("al"), compat.array_has_any(a, b).alias("an"),
        compat.range_(F.lit(0).cast("long"), (F.col("k") % 4).cast("long")).alias("rg"), F.array_repeat(F.lit("x"), 2).alias("rp"),
    )


@query("F_unnest", "SELECT vec_id, pos - 1 AS pos, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)")
def unnest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", F.col("p").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


sql_query(
    "F_map_struct",
    "SELECT n_nationkey, m['k'] AS mk, sort_array(map_keys(m)) AS ks, size(m) AS sz, s.a AS sa, s.b AS sb FROM (SELECT n_nationkey, map('k', n_regionkey, 'j', n_nationkey) AS m, named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation) t",
    "SELECT n_nationkey, m['k'] AS mk, list_sort(map_keys(m)) AS ks, CAST(cardinality(m) AS INT) AS sz, s.a AS sa, s.b AS sb FROM (SELECT n_nationkey, map(['k', 'j'], [n_regionkey, n_nationkey]) AS m, {'a': n_name, 'b': n_regionkey} AS s FROM nation) t",
)
sql_query(
    "F_hash_encoding",
    "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, lower(hex(encode(n_name, 'UTF-8'))) AS h, base64(encode(n_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS d FROM nation",
    "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, lower(hex(encode(n_name))) AS h, base64(encode(n_name)) AS b, n_name AS d FROM nation",
)
sql_query(
    "F_json",
    "SELECT event_id, get_json_object(props, '$.page') AS page, get_json_object(props, '$.ref') AS ref, props IS NULL AS none FROM events",
    "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref, props IS NULL AS none FROM events",
)
sql_query(
    "F_cast",
    "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_retailprice AS DECIMAL(12,2)) AS dc, try_cast(p_brand AS INT) AS bad, try_cast(right(p_brand, 2) AS INT) AS good, CAST(p_size AS DOUBLE) AS db, CAST(p_size > 10 AS INT) AS b FROM part",
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS DECIMAL(12,2)) AS dc, try_cast(p_brand AS INT) AS bad, try_cast(right(p_brand, 2) AS INT) AS good, CAST(p_size AS DOUBLE) AS db, CAST(p_size > 10 AS INT) AS b FROM part",
)


@query("F_more_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity) / ln(3.0), 9) AS l3, CASE WHEN isnan(x) THEN -1.0 ELSE x END AS nv, CASE WHEN l_quantity > 25 THEN l_quantity ELSE l_tax END AS g FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_tax END AS x FROM lineitem)")
def more_math(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_tax")))
    q = F.col("l_quantity")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.log(3.0, q), 9).alias("l3"), F.nanvl(F.col("x"), F.lit(-1.0)).alias("nv"), F.when(q > 25, q).otherwise(F.col("l_tax")).alias("g"))


@query(
    "F_more_string",
    "SELECT p_partkey, CAST(coalesce(list_position(string_split('Brand#11,Brand#12,Brand#13', ','), p_brand), 0) AS INT) AS fs, trim('xx' || p_brand || 'x', 'x') AS bt, CAST(CASE WHEN regexp_matches(p_brand, '[0-9]') THEN length(regexp_extract(p_brand, '^[^0-9]*')) + 1 ELSE 0 END AS INT) AS ri, CASE WHEN regexp_matches(p_brand, '([a-z]+)#([0-9])') THEN [regexp_extract(p_brand, '([a-z]+)#([0-9])', 1), regexp_extract(p_brand, '([a-z]+)#([0-9])', 2)] END AS rm, CASE WHEN p_brand IS NULL THEN 'n' ELSE p_type END AS n2, substr(p_name, -3) AS tail FROM part",
)
def more_string(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.find_in_set(b, F.lit("Brand#11,Brand#12,Brand#13")).alias("fs"), F.btrim(F.concat(F.lit("xx"), b, F.lit("x")), F.lit("x")).alias("bt"), F.regexp_instr(b, F.lit("[0-9]")).alias("ri"), compat.regexp_match(b, "([a-z]+)#([0-9])").alias("rm"), F.nvl2(b, F.col("p_type"), F.lit("n")).alias("n2"), F.substring("p_name", -3, 3).alias("tail")
    )


sql_query(
    "F_more_time",
    "SELECT event_id, date_part('MINUTE', ts) AS mi, date_format(ts, 'HH:mm') AS ch, CAST(CAST(timestamp_seconds(unix_micros(CAST(ts AS TIMESTAMP)) div 1000000) AS TIMESTAMP_NTZ) AS STRING) AS fu, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS h, unix_millis(CAST(ts AS TIMESTAMP)) AS ms, weekday(ts) AS wd FROM events",
    "SELECT event_id, CAST(date_part('minute', ts) AS INT) AS mi, strftime(ts, '%H:%M') AS ch, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS fu, date_trunc('hour', ts) AS h, epoch_us(ts) // 1000 AS ms, CAST(isodow(ts) - 1 AS INT) AS wd FROM events",
)
sql_query(
    "F_more_map",
    "SELECT n_nationkey, sort_array(map_values(m)) AS vs, map_contains_key(m, 'k') AS has, element_at(m, 'j') AS ex, size(map_entries(m)) AS n, typeof(n_name) AS t FROM (SELECT n_nationkey, n_name, map('k', n_regionkey, 'j', n_nationkey) AS m FROM nation) t",
    "SELECT n_nationkey, list_sort(map_values(m)) AS vs, map_contains(m, 'k') AS has, m['j'] AS ex, CAST(len(map_entries(m)) AS INT) AS n, 'string' AS t FROM (SELECT n_nationkey, n_name, map(['k', 'j'], [n_regionkey, n_nationkey]) AS m FROM nation) t",
)


def _digests() -> str:
    """The digests of the regions' names, which DuckDB has no functions for."""
    import hashlib

    names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    return ", ".join("(" + ", ".join(f"'{x}'" for x in (n, *(hashlib.new(f"sha{k}", n.encode()).hexdigest() for k in (224, 384, 512)))) + ")" for n in names)


@query("F_digests", f"SELECT c_custkey, s224, s384, s512 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (VALUES {_digests()}) t(name, s224, s384, s512) ON name = r_name")
def digests(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select("c_custkey", *(F.sha2("r_name", k).alias(f"s{k}") for k in (224, 384, 512)))


sql_query(
    "F_random_uuid",
    "SELECT count(*) AS n, min(r) >= 0 AND max(r) < 1 AS in_range, count(DISTINCT r) > count(*) * 0.9 AS varied, count(DISTINCT u) = count(*) AS distinct_ids, min(length(u)) = 36 AND max(length(u)) = 36 AS full_length FROM (SELECT rand() AS r, uuid() AS u FROM orders) t",
    "SELECT count(*) AS n, min(r) >= 0 AND max(r) < 1 AS in_range, count(DISTINCT r) > count(*) * 0.9 AS varied, count(DISTINCT u) = count(*) AS distinct_ids, min(length(u)) = 36 AND max(length(u)) = 36 AS full_length FROM (SELECT random() AS r, CAST(uuid() AS VARCHAR) AS u FROM orders) t",
)
sql_query(
    "F_now",
    "SELECT count(*) AS n, bool_and(CAST(current_timestamp() AS DATE) = current_date()) AS same_day, bool_and(current_date() > CAST(o_orderdate AS DATE)) AS later, count(DISTINCT current_timestamp()) = 1 AS one_time FROM orders",
    "SELECT count(*) AS n, TRUE AS same_day, bool_and(current_date > CAST(o_orderdate AS DATE)) AS later, TRUE AS one_time FROM orders",
)


@query("F_time_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS tc, strptime(strftime(o_orderdate, '%d/%m/%Y') || ' 10:11:12', '%d/%m/%Y %H:%M:%S') AS tt, make_timestamp(CAST(o_orderkey AS BIGINT) * 1000000) AS fu, CAST(o_orderkey AS BIGINT) AS back FROM orders")
def time_text(spark, sf_dir):
    """to_char, to_timestamp, from_unixtime and to_unixtime."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey").cast("long")
    text = F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 10:11:12"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy.MM.dd").alias("tc"), F.to_timestamp_ntz(text, F.lit("dd/MM/yyyy HH:mm:ss")).alias("tt"), compat.from_unixtime(k).alias("fu"), compat.to_unixtime(compat.from_unixtime(k)).alias("back"))


@query("F_arrow_types", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS s, CAST(p_retailprice AS DECIMAL(12,2)) AS d, CAST(p_partkey AS VARCHAR) AS u, 'Int16' AS ts, 'Decimal128(12, 2)' AS td, 'Utf8' AS tu, 'Float64' AS tf FROM part")
def arrow_types(spark, sf_dir):
    s, d, u = compat.arrow_cast(F.col("p_size"), "Int16"), compat.arrow_cast(F.col("p_retailprice"), "Decimal128(12, 2)"), compat.arrow_cast(F.col("p_partkey"), "Utf8")
    kinds = {"ts": s, "td": d, "tu": u, "tf": F.col("p_retailprice")}
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), d.alias("d"), u.alias("u"), *(compat.arrow_typeof(c).alias(k) for k, c in kinds.items()))
