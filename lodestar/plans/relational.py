"""Queries of one table: filters, functions, groups, order, and changes of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import ranges, scalar, vectors
from lodestar.operators import aggregates, joins, tables
from lodestar.plans.registry import register, table
from lodestar.sources import files


@register("select_star", "SELECT * FROM nation")
def select_star(spark, sf):
    return table(spark, sf, "nation").select("*")


@register("project_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice, o_orderpriority AS p FROM orders")
def project_alias(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("twice"), F.col("o_orderpriority").alias("p"))


@register("constant_select", "SELECT 3 AS a, 'x' AS b, (SELECT count(*) FROM region) AS n")
def constant_select(spark, sf):
    return table(spark, sf, "region").agg(F.count("*").alias("n")).select(F.lit(3).alias("a"), F.lit("x").alias("b"), "n")


@register("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = 7")


@register("count_scan", "SELECT count(*) AS n FROM lineitem")
def count_scan(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@register("count_where", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def count_where(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 25").agg(F.count("*").alias("n"))


@register(
    "filter_between_in",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('R', 'A') AND l_linenumber NOT IN (1, 2) AND l_discount NOT BETWEEN 0.02 AND 0.05""",
)
def filter_between_in(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("R", "A") & ~F.col("l_linenumber").isin(1, 2) & ~F.col("l_discount").between(0.02, 0.05))
        .select("l_orderkey", "l_linenumber", "l_quantity")
    )


@register(
    "filter_and_or",
    "SELECT o_orderkey FROM orders WHERE (o_totalprice < 50000 OR o_totalprice >= 300000) AND o_orderstatus <> 'F'",
)
def filter_and_or(spark, sf):
    return table(spark, sf, "orders").where(((F.col("o_totalprice") < 50000) | (F.col("o_totalprice") >= 300000)) & (F.col("o_orderstatus") != "F")).select("o_orderkey")


@register(
    "like_match",
    """SELECT o_orderkey, starts_with(o_orderpriority, '1-') AS prefix, ends_with(o_orderpriority, 'H') AS suffix, contains(o_orderpriority, 'ED') AS inside,
              o_orderpriority = '5-LOW' AS same, o_orderpriority LIKE '%-%I%' AS middle, regexp_full_match(o_orderpriority, '[0-9]-[A-Z]{3,4}') AS matched FROM orders""",
)
def like_match(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", scalar.like(p, "1-%").alias("prefix"), scalar.like(p, "%H").alias("suffix"), scalar.like(p, "%ED%").alias("inside"),
        scalar.like(p, "5-LOW").alias("same"), scalar.like(p, "%-%I%").alias("middle"), scalar.match(p, "[0-9]-[A-Z]{3,4}").alias("matched"),
    )


@register(
    "int_arith",
    """SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS s, l_orderkey - l_partkey AS d, l_partkey * l_linenumber AS p,
              (l_orderkey - 500) // (l_linenumber - 3) AS q, l_partkey % (l_linenumber - 3) AS m, CAST(pow(l_linenumber, 3) AS BIGINT) AS cube
       FROM lineitem WHERE l_linenumber <> 3""",
)
def int_arith(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({
        "q": scalar.int_divide(F.col("l_orderkey") - 500, F.col("l_linenumber") - 3),
        "m": scalar.int_mod("l_partkey", F.col("l_linenumber") - 3),
    })
    return scalar.drop_failed(df, "q", "m").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_linenumber")).alias("s"), (F.col("l_orderkey") - F.col("l_partkey")).alias("d"),
        (F.col("l_partkey") * F.col("l_linenumber")).alias("p"), "q", "m", scalar.power("l_linenumber", 3, integers=True).alias("cube"),
    )


@register(
    "numeric_fns",
    """SELECT l_orderkey, l_linenumber, abs(l_tax - 0.04) AS a, ceil(l_extendedprice)::DOUBLE AS c, floor(l_extendedprice)::DOUBLE AS f, round(log2(l_quantity), 6) AS l2,
              round(log10(l_quantity), 6) AS l10, round(ln(l_quantity), 6) AS l, round(sqrt(l_quantity), 6) AS sq, round(pow(l_quantity, 2), 6) AS pw,
              round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS co, round(tan(l_quantity), 6) AS ta, round(atan(l_quantity), 6) AS at,
              round(l_quantity / 57.295779513, 6) AS ra, round(l_quantity * 57.295779513, 4) AS de, round(fmod(l_extendedprice, 7.5), 4) AS mo
       FROM lineitem""",
)
def numeric_fns(spark, sf):
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    r = lambda c, n=6: F.round(c, n)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(F.col("l_tax") - 0.04).alias("a"), scalar.ceil(p).alias("c"), scalar.floor(p).alias("f"), r(F.log2(q)).alias("l2"),
        r(F.log10(q)).alias("l10"), r(F.ln(q)).alias("l"), r(F.sqrt(q)).alias("sq"), r(F.pow(q, 2)).alias("pw"), r(F.sin(q)).alias("si"), r(F.cos(q)).alias("co"),
        r(F.tan(q)).alias("ta"), r(F.atan(q)).alias("at"), r(scalar.radians(q)).alias("ra"), r(scalar.degrees(q), 4).alias("de"), r(scalar.mod(p, 7.5), 4).alias("mo"),
    )


@register(
    "domain_fns",
    """SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) > 1 THEN 0 ELSE round(acos(CASE WHEN abs(x) > 1 THEN 0 ELSE x END), 6) END AS ac,
              CASE WHEN abs(x) > 1 THEN 0 ELSE round(asin(CASE WHEN abs(x) > 1 THEN 0 ELSE x END), 6) END AS as_, round(1 / tan(x), 6) AS ct, round(pi(), 6) AS pi_
       FROM (SELECT *, l_quantity / 25.0 AS x FROM lineitem) WHERE abs(tan(x)) >= 1e-10""",
)
def domain_fns(spark, sf):
    x = F.col("l_quantity").cast("double") / 25.0
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scalar.acos(x), 6).alias("ac"), F.round(scalar.asin(x), 6).alias("as_"), F.round(scalar.cot(x), 6).alias("ct"), F.round(F.pi(), 6).alias("pi_"),
    )
    return scalar.drop_failed(df, "ct")


@register(
    "string_fns",
    """SELECT doc_id, upper(lang) AS u, lower(source) AS l, substring(text, 3, 10) AS s, trim('  ' || lang || ' ') AS t, ltrim('  ' || lang) AS lt, rtrim(lang || '  ') AS rt,
              strlen(text) AS n, levenshtein(source, lang) AS d, source || '/' || doc_id AS c FROM documents""",
)
def string_fns(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.upper("lang").alias("u"), F.lower("source").alias("l"), scalar.substr("text", 3, 10, "UTF8").alias("s"), F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("t"),
        F.ltrim(F.concat(F.lit("  "), "lang")).alias("lt"), F.rtrim(F.concat("lang", F.lit("  "))).alias("rt"), scalar.length("text").cast("long").alias("n"),
        scalar.strdiff("source", "lang").cast("long").alias("d"), scalar.concat("source", F.lit("/"), "doc_id").alias("c"),
    )


@register(
    "date_parts",
    """SELECT event_id, second(ts) AS s, minute(ts) AS mi, hour(ts) AS h, day(ts) AS d, month(ts) AS mo, year(ts) AS y, strftime(ts, '%Y-%m-%d') AS dt,
              dayofweek(ts) AS w, dayofyear(ts) AS yd FROM events""",
)
def date_parts(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", *[f("ts").cast("long").alias(n) for n, f in (("s", F.second), ("mi", F.minute), ("h", F.hour), ("d", F.dayofmonth), ("mo", F.month), ("y", F.year), ("yd", F.dayofyear))],
        scalar.date_text("ts").alias("dt"), scalar.dayofweek("ts").cast("long").alias("w"),
    )


@register(
    "datediff_units",
    """SELECT l_orderkey, l_linenumber, epoch(b - a)::BIGINT AS s, trunc(epoch(b - a) / 60)::BIGINT AS mi, trunc(epoch(b - a) / 3600)::BIGINT AS h, trunc(epoch(b - a) / 86400)::BIGINT AS d,
              (year(b) - year(a)) * 12 + month(b) - month(a) AS mo, year(b) - year(a) AS y
       FROM (SELECT *, l_shipdate::TIMESTAMP AS a, TIMESTAMP '1995-06-17 13:14:15' AS b FROM lineitem)""",
)
def datediff_units(spark, sf):
    end = F.lit("1995-06-17 13:14:15").cast("timestamp")
    units = {"s": "second", "mi": "minute", "h": "hour", "d": "day", "mo": "month", "y": "year"}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[scalar.datediff(u, "l_shipdate", end).alias(n) for n, u in units.items()])


@register(
    "unit_conversions",
    """SELECT o_orderkey, round(o_totalprice / 1609.344, 6) AS a, round(o_totalprice * 1609.344, 2) AS b, round(o_totalprice / 1.609344, 4) AS c, round(o_totalprice * 1.609344, 4) AS d,
              900 AS secs, 7200000000 AS micros FROM orders""",
)
def unit_conversions(spark, sf):
    p = F.col("o_totalprice").cast("double")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(scalar.metertomile(p), 6).alias("a"), F.round(scalar.miletometer(p), 2).alias("b"), F.round(scalar.kilometertomile(p), 4).alias("c"), F.round(scalar.miletokilometer(p), 4).alias("d"),
        F.lit(scalar.tosecond("15M")).alias("secs"), F.lit(scalar.tomicrosecond("2H")).alias("micros"),
    )


@register(
    "agg_all",
    """SELECT min(l_quantity) AS mn, max(l_quantity) AS mx, round(avg(l_quantity), 6) AS av, sum(l_quantity) AS su, count(*) AS cn, round(stddev_pop(l_quantity), 6) AS sd,
              min(l_linestatus) AS ms, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem""",
)
def agg_all(spark, sf):
    q = F.col("l_quantity")
    return aggregates.aggregate(
        table(spark, sf, "lineitem"), mn=("min", q), mx=("max", q), av=("avg", q), su=("sum", q), cn=("count", F.lit(1)), sd=("stddev", q), ms=("min", F.col("l_linestatus")),
        rev=("sum", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
    ).withColumns({"av": F.round("av", 6), "sd": F.round("sd", 6), "rev": F.round("rev", 2)})


@register(
    "agg_first_last",
    """SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey""",
)
def agg_first_last(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(aggregates.first_by("o_totalprice", ["o_orderkey"]).alias("first_price"), aggregates.last_by("o_totalprice", ["o_orderkey"]).alias("last_price"))


@register(
    "group_sorted",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, round(stddev_pop(l_quantity), 6) AS sd, arg_min(l_comment_, (l_orderkey, l_linenumber)) AS l_comment_
       FROM (SELECT *, l_linestatus || l_linenumber AS l_comment_ FROM lineitem) GROUP BY ALL ORDER BY 1, 2""",
)
def group_sorted(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_comment_", F.concat("l_linestatus", "l_linenumber"))
    aggs = {"n": F.count("*"), "q": F.sum("l_quantity"), "sd": F.round(F.stddev_pop("l_quantity"), 6)}
    return aggregates.group(df, ["l_returnflag", "l_linestatus"], aggs, bare=["l_comment_"], order=["l_orderkey", "l_linenumber"])


@register("group_lastvalue", "SELECT user_id, count(*) AS n, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id ORDER BY user_id")
def group_lastvalue(spark, sf):
    return aggregates.group(table(spark, sf, "events"), ["user_id"], {"n": F.count("*")}, bare=["value"], order=["ts", "event_id"], last=True)


@register("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12 ORDER BY o_custkey")
def group_having(spark, sf):
    aggs = {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)}
    return aggregates.group(table(spark, sf, "orders"), ["o_custkey"], aggs, having=F.col("n") >= 12)


@register("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit(spark, sf):
    return aggregates.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10)


@register("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 40")
def limit_offset(spark, sf):
    return aggregates.page(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 15, 40)


@register("reverse_scan", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 25")
def reverse_scan(spark, sf):
    return aggregates.page(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), [F.desc("l_orderkey"), F.desc("l_linenumber")], 25)


@register("index_view", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey")
def index_view(spark, sf):
    return tables.index_view(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"])


@register("insert_dedup", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def insert_dedup(spark, sf):
    """Of rows of one key the first; half the keys are there already, as their first orders."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    there = rows.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return tables.insert(there, rows, ["o_custkey"])


@register(
    "upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def upsert(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tables.upsert(base, base.where("o_orderkey % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"])


@register("update_rows", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_rows(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.update(base, tables.TableSpec(["o_orderkey"]), F.col("o_totalprice") > 200000, o_orderstatus="BIG").drop("o_totalprice")


@register("delete_rows", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_rows(spark, sf):
    return tables.delete(table(spark, sf, "orders"), tables.TableSpec(["o_orderkey"]), F.col("o_orderstatus") == "F").select("o_orderkey")


@register("export_sql", "SELECT 'insert into nation (n_nationkey, n_name) values (' || n_nationkey || ', ''' || n_name || ''');' AS sql FROM nation")
def export_sql(spark, sf):
    return files.insert_statements(table(spark, sf, "nation").select("n_nationkey", "n_name"), "nation")


def _ranges(spark, sf):
    days = lambda c, n: F.date_add(F.col(c), n)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ranges.range_of("l_shipdate", days("l_shipdate", 30)).alias("r"))


_RANGE_SQL = "FROM (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS b, l_shipdate::DATE + 30 AS e, DATE '1995-03-01' AS b2, DATE '1995-06-01' AS e2 FROM lineitem)"


def _query_range():
    return ranges.range_of(F.lit("1995-03-01").cast("date"), F.lit("1995-06-01").cast("date"))


@register("range_within", f"SELECT l_orderkey, l_linenumber, (b2 < b AND e < e2) AS strict, (b2 <= b AND e <= e2) AS loose, (b < DATE '1995-04-01' AND DATE '1995-04-01' < e) AS holds {_RANGE_SQL}")
def range_within(spark, sf):
    day = F.lit("1995-04-01").cast("date")
    return _ranges(spark, sf).select("l_orderkey", "l_linenumber", ranges.within(F.col("r"), _query_range()).alias("strict"), ranges.within(F.col("r"), _query_range(), False).alias("loose"), ranges.value_within(day, F.col("r")).alias("holds"))


@register("range_intersect", f"SELECT l_orderkey, l_linenumber {_RANGE_SQL} WHERE e > b2 AND e2 > b")
def range_intersect(spark, sf):
    return _ranges(spark, sf).where(ranges.intersect(F.col("r"), _query_range())).select("l_orderkey", "l_linenumber")


@register("range_equal", f"SELECT l_orderkey, l_linenumber {_RANGE_SQL} WHERE b = DATE '1995-03-01' AND e = DATE '1995-03-31'")
def range_equal(spark, sf):
    own = ranges.range_of(F.lit("1995-03-01").cast("date"), F.lit("1995-03-31").cast("date"))
    return _ranges(spark, sf).where(ranges.equal(F.col("r"), own)).select("l_orderkey", "l_linenumber")


@register(
    "vector_similarity",
    """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 5) AS cosine, round(list_distance(e.embedding::DOUBLE[], q.v), 5) AS euclidean
       FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q""",
)
def vector_similarity(spark, sf):
    df = table(spark, sf, "embeddings")
    query = df.where("vec_id = 0").agg(F.min("embedding").alias("v"))  # an aggregate is of one row
    both = df.crossJoin(query)
    return both.select("vec_id", F.round(vectors.similarity("embedding", "v"), 5).alias("cosine"), F.round(vectors.similarity("embedding", "v", "euclidean"), 5).alias("euclidean"))


@register(
    "vector_topk",
    """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 5) AS similarity
       FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 20""",
)
def vector_topk(spark, sf):
    df = table(spark, sf, "embeddings")
    query = df.where("vec_id = 0").agg(F.min("embedding").alias("v"))  # an aggregate is of one row
    return vectors.top_similar(df.crossJoin(query), "embedding", F.col("v"), 20, order="vec_id").select("vec_id", F.round("similarity", 5).alias("similarity"))


@register(
    "overlap_join",
    """SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM (SELECT *, s_acctbal::DOUBLE AS x, s_acctbal::DOUBLE + 50 AS x2 FROM supplier) a
       JOIN (SELECT *, s_acctbal::DOUBLE + 20 AS y, s_acctbal::DOUBLE + 60 AS y2 FROM supplier) b ON a.x2 > b.y AND b.y2 > a.x""",
)
def overlap_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"))
    a = s.select(F.col("s_suppkey").alias("a"), "x", (F.col("x") + 50).alias("x2"))
    b = s.select(F.col("s_suppkey").alias("b"), (F.col("x") + 20).alias("y"), (F.col("x") + 60).alias("y2"))
    return joins.overlap_join(a, b, "x", "x2", "y", "y2", 50.0).select("a", "b")
