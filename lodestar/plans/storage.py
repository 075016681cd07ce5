"""Queries of files, table changes, time-series declarations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.functions import geometry as geo
from lodestar.functions import scalar
from lodestar.operators import tables, ticks
from lodestar.plans.registry import register, table
from lodestar.session import scratch
from lodestar.sources import files
from lodestar.streaming import ticks as stream_ticks


def _place(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@register("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders")
def csv_round_trip(spark, sf):
    """Orders written as separated values and read again."""
    path = _place(spark, "orders-csv")
    files.export_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice")), path)
    return files.load_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", quote='"', header=True)


@register("csv_terminators", "SELECT c_custkey, c_name || ';, x' AS label FROM customer")
def csv_terminators(spark, sf):
    """Fields ended by semicolons, lines by bars, and quoted by single quotes."""
    path = _place(spark, "customers-csv")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(";, x")).alias("label"))
    rows.write.csv(path, sep=";", lineSep="|", quote="'", header=False)
    return files.load_csv(spark, path, "c_custkey long, label string", columns=";", lines="|")


@register("sql_export_file", "SELECT 'insert into region (r_regionkey, r_name) values (' || r_regionkey || ', ''' || r_name || ''');' AS value FROM region")
def sql_export_file(spark, sf):
    path = _place(spark, "region-sql")
    files.export_sql(table(spark, sf, "region").select("r_regionkey", "r_name"), path, "region")
    return spark.read.text(path)


@register("geojson_file", "SELECT s_suppkey::BIGINT AS id, (s_suppkey % 50)::DOUBLE AS x, 'point' AS kind FROM supplier")
def geojson_file(spark, sf):
    """GeoJSON lines written and read as geometries."""
    path = _place(spark, "geojson")
    x = (F.col("s_suppkey") % 50).cast("double")
    table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), geo.geojson(geo.point(x, F.lit(1.0))).alias("shape")).write.json(path)
    read = files.read_geojson(spark.read.json(path, schema="id long, shape string"), "shape")
    return read.select("id", geo.center("geom")["x"].alias("x"), geo.geotype("geom").alias("kind"))


@register("file_attributes", "SELECT n_regionkey::BIGINT AS part, sum(length(n_name) + 1)::BIGINT AS size, round(sum(length(n_name) + 1) / 1e6, 9) AS sizemb, count(*)::BIGINT AS lines FROM nation GROUP BY 1")
def file_attributes(spark, sf):
    """Sizes and contents of files, one for each region."""
    path = _place(spark, "nations")
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("part"), F.col("n_name").alias("value"))
    nations.repartition("part").write.partitionBy("part").text(path)
    found = files.read_files(spark, path, "*.txt", recursive=True)
    part = F.regexp_extract("fpath", r"part=(\d+)", 1).cast("long")
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    return found.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.round(F.sum("sizemb"), 9).alias("sizemb"), F.sum(lines).cast("long").alias("lines"))


@register("insert_files", "SELECT n_regionkey::BIGINT AS part, sum(length(n_name) + 1)::BIGINT AS size, true AS same FROM nation GROUP BY 1")
def insert_files(spark, sf):
    """Rows that name files get the files' contents and checksums."""
    path = _place(spark, "named")
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("part"), F.col("n_name").alias("value"))
    nations.repartition("part").write.partitionBy("part").text(path)
    rows = files.read_files(spark, path, "*.txt", recursive=True).select(F.regexp_extract("fpath", r"part=(\d+)", 1).cast("long").alias("part"), F.col("fpath").alias("file"), "md5")
    kept = files.with_files(rows, "file", path, "*.txt", recursive=True)
    return kept.groupBy("part").agg(F.sum("size").alias("size"), F.min(F.md5("content") == F.col("md5")).alias("same"))


@register(
    "import_table",
    """SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, -o_totalprice::DOUBLE FROM orders WHERE o_orderkey % 3 = 0""",
)
def import_table(spark, sf):
    """A stored table into another: keys that are there stay as they are."""
    path = _place(spark, "stored")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    orders.write.parquet(path)
    target = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", -F.col("o_totalprice"))
    return tables.insert(target, spark.read.parquet(path), ["o_orderkey"])


@register(
    "change_sync",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN -o_totalprice::DOUBLE ELSE o_totalprice::DOUBLE END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0""",
)
def change_sync(spark, sf):
    """A log of changes in order: keys over 5 without rest are added late and removed, others changed twice."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    k = F.col("o_orderkey") % 5
    change = lambda which, op, n, price: orders.where(which).select(F.lit(op).alias("op"), F.lit(n).alias("n"), "o_orderkey", price.alias("o_totalprice"))
    price = F.col("o_totalprice")
    log = change(k == 0, "insert", 1, price).unionByName(change(k == 0, "delete", 2, price)).unionByName(change(k == 1, "update", 1, price + 1)).unionByName(change(k == 1, "update", 3, -price))
    return tables.apply_changes(orders.where(k != 0), log, ["o_orderkey"], "n", "op")


@register("insert_select", "SELECT c_custkey, max(v) AS v FROM (SELECT c_custkey, 1 AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 0 FROM customer) GROUP BY 1")
def insert_select(spark, sf):
    """Rows of a selection into a table that has the even keys already."""
    keys = table(spark, sf, "customer").select("c_custkey")
    return tables.insert(keys.where("c_custkey % 2 = 0").withColumn("v", F.lit(1)), keys.withColumn("v", F.lit(0)), ["c_custkey"])


@register("insert_values", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT * FROM (VALUES (-1, 'N'), (-2, 'M'))")
def insert_values(spark, sf):
    """Literal rows, one of them a key that is there and one given twice."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return tables.insert_values(orders, [(-1, "N"), (-2, "M"), (-2, "Z"), (1, "X")], ["o_orderkey"])


@register(
    "upsert_keys",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS v FROM orders UNION ALL SELECT -o_orderkey - 1, 2 FROM orders WHERE o_orderkey % 4 = 0""",
)
def upsert_keys(spark, sf):
    """Some keys replaced, some of them twice, the higher version last, and new ones added."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("v"))
    even = orders.where("o_orderkey % 2 = 0").withColumn("v", F.lit(1))
    fourth = orders.where("o_orderkey % 4 = 0").withColumn("v", F.lit(2))
    fresh = fourth.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return tables.upsert(orders, even.unionByName(fourth).unionByName(fresh), ["o_orderkey"], version="v")


@register("table_shape", "SELECT s_suppkey::BIGINT AS id, s_name AS label, 'none' AS note, s_acctbal::DOUBLE AS balance, 7::BIGINT AS rank FROM supplier WHERE s_suppkey % 3 <> 2")
def table_shape(spark, sf):
    """A declared table: types, defaults, an enumeration, a column added and one renamed; truncated it is empty."""
    spec = tables.TableSpec(["id"], defaults={"note": "none"}, enums={"kind": ["a", "b"]})
    declared = tables.schema_of([("id", "bigint"), ("name", "char(25)"), ("balance", "double"), ("kind", "enum"), ("note", "varchar(10)")])
    kind = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), kind.alias("kind"), F.lit(None).alias("note"))
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared])
    made = tables.rename_column(tables.add_column(tables.with_defaults(typed, spec), "rank", "bigint", 7), "name", "label").drop("kind")
    return made.unionByName(tables.truncate(made))


@register("index_count", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders")
def index_count(spark, sf):
    return tables.index_view(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], ordered=False).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("keys"))


@register("index_group", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def index_group(spark, sf):
    return tables.index_view(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], ordered=False).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@register("sub_columns", "SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS x, 3::DOUBLE AS r, s_acctbal::DOUBLE AS b, s_acctbal::DOUBLE + 1 AS e FROM supplier")
def sub_columns(spark, sf):
    """Parts of a shape and of a range by name."""
    x = (F.col("s_suppkey") % 50).cast("double")
    balance = F.col("s_acctbal").cast("double")
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), geo.circle(x, 1.0, 3.0).alias("c"), F.struct(balance.alias("begin"), (balance + 1).alias("end")).alias("span"))
    return df.select("id", geo.part("c", "x").alias("x"), geo.part("c", "a").alias("r"), F.col("span.begin").alias("b"), F.col("span.end").alias("e"))


@register("clock", "SELECT r_regionkey, true AS day, true AS clock, true AS now, true AS seconds FROM region")
def clock(spark, sf):
    """The current date and times in their forms."""
    form = lambda c, pattern: F.to_timestamp(c, pattern).isNotNull()
    near = F.abs(scalar.time() - F.unix_timestamp(F.current_timestamp())) <= 1
    return table(spark, sf, "region").select(
        "r_regionkey", (F.to_date(scalar.curdate()) == F.current_date()).alias("day"), scalar.curtime().rlike(r"^\d\d:\d\d:\d\d\z").alias("clock"),
        (form(scalar.now(), "yyyy-MM-dd HH:mm:ss") & (scalar.now() == scalar.sysdate())).alias("now"), near.alias("seconds"))


@register(
    "match_whole",
    r"""SELECT p_partkey, regexp_full_match(p_type, '[A-Z ]+BRASS') AS brass, regexp_full_match(p_type, '[A-Z]+') AS word, false AS line FROM part""",
)
def match_whole(spark, sf):
    """Whole strings against patterns; a line's end is part of the string."""
    return table(spark, sf, "part").select(
        "p_partkey", scalar.match("p_type", "[A-Z ]+BRASS").alias("brass"), scalar.match("p_type", "[A-Z]+").alias("word"), scalar.match(F.concat("p_type", F.lit("\n")), "[A-Z ]+").alias("line"))


@register(
    "tick_declared",
    """SELECT '1h' AS tick, date_trunc('hour', ts) AS ts, event_type, count(*) AS counter FROM events GROUP BY 2, 3
       UNION ALL SELECT '1d', date_trunc('day', ts), event_type, count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 2, 3""",
)
def tick_declared(spark, sf):
    """A declared series, altered: a tick dropped, one added, one given another retention; all its tick tables."""
    series = ticks.parse_timeseries("timeseries(5m:1d,1h:48h|5y)").drop_tick("5m").add_tick("1d", "7d").set_retention("1h", None)
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))
    out = None
    for tick, keep in series.ticks.items():
        rows = events if keep is None else ticks.retain(events.crossJoin(now), "ts", keep, F.col("now")).drop("now")  # of one row
        made = ticks.build_tick(rows, tick, "ts", ["event_type"], ["value"]).where("event_type <> '*'").select(F.lit(tick).alias("tick"), "ts", "event_type", "counter")
        out = made if out is None else out.unionByName(made)
    return out


@register("tick_index", "SELECT event_type, date_trunc('day', ts) AS ts, count(*) AS counter FROM events GROUP BY 1, 2")
def tick_index(spark, sf):
    """An index of a tick table: its rows in the order of other columns."""
    made = ticks.build_tick(table(spark, sf, "events"), "1d", "ts", ["event_type"], ["value"])
    return tables.index_view(made.where("event_type <> '*'"), ["event_type", "ts", "counter"])


@register("tick_slice_rest", "SELECT date_trunc('day', ts) AS ts, count(*) AS counter FROM events WHERE event_type = 'click' GROUP BY 1")
def tick_slice_rest(spark, sf):
    """A key that is not named is summed over."""
    made = ticks.build_tick(table(spark, sf, "events"), "1d", "ts", ["event_type", "user_id"], ["value"])
    return ticks.slice_tick(made, ["event_type", "user_id"], event_type="click").select("ts", "counter")


@register(
    "tick_stream",
    """SELECT date_trunc('day', ts) AS ts, event_type, count(*) AS counter, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""",
)
def tick_stream(spark, sf):
    """Events as a stream in three batches, each with rows of windows that are there: late ones."""
    place = _place(spark, "stream")
    events = table(spark, sf, "events").withColumn("part", F.pmod("event_id", F.lit(3)))
    events.repartition("part").write.partitionBy("part").parquet(f"{place}/in")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{place}/in")
    query = stream_ticks.stream_ticks(stream, f"{place}/base", f"{place}/ticks", "1d", "ts", ["event_type"], ["value"], f"{place}/checkpoint")
    query.awaitTermination()
    made = spark.read.parquet(f"{place}/ticks").where("event_type <> '*'")
    return made.select("ts", "event_type", "counter", F.round("value::sum", 2).alias("total"), F.col("value::min").alias("low"), F.col("value::max").alias("high"))
