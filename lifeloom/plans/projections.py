"""Projections of the test tables onto the engine's data model, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeloom.operators.lifecycle import lifecycle_from_snapshots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as revisions of the page of their user, with two statements each: the kind and the band of the value."""
    e = table(spark, sf_dir, "events")
    ordered = e.select(
        F.concat(F.lit("wd:Q"), F.col("user_id").cast("string")).alias("page"),
        F.struct("ts", "event_id").alias("ord"),
        "ts",
        F.get_json_object("props", "$.k").alias("user"),
        F.concat(F.lit("wd:"), F.col("event_type")).alias("kind"),
        F.concat(F.lit("wd:B"), F.floor(F.col("value") / 100).cast("string")).alias("band"),
    )
    pairs = F.explode(F.array(F.struct(F.lit("wdt:P1").alias("p"), F.col("kind").alias("o")), F.struct(F.lit("wdt:P2").alias("p"), F.col("band").alias("o"))))
    triples = ordered.select("page", "ord", pairs.alias("t")).select("page", "ord", "t.p", "t.o")
    return ordered.select("page", "ord", "ts", "user"), triples


def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle_from_snapshots(*revisions(spark, sf_dir)).withColumnRenamed("page", "s")


LC = """
rev AS (
  SELECT 'wd:Q' || CAST(user_id AS VARCHAR) AS s, ts, json_extract_string(props, '$.k') AS editor,
         'wd:' || event_type AS kind, 'wd:B' || CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS band,
         row_number() OVER w AS n, lead(ts) OVER w AS next_ts, lead(json_extract_string(props, '$.k')) OVER w AS next_editor
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
tri AS (
  SELECT s, n, ts, editor, next_ts, next_editor, 'wdt:P1' AS p, kind AS o FROM rev
  UNION ALL SELECT s, n, ts, editor, next_ts, next_editor, 'wdt:P2', band FROM rev
),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY s, p, o ORDER BY n) AS run FROM tri),
ends AS (SELECT s, p, o, run, min(n) AS n1, max(n) AS n2 FROM runs GROUP BY s, p, o, run),
lc AS (
  SELECT e.s, e.p, e.o, a.ts AS cdate, a.editor AS cuser, b.next_ts AS ddate, b.next_editor AS duser
  FROM ends e JOIN rev a ON a.s = e.s AND a.n = e.n1 JOIN rev b ON b.s = e.s AND b.n = e.n2
)"""


def user_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, property, count): customers and the brands they buy."""
    o, l, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    met = l.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    user = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    return met.groupBy(user.alias("user"), F.col("p_brand").alias("property")).agg(F.count(F.lit(1)).alias("count"))


UPC = """
upc AS (
  SELECT 'u' || CAST(o_custkey AS VARCHAR) AS "user", p_brand AS property, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, class, cdate, ddate): customers are of the class of their latest order's status."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("class"), F.col("o_orderdate").alias("cdate"), F.lead("o_orderdate").over(w).alias("ddate"))


def item_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, user, t): line items as edits of their customer by the supplier on the day of shipping."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    met = l.select("l_orderkey", "l_suppkey", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_custkey").alias("item"), F.col("l_suppkey").alias("user"), F.col("l_shipdate").alias("t"))


CLS = """
mem AS (
  SELECT o_custkey AS item, o_orderstatus AS class, o_orderdate AS cdate,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ddate FROM orders
),
ed AS (SELECT o_custkey AS item, l_suppkey AS "user", l_shipdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cec AS (
  SELECT class, "user", cdate, ddate, count(*) AS n FROM ed JOIN mem USING (item)
  WHERE cdate <= t AND (ddate IS NULL OR t < ddate) GROUP BY ALL
)"""


def user_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, class, edit_count): customers and the classes, part types and sizes, they buy."""
    o, l, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    met = l.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(p.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    user, cls = F.concat(F.lit("u"), F.col("o_custkey").cast("string")), F.concat(F.lit("c"), F.col("p_size").cast("string"))
    return met.groupBy(user.alias("user"), cls.alias("class")).agg(F.count(F.lit(1)).alias("edit_count"))


UCL = """
ucl AS (
  SELECT 'u' || CAST(o_custkey AS VARCHAR) AS "user", 'c' || CAST(p_size AS VARCHAR) AS class, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""


def corrections(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Lifecycles of P1 as corrections, some of them without a history. known: the lifecycles, if they are there already."""
    lc = (lifecycles(spark, sf_dir) if known is None else known).where("p = 'wdt:P1'")
    q = F.substring("s", 5, 20).cast("long")
    found = F.when(q % 11 == 0, "not_found").otherwise("found")
    row = F.concat_ws("|", "s", "o", F.date_format("cdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    prop = F.when(q % 13 == 0, "p:P1").when(q % 17 == 0, "wdt:P9").otherwise(F.col("p"))
    return lc.select(row.alias("row_id"), F.concat(F.lit("c"), (q % 4).cast("string")).alias("constraint_id"), "s", prop.alias("p"), "o", "cdate", "ddate", found.alias("match_status"))


def _days(n: int):
    return F.expr(f"INTERVAL {n} DAYS")


def entries(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Entries and exceptions of one kind for P1: three constraints with their own times, over the kinds of events."""
    e = table(spark, sf_dir, "events")
    base = e.groupBy("event_type").agg(F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz").alias("t0"))
    k = spark.range(3).select(F.col("id").alias("k"))
    grid = base.crossJoin(F.broadcast(k))  # kinds of events times three
    place = F.row_number().over(Window.partitionBy("k").orderBy("event_type"))
    grid = grid.withColumn("i", place)
    start = F.expr("t0 + make_dt_interval(k * 5 + i)")
    end = F.when(F.col("k") < 2, F.expr("t0 + make_dt_interval(k * 5 + i + 9)"))
    none = F.lit(None).cast("string")
    value = F.concat(F.lit("wd:B"), (F.col("i") % 3).cast("string"))
    cols = {
        "one_of": (none, none, F.concat(F.lit("wd:"), F.col("event_type"))),
        "none_of": (none, none, F.concat(F.lit("wd:"), F.col("event_type"))),
        "conflicts_with": (F.lit("wd:P2"), F.when(F.col("i") != 3, value), none),
        "inverse": (F.lit("wd:P3"), none, none),
        "symmetric": (none, none, none),
        "item_requires_statement": (F.lit("wd:P2"), F.when(F.col("k") != 1, value), none),
        "value_requires_statement": (F.lit("wd:P4"), F.when(F.col("k") != 1, value), none),
    }[kind]
    own = grid.where("i <= 3").select(
        F.lit("wd:P1").alias("prop"), F.lit(kind).alias("kind"), F.lit("entry").alias("role"), cols[0].alias("pq2306"), cols[1].alias("pq2305"), cols[2].alias("entity"),
        start.alias("start"), end.alias("end"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("constraint_id"),
    )
    users = e.where("user_id % 7 = 0").groupBy("user_id").agg(F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz").alias("t0"))
    free = users.select(
        F.lit("wd:P1").alias("prop"), F.lit(kind).alias("kind"), F.lit("exception").alias("role"), none.alias("pq2306"), none.alias("pq2305"),
        F.concat(F.lit("wd:Q"), F.col("user_id").cast("string")).alias("entity"), F.col("t0").alias("start"), F.expr("t0 + INTERVAL 12 DAYS").alias("end"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("constraint_id"),
    )
    return own.unionByName(free)


def witnesses(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Lifecycles with reversed statements of every second page and statements about the objects added; known as above."""
    lc = (lifecycles(spark, sf_dir) if known is None else known).select("s", "p", "o", "cdate", "ddate")
    q = F.substring("s", 5, 20).cast("long")
    p1 = lc.where("p = 'wdt:P1'")
    back = p1.where(q % 2 == 0).select(F.col("o").alias("s"), F.when(q % 4 == 0, "wdt:P1").otherwise("wdt:P3").alias("p"), F.col("s").alias("o"), "cdate", "ddate")
    about = p1.where(q % 5 == 0).select(F.col("o").alias("s"), F.lit("wdt:P4").alias("p"), F.concat(F.lit("wd:B"), (q % 3).cast("string")).alias("o"), "cdate", F.expr("ddate + INTERVAL 2 DAYS").alias("ddate"))
    return lc.unionByName(back).unionByName(about)


CON = LC + """,
cor AS (
  SELECT s || '|' || o || '|' || strftime(cdate, '%Y-%m-%d %H:%M:%S.%f') AS row_id, 'c' || CAST(q % 4 AS VARCHAR) AS constraint_id, s,
         CASE WHEN q % 13 = 0 THEN 'p:P1' WHEN q % 17 = 0 THEN 'wdt:P9' ELSE p END AS p, o, cdate AS a,
         coalesce(ddate, TIMESTAMP '9999-12-31') AS b, CASE WHEN q % 11 = 0 THEN 'not_found' ELSE 'found' END AS match_status
  FROM (SELECT *, CAST(substr(s, 5) AS BIGINT) AS q FROM lc WHERE p = 'wdt:P1')
),
kinds AS (
  SELECT event_type, date_trunc('day', min(ts)) AS t0, row_number() OVER (ORDER BY event_type) AS i FROM events GROUP BY event_type
),
grid AS (
  SELECT event_type, i, k, t0 + to_days(CAST(k * 5 + i AS INTEGER)) AS st,
         CASE WHEN k < 2 THEN t0 + to_days(CAST(k * 5 + i + 9 AS INTEGER)) ELSE TIMESTAMP '9999-12-31' END AS en,
         'c' || CAST(k AS VARCHAR) AS cid, 'wd:B' || CAST(i % 3 AS VARCHAR) AS v
  FROM kinds, range(3) AS r(k) WHERE i <= 3
),
exc AS (
  SELECT 'wd:Q' || CAST(user_id AS VARCHAR) AS entity, date_trunc('day', min(ts)) AS st, date_trunc('day', min(ts)) + to_days(12) AS en,
         'c' || CAST(user_id % 3 AS VARCHAR) AS cid FROM events WHERE user_id % 7 = 0 GROUP BY user_id
),
wit AS (
  SELECT s, p, o, cdate AS a, coalesce(ddate, TIMESTAMP '9999-12-31') AS b FROM lc
  UNION ALL SELECT o, CASE WHEN CAST(substr(s, 5) AS BIGINT) % 4 = 0 THEN 'wdt:P1' ELSE 'wdt:P3' END, s, cdate, coalesce(ddate, TIMESTAMP '9999-12-31')
    FROM lc WHERE p = 'wdt:P1' AND CAST(substr(s, 5) AS BIGINT) % 2 = 0
  UNION ALL SELECT o, 'wdt:P4', 'wd:B' || CAST(CAST(substr(s, 5) AS BIGINT) % 3 AS VARCHAR), cdate, coalesce(ddate + to_days(2), TIMESTAMP '9999-12-31')
    FROM lc WHERE p = 'wdt:P1' AND CAST(substr(s, 5) AS BIGINT) % 5 = 0
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of suppliers with validities, and an edge from the root that makes a cycle."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 1")
    origin = "TIMESTAMP_NTZ '2020-01-01 00:00:00'"
    own = s.select(
        F.col("s_suppkey").alias("child"), F.floor(F.col("s_suppkey") / 2).alias("parent"),
        F.expr(f"{origin} + make_dt_interval(s_nationkey)").alias("start"), F.expr(f"{origin} + make_dt_interval(s_nationkey + 20)").alias("end"),
    )
    loop = spark.sql(f"SELECT CAST(1 AS BIGINT) AS child, CAST(5 AS BIGINT) AS parent, {origin} AS start, {origin} + INTERVAL 30 DAYS AS end")
    return own.unionByName(loop)


EDGE = """
edge AS (
  SELECT s_suppkey AS child, s_suppkey // 2 AS parent, TIMESTAMP '2020-01-01' + to_days(s_nationkey) AS a, TIMESTAMP '2020-01-01' + to_days(s_nationkey + 20) AS b
  FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 1, 5, TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-31'
)"""


def governance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles as rows about constraints: the object is the type, the page's number the target."""
    lc = lifecycles(spark, sf_dir)
    q = F.substring("s", 5, 20).cast("long")
    action = F.when(F.col("p") == "wdt:P1", "creation").when(q % 3 == 0, "rank").otherwise("qualifier")
    return lc.select(
        F.col("s"), F.col("o").alias("constraint_type"), (q % 6).cast("string").alias("target"), F.col("cuser").alias("user"), "duser", "cdate", "ddate", action.alias("action"), "p"
    )


GOV = LC + """,
gov AS (
  SELECT s, o AS constraint_type, CAST(CAST(substr(s, 5) AS BIGINT) % 6 AS VARCHAR) AS target, cuser AS "user", duser, cdate, ddate, p,
         CASE WHEN p = 'wdt:P1' THEN 'creation' WHEN CAST(substr(s, 5) AS BIGINT) % 3 = 0 THEN 'rank' ELSE 'qualifier' END AS action
  FROM lc
)"""
