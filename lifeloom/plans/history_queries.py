"""Queries on lifecycles, intervals, classes, constraints, closures and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.functions.actors import with_flags
from lifeloom.operators import classes, closure, enrich, governance, intervals, lifecycle, validators
from lifeloom.plans import projections as P
from lifeloom.plans.catalogue import query
from lifeloom.session import cut_lineage

FAR = "TIMESTAMP '9999-12-31'"


@query("lifecycle_from_snapshots", f"WITH {P.LC} SELECT s, p, o, cdate, cuser, ddate, duser FROM lc")
def lifecycle_from_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return P.lifecycles(spark, sf)


@query(
    "active_vs_deleted",
    f"WITH {P.LC} SELECT p, count(*) FILTER (ddate IS NULL AND duser IS NULL) AS active, count(*) FILTER (ddate IS NOT NULL) AS deleted FROM lc GROUP BY p",
)
def active_vs_deleted(spark: SparkSession, sf: str) -> DataFrame:
    lc = lifecycle.truthy(P.lifecycles(spark, sf))
    gone = lifecycle.deleted(lc).groupBy("p").agg(F.count(F.lit(1)).alias("deleted"))
    return lifecycle.active(lc).groupBy("p").agg(F.count(F.lit(1)).alias("active")).join(gone, "p", "full").fillna(0)


@query(
    "class_add_delete",
    f"""WITH {P.LC} SELECT o AS class, count(*) FILTER (ddate IS NULL AND duser IS NULL) AS n_instances_added,
    count(*) FILTER (ddate IS NOT NULL) AS n_instances_deleted, count(*) AS n_total_instances_added FROM lc WHERE p = 'wdt:P1' GROUP BY o""",
)
def class_add_delete(spark: SparkSession, sf: str) -> DataFrame:
    member, _, _ = lifecycle.split_membership(P.lifecycles(spark, sf), "wdt:P1", "wdt:P2")
    return classes.class_adds_deletes(member.select(F.col("s").alias("item"), F.col("o").alias("class"), "ddate", "duser"))


@query("class_edit_counts_interval", f'WITH {P.CLS} SELECT class, "user", cdate, ddate, n AS "count" FROM cec')
def class_edit_counts_interval(spark: SparkSession, sf: str) -> DataFrame:
    return classes.class_edit_counts(P.item_edits(spark, sf), P.membership(spark, sf))


@query("class_edit_totals", f'WITH {P.CLS} SELECT class, "user", CAST(sum(n) AS BIGINT) AS edit_count FROM cec GROUP BY ALL')
def class_edit_totals(spark: SparkSession, sf: str) -> DataFrame:
    counts = class_edit_counts_interval(spark, sf).select("class", F.col("user").cast("string").alias("user"), F.col("count").alias("edit_count"))
    return classes.merge_counts(counts).withColumn("user", F.col("user").cast("long"))


_US = "%Y-%m-%d %H:%M:%S.%f"


@query(
    "class_documents",
    f"""WITH {P.CLS} SELECT class, count(*) AS entries, CAST(sum(n) AS BIGINT) AS edits,
    sha256(string_agg("user" || ' ' || strftime(cdate, '{_US}') || ' ' || coalesce(strftime(ddate, '{_US}'), '') || ' ' || n, '|' ORDER BY cdate, ddate NULLS FIRST, "user")) AS entries_sha256 FROM cec GROUP BY class""",
)
def class_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents; their entries, in their order, as a digest."""
    docs = classes.class_documents(class_edit_counts_interval(spark, sf), merge_identical=True)
    when = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    entry = F.transform("edit_counts", lambda e: F.concat_ws(" ", e["user"].cast("string"), when(e["cdate"]), when(e["ddate"]), e["count"].cast("string")))
    return classes.digests(docs, F.array_join(entry, "|"))


_SCAN = f"""WITH RECURSIVE {P.CLS},
a AS (SELECT item, class, list(cdate ORDER BY cdate) AS ts FROM mem GROUP BY ALL), d AS (SELECT item, class, list(ddate ORDER BY ddate) AS ds FROM mem WHERE ddate IS NOT NULL GROUP BY ALL),
g AS (SELECT item, class, ts, coalesce(ds, []) AS ds FROM a LEFT JOIN d USING (item, class)),
st(item, class, ts, ds, i, j, opened, en) AS (
  SELECT item, class, ts, ds, 0::BIGINT, 0::BIGINT, NULL::TIMESTAMP, TIMESTAMP '0001-01-01' FROM g
  UNION ALL SELECT item, class, ts, ds, i + 1, CASE WHEN t >= en THEN coalesce(k, len(ds) + 1) ELSE j END, CASE WHEN t >= en THEN t END, CASE WHEN t >= en THEN coalesce(ds[k], {FAR}) ELSE en END
    FROM (SELECT *, ts[i + 1] AS t, list_filter(range(j + 1, len(ds) + 1), lambda x: ds[x] >= ts[i + 1])[1] AS k FROM st WHERE i < len(ts))
),
iv AS (SELECT item, class, opened, en FROM st WHERE opened IS NOT NULL),
r AS (SELECT item, t, 1 AS ord, CAST("user" AS VARCHAR) AS "user" FROM ed UNION ALL SELECT item, cdate, 0, 'o' FROM mem)
SELECT "user", class, count(*) AS edit_count FROM r JOIN iv USING (item) WHERE (t > opened OR (t = opened AND ord > 0)) AND t < en GROUP BY ALL"""


@query("class_edit_counts_scan", _SCAN)
def class_edit_counts_scan(spark: SparkSession, sf: str) -> DataFrame:
    member = P.membership(spark, sf)
    ends = member.where("ddate is not null").select("item", "class", F.col("ddate").alias("t"))
    edits = P.item_edits(spark, sf).select("item", "t", F.lit(1).cast("long").alias("ord"), F.col("user").cast("string").alias("user"))
    opened = member.select("item", F.col("cdate").alias("t"), F.lit(0).cast("long").alias("ord"), F.lit("o").alias("user"), "class")
    return classes.class_edit_counts_by_scan(edits, opened, ends)


_IV = """
iv AS (SELECT user_id AS k, event_type AS side, ts AS a, ts + to_days(1 + CAST(floor(value) AS INTEGER) % 4) AS b FROM events),
pt AS (SELECT k, a AS t FROM iv UNION SELECT k, b FROM iv),
seg AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS b FROM pt),
cov AS (
  SELECT seg.k, seg.a, seg.b, count(iv.k) FILTER (side IN ('click', 'view')) AS n0, count(iv.k) FILTER (side NOT IN ('click', 'view')) AS n1
  FROM seg LEFT JOIN iv ON iv.k = seg.k AND iv.a <= seg.a AND seg.b <= iv.b WHERE seg.b IS NOT NULL GROUP BY ALL
)"""


def _islands(test: str) -> str:
    return f"""WITH {_IV}, f AS (SELECT k, a, b FROM cov WHERE {test}),
    g AS (SELECT *, CASE WHEN a > lag(b) OVER (PARTITION BY k ORDER BY a) THEN 1 ELSE 0 END AS fresh FROM f),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT k, min(a) AS "start", max(b) AS "end" FROM h GROUP BY k, island"""


def _spans(spark: SparkSession, sf: str, base: bool | None = None) -> DataFrame:
    e = P.table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("k"), "event_type", F.col("ts").alias("start"), F.expr("ts + make_dt_interval(1 + CAST(floor(value) AS INT) % 4)").alias("end"))
    own = F.col("event_type").isin("click", "view")
    return (rows if base is None else rows.where(own if base else ~own)).drop("event_type")


@query("interval_merge", _islands("n0 + n1 > 0"))
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge(_spans(spark, sf), ["k"])


@query("interval_subtract", _islands("n0 > 0 AND n1 = 0"))
def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.subtract(_spans(spark, sf, True), _spans(spark, sf, False), ["k"])


@query("interval_intersect", _islands("n0 > 0 AND n1 > 0"))
def interval_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.intersect(_spans(spark, sf, True), _spans(spark, sf, False), ["k"])


@query("interval_cover", f"WITH {_IV} SELECT k, count(*) FILTER (n0 > 0 AND n1 = 0) = 0 AS fully_covered FROM cov GROUP BY k HAVING sum(n0) > 0")
def interval_cover(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.covered(_spans(spark, sf, True), _spans(spark, sf, False), ["k"])


@query("interval_segments", f'WITH {_IV} SELECT k, a AS "start", b AS "end", CAST(n0 + n1 AS BIGINT) AS active FROM cov WHERE n0 + n1 > 0')
def interval_segments(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.segments(_spans(spark, sf), ["k"])


@query(
    "overlap_join",
    f"WITH {P.LC} SELECT x.s, x.o AS o, y.o AS other, greatest(x.cdate, y.cdate) AS i_start, nullif(least(coalesce(x.ddate, {FAR}), coalesce(y.ddate, {FAR})), {FAR}) AS i_end "
    f"FROM lc x JOIN lc y ON x.s = y.s AND x.p = 'wdt:P1' AND y.p = 'wdt:P2' AND x.cdate < coalesce(y.ddate, {FAR}) AND y.cdate < coalesce(x.ddate, {FAR})",
)
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    lc = P.lifecycles(spark, sf).select("s", "p", "o", F.col("cdate").alias("start"), F.col("ddate").alias("end"))
    a, b = lc.where("p = 'wdt:P1'").drop("p"), lc.where("p = 'wdt:P2'").select("s", F.col("o").alias("other"), "start", "end")
    return intervals.overlap_join(a, b, ["s"]).select("s", "o", "other", "i_start", "i_end")


_REACH = P.EDGE.replace("edge AS", "RECURSIVE edge AS", 1) + """,
reach AS (
  SELECT child, parent, a, b FROM edge
  UNION SELECT r.child, e.parent, greatest(r.a, e.a), least(r.b, e.b) FROM reach r JOIN edge e ON r.parent = e.child AND greatest(r.a, e.a) < least(r.b, e.b)
),
g AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY child, parent ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM reach),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY child, parent ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g),
cl AS (SELECT child, parent, min(a) AS a, max(b) AS b FROM h GROUP BY child, parent, island)"""


@query("temporal_closure", f'WITH {_REACH} SELECT child, parent, a AS "start", b AS "end" FROM cl')
def temporal_closure(spark: SparkSession, sf: str) -> DataFrame:
    return closure.temporal_closure(P.edges(spark, sf))


_TYPES = _REACH + """,
st AS (SELECT s_suppkey AS s, s_nationkey AS o, TIMESTAMP '2020-01-01' + to_days(CAST(s_suppkey % 17 AS INTEGER)) AS a, TIMESTAMP '2020-01-01' + to_days(CAST(s_suppkey % 17 + 15 AS INTEGER)) AS b FROM supplier),
me AS (SELECT s_suppkey AS s, s_suppkey AS class, TIMESTAMP '2020-01-04' AS a, TIMESTAMP '2020-01-28' AS b FROM supplier),
co AS (SELECT * FROM (VALUES (1, TIMESTAMP '2020-01-03', TIMESTAMP '2020-01-20'), (3, TIMESTAMP '2020-01-15', TIMESTAMP '2020-02-10')) AS c(class, a, b)),
ask AS (SELECT cl.child AS class, greatest(cl.a, co.a) AS a, least(cl.b, co.b) AS b FROM cl JOIN co ON cl.parent = co.class AND greatest(cl.a, co.a) < least(cl.b, co.b) UNION ALL SELECT class, a, b FROM co),
wi AS (SELECT me.s, greatest(me.a, ask.a) AS a, least(me.b, ask.b) AS b FROM me JOIN ask ON me.class = ask.class AND greatest(me.a, ask.a) < least(me.b, ask.b)),
pt AS (SELECT s, o, a AS t FROM st UNION SELECT s, o, b FROM st UNION SELECT st.s, o, wi.a FROM st JOIN wi USING (s) UNION SELECT st.s, o, wi.b FROM st JOIN wi USING (s)
  UNION SELECT s, o, co.a FROM st, co UNION SELECT s, o, co.b FROM st, co),
sg AS (SELECT s, o, t AS a, lead(t) OVER (PARTITION BY s, o ORDER BY t) AS b FROM pt),
fl AS (
  SELECT s, o, a, b, EXISTS (SELECT 1 FROM wi WHERE wi.s = sg.s AND wi.a <= sg.a AND sg.b <= wi.b) AS ok FROM sg
  WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM st WHERE st.s = sg.s AND st.o = sg.o AND st.a <= sg.a AND sg.b <= st.b) AND EXISTS (SELECT 1 FROM co WHERE co.a <= sg.a AND sg.b <= co.b)
),
fg AS (SELECT *, CASE WHEN a > lag(b) OVER (PARTITION BY s, o, ok ORDER BY a) THEN 1 ELSE 0 END AS fresh2 FROM fl),
fh AS (SELECT *, sum(fresh2) OVER (PARTITION BY s, o, ok ORDER BY a ROWS UNBOUNDED PRECEDING) AS isl FROM fg)
SELECT s, o, ok AS valid, min(a) AS "start", max(b) AS "end" FROM fh GROUP BY s, o, ok, isl"""


@query("subject_type_intervals", f"WITH {_TYPES}")
def subject_type_intervals(spark: SparkSession, sf: str) -> DataFrame:
    s = P.table(spark, sf, "supplier")
    day = "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(CAST(s_suppkey % 17 AS INT)"
    st = s.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("o"), F.expr(day + ")").alias("start"), F.expr(day + " + 15)").alias("end"))
    me = s.select(F.col("s_suppkey").alias("s"), F.col("s_suppkey").alias("class"), F.expr("TIMESTAMP_NTZ '2020-01-04 00:00:00'").alias("start"), F.expr("TIMESTAMP_NTZ '2020-01-28 00:00:00'").alias("end"))
    co = spark.sql(
        "SELECT CAST(c AS BIGINT) AS class, CAST(a AS TIMESTAMP_NTZ) AS start, CAST(b AS TIMESTAMP_NTZ) AS end FROM VALUES (1, '2020-01-03', '2020-01-20'), (3, '2020-01-15', '2020-02-10') AS x(c, a, b)"
    )
    valid, broken = closure.subject_type_check(st, me, co, closure.temporal_closure(P.edges(spark, sf)))
    return valid.withColumn("valid", F.lit(True)).unionByName(broken.withColumn("valid", F.lit(False)))


def _levels(cte: str, status: str) -> str:
    """SQL of a validator: `status` for level 'p' (all entries) and 'c' (the row's own constraint)."""
    return f"""WITH {P.CON}, lv AS (SELECT cor.*, l.lvl FROM cor, (VALUES ('p'), ('c')) AS l(lvl)), {cte},
    fin AS (SELECT row_id, lvl, {status} AS status FROM lv)
    SELECT row_id, max(status) FILTER (lvl = 'p') AS historical_status_property_level, max(status) FILTER (lvl = 'c') AS historical_status_constraint_id_level FROM fin GROUP BY row_id"""


_WD = "CASE WHEN p LIKE 'wdt:%' THEN 'wd:' || substr(p, 5) END"
_ENT = """ent AS (
  SELECT row_id, lvl, lv.s, lv.o, lv.p, cid, {cols}, greatest(a, st) AS st, least(b, en) AS en FROM lv JOIN grid ON p = 'wdt:P1' AND (lvl = 'p' OR cid = constraint_id)
  WHERE greatest(a, st) < least(b, en){more}
),
fre AS (SELECT row_id, lvl, greatest(a, st) AS st, least(b, en) AS en FROM lv JOIN exc ON p = 'wdt:P1' AND entity = s AND (lvl = 'p' OR cid = constraint_id) WHERE greatest(a, st) < least(b, en))"""
_HAS = "EXISTS (SELECT 1 FROM grid WHERE lvl = 'p' OR cid = constraint_id)"

_ONE_OF = _levels(
    _ENT.format(cols="'wd:' || event_type AS entity", more="")
    + """,
    pts AS (SELECT row_id, lvl, st AS t FROM ent UNION SELECT row_id, lvl, en FROM ent UNION SELECT row_id, lvl, st FROM fre UNION SELECT row_id, lvl, en FROM fre),
    sg AS (SELECT row_id, lvl, t AS a, lead(t) OVER (PARTITION BY row_id, lvl ORDER BY t) AS b FROM pts),
    hd AS (SELECT sg.row_id, sg.lvl, sg.a, sg.b, bool_or(ent.entity = ent.o) AS listed FROM sg JOIN ent ON ent.row_id = sg.row_id AND ent.lvl = sg.lvl AND ent.st <= sg.a AND sg.b <= ent.en GROUP BY ALL),
    fx AS (SELECT hd.*, EXISTS (SELECT 1 FROM fre WHERE fre.row_id = hd.row_id AND fre.lvl = hd.lvl AND fre.st <= hd.a AND hd.b <= fre.en) AS freed FROM hd),
    sm AS (SELECT row_id AS r, lvl AS l, bool_or(NOT freed AND {bad}) AS bad, bool_or(freed) AS exd FROM fx GROUP BY ALL)""",
    f"""CASE WHEN match_status <> 'found' THEN 'no_historical_row' WHEN {_WD} IS NULL THEN 'non_wdt_property' WHEN p <> 'wdt:P1' THEN 'no_constraint_for_property'
    WHEN NOT {_HAS} THEN 'no_constraint_for_property_instance'
    ELSE coalesce((SELECT CASE WHEN bad THEN 'historical_violation' WHEN exd THEN 'not_violation_exception' ELSE 'not_violation_object_allowed' END FROM sm WHERE r = row_id AND l = lvl), 'no_constraint_lifecycle_intersection') END""",
)

_REST = """,
    rpt AS (SELECT row_id, lvl, cid, need, v, t FROM (
      SELECT row_id, lvl, cid, need, v, st AS t FROM ent UNION SELECT row_id, lvl, cid, need, v, en FROM ent
      UNION SELECT ent.row_id, ent.lvl, cid, need, v, fre.st FROM ent JOIN fre USING (row_id, lvl) UNION SELECT ent.row_id, ent.lvl, cid, need, v, fre.en FROM ent JOIN fre USING (row_id, lvl)
      UNION SELECT ent.row_id, ent.lvl, cid, need, v, wit.a FROM ent JOIN wit ON {who} = wit.s AND wit.p = need UNION SELECT ent.row_id, ent.lvl, cid, need, v, wit.b FROM ent JOIN wit ON {who} = wit.s AND wit.p = need
      {extra})),
    rsg AS (SELECT row_id, lvl, cid, need, v, t AS a, lead(t) OVER (PARTITION BY row_id, lvl, cid, need, v ORDER BY t) AS b FROM rpt),
    req AS (
      SELECT r.row_id, r.lvl, r.cid, r.need, r.v, ent.s, ent.o, r.a, r.b FROM rsg r
      JOIN ent ON ent.row_id = r.row_id AND ent.lvl = r.lvl AND ent.cid = r.cid AND ent.need = r.need AND ent.v IS NOT DISTINCT FROM r.v AND ent.st <= r.a AND r.b <= ent.en
      WHERE NOT EXISTS (SELECT 1 FROM fre WHERE fre.row_id = r.row_id AND fre.lvl = r.lvl AND fre.st <= r.a AND r.b <= fre.en)
    ),
    bad AS ({bad})"""


def _covering(good: str) -> str:
    return f"""CASE WHEN match_status <> 'found' THEN 'no_historical_row' WHEN {_WD} IS NULL THEN 'non_wdt_property' WHEN p <> 'wdt:P1' THEN 'no_constraint_for_property'
    WHEN a >= b THEN 'invalid_dates' WHEN NOT {_HAS} THEN 'no_constraint_for_property_instance'
    WHEN (row_id, lvl) NOT IN (SELECT row_id, lvl FROM ent) THEN 'no_constraint_lifecycle_intersection'
    WHEN (row_id, lvl) NOT IN (SELECT row_id, lvl FROM req) THEN 'not_violation_exception'
    WHEN (row_id, lvl) IN (SELECT row_id, lvl FROM bad) THEN 'historical_violation' ELSE '{good}' END"""


_NO_WITNESS = "SELECT row_id, lvl FROM req WHERE NOT EXISTS (SELECT 1 FROM wit WHERE {who} = wit.s AND wit.p = need AND wit.o = {what} AND wit.a <= req.a AND req.b <= wit.b)"
_ANY = """SELECT row_id, lvl FROM (
    SELECT row_id, lvl, cid, need, a, b, {who} AS who, bool_or(v IS NULL) AS anyv, list(v) AS vs FROM req GROUP BY ALL) q
    WHERE NOT EXISTS (SELECT 1 FROM wit WHERE wit.s = who AND wit.p = need AND wit.a <= q.a AND q.b <= wit.b AND (anyv OR list_contains(vs, wit.o)))"""
#: Values of one group share their event points, so that a segment means the same for each.
_SHARED = """UNION SELECT x.row_id, x.lvl, x.cid, x.need, x.v, y.st FROM ent x JOIN ent y ON x.row_id = y.row_id AND x.lvl = y.lvl AND x.cid = y.cid AND x.need = y.need
      UNION SELECT x.row_id, x.lvl, x.cid, x.need, x.v, y.en FROM ent x JOIN ent y ON x.row_id = y.row_id AND x.lvl = y.lvl AND x.cid = y.cid AND x.need = y.need"""

_VALIDATORS = {
    "one_of": _ONE_OF.replace("{bad}", "NOT listed"),
    "none_of": _ONE_OF.replace("{bad}", "listed"),
    "conflicts_with": _levels(
        _ENT.format(cols="'wdt:P2' AS need, CASE WHEN i <> 3 THEN v END AS v", more="")
        + _REST.format(who="ent.s", extra="", bad="SELECT row_id, lvl FROM req WHERE EXISTS (SELECT 1 FROM wit WHERE wit.s = req.s AND wit.p = need AND wit.o = v AND greatest(wit.a, req.a) < least(wit.b, req.b))"),
        _covering("not_violation_no_conflicting_statement"),
    ),
    "inverse": _levels(
        _ENT.format(cols="'wdt:P3' AS need, NULL::VARCHAR AS v", more="") + _REST.format(who="ent.o", extra="", bad=_NO_WITNESS.format(who="req.o", what="req.s")),
        _covering("not_violation_inverse_covers_required_lifecycle"),
    ),
    "symmetric": _levels(
        _ENT.format(cols="p AS need, NULL::VARCHAR AS v", more="") + _REST.format(who="ent.o", extra="", bad=_NO_WITNESS.format(who="req.o", what="req.s")),
        _covering("not_violation_reverse_covers_required_lifecycle"),
    ),
    "item_requires_statement": _levels(
        _ENT.format(cols="'wdt:P2' AS need, CASE WHEN k <> 1 THEN v END AS v", more="") + _REST.format(who="ent.s", extra=_SHARED, bad=_ANY.format(who="s")),
        _covering("not_violation_required_statement_covers_required_lifecycle"),
    ),
    "value_requires_statement": _levels(
        _ENT.format(cols="'wdt:P4' AS need, CASE WHEN k <> 1 THEN v END AS v", more="") + _REST.format(who="ent.o", extra=_SHARED, bad=_ANY.format(who="o")),
        _covering("not_violation_required_statement_covers_required_lifecycle"),
    ),
}


def _validated(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if kind in ("one_of", "none_of"):
            return validators.validate(kind, P.corrections(spark, sf), P.entries(spark, sf, kind))
        lc = cut_lineage(P.lifecycles(spark, sf).select("s", "p", "o", "cdate", "ddate"))  # read as both
        return validators.validate(kind, P.corrections(spark, sf, lc), P.entries(spark, sf, kind), P.witnesses(spark, sf, lc))

    return run


for _kind, _sql in _VALIDATORS.items():
    query(f"validate_{_kind}", _sql)(_validated(_kind))


@query(
    "validation_summary",
    f"""SELECT 'property_level' AS level, historical_status_property_level AS status, count(*) AS n FROM ({_VALIDATORS['one_of']}) GROUP BY ALL
    UNION ALL SELECT 'constraint_id_level', historical_status_constraint_id_level, count(*) FROM ({_VALIDATORS['one_of']}) GROUP BY ALL""",
)
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validators.summary(_validated("one_of")(spark, sf))


_ASKED = """ask AS (
  SELECT 'r' || CAST(user_id AS VARCHAR) AS row_id, 'wd:Q' || CAST(user_id AS VARCHAR) AS s, 'wdt:P1' AS p, 'wd:' || max(event_type) AS o FROM events GROUP BY user_id
  UNION ALL SELECT 'x' || CAST(user_id AS VARCHAR), 'wd:Q' || CAST(user_id AS VARCHAR), 'wdt:P1', 'wd:none' FROM events GROUP BY user_id
)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    u = P.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("u")).agg(F.max("event_type").alias("t"))
    row = lambda mark, o: u.select(F.concat(F.lit(mark), "u").alias("row_id"), F.concat(F.lit("wd:Q"), "u").alias("s"), F.lit("wdt:P1").alias("p"), o.alias("o"))
    return row("r", F.concat(F.lit(" wd:"), "t")).unionByName(row("x", F.lit("wd:none")))


_ENRICHED = f"""WITH {P.LC}, {_ASKED}
SELECT row_id, s, p, ask.o, cdate, cuser, ddate, duser, CASE WHEN cdate IS NULL THEN 'not_found' ELSE 'found' END AS match_status FROM ask LEFT JOIN lc USING (s, p, o)"""


@query("enrich_exact", _ENRICHED)
def enrich_exact(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_exact(_asked(spark, sf), P.lifecycles(spark, sf))


_FORMS = f"""WITH {P.LC},
h AS (SELECT *, CASE p WHEN 'wdt:P1' THEN repeat('"', 3) || substr(o, 4) || repeat('"', 3) ELSE '"0' || substr(o, 5) || '.50"^^http://example.org/x#decimal' END AS ho FROM lc),
u AS (SELECT 'wd:Q' || CAST(user_id AS VARCHAR) AS s, max(event_type) AS t, max(CAST(floor(value / 100) AS BIGINT)) AS b FROM events GROUP BY user_id),
ask AS (
  SELECT s, 'wdt:P1' AS p, 'wd:' || t AS k, '\\u00' || lower(hex(t[1])) || substr(t, 2) AS o FROM u
  UNION ALL SELECT s, 'wdt:P2', 'wd:B' || b, '{{"amount":"+' || b || '.5","unit":"1"}}' FROM u
  UNION ALL SELECT s, 'wdt:P2', 'none', '7.25' FROM u
)
SELECT ask.s || '|' || ask.o AS row_id, ask.s, ask.p, ask.o, ho AS matched_history_o, cdate, cuser, ddate, duser, CASE WHEN cdate IS NULL THEN 'not_found' ELSE 'found' END AS match_status
FROM ask LEFT JOIN h ON h.s = ask.s AND h.p = ask.p AND h.o = ask.k"""


@query("enrich_normalised", _FORMS)
def enrich_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted texts and typed decimals in the history; escapes and JSON amounts in the corrections."""
    lc, e = P.lifecycles(spark, sf), P.table(spark, sf, "events")
    typed = F.concat(F.lit('"0'), F.substring("o", 5, 20), F.lit('.50"^^http://example.org/x#decimal'))
    history = lc.withColumn("o", F.when(F.col("p") == "wdt:P1", F.concat(F.lit('"""'), F.substring("o", 4, 99), F.lit('"""'))).otherwise(typed))
    u = e.groupBy(F.concat(F.lit("wd:Q"), F.col("user_id").cast("string")).alias("s")).agg(F.max("event_type").alias("t"), F.max(F.floor(F.col("value") / 100)).cast("string").alias("b"))
    escaped = F.concat(F.lit("\\u00"), F.lower(F.hex(F.substring("t", 1, 1))), F.substring("t", 2, 99))
    forms = {"wdt:P1": (escaped,), "wdt:P2": (F.concat(F.lit('{"amount":"+'), "b", F.lit('.5","unit":"1"}')), F.lit("7.25"))}
    asked = None
    for p, objects in forms.items():
        for o in objects:
            own = u.select("s", F.lit(p).alias("p"), o.alias("o")).withColumn("row_id", F.concat("s", F.lit("|"), "o"))
            asked = own if asked is None else asked.union(own)
    return enrich.enrich_normalised(asked, history).select("row_id", "s", "p", "o", "matched_history_o", "cdate", "cuser", "ddate", "duser", "match_status")


@query(
    "creator_deleter_matrix",
    f"""WITH {P.GOV}, k AS (SELECT CASE WHEN CAST("user" AS BIGINT) % 5 = 0 THEN 'bot' ELSE 'human' END AS creator, CASE WHEN CAST(duser AS BIGINT) % 5 = 0 THEN 'bot' ELSE 'human' END AS deleter FROM gov WHERE ddate IS NOT NULL)
    SELECT c.creator, count(*) FILTER (deleter = 'bot') AS bot, count(*) FILTER (deleter = 'human') AS human FROM (VALUES ('bot'), ('human')) AS c(creator) LEFT JOIN k USING (creator) GROUP BY c.creator""",
)
def creator_deleter_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.governance_rows(spark, sf).where("ddate is not null")
    bot = lambda c: F.col(c).cast("long") % 5 == 0
    return governance.creator_deleter_matrix(rows.select(bot("user").alias("creator_bot"), bot("duser").alias("deleter_bot")))


@query(
    "period_rolling",
    f"""WITH {P.GOV}, n AS (SELECT date_trunc('day', cdate) AS period, constraint_type, count(*) AS n FROM gov GROUP BY ALL), tp AS (SELECT constraint_type FROM n GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 5),
    g AS (SELECT p.period, tp.constraint_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT period FROM n) p CROSS JOIN tp LEFT JOIN n ON n.period = p.period AND n.constraint_type = tp.constraint_type)
    SELECT period, constraint_type, round(avg(n) OVER (PARTITION BY constraint_type ORDER BY period ROWS 2 PRECEDING), 6) AS rolling FROM g""",
)
def period_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """A column for each of the five main types, whatever they are, and these columns as rows again."""
    rows = P.governance_rows(spark, sf)
    labels = governance.top_labels(rows, "constraint_type", 5)
    pivoted = governance.period_pivot(rows, "cdate", "constraint_type", labels, "day")
    rolled = governance.rolling_mean(pivoted.withColumn("period", F.col("period").cast("timestamp_ntz")), labels)
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("constraint_type"), F.round(F.col(f"`{x}_rolling`"), 6).alias("rolling")) for x in labels)))
    return rolled.select("period", pairs.alias("x")).select("period", "x.*")


_DOM = """t AS (SELECT "user", constraint_type, count(*) AS n FROM gov GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, constraint_type) AS r, sum(n) OVER (PARTITION BY "user") AS total FROM t),
g AS (SELECT "user", target, count(*) AS n FROM gov GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, target) AS r, sum(n) OVER (PARTITION BY "user") AS total FROM g),
us AS (
  SELECT tr."user", CAST(tr.total AS BIGINT) AS total, tr.constraint_type AS type, tr.n / tr.total AS ts, gr.target, gr.n / gr.total AS gs FROM tr JOIN gr ON tr."user" = gr."user" AND tr.r = 1 AND gr.r = 1 WHERE tr.total >= 20
)"""


@query(
    "user_specialization",
    f"""WITH {P.GOV}, {_DOM} SELECT "user", total, type, round(ts, 6) AS type_share, target, round(gs, 6) AS target_share,
    CASE WHEN ts >= 0.25 AND gs >= 0.25 THEN 'dual' WHEN ts >= 0.25 THEN 'type' WHEN gs >= 0.25 THEN 'target' ELSE 'generalist' END AS kind FROM us""",
)
def user_specialization(spark: SparkSession, sf: str) -> DataFrame:
    u = governance.user_specialization(P.governance_rows(spark, sf), 20, 0.25)
    return u.withColumns({"type_share": F.round("type_share", 6), "target_share": F.round("target_share", 6)})


@query(
    "specialization_cutoffs",
    f"WITH {P.GOV}, {_DOM} SELECT cut, count(*) FILTER (ts >= cut) AS n, round(count(*) FILTER (ts >= cut) / count(*), 6) AS share FROM us, (VALUES (0.1::DOUBLE), (0.15), (0.2), (0.25)) AS c(cut) GROUP BY cut",
)
def specialization_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    u = governance.user_specialization(P.governance_rows(spark, sf), 20, 0.25)
    return governance.cutoff_counts(u, "type_share", [0.1, 0.15, 0.2, 0.25]).withColumn("share", F.round("share", 6))


@query(
    "participation_classes",
    f"""WITH {P.GOV}, st AS (SELECT DISTINCT s AS statement FROM gov), n AS (
      SELECT statement, count(DISTINCT "user") AS c FROM st LEFT JOIN gov ON s = statement AND action = 'qualifier' GROUP BY statement
    ), k AS (SELECT CASE c WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_or_more' END AS participation FROM n)
    SELECT participation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY participation""",
)
def participation_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.governance_rows(spark, sf).withColumnRenamed("s", "statement")
    found = governance.participation(rows, rows.where("action = 'qualifier'"))
    return governance.value_counts(found, "participation").withColumn("share", F.round("share", 6))


@query(
    "role_shares",
    f"""WITH {P.GOV}, n AS (SELECT "user", count(*) AS total, count(*) FILTER (action = 'creation') AS c, count(*) FILTER (action = 'qualifier') AS q, count(*) FILTER (action = 'rank') AS r FROM gov GROUP BY 1)
    SELECT "user", total, round(c / total, 6) AS creation_share, round(q / total, 6) AS qualifier_share, round(r / total, 6) AS rank_share,
    CASE WHEN c / total >= 0.5 THEN 'creation-focused' WHEN q / total >= 0.5 THEN 'qualifier-focused' WHEN r / total >= 0.5 THEN 'rank-focused' ELSE 'mixed' END AS role FROM n WHERE total >= 20""",
)
def role_shares(spark: SparkSession, sf: str) -> DataFrame:
    r = governance.role_shares(P.governance_rows(spark, sf), 20, 0.5)
    return r.withColumns({f"{a}_share": F.round(f"{a}_share", 6) for a in ("creation", "qualifier", "rank")})


@query(
    "later_window_sweep",
    f"""WITH {P.GOV}, c AS (SELECT s, min(cdate) AS cdate FROM gov GROUP BY s), q AS (SELECT s, cdate AS qc FROM gov WHERE action = 'qualifier'),
    m AS (SELECT w, c.s, count(*) FILTER (epoch_us(qc) - epoch_us(c.cdate) > w * 86400000000) AS later FROM c LEFT JOIN q USING (s), (VALUES (0), (1), (7), (30)) AS x(w) GROUP BY ALL)
    SELECT CAST(w AS BIGINT) AS "window", count(*) AS n_constraints, round(avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_with_later_qualifier, quantile_cont(later, 0.5) AS median_later_qualifier_rows,
    round(quantile_cont(later, 0.75), 6) AS p75_later_qualifier_rows, round(quantile_cont(later, 0.9), 6) AS p90_later_qualifier_rows, round(quantile_cont(later, 0.95), 6) AS p95_later_qualifier_rows FROM m GROUP BY w""",
)
def later_window_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.governance_rows(spark, sf)
    first = rows.groupBy("s").agg(F.min("cdate").alias("cdate")).withColumn("ddate", F.lit(None).cast("timestamp"))
    stable = governance.stability(first, rows.where("action = 'qualifier'").select("s", "cdate", "ddate"), governance.days(spark, [0, 1, 7, 30]))
    out = governance.window_sweep(stable)
    return out.select("window", "n_constraints", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query(
    "type_concentration",
    f"""WITH {P.GOV}, t AS (SELECT constraint_type, "user", count(*) AS n FROM gov GROUP BY ALL), r AS (
      SELECT *, row_number() OVER (PARTITION BY constraint_type ORDER BY n DESC, "user") AS place, sum(n) OVER (PARTITION BY constraint_type) AS total, count(*) FILTER ("user" IS NOT NULL) OVER (PARTITION BY constraint_type) AS n_users FROM t)
    SELECT constraint_type, CAST(total AS BIGINT) AS total, n_users, "user", round(n / total, 6) AS user_share FROM r WHERE place = 1 AND total >= 100""",
)
def type_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return governance.type_concentration(P.governance_rows(spark, sf), 100).withColumn("user_share", F.round("user_share", 6))


@query(
    "co_participation",
    f"""WITH {P.GOV}, o AS (SELECT DISTINCT "user", constraint_type FROM gov WHERE p = 'wdt:P2')
    SELECT a."user" AS user_1, b."user" AS user_2, count(*) AS shared FROM o a JOIN o b ON a.constraint_type = b.constraint_type AND a."user" < b."user" GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def co_participation(spark: SparkSession, sf: str) -> DataFrame:
    return governance.co_participation(P.governance_rows(spark, sf).where("p = 'wdt:P2'"), 3)


@query(
    "describe_durations",
    f"""WITH {P.LC}, d AS (SELECT (epoch_us(ddate) - epoch_us(cdate)) / 86400000000.0 AS x FROM lc WHERE ddate IS NOT NULL)
    SELECT count(x) AS "count", round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS "min", round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS "max" FROM d""",
)
def describe_durations(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.expr("unix_micros(CAST(ddate AS TIMESTAMP))") - F.expr("unix_micros(CAST(cdate AS TIMESTAMP))")) / 86_400_000_000.0
    d = governance.describe(P.lifecycles(spark, sf).where("ddate is not null").select(x.alias("x")), "x")
    return d.select("count", *(F.round(c, 6).alias(c) for c in d.columns[1:]))


@query(
    "actor_flags",
    """WITH u AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN s_name || 'Bot' WHEN s_suppkey % 4 = 1 THEN '10.0.0.' || CAST(s_suppkey % 256 AS VARCHAR) ELSE s_name END AS "user" FROM supplier)
    SELECT "user", "user" LIKE '10.0.0.%' AS is_ip, "user" LIKE '%Bot' AS is_bot FROM u""",
)
def actor_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat("s_name", F.lit("Bot"))).when(k % 4 == 1, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).otherwise(F.col("s_name"))
    return with_flags(P.table(spark, sf, "supplier").select(name.alias("user")))
