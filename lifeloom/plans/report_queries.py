"""Queries of report tables: candidates, summaries, drill-downs, mixes, creations over time, rates by type, factors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.operators import factors, governance, reports
from lifeloom.operators import specialists as S
from lifeloom.operators import sweeps
from lifeloom.plans import projections as P
from lifeloom.plans import specialist_queries as Q
from lifeloom.plans.catalogue import oracle_text, query
from lifeloom.session import scratch_folder

rounded = Q.rounded

_COLUMNS = ("rows", "users", "properties", "total_edits")


@query(
    "funnel_report",
    f"""WITH fun AS ({oracle_text('filter_funnel')}), b AS (SELECT * FROM fun WHERE stage = 'raw')
    SELECT fun.*, {", ".join(f'b."{c}" - fun."{c}" AS {c}_removed, round(100 * (b."{c}" - fun."{c}") / b."{c}", 6) AS {c}_removed_pct' for c in _COLUMNS)} FROM fun, b""",
)
def funnel_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.with_removed(Q.filter_funnel(spark, sf)))


@query("ablation_report", f"SELECT *, round(100 * change / before, 6) AS pct_change FROM ({oracle_text('ablation')})")
def ablation_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.with_pct_change(Q.ablation(spark, sf)))


@query(
    "specialist_candidates",
    Q.with_total(
        Q._TFIDF
        + """, l AS (SELECT "user", property, (n / sum(n) OVER (PARTITION BY "user")) / (sum(n) OVER (PARTITION BY property) / (SELECT sum(n) FROM upc)) AS lift FROM upc),
    a AS (SELECT "user", property, score, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, property) AS r FROM t),
    c AS (SELECT "user", property, lift, row_number() OVER (PARTITION BY "user" ORDER BY round(lift, 9) DESC, property) AS r FROM l),
    s AS (SELECT "user", n, n / sum(n) OVER (PARTITION BY "user") AS p FROM upc), e AS (SELECT "user", CAST(sum(n) AS BIGINT) AS total_edits, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits FROM s GROUP BY 1)
    SELECT "user", round(score, 6) AS max_tfidf, a.property AS top_property_by_tfidf, c.property AS top_lift_property, round(lift, 6) AS top_lift_value, entropy_bits, total_edits
    FROM e JOIN a USING ("user") JOIN c USING ("user") WHERE a.r = 1 AND c.r = 1 AND total_edits >= 30"""
    ),
)
def specialist_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.candidates(P.user_properties(spark, sf), 30))


@query("idf", Q.with_total(Q._TFIDF + " SELECT property, round(idf, 6) AS idf FROM d"))
def idf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.tfidf(P.user_properties(spark, sf)).groupBy("property").agg(F.max("idf").alias("idf")))


@query(
    "portfolio_summary",
    f"""WITH p AS ({oracle_text('owned_portfolio')}) SELECT kind, count(*) AS n_users, round(median(owned_edit_fraction), 6) AS median_owned_edit_fraction, median(total_owned_edits) AS median_total_owned_edits,
    round(median(mean_property_share), 6) AS median_mean_property_share FROM p GROUP BY kind""",
)
def portfolio_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.kind_summary(Q.owned_portfolio(spark, sf)))


@query("top_leaders", f"SELECT * FROM ({oracle_text('domination_leaders')}) ORDER BY domination_score DESC, property LIMIT 10")
def top_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return reports.head(Q.domination_leaders(spark, sf), [F.desc("domination_score"), "property"], 10)


_PROFILES = f"""WITH {Q._KL}, {Q._PROFILE.replace("b AS (SELECT *", "pb AS (SELECT *", 1).replace("FROM b GROUP BY", "FROM pb GROUP BY")},
    q AS (SELECT quantile_cont(max_class_share, 0.5) AS p50, quantile_cont(max_class_share, 0.9) AS p90 FROM pf),
    ty AS (SELECT "user", total_edits, CASE WHEN max_class_share >= p90 AND active_classes <= 3 THEN 'A' WHEN max_class_share >= p50 AND max_class_share < p90 AND active_classes BETWEEN 4 AND 15 THEN 'B'
      WHEN max_class_share < 0.6 AND active_classes >= 16 THEN 'C' ELSE 'Other' END AS profile FROM pf, q),
    sc AS (SELECT ty.*, v FROM ty JOIN kl USING ("user") WHERE baseline = 'edits' AND min_edits = 30 AND alpha = 0.5)"""


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_classes(spark, sf)
    edits = counts.groupBy("class").agg(F.sum("edit_count").cast("double").alias("mass"))
    kl = S.smoothed_kl(counts, edits, 0.5, 30, 2)
    return S.typology(S.class_profile(counts)).join(kl, "user")


@query("profile_mix", _PROFILES + """, tp AS (SELECT * FROM sc ORDER BY round(v, 9) DESC, total_edits DESC, "user" LIMIT 100) SELECT profile, count(*) AS n, round(count(*) / 100, 6) AS pct FROM tp GROUP BY 1""")
def profile_mix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.profile_mix(_profiled(spark, sf), "kl_divergence_smoothed"))


@query(
    "profile_examples",
    _PROFILES + """, ex AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(v, 9) DESC, total_edits DESC, "user") AS place FROM sc WHERE profile <> 'Other')
    SELECT profile, "user", round(v, 6) AS kl_divergence_smoothed, total_edits, CAST(place AS INTEGER) AS place FROM ex WHERE place <= 3""",
)
def profile_examples(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.profile_examples(_profiled(spark, sf), "kl_divergence_smoothed")
    return rounded(found.select("profile", "user", "kl_divergence_smoothed", "total_edits", "place"))


@query(
    "user_drill_down",
    f"""WITH {P.UCL}, ask AS (SELECT 'u' || CAST(o_custkey AS VARCHAR) AS "user" FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, "user" LIMIT 5),
    r AS (SELECT *, n / sum(n) OVER (PARTITION BY "user") AS sh, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, class) AS place FROM ucl WHERE "user" IN (SELECT "user" FROM ask))
    SELECT "user", class, n AS edit_count, round(sh, 6) AS class_share, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""",
)
def user_drill_down(spark: SparkSession, sf: str) -> DataFrame:
    """The classes of the five customers who pay most."""
    paid = P.table(spark, sf, "orders").groupBy(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user")).agg(F.sum("o_totalprice").alias("paid"))
    return rounded(reports.drill_down(P.user_classes(spark, sf), reports.head(paid, [F.desc("paid"), "user"], 5)))


@query(
    "monthly_class_activity",
    """WITH r AS (SELECT date_trunc('month', l_shipdate) AS period, 'c' || CAST(p_size AS VARCHAR) AS class, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    tp AS (SELECT class FROM r GROUP BY class ORDER BY sum(n) DESC, class LIMIT 8) SELECT period, class, n FROM r SEMI JOIN tp USING (class)""",
)
def monthly_class_activity(spark: SparkSession, sf: str) -> DataFrame:
    l, p = P.table(spark, sf, "lineitem"), P.table(spark, sf, "part")
    rows = l.select("l_partkey", "l_shipdate").join(p.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return reports.period_activity(rows.select("l_shipdate", F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("class")), "l_shipdate", "class")


@query(
    "kl_merged_scores",
    f"""WITH {Q._KL} SELECT alpha, "user", round(x.v, 6) AS kl_one, round(y.v, 6) AS kl_other FROM kl x JOIN kl y USING (alpha, "user") WHERE x.min_edits = 30 AND y.min_edits = 30 AND x.baseline = 'edits' AND y.baseline = 'instances'""",
)
def kl_merged_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.merged_scores(Q._swept(spark, sf), "edits", "instances", 30))


_CURATED = "cu AS (SELECT 'wd:' || event_type AS constraint_type FROM events GROUP BY event_type HAVING avg(value) > (SELECT avg(value) FROM events))"


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    """Types of events whose mean value is above that of all events."""
    e = P.table(spark, sf, "events")
    own = e.groupBy("event_type").agg(F.avg("value").alias("own")).crossJoin(F.broadcast(e.agg(F.avg("value").alias("all"))))  # one row
    return own.where("own > all").select(F.concat(F.lit("wd:"), F.col("event_type")).alias("constraint_type"))


def _user_flags(spark: SparkSession, sf: str) -> DataFrame:
    u = P.governance_rows(spark, sf).select("user").where("user is not null").distinct()
    n = F.col("user").cast("long")
    return u.select("user", (n % 7 == 0).alias("is_ip"), (n % 5 == 0).alias("is_bot"))


_ROLLED = """SELECT period, constraint_type, n, round(avg(n) OVER (PARTITION BY constraint_type ORDER BY period ROWS 2 PRECEDING), 6) AS rolling FROM (
    SELECT pe.period, tp.constraint_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT period FROM r SEMI JOIN tp USING (constraint_type)) pe CROSS JOIN tp LEFT JOIN r ON r.period = pe.period AND r.constraint_type = tp.constraint_type)"""


@query(
    "creations_rolling",
    f"""WITH {P.GOV}, r AS (SELECT date_trunc('day', cdate) AS period, constraint_type, count(*) AS n FROM gov GROUP BY ALL),
    tp AS (SELECT constraint_type FROM r GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 4) {_ROLLED}""",
)
def creations_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """The four main types by day, whatever they are."""
    rows = reports.creations(P.governance_rows(spark, sf))
    return rounded(reports.rolling_activity(reports.period_activity(rows, "cdate", "constraint_type", k=4, unit="day"), "constraint_type"))


@query(
    "active_creations",
    f"""WITH {P.GOV}, {_CURATED}, r AS (SELECT date_trunc('day', cdate) AS period, constraint_type, count(*) AS n FROM gov SEMI JOIN cu USING (constraint_type) WHERE ddate IS NULL GROUP BY ALL),
    tp AS (SELECT constraint_type FROM r GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 12) {_ROLLED}""",
)
def active_creations(spark: SparkSession, sf: str) -> DataFrame:
    """Creations of curated types that are still there."""
    rows = reports.creations(P.governance_rows(spark, sf), _curated(spark, sf), still_active=True)
    return rounded(reports.rolling_activity(reports.period_activity(rows, "cdate", "constraint_type", k=12, unit="day"), "constraint_type"))


@query(
    "creations_by_creator_type",
    f"""WITH {P.GOV}, {_CURATED} SELECT date_trunc('day', cdate) AS period, CASE WHEN CAST("user" AS BIGINT) % 5 = 0 THEN 'bot' ELSE 'human' END AS creator_type, count(*) AS n
    FROM gov SEMI JOIN cu USING (constraint_type) WHERE CAST("user" AS BIGINT) % 7 <> 0 GROUP BY ALL""",
)
def creations_by_creator_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.creations(P.governance_rows(spark, sf), _curated(spark, sf), _user_flags(spark, sf))
    return reports.period_activity(rows, "cdate", "creator_type", k=2, unit="day")


_PART = """st AS (SELECT DISTINCT s AS statement FROM gov), n AS (SELECT statement, count(DISTINCT "user") AS c FROM st LEFT JOIN gov ON s = statement AND action = 'qualifier' GROUP BY statement),
k AS (SELECT statement, CASE c WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_or_more' END AS participation FROM n), md AS (SELECT s AS statement, constraint_type, ddate IS NOT NULL AS deleted FROM gov WHERE action = 'creation')"""


def _participation(spark: SparkSession, sf: str, by: str) -> DataFrame:
    rows = P.governance_rows(spark, sf).withColumnRenamed("s", "statement")
    found = governance.participation(rows, rows.where("action = 'qualifier'"))
    meta = rows.where("action = 'creation'").select("statement", "constraint_type", F.col("ddate").isNotNull().alias("deleted"))
    return rounded(reports.participation_by(found, meta, by))


def _participation_sql(by: str) -> str:
    return f"WITH {P.GOV}, {_PART}, c AS (SELECT {by}, participation, count(*) AS n FROM k LEFT JOIN md USING (statement) GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY {by}), 6) AS share FROM c"


@query("participation_by_type", _participation_sql("constraint_type"))
def participation_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _participation(spark, sf, "constraint_type")


@query("participation_by_deletion", _participation_sql("deleted"))
def participation_by_deletion(spark: SparkSession, sf: str) -> DataFrame:
    return _participation(spark, sf, "deleted")


@query(
    "stability_by_type",
    f"""WITH {P.GOV}, c AS (SELECT s, min(cdate) AS cdate, max(CASE WHEN action = 'creation' THEN ddate END) AS ddate FROM gov GROUP BY s), q AS (SELECT s, cdate AS qc, ddate AS qd FROM gov WHERE action = 'qualifier'),
    m AS (SELECT w, c.s, any_value(c.ddate IS NOT NULL) AS del, count(qc) AS nq, count(*) FILTER (epoch_us(qc) - epoch_us(c.cdate) > w * 86400000000) AS later, coalesce(bool_or(qd IS NOT NULL), false) AS dq, (epoch_us(max(qc)) - epoch_us(min(qc))) / 86400000000.0 AS span
      FROM c LEFT JOIN q USING (s), (VALUES (1), (7)) AS x(w) GROUP BY ALL),
    ty AS (SELECT s, constraint_type FROM gov WHERE action = 'creation')
    SELECT CAST(w AS BIGINT) AS "window", constraint_type, count(*) AS n_constraints, round(avg(del::INT), 6) AS deletion_rate, round(avg((later > 0)::INT), 6) AS later_qualifier_rate, round(avg(dq::INT), 6) AS deleted_qualifier_rate,
    round(avg(nq), 6) AS mean_qualifier_rows, round(avg(later), 6) AS mean_later_qualifier_rows, round(median(span), 6) AS median_qualifier_span_days FROM m JOIN ty USING (s) GROUP BY ALL""",
)
def stability_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.governance_rows(spark, sf)
    made = rows.where("action = 'creation'")
    first = rows.groupBy("s").agg(F.min("cdate").alias("cdate"), F.max(F.when(F.col("action") == "creation", F.col("ddate"))).alias("ddate"))
    stable = governance.stability(first, rows.where("action = 'qualifier'").select("s", "cdate", "ddate"), governance.days(spark, [1, 7]))
    return rounded(reports.stability_by_type(stable, made.select("s", "constraint_type")))


@query(
    "mean_lifetime",
    f"""WITH {P.LC} SELECT p, count(*) AS n, round(avg((epoch_us(ddate) - epoch_us(cdate)) / 86400000000.0), 6) AS mean_days, round(max((epoch_us(ddate) - epoch_us(cdate)) / 86400000000.0), 6) AS max_days FROM lc WHERE ddate IS NOT NULL GROUP BY p""",
)
def mean_lifetime(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.mean_lifetime(P.lifecycles(spark, sf), "p"))


@query(
    "set_similarity",
    Q.with_total("""x AS (SELECT DISTINCT property, CAST(substr("user", 2) AS BIGINT) % 6 AS g FROM upc WHERE n >= 2), y AS (SELECT DISTINCT property, CAST(substr("user", 2) AS BIGINT) % 6 AS g FROM upc WHERE n >= 3)
    SELECT g, round(count(y.property) / count(*), 6) AS jaccard FROM x LEFT JOIN y USING (g, property) GROUP BY g"""),
)
def set_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Properties that a group of users edits at least twice, and at least three times."""
    rows = P.user_properties(spark, sf).withColumn("g", F.substring("user", 2, 20).cast("long") % 6)
    return rounded(sweeps.set_similarity(rows.where("count >= 2"), rows.where("count >= 3"), ["g"], "property"))


@query("user_factors")
def user_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each user's row in five dimensions, and its cluster by a model that was saved and loaded."""
    found, _ = factors.factors(P.user_properties(spark, sf), 5)
    _, model = factors.clusters(found, 4)
    path = scratch_folder(spark, "model")
    factors.save_model(model, path)
    placed = factors.load_model(path).transform(found)
    length = F.sqrt(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda t, x: t + x * x))
    return rounded(placed.select("user", length.alias("length"), "cluster"))
