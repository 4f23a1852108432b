"""Queries on contributors' specialization: property counts, domination, classes, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeloom.operators import specialists as S
from lifeloom.operators import sweeps
from lifeloom.plans import projections as P
from lifeloom.plans.catalogue import oracle_text, query


#: Shares of edits in the mixed baselines.
_LAMBDAS = (0.25, 0.5, 0.75)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that sums in another order give the same text."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def with_total(sql: str) -> str:
    return f"WITH {P.UPC}, {sql}"


@query(
    "user_property_counts",
    f"""WITH {P.GOV} SELECT "user", substr(p, 5) AS property, count(*) AS "count" FROM gov WHERE "user" IS NOT NULL AND "user" <> '' AND action <> 'rank' GROUP BY ALL""",
)
def user_property_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lifecycles, those that count as ranks under a property that is none of the direct ones."""
    rows = P.governance_rows(spark, sf).select(F.col("user").alias("cuser"), F.when(F.col("action") == "rank", "wikibase:rank").otherwise(F.col("p")).alias("p"))
    return S.user_property_counts(rows)


@query("user_brand_counts", f'WITH {P.UPC} SELECT "user", property, n AS "count" FROM upc')
def user_brand_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.user_properties(spark, sf)


_FUNNEL = with_total(
    """fl AS (SELECT DISTINCT "user", CAST(substr("user", 2) AS BIGINT) % 10 = 0 AS ip, CAST(substr("user", 2) AS BIGINT) % 10 = 1 AS bot FROM upc),
    a1 AS (SELECT upc.* FROM upc JOIN fl USING ("user") WHERE NOT ip),
    a2 AS (SELECT a1.* FROM a1 JOIN fl USING ("user") WHERE NOT bot),
    a3 AS (SELECT * FROM a2 WHERE property IN (SELECT property FROM a2 GROUP BY 1 HAVING count(DISTINCT "user") >= 5)),
    a4 AS (SELECT * FROM a3 WHERE "user" IN (SELECT "user" FROM a3 GROUP BY 1 HAVING sum(n) >= 20)),
    a5 AS (SELECT * FROM a4 WHERE "user" IN (SELECT "user" FROM a4 GROUP BY 1 HAVING count(DISTINCT property) >= 12))"""
)
_STAGES = ("raw", "after_ip_filter", "after_bot_filter", "after_min_property_users", "after_min_user_edits", "after_min_distinct_properties_per_user")


@query(
    "filter_funnel",
    _FUNNEL + " "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS stage, count(*) AS \"rows\", count(DISTINCT \"user\") AS users, count(DISTINCT property) AS properties, CAST(sum(n) AS DOUBLE) AS total_edits FROM {t}"
        for name, t in zip(_STAGES, ("upc", "a1", "a2", "a3", "a4", "a5"), strict=True)
    ),
)
def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_properties(spark, sf)
    return S.funnel(counts, _flags(spark, sf), 5, 20, 12)[1]


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth customer as an address, every tenth as a bot."""
    c = P.table(spark, sf, "customer").select("c_custkey")
    return c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), (F.col("c_custkey") % 10 == 0).alias("is_ip"), (F.col("c_custkey") % 10 == 1).alias("is_bot"))


@query("funnel_survivors", _FUNNEL + ' SELECT "user", property, n AS "count" FROM a5')
def funnel_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return S.funnel(P.user_properties(spark, sf), _flags(spark, sf), 5, 20, 12)[0]


@query(
    "removal_statistics",
    _FUNNEL + """, us AS (SELECT "user", ip, bot, count(*) AS k, sum(n) AS e FROM upc JOIN fl USING ("user") GROUP BY ALL)
    SELECT count(*) AS n_users, count(*) FILTER (ip) AS n_ip_users, count(*) FILTER (bot) AS n_bot_users, count(*) FILTER (ip OR bot) AS n_removed_users, CAST(sum(k) FILTER (ip OR bot) AS BIGINT) AS n_removed_rows,
    CAST(sum(e) FILTER (ip OR bot) AS BIGINT) AS removed_edits, round(count(*) FILTER (ip OR bot) / count(*), 6) AS removed_user_share, round(sum(e) FILTER (ip OR bot) / sum(e), 6) AS removed_edit_share FROM us""",
)
def removal_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.removals(P.user_properties(spark, sf), _flags(spark, sf))[1])


@query(
    "matrix_stats",
    with_total("""u AS (SELECT "user", count(*) AS k, sum(n) AS e FROM upc GROUP BY 1), p AS (SELECT property, count(*) AS k FROM upc GROUP BY 1)
    SELECT n_users, nnz, total_edits, median_properties_per_user, median_edits_per_user, max_properties_per_user, n_properties, median_users_per_property, max_users_per_property, round(nnz / (n_users * n_properties), 6) AS density
    FROM (SELECT count(*) AS n_users, CAST(sum(k) AS BIGINT) AS nnz, CAST(sum(e) AS BIGINT) AS total_edits, median(k) AS median_properties_per_user, median(e)::DOUBLE AS median_edits_per_user, max(k) AS max_properties_per_user FROM u),
    (SELECT count(*) AS n_properties, median(k) AS median_users_per_property, max(k) AS max_users_per_property FROM p)"""),
)
def matrix_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.matrix_stats(P.user_properties(spark, sf)))


_TFIDF = """d AS (SELECT property, ln((1 + (SELECT count(DISTINCT "user") FROM upc)) / (1 + count(DISTINCT "user"))) + 1 AS idf FROM upc GROUP BY property),
w AS (SELECT "user", property, n * idf AS raw FROM upc JOIN d USING (property)),
t AS (SELECT "user", property, raw / sqrt(sum(raw * raw) OVER (PARTITION BY "user")) AS score FROM w)"""
_TOP = """r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, property) AS rank FROM t)
SELECT "user", property, round(score, 6) AS {name}, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


def _top5(scored: DataFrame, name: str) -> DataFrame:
    # Equal scores must stay equal whatever the order of a sum was.
    top = S.top_per_user(scored.withColumn("key", F.round(name, 9)), "key")
    return rounded(top.select("user", "property", name, "rank"))


@query("tfidf_top5", with_total(f"{_TFIDF}, {_TOP.format(name='tfidf')}"))
def tfidf_top5(spark: SparkSession, sf: str) -> DataFrame:
    return _top5(S.tfidf(P.user_properties(spark, sf)), "tfidf")


_LIFT = """t AS (SELECT "user", property, (n / sum(n) OVER (PARTITION BY "user")) / (sum(n) OVER (PARTITION BY property) / (SELECT sum(n) FROM upc)) AS score FROM upc)"""


@query("lift_top5", with_total(f"{_LIFT}, {_TOP.format(name='lift')}"))
def lift_top5(spark: SparkSession, sf: str) -> DataFrame:
    return _top5(S.lift(P.user_properties(spark, sf)), "lift")


@query(
    "user_entropy",
    with_total("""s AS (SELECT "user", n / sum(n) OVER (PARTITION BY "user") AS p, n FROM upc)
    SELECT "user", CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds, round(-sum(p * log2(p)), 6) + 0.0 AS entropy, round(-sum(p * log2(p)), 6) < 3.5 AND sum(n) > 30 AS is_extreme FROM s GROUP BY 1"""),
)
def user_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.extreme_users(P.user_properties(spark, sf), 3.5, 30))


_DOM = """b AS (
  SELECT "user", property, n, sum(n) OVER (PARTITION BY property) AS pt, sum(n) OVER (PARTITION BY "user") AS ut,
         row_number() OVER (PARTITION BY property ORDER BY n DESC, "user") AS r, count(*) OVER (PARTITION BY property) AS nu FROM upc
),
c AS (SELECT *, n / pt AS ps, n / ut AS us FROM b),
h AS (SELECT property, sum(ps * ps) AS hhi, -sum(ps * ln(ps)) / ln(max(nu)) AS en, max(CASE WHEN r = 2 THEN n END) AS n2, max(CASE WHEN r = 2 THEN "user" END) AS u2 FROM c GROUP BY property),
led AS (SELECT c.*, hhi, en, n2, u2 FROM c JOIN h USING (property) WHERE r = 1)"""


@query(
    "domination_leaders",
    with_total(
        _DOM
        + """ SELECT "user", property, n AS "count", CAST(pt AS BIGINT) AS prop_total_edits, CAST(ut AS BIGINT) AS user_total_edits, round(ps, 6) AS property_edit_share, round(us, 6) AS user_focus_share,
    n2 AS second_count, u2 AS second_user, round(n / n2, 6) AS count_ratio_vs_second, round(ps - n2 / pt, 6) AS share_gap, nu = 1 AS solo_flag, round(hhi, 6) AS property_hhi, round(en, 6) AS property_entropy_norm,
    round(ps * sqrt(us) * ln(1 + pt) * (1.5 - en), 6) AS domination_score FROM led"""
    ),
)
def domination_leaders(spark: SparkSession, sf: str) -> DataFrame:
    led = S.leaders(P.user_properties(spark, sf))
    names = "user property count prop_total_edits user_total_edits property_edit_share user_focus_share second_count second_user count_ratio_vs_second share_gap solo_flag property_hhi property_entropy_norm domination_score"
    return rounded(led.select(*names.split()))


#: Thresholds under which the test tables' even shares own something.
_LOW = {"min_prop_edits": 20, "min_user_edits": 20, "min_share": 0.001, "min_focus": 0.05}
_OWN = _DOM + f""",
own AS (SELECT * FROM led WHERE pt >= {_LOW['min_prop_edits']} AND ut >= {_LOW['min_user_edits']} AND ps >= {_LOW['min_share']} AND us >= {_LOW['min_focus']})"""


@query(
    "owned_portfolio",
    with_total(
        _OWN
        + """, k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, property) AS place FROM own)
    SELECT "user", count(DISTINCT property) AS n_owned_properties, CAST(sum(n) AS BIGINT) AS total_owned_edits, round(avg(ps), 6) AS mean_property_share, round(median(ps), 6) AS median_property_share, round(avg(us), 6) AS mean_user_focus,
    round(max(us), 6) AS max_user_focus, CAST(max(ut) AS BIGINT) AS total_user_edits, string_agg(property, ', ' ORDER BY place) FILTER (place <= 5) AS top_owned_properties, round(sum(n) / max(ut), 6) AS owned_edit_fraction,
    CASE WHEN count(DISTINCT property) = 1 THEN 'property' ELSE 'portfolio' END AS kind FROM k GROUP BY "user" """
    ),
)
def owned_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    owned = S.owned_pairs(S.leaders(P.user_properties(spark, sf)), **_LOW)
    return rounded(S.specialist_kind(S.portfolio(owned)))


_GRID = {"min_prop_edits": [20, 2400], "min_user_edits": [20, 60], "min_share": [0.001, 0.004, 0.005], "min_focus": [0.05, 0.15]}


def _grid_sql() -> str:
    ranges = [f"(VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in enumerate(vs))}) AS g{k}(i{k}, {name})" for k, (name, vs) in enumerate(_GRID.items())]
    sizes = [len(v) for v in _GRID.values()]
    run = " + ".join(f"i{k} * {math.prod(sizes[k + 1 :])}" for k in range(len(sizes)))
    return f"runs AS (SELECT CAST({run} AS BIGINT) AS run, {', '.join(_GRID)} FROM {', '.join(ranges)})"


_RUNS = (
    _DOM
    + ", "
    + _grid_sql()
    + """, ow AS (SELECT run, led.* FROM led JOIN runs ON pt >= min_prop_edits AND ut >= min_user_edits AND ps >= min_share AND us >= min_focus),
pe AS (SELECT run, "user", count(DISTINCT property) AS k, sum(n) AS tn, sum(n) / max(ut) AS fr, avg(ps) AS ms FROM ow GROUP BY ALL)"""
)


@query(
    "threshold_sensitivity",
    with_total(
        _RUNS
        + """, b AS (SELECT "user", k = 1 AS single FROM pe WHERE run = 0),
    f AS (
      SELECT run, count(*) AS n_editors_with_owned, count(*) FILTER (k = 1) AS p1, count(*) FILTER (k > 1) AS p2, median(fr) FILTER (k = 1) AS m1, median(fr) FILTER (k > 1) AS m2,
             median(ms) FILTER (k = 1) AS s1, median(ms) FILTER (k > 1) AS s2, count(*) FILTER (k = 1 AND single) AS j1, count(*) FILTER (k > 1 AND NOT single) AS j2 FROM pe LEFT JOIN b USING ("user") GROUP BY run
    ), z AS (SELECT count(*) FILTER (single) AS b1, count(*) FILTER (NOT single) AS b2 FROM b), o AS (SELECT run, count(*) AS n FROM ow GROUP BY run)
    SELECT run, min_prop_edits, min_user_edits, min_share, min_focus, coalesce(n, 0) AS n_owned_pairs, coalesce(n_editors_with_owned, 0) AS n_editors_with_owned, coalesce(p1, 0) AS n_property_specialists, coalesce(p2, 0) AS n_portfolio_specialists,
    round(m1, 6) AS median_owned_edit_fraction_property, round(m2, 6) AS median_owned_edit_fraction_portfolio, round(s1, 6) AS median_mean_property_share_property, round(s2, 6) AS median_mean_property_share_portfolio,
    round(CASE WHEN coalesce(p1, 0) + b1 - coalesce(j1, 0) = 0 THEN 1.0 ELSE coalesce(j1, 0) / (coalesce(p1, 0) + b1 - coalesce(j1, 0)) END, 6) AS jaccard_property_specialists_vs_baseline,
    round(CASE WHEN coalesce(p2, 0) + b2 - coalesce(j2, 0) = 0 THEN 1.0 ELSE coalesce(j2, 0) / (coalesce(p2, 0) + b2 - coalesce(j2, 0)) END, 6) AS jaccard_portfolio_specialists_vs_baseline,
    m2 > m1 AS portfolio_stronger_by_fraction FROM runs LEFT JOIN o USING (run) LEFT JOIN f USING (run), z"""
    ).replace(", b AS (SELECT \"user\", k = 1", ", base AS (SELECT \"user\", k = 1").replace("LEFT JOIN b USING", "LEFT JOIN base USING").replace("AS b2 FROM b)", "AS b2 FROM base)"),
)
def threshold_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweeps.sensitivity(S.leaders(P.user_properties(spark, sf)), sweeps.grid(spark, **_GRID)))


@query(
    "persistence",
    with_total(
        _RUNS
        + """, rk AS (SELECT run, "user", row_number() OVER (PARTITION BY run ORDER BY fr DESC, k DESC, tn DESC, ms DESC, "user") AS place FROM pe)
    SELECT "user", count(*) AS appearances, round(count(*) / (SELECT count(*) FROM runs), 6) AS share_of_runs FROM rk WHERE place <= 10 GROUP BY "user" """
    ),
)
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweeps.persistence(S.leaders(P.user_properties(spark, sf)), sweeps.grid(spark, **_GRID)))


_RANKED = _RUNS + """, rk AS (SELECT run, "user", row_number() OVER (PARTITION BY run ORDER BY tn DESC, "user") AS place FROM pe),
t20 AS (SELECT rk.run, rk."user", rk.place, b0.place AS base FROM rk JOIN rk b0 ON b0.run = 0 AND b0."user" = rk."user" AND b0.place <= 20 WHERE rk.place <= 20)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    people = S.portfolio(sweeps.owned_by_run(S.leaders(P.user_properties(spark, sf)), sweeps.grid(spark, **_GRID)), keys=("run",))
    order = Window.partitionBy("run").orderBy(F.desc("total_owned_edits"), "user")
    return people.select("run", "user", F.row_number().over(order).alias("place"))


@query("overlap_at_20", with_total(_RANKED + " SELECT run, round(count(*) / 20, 6) AS overlap FROM t20 GROUP BY run"))
def overlap_at_20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweeps.overlap_at(_ranked(spark, sf), 20))


@query(
    "rank_correlation",
    with_total(
        _RANKED
        + """, xy AS (SELECT run, rank() OVER (PARTITION BY run ORDER BY place) AS x, rank() OVER (PARTITION BY run ORDER BY base) AS y FROM t20)
    SELECT run, CASE WHEN count(*) >= 2 THEN round(corr(x, y), 6) END AS rank_corr FROM xy GROUP BY run"""
    ),
)
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweeps.rank_correlation(_ranked(spark, sf), 20))


@query(
    "ablation",
    with_total(
        """x AS (SELECT *, CAST(substr("user", 2) AS BIGINT) % 9 = 0 AS gone FROM upc),
    a AS (SELECT count(*)::DOUBLE AS pairs, count(DISTINCT "user")::DOUBLE AS users, sum(n)::DOUBLE AS edits FROM x), b AS (SELECT count(*)::DOUBLE AS pairs, count(DISTINCT "user")::DOUBLE AS users, sum(n)::DOUBLE AS edits FROM x WHERE NOT gone)
    SELECT 'pairs' AS metric, a.pairs AS before, b.pairs AS after, b.pairs - a.pairs AS change FROM a, b UNION ALL SELECT 'users', a.users, b.users, b.users - a.users FROM a, b UNION ALL SELECT 'edits', a.edits, b.edits, b.edits - a.edits FROM a, b"""
    ),
)
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_properties(spark, sf)
    gone = counts.where(F.substring("user", 2, 20).cast("long") % 9 == 0)
    metric = lambda d: d.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("user").alias("users"), F.sum("count").alias("edits"))
    return sweeps.ablation(counts, gone, metric)


_CLUSTERS = """cl AS (SELECT DISTINCT "user", CAST(substr("user", 2) AS BIGINT) % 4 AS cluster FROM upc),
pc AS (SELECT property, cluster, count(DISTINCT "user") AS npc FROM upc JOIN cl USING ("user") GROUP BY ALL), np AS (SELECT property, count(DISTINCT "user") AS n_p FROM upc GROUP BY 1),
nc AS (SELECT cluster, count(*) AS n_c FROM cl GROUP BY 1),
gr AS (
  SELECT property, nc.cluster, n_p, n_c, coalesce(npc, 0) AS npc, (coalesce(npc, 0) + 0.5) / (n_p + 0.5 * 4) AS sh, (coalesce(npc, 0) + 0.5) / (n_c + 1.0) AS cv,
         ((coalesce(npc, 0) + 0.5) / (n_p + 0.5 * 4)) / (n_c / (SELECT sum(n_c) FROM nc)) AS er FROM np CROSS JOIN nc LEFT JOIN pc USING (property, cluster)
),
ra AS (SELECT *, row_number() OVER w AS place, lead(sh) OVER w AS s2, -sum(sh * ln(sh)) OVER (PARTITION BY property) / ln(4) AS en FROM gr WINDOW w AS (PARTITION BY property ORDER BY sh DESC, cluster))"""


@query(
    "community_ownership",
    with_total(
        _CLUSTERS
        + """ SELECT property, cluster AS owner_cluster, npc AS owner_users, n_p, n_c, round(sh, 6) AS owner_share, round(cv, 6) AS owner_coverage, round(er, 6) AS owner_enrichment, round(log2(er), 6) AS owner_log2_enrichment,
    round(en, 6) AS entropy_norm, round(1 - en, 6) AS purity, round(s2, 6) AS second_share, round(n_p / (n_p + 25.0), 6) AS support_weight, round((1 - en) * cv * ln(1 + er) * n_p / (n_p + 25.0), 6) AS owned_score,
    CASE WHEN n_p < 30 THEN 'rare/unstable' WHEN sh >= 0.6 AND cv >= 0.05 AND er >= 2 THEN 'community-owned' WHEN s2 >= 0.25 AND 1 - en >= 0.2 THEN 'bridge/multi-community' ELSE 'generic/mixed' END AS class FROM ra WHERE place = 1"""
    ),
)
def community_ownership(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_properties(spark, sf)
    clusters = counts.select("user").distinct().withColumn("cluster", F.substring("user", 2, 20).cast("long") % 4)
    return rounded(S.cluster_ownership(counts, clusters))


_PROFILE = """b AS (SELECT *, n / sum(n) OVER (PARTITION BY "user") AS sh, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, class) AS r FROM ucl),
pf AS (
  SELECT "user", CAST(sum(n) AS BIGINT) AS total_edits, count(*) AS active_classes, max(sh) AS max_class_share, -sum(sh * log2(sh)) AS en, max(class) FILTER (r = 1) AS top_class, max(sh) FILTER (r = 1) AS top_class_share,
         max(class) FILTER (r = 2) AS second_class, coalesce(max(sh) FILTER (r = 2), 0.0) AS second_class_share FROM b GROUP BY "user"
)"""


@query(
    "class_profiles",
    f"""WITH {P.UCL}, {_PROFILE} SELECT "user", total_edits, active_classes, round(max_class_share, 6) AS max_class_share, round(en, 6) + 0.0 AS entropy, top_class, round(top_class_share, 6) AS top_class_share, second_class, round(second_class_share, 6) AS second_class_share,
    CASE WHEN active_classes > 1 THEN round(en / log2(active_classes), 6) ELSE 0.0 END AS normalized_entropy, CASE WHEN active_classes > 1 THEN round(1 - en / log2(active_classes), 6) + 0.0 ELSE 1.0 END AS specialization_score, round(pow(2.0, en), 6) AS effective_classes FROM pf""",
)
def class_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.class_profile(P.user_classes(spark, sf)))


@query(
    "profile_typology",
    f"""WITH {P.UCL}, {_PROFILE}, q AS (SELECT quantile_cont(max_class_share, 0.5) AS p50, quantile_cont(max_class_share, 0.9) AS p90 FROM pf)
    SELECT CASE WHEN max_class_share >= p90 AND active_classes <= 3 THEN 'A' WHEN max_class_share >= p50 AND max_class_share < p90 AND active_classes BETWEEN 4 AND 15 THEN 'B' WHEN max_class_share < 0.6 AND active_classes >= 16 THEN 'C' ELSE 'Other' END AS profile,
    count(*) AS n FROM pf, q GROUP BY 1""",
)
def profile_typology(spark: SparkSession, sf: str) -> DataFrame:
    return S.typology(S.class_profile(P.user_classes(spark, sf))).groupBy("profile").agg(F.count(F.lit(1)).alias("n"))


@query("global_class_shares", f'WITH {P.UCL} SELECT class, CAST(sum(n) AS BIGINT) AS global_edits, round(sum(n) / (SELECT sum(n) FROM ucl), 6) AS global_share FROM ucl GROUP BY class')
def global_class_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.global_shares(P.user_classes(spark, sf)))


@query(
    "class_specialist_kl",
    f"""WITH {P.UCL}, m AS (SELECT 'c' || CAST(p_size AS VARCHAR) AS class, count(*) AS mass FROM part GROUP BY 1),
    u AS (SELECT *, sum(n) OVER (PARTITION BY "user") AS total, count(*) OVER (PARTITION BY "user") AS kinds FROM ucl), f AS (SELECT * FROM u WHERE total >= 30 AND kinds >= 2),
    k AS (SELECT count(*) AS k FROM (SELECT class FROM f UNION SELECT class FROM m)),
    t AS (SELECT "user", class, (n / total) * log2((n / total) / ((coalesce(mass, 0) + 0.5) / ((SELECT sum(mass) FROM m) + 0.5 * k.k))) AS term FROM f LEFT JOIN m USING (class), k),
    r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(term, 9) DESC, class) AS place FROM t)
    SELECT "user", round(sum(term), 6) AS kl_divergence_smoothed, max(class) FILTER (place = 1) AS top_class_by_kl_contribution, round(max(term) FILTER (place = 1), 6) AS top_kl_term FROM r GROUP BY "user" """,
)
def class_specialist_kl(spark: SparkSession, sf: str) -> DataFrame:
    base = P.table(spark, sf, "part").groupBy(F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("class")).agg(F.count(F.lit(1)).alias("mass"))
    return rounded(S.smoothed_kl(P.user_classes(spark, sf), base, 0.5, 30, 2))


@query(
    "class_intensity",
    f"""WITH {P.UCL}, e AS (SELECT class, CAST(sum(n) AS BIGINT) AS global_edits FROM ucl GROUP BY class), m AS (SELECT 'c' || CAST(p_size AS VARCHAR) AS class, count(*) AS a, count(*) FILTER (p_partkey % 3 = 0) AS d FROM part GROUP BY 1 UNION ALL SELECT 's' || CAST(s_nationkey AS VARCHAR), count(*), 0 FROM supplier GROUP BY 1)
    SELECT class, coalesce(global_edits, 0) AS global_edits, coalesce(a, 0) AS n_total_instances_added, coalesce(d, 0) AS n_instances_deleted, round(coalesce(global_edits, 0) / nullif(coalesce(a, 0), 0), 6) AS edits_per_added, round(coalesce(d, 0) / nullif(coalesce(a, 0), 0), 6) AS delete_rate FROM e FULL JOIN m USING (class)""",
)
def class_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of parts and, without edits, those of suppliers."""
    parts = P.table(spark, sf, "part").select(F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("class"), (F.col("p_partkey") % 3 == 0).alias("gone"))
    rows = parts.union(P.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")), F.lit(False)))
    adds = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_total_instances_added"), F.count_if("gone").alias("n_instances_deleted"))
    edits = P.user_classes(spark, sf).groupBy("class").agg(F.sum("edit_count").alias("global_edits"))
    return rounded(S.class_intensity(edits, adds))


@query(
    "baseline_mixture",
    f"""WITH {P.UCL}, e AS (SELECT class, sum(n) / (SELECT sum(n) FROM ucl) AS e FROM ucl GROUP BY class), i AS (SELECT 'c' || CAST(p_size AS VARCHAR) AS class, count(*) / (SELECT count(*) FROM part) AS i FROM part GROUP BY 1)
    SELECT lam, class, round(lam * coalesce(e, 0) + (1 - lam) * coalesce(i, 0), 9) AS mass FROM e FULL JOIN i USING (class), (VALUES (0.25::DOUBLE), (0.5), (0.75)) AS l(lam)""",
)
def baseline_mixture(spark: SparkSession, sf: str) -> DataFrame:
    edits = P.user_classes(spark, sf).groupBy("class").agg(F.sum("edit_count").alias("mass"))
    parts = P.table(spark, sf, "part").groupBy(F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("class")).agg(F.count(F.lit(1)).alias("mass"))
    made = [S.baseline_mixture(edits, parts, v).select(F.lit(v).alias("lam"), "class", "mass") for v in _LAMBDAS]
    return rounded(made[0].union(made[1]).union(made[2]), 9)


@query(
    "average_rank",
    f"""WITH {P.UPC} SELECT "user", property, rank() OVER (PARTITION BY property ORDER BY n DESC) + (count(*) OVER (PARTITION BY property, n) - 1) / 2 AS avg_rank FROM upc""",
)
def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return S.average_rank(P.user_properties(spark, sf), "count", ["property"]).select("user", "property", "avg_rank")


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_properties(spark, sf)
    return S.cluster_ownership(counts, counts.select("user").distinct().withColumn("cluster", F.substring("user", 2, 20).cast("long") % 4))


@query(
    "community_ownership_soft",
    with_total(
        _CLUSTERS
        + """ SELECT property, cluster AS owner_cluster, CASE WHEN n_p < 30 THEN 'rare/unstable' WHEN sh >= 0.45 AND er >= 3 AND 1 - en >= 0.45 AND cv >= 0.02 AND s2 <= 0.35 THEN 'community-owned-soft'
    WHEN s2 >= 0.25 AND 1 - en >= 0.2 THEN 'bridge/multi-community' ELSE 'generic/mixed' END AS class_soft FROM ra WHERE place = 1"""
    ),
)
def community_ownership_soft(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_soft_class(_owned(spark, sf)).select("property", "owner_cluster", "class_soft")


@query(
    "community_borderline",
    with_total(_CLUSTERS + """ SELECT property, cluster AS owner_cluster, round(sh, 6) AS owner_share FROM ra WHERE place = 1 AND n_p >= 20 AND er >= 1.05 AND sh BETWEEN 0.26 AND 0.60"""),
)
def community_borderline(spark: SparkSession, sf: str) -> DataFrame:
    """At bounds that the test tables' even shares come near to."""
    return rounded(S.borderline(_owned(spark, sf), 20, 1.05, 0.26, 0.60).select("property", "owner_cluster", "owner_share"))


@query(
    "cluster_profile",
    f"""WITH {P.UPC}, cl AS (SELECT DISTINCT "user", CAST(substr("user", 2) AS BIGINT) % 4 AS cluster FROM upc), nc AS (SELECT cluster, count(*) AS n_c FROM cl GROUP BY 1),
    g AS (SELECT property, count(*) AS global_users FROM upc GROUP BY 1), w AS (SELECT "user", property, n, n * (ln((1 + (SELECT count(*) FROM cl)) / (1 + global_users)) + 1) AS raw FROM upc JOIN g USING (property)),
    ti AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY "user")) AS score FROM w),
    a AS (SELECT cluster, property, count(*) AS users_in_cluster, CAST(sum(n) AS BIGINT) AS total_edits_in_cluster, sum(score) AS s FROM ti JOIN cl USING ("user") GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s / n_c, 9) DESC, property) AS place_by_tfidf, row_number() OVER (PARTITION BY cluster ORDER BY users_in_cluster DESC, property) AS place_by_coverage FROM a JOIN nc USING (cluster) JOIN g USING (property))
    SELECT cluster, property, users_in_cluster, total_edits_in_cluster, global_users, round(users_in_cluster / n_c, 6) AS coverage, round(users_in_cluster / global_users, 6) AS cluster_share, round(s / n_c, 6) AS mean_tfidf, place_by_tfidf, place_by_coverage
    FROM r WHERE place_by_tfidf <= 5 OR place_by_coverage <= 5""",
)
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_properties(spark, sf)
    clusters = counts.select("user").distinct().withColumn("cluster", F.substring("user", 2, 20).cast("long") % 4)
    return rounded(S.cluster_profile(counts, clusters, 5))


@query(
    "threshold_gap_table",
    f"""WITH s AS (SELECT *, median_owned_edit_fraction_portfolio - median_owned_edit_fraction_property AS gap FROM ({oracle_text('threshold_sensitivity')})),
    t AS (SELECT min_share, min_focus, avg(gap) AS g, avg(n_portfolio_specialists) AS n, min(gap) AS lo, max(gap) AS hi FROM s GROUP BY ALL),
    h AS (SELECT min_share, any_value(g) FILTER (min_focus = 0.05) AS a, any_value(g) FILTER (min_focus = 0.15) AS b FROM t GROUP BY 1)
    SELECT min_share, min_focus, round(g, 6) AS mean_gap, round(n, 6) AS mean_portfolio_n, round(lo, 6) AS min_gap, round(hi, 6) AS max_gap, round(a, 6) AS mean_gap_at_0_05, round(b, 6) AS mean_gap_at_0_15 FROM t JOIN h USING (min_share)""",
)
def threshold_gap_table(spark: SparkSession, sf: str) -> DataFrame:
    """Both levels: each cell, and beside it its row of the heat-map."""
    gaps = sweeps.gap_table(threshold_sensitivity(spark, sf))
    row = sweeps.heat_map(gaps, _GRID["min_focus"]).toDF("min_share", "mean_gap_at_0_05", "mean_gap_at_0_15")
    return rounded(gaps.join(row, "min_share"))


_KL = f"""{P.UCL}, e AS (SELECT class, CAST(sum(n) AS DOUBLE) AS m FROM ucl GROUP BY 1), i AS (SELECT 'c' || CAST(p_size AS VARCHAR) AS class, CAST(count(*) AS DOUBLE) AS m FROM part GROUP BY 1),
x AS (SELECT class, coalesce(e.m, 0) / (SELECT sum(m) FROM e) AS e, coalesce(i.m, 0) / (SELECT sum(m) FROM i) AS i FROM e FULL JOIN i USING (class)),
bl AS (SELECT 'edits' AS baseline, class, m AS mass FROM e UNION ALL SELECT 'instances', class, m FROM i {' '.join(f"UNION ALL SELECT 'mixture_{v}', class, {v} * e + {1 - v} * i FROM x" for v in _LAMBDAS)}),
u AS (SELECT *, sum(n) OVER (PARTITION BY "user") AS total, count(*) OVER (PARTITION BY "user") AS kinds FROM ucl),
f AS (SELECT * FROM u JOIN (VALUES (20), (30), (50)) AS t(min_edits) ON total >= min_edits WHERE kinds >= 2),
b AS (SELECT baseline, sum(mass) AS whole FROM bl GROUP BY 1),
kc AS (SELECT baseline, min_edits, count(*) AS k FROM (SELECT baseline, min_edits, class FROM f, b UNION SELECT baseline, min_edits, class FROM bl, (VALUES (20), (30), (50)) AS t(min_edits)) GROUP BY ALL),
kl AS (SELECT baseline, min_edits, alpha, "user", sum((n / total) * log2((n / total) / ((coalesce(mass, 0) + alpha) / (whole + alpha * k)))) AS v
  FROM f JOIN kc USING (min_edits) JOIN b USING (baseline) LEFT JOIN bl USING (baseline, class), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS s(alpha) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY baseline, min_edits, alpha ORDER BY round(v, 9) DESC, "user") AS place FROM kl)"""


def _swept(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.user_classes(spark, sf)
    edits = counts.groupBy("class").agg(F.sum("edit_count").cast("double").alias("mass"))
    parts = P.table(spark, sf, "part").groupBy(F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("class")).agg(F.count(F.lit(1)).cast("double").alias("mass"))
    named = {"edits": edits, "instances": parts, **{f"mixture_{v}": S.baseline_mixture(edits, parts, v) for v in _LAMBDAS}}
    made = None
    for name, df in named.items():
        df = df.select(F.lit(name).alias("baseline"), "class", "mass")
        made = df if made is None else made.union(df)
    return sweeps.kl_sweep(counts, made, [20, 30, 50], [0.1, 0.5, 1.0])


@query("kl_robustness", f"""WITH {_KL} SELECT baseline, min_edits, alpha, "user", round(v, 6) AS kl_divergence_smoothed, place FROM rk WHERE place <= 10""")
def kl_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten of each of the 5 x 3 x 3 settings."""
    return rounded(_swept(spark, sf).where("place <= 10"))


@query(
    "kl_baseline_comparison",
    f"""WITH {_KL}, ar AS (SELECT *, rank() OVER (PARTITION BY baseline, alpha ORDER BY round(v, 9) DESC) + (count(*) OVER (PARTITION BY baseline, alpha, round(v, 9)) - 1) / 2 AS r FROM rk WHERE min_edits = 30)
    SELECT alpha, count(*) FILTER (x.place <= 10 AND y.place <= 10) AS shared_top, round(corr(x.r, y.r), 6) AS spearman FROM ar x JOIN ar y USING (alpha, "user") WHERE x.baseline = 'edits' AND y.baseline = 'instances' GROUP BY alpha""",
)
def kl_baseline_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweeps.kl_comparison(_swept(spark, sf), "edits", "instances", 30))
