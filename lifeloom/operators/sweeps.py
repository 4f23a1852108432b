"""Parameter grids: one grouped aggregation over all settings instead of a loop of runs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeloom.operators.specialists import average_rank, portfolio
from lifeloom.session import cut_lineage

GRID = ("min_prop_edits", "min_user_edits", "min_share", "min_focus")


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """One row for each combination, with a run number in the order of the lists."""
    names = list(values)
    rows = [(i, *map(float, v)) for i, v in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, "run long, " + ", ".join(f"{n} double" for n in names))


def owned_by_run(led: DataFrame, runs: DataFrame) -> DataFrame:
    """Leader pairs that each run's thresholds keep, with its run number. runs is the caller's grid: a fixed list."""
    test = (
        (F.col("prop_total_edits") >= F.col("min_prop_edits"))
        & (F.col("user_total_edits") >= F.col("min_user_edits"))
        & (F.col("property_edit_share") >= F.col("min_share"))
        & (F.col("user_focus_share") >= F.col("min_focus"))
    )
    return led.join(F.broadcast(runs), test)


def set_similarity(a: DataFrame, b: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, jaccard) of two tables of (keys, member): both empty 1, one empty 0; keys come from either."""
    x = a.select(*keys, member).distinct().withColumn("ina", F.lit(1))
    y = b.select(*keys, member).distinct().withColumn("inb", F.lit(1))
    both = x.join(y, [*keys, member], "full")
    return both.groupBy(*keys).agg((F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull()) / F.count(F.lit(1))).alias("jaccard"))


def sensitivity(led: DataFrame, runs: DataFrame, baseline_run: int = 0) -> DataFrame:
    """A row for each run: owned pairs, specialists of one property and of several, medians, Jaccard to the baseline run."""
    # Leaders, one for each property, are read for every figure below: written once.
    owned = owned_by_run(cut_lineage(led), runs)
    people = portfolio(owned, keys=("run",)).withColumn("single", F.col("n_owned_properties") == 1)
    pairs = owned.groupBy("run").agg(F.count(F.lit(1)).alias("n_owned_pairs"))
    found = people.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_editors_with_owned"),
        F.count_if("single").alias("n_property_specialists"),
        F.count_if(~F.col("single")).alias("n_portfolio_specialists"),
        F.median(F.when(F.col("single"), F.col("owned_edit_fraction"))).alias("median_owned_edit_fraction_property"),
        F.median(F.when(~F.col("single"), F.col("owned_edit_fraction"))).alias("median_owned_edit_fraction_portfolio"),
        F.median(F.when(F.col("single"), F.col("mean_property_share"))).alias("median_mean_property_share_property"),
        F.median(F.when(~F.col("single"), F.col("mean_property_share"))).alias("median_mean_property_share_portfolio"),
    )
    base = people.where(F.col("run") == baseline_run).select("user", F.col("single").alias("base_single"))
    met = people.join(base, "user", "left")
    sizes = base.agg(F.count_if("base_single").alias("b1"), F.count_if(~F.col("base_single")).alias("b2"))
    shared = met.groupBy("run").agg(
        F.count_if(F.col("single") & F.col("base_single")).alias("s1"), F.count_if(~F.col("single") & ~F.col("base_single")).alias("s2")
    )

    def jaccard(n, b, s):
        size = F.coalesce(n, F.lit(0)) + b - F.coalesce(s, F.lit(0))
        return F.when(size == 0, F.lit(1.0)).otherwise(F.coalesce(s, F.lit(0)) / size)

    out = runs.join(pairs, "run", "left").join(found, "run", "left").join(shared, "run", "left").crossJoin(F.broadcast(sizes))  # one row
    counts = ["n_owned_pairs", "n_editors_with_owned", "n_property_specialists", "n_portfolio_specialists"]
    return out.fillna(0, counts).withColumns(
        {
            "jaccard_property_specialists_vs_baseline": jaccard(F.col("n_property_specialists"), F.col("b1"), F.col("s1")),
            "jaccard_portfolio_specialists_vs_baseline": jaccard(F.col("n_portfolio_specialists"), F.col("b2"), F.col("s2")),
            "portfolio_stronger_by_fraction": F.col("median_owned_edit_fraction_portfolio") > F.col("median_owned_edit_fraction_property"),
        }
    ).drop("b1", "b2", "s1", "s2")


def overlap_at(ranked: DataFrame, k: int, baseline_run: int = 0, member: str = "user") -> DataFrame:
    """(run, overlap): members of the first k that are also among the baseline's first k, over k."""
    top = ranked.where(F.col("place") <= k)
    base = top.where(F.col("run") == baseline_run).select(member)
    return top.join(base, member, "left_semi").groupBy("run").agg((F.count(F.lit(1)) / k).alias("overlap"))


def rank_correlation(ranked: DataFrame, k: int, baseline_run: int = 0, member: str = "user") -> DataFrame:
    """(run, rank_corr): Pearson correlation of the ranks of common members; null below two or without variance."""
    top = ranked.where(F.col("place") <= k)
    base = top.where(F.col("run") == baseline_run).select(member, F.col("place").alias("base_place"))
    met = top.join(base, member)
    own = Window.partitionBy("run")
    both = met.withColumns({"x": F.rank().over(own.orderBy("place")), "y": F.rank().over(own.orderBy("base_place"))})
    return both.groupBy("run").agg(F.when(F.count(F.lit(1)) >= 2, F.corr("x", "y")).alias("rank_corr"))


def persistence(led: DataFrame, runs: DataFrame, k: int = 10) -> DataFrame:
    """(user, appearances, share_of_runs): how often a user is among the first k portfolio owners of a run."""
    people = portfolio(owned_by_run(led, runs), keys=("run",))
    order = Window.partitionBy("run").orderBy(F.desc("owned_edit_fraction"), F.desc("n_owned_properties"), F.desc("total_owned_edits"), F.desc("mean_property_share"), "user")
    ranked = people.withColumn("place", F.row_number().over(order))
    n = runs.agg(F.count(F.lit(1)).alias("runs"))
    found = ranked.where(F.col("place") <= k).groupBy("user").agg(F.count(F.lit(1)).alias("appearances"))
    return found.crossJoin(F.broadcast(n)).select("user", "appearances", (F.col("appearances") / F.col("runs")).alias("share_of_runs"))  # one row


def ablation(counts: DataFrame, excluded: DataFrame, metric) -> DataFrame:
    """metric(counts) before and after the excluded users are taken out, side by side: (metric, before, after, change)."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in df.columns)))
        return df.select(pairs.alias("x")).select("x.metric", F.col("x.v").alias(name))

    left = counts.join(excluded.select("user").distinct(), "user", "left_anti")
    met = long(metric(counts), "before").join(long(metric(left), "after"), "metric")
    return met.withColumn("change", F.col("after") - F.col("before"))


def gap_table(summary: DataFrame) -> DataFrame:
    """(min_share, min_focus, mean_gap, mean_portfolio_n, min_gap, max_gap) over the other two thresholds of sensitivity().

    The gap is the median owned fraction of portfolio owners less that of single-property owners; runs without one of
    the two have none.
    """
    gap = F.col("median_owned_edit_fraction_portfolio") - F.col("median_owned_edit_fraction_property")
    return summary.withColumn("gap", gap).groupBy("min_share", "min_focus").agg(
        F.avg("gap").alias("mean_gap"), F.avg("n_portfolio_specialists").alias("mean_portfolio_n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap")
    )


def heat_map(gaps: DataFrame, focus: list[float], value: str = "mean_gap") -> DataFrame:
    """gap_table() with a row for each min_share and a column of the value for each of the min_focus values."""
    return gaps.groupBy("min_share").pivot("min_focus", focus).agg(F.first(value))


def kl_sweep(counts: DataFrame, baselines: DataFrame, min_edits: list[int], alphas: list[float], min_classes: int = 2) -> DataFrame:
    """(baseline, min_edits, alpha, user, kl_divergence_smoothed, place): smoothed_kl() under each of the settings at once.

    counts: (user, class, edit_count). baselines: (baseline, class, mass). place is the order by falling divergence
    within a setting; divergences equal to nine digits go by the user's name.
    """
    spark = counts.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(x,) for x in dict.fromkeys(min_edits)], "min_edits long"))
    steps = F.broadcast(spark.createDataFrame([(float(x),) for x in dict.fromkeys(alphas)], "alpha double"))
    by = Window.partitionBy("user")
    rows = counts.withColumns({"total": F.sum("edit_count").over(by), "kinds": F.count(F.lit(1)).over(by)}).where(F.col("kinds") >= min_classes)
    rows = rows.join(cuts, F.col("total") >= F.col("min_edits"))
    whole = baselines.groupBy("baseline").agg(F.sum("mass").alias("whole"))
    known = rows.select("min_edits", "class").distinct().crossJoin(F.broadcast(whole.select("baseline")))  # the caller's few baselines
    known = known.union(baselines.select("class", "baseline").distinct().crossJoin(cuts).select("min_edits", "class", "baseline"))
    sizes = known.distinct().groupBy("baseline", "min_edits").agg(F.count(F.lit(1)).alias("k")).join(whole, "baseline")
    met = rows.join(F.broadcast(sizes), "min_edits").join(baselines, ["baseline", "class"], "left").crossJoin(steps)
    q = (F.coalesce("mass", F.lit(0)) + F.col("alpha")) / (F.col("whole") + F.col("alpha") * F.col("k"))
    p = F.col("edit_count") / F.col("total")
    run = ["baseline", "min_edits", "alpha"]
    sums = met.groupBy(*run, "user").agg(F.sum(p * F.log2(p / q)).alias("kl_divergence_smoothed"))
    order = Window.partitionBy(*run).orderBy(F.desc(F.round("kl_divergence_smoothed", 9)), "user")
    return sums.withColumn("place", F.row_number().over(order))


def kl_comparison(swept: DataFrame, one: str, other: str, min_edits: int = 50, top: int = 10) -> DataFrame:
    """(alpha, shared_top, spearman) of two baselines of kl_sweep(): users among the first of both, rank correlation."""
    rows = swept.where(F.col("min_edits") == min_edits).withColumn("kl", F.round("kl_divergence_smoothed", 9))
    ranked = average_rank(rows, "kl", ["baseline", "alpha"], "r")
    x = ranked.where(F.col("baseline") == one).select("alpha", "user", F.col("place").alias("p1"), F.col("r").alias("r1"))
    y = ranked.where(F.col("baseline") == other).select("alpha", "user", F.col("place").alias("p2"), F.col("r").alias("r2"))
    return x.join(y, ["alpha", "user"]).groupBy("alpha").agg(
        F.count_if((F.col("p1") <= top) & (F.col("p2") <= top)).alias("shared_top"), F.corr("r1", "r2").alias("spearman")
    )
