"""How constraints are governed: who creates, qualifies and removes them, and how stable they stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeloom.functions.terms import days_between
from lifeloom.session import cut_lineage


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share), nulls counted too."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("all")))).select(column, "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def creator_deleter_matrix(rows: DataFrame) -> DataFrame:
    """2 x 2 counts of (creator_bot, deleter_bot booleans), a row for each creator kind, absent pairs 0."""
    kind = lambda c: F.when(F.col(c), "bot").otherwise("human")
    kinds = rows.sparkSession.createDataFrame([("bot",), ("human",)], "creator string")
    n = rows.select(kind("creator_bot").alias("creator"), kind("deleter_bot").alias("deleter")).groupBy("creator").pivot("deleter", ["bot", "human"]).count()
    return kinds.join(n, "creator", "left").fillna(0, ["bot", "human"])


def period_pivot(rows: DataFrame, time: str, label: str, labels: list[str], unit: str = "month") -> DataFrame:
    """(period, one column for each label): counts by calendar period, absent ones 0. labels is a fixed list of columns."""
    return rows.groupBy(F.date_trunc(unit, F.col(time)).alias("period")).pivot(label, labels).count().fillna(0, labels)


def top_labels(rows: DataFrame, label: str, k: int) -> list[str]:
    """The k most frequent labels, ties by name: at most k rows come to the driver, as column names of a pivot."""
    n = rows.where(F.col(label).isNotNull()).groupBy(label).count()
    return [r[0] for r in n.orderBy(F.desc("count"), label).limit(k).collect()]


def rolling_mean(pivoted: DataFrame, columns: list[str], rows: int = 3) -> DataFrame:
    """Means over the last so many periods that are there. One row a period: a calendar's length, not the data's."""
    w = Window.partitionBy().orderBy("period").rowsBetween(-(rows - 1), 0)
    return pivoted.select("period", *(F.avg(F.col(f"`{c}`")).over(w).alias(f"{c}_rolling") for c in columns))


def dominant(rows: DataFrame, key: str, category: str, prefix: str) -> DataFrame:
    """(key, total, <prefix>, <prefix>_share): most frequent category, ties to the first by name, and its share."""
    n = rows.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(key)
    ranked = n.withColumns({"place": F.row_number().over(by.orderBy(F.desc("n"), category)), "total": F.sum("n").over(by)})
    return ranked.where("place = 1").select(key, "total", F.col(category).alias(prefix), (F.col("n") / F.col("total")).alias(f"{prefix}_share"))


def specialization_class(type_share: Column, target_share: Column, cut: float = 0.70) -> Column:
    both = (type_share >= cut) & (target_share >= cut)
    return F.when(both, "dual").when(type_share >= cut, "type").when(target_share >= cut, "target").otherwise("generalist")


def user_specialization(creations: DataFrame, min_additions: int = 20, cut: float = 0.70) -> DataFrame:
    """(user, total, type, type_share, target, target_share, kind) of (user, constraint_type, target) rows."""
    t = dominant(creations, "user", "constraint_type", "type")
    g = dominant(creations, "user", "target", "target").drop("total")
    met = t.join(g, "user").where(F.col("total") >= min_additions)
    return met.withColumn("kind", specialization_class(F.col("type_share"), F.col("target_share"), cut))


def cutoff_counts(shares: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """(cut, n, share): rows whose column reaches each cut-off of a fixed list, in one pass."""
    all_ = shares.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col(column) >= c).alias(str(i)) for i, c in enumerate(cuts)))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.col(str(i)).alias("n")) for i, c in enumerate(cuts))))
    return all_.select("all", pairs.alias("x")).select("x.cut", "x.n", (F.col("x.n") / F.nullif("all", F.lit(0))).alias("share"))


def participation(statements: DataFrame, actions: DataFrame) -> DataFrame:
    """(statement, n_humans, participation): distinct users on each statement, those without one included."""
    n = actions.groupBy("statement").agg(F.countDistinct("user").alias("n"))
    met = statements.select("statement").distinct().join(n, "statement", "left").select("statement", F.coalesce("n", F.lit(0)).alias("n_humans"))
    c = F.col("n_humans")
    return met.withColumn("participation", F.when(c == 0, "none").when(c == 1, "one").when(c == 2, "two").otherwise("three_or_more"))


def role_shares(actions: DataFrame, min_actions: int = 20, cut: float = 0.70) -> DataFrame:
    """(user, total, creation_share, qualifier_share, rank_share, role) of (user, action) rows; the first that reaches the cut."""
    n = actions.groupBy("user").pivot("action", ["creation", "qualifier", "rank"]).count().fillna(0)
    total = F.col("creation") + F.col("qualifier") + F.col("rank")
    shares = n.withColumn("total", total).where(F.col("total") >= min_actions)
    for a in ("creation", "qualifier", "rank"):
        shares = shares.withColumn(f"{a}_share", F.col(a) / F.col("total"))
    role = F.when(F.col("creation_share") >= cut, "creation-focused").when(F.col("qualifier_share") >= cut, "qualifier-focused").when(F.col("rank_share") >= cut, "rank-focused").otherwise("mixed")
    return shares.select("user", "total", "creation_share", "qualifier_share", "rank_share", role.alias("role"))


def stability(constraints: DataFrame, qualifiers: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, s, n_qualifier_rows, n_initial, n_later, has_deleted_qualifier, span_days, is_deleted) of each constraint.

    constraints: (s, cdate, ddate). qualifiers: (s, cdate, ddate). windows: a fixed list of days. A qualifier is later if
    it came more than `window` days after the constraint; one without a time counts as initial.
    """
    q = qualifiers.select("s", F.col("cdate").alias("q_cdate"), F.col("ddate").alias("q_ddate"))
    met = constraints.join(q, "s", "left").crossJoin(F.broadcast(windows))  # the caller's list
    later = F.coalesce(days_between(F.col("q_cdate"), F.col("cdate")) > F.col("window"), F.lit(False))
    there = F.col("q_cdate").isNotNull() | F.col("q_ddate").isNotNull()
    return met.groupBy("window", "s", "cdate", "ddate").agg(
        F.count_if(there).alias("n_qualifier_rows"),
        F.count_if(there & ~later).alias("n_initial"),
        F.count_if(later).alias("n_later"),
        F.coalesce(F.bool_or(F.col("q_ddate").isNotNull()), F.lit(False)).alias("has_deleted_qualifier"),
        days_between(F.max("q_cdate"), F.min("q_cdate")).alias("span_days"),
    ).withColumn("is_deleted", F.col("ddate").isNotNull())


def window_sweep(stable: DataFrame) -> DataFrame:
    return stable.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_constraints"),
        F.avg((F.col("n_later") > 0).cast("double")).alias("share_with_later_qualifier"),
        *(F.percentile("n_later", p).alias(f"{n}_later_qualifier_rows") for n, p in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))),
    )


def type_concentration(creations: DataFrame, min_rows: int = 100) -> DataFrame:
    """(constraint_type, total, n_users, user, user_share): the user who makes most of a type, types of min_rows on."""
    users = creations.groupBy("constraint_type").agg(F.countDistinct("user").alias("n_users"))
    return dominant(creations, "constraint_type", "user", "user").join(users, "constraint_type").where(F.col("total") >= min_rows)


def co_participation(rows: DataFrame, min_shared: int = 3) -> DataFrame:
    """(user_1, user_2, shared): pairs of users active in at least so many common types; rows are (user, constraint_type).

    A user's types are ordered by how many users have them. Two users that share so many types share one that is not
    among the last min_shared - 1 of either, so users meet on the others only: those of fewer types meet nobody, and the
    types that everyone has make no pairs. What they share is then counted on both users' types.
    """
    own = rows.select("user", "constraint_type").where("user is not null and constraint_type is not null").distinct()
    often = own.groupBy("constraint_type").agg(F.count(F.lit(1)).alias("held"))
    types = own.join(often, "constraint_type").groupBy("user").agg(F.array_sort(F.collect_list(F.struct("held", "constraint_type"))).alias("types"))
    types = cut_lineage(types.where(F.size("types") >= min_shared).select("user", F.transform("types", lambda t: t["constraint_type"]).alias("types")))
    met = types.select("user", F.explode(F.slice("types", F.lit(1), F.size("types") - (min_shared - 1))).alias("type"))
    a, b = met.withColumnRenamed("user", "user_1"), met.withColumnRenamed("user", "user_2")
    pairs = a.join(b, "type").where("user_1 < user_2").select("user_1", "user_2").distinct()
    sides = (types.select(F.col("user").alias(f"user_{i}"), F.col("types").alias(f"types_{i}")) for i in (1, 2))
    for side in sides:
        pairs = pairs.join(side, side.columns[0])
    counted = pairs.select("user_1", "user_2", F.size(F.array_intersect("types_1", "types_2")).cast("long").alias("shared"))
    return counted.where(F.col("shared") >= min_shared)


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum, percentiles interpolated."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"),
        q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(column).cast("double").alias("max"),
    )


def days(spark: SparkSession, values: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(v),) for v in values], "window long")
