"""Report tables on top of the specialists and governance operators: candidates, drill-downs, mixes, rates by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeloom.functions.terms import days_between
from lifeloom.operators import specialists as S

#: Digits to which scores are compared, so that equal ones stay equal whatever the order of a sum was.
_DIGITS = 9


def with_removed(log: DataFrame, columns: tuple[str, ...] = ("rows", "users", "properties", "total_edits"), first: str = "raw") -> DataFrame:
    """A funnel's snapshots with what each stage has taken from the first one: <column>_removed, <column>_removed_pct."""
    base = log.where(F.col("stage") == first).select(*(F.col(c).alias(f"_{c}") for c in columns))
    met = log.crossJoin(F.broadcast(base))  # one row
    for c in columns:
        gone = F.col(f"_{c}") - F.col(c)
        met = met.withColumns({f"{c}_removed": gone, f"{c}_removed_pct": F.when(F.col(f"_{c}") > 0, 100 * gone / F.col(f"_{c}"))})
    return met.drop(*(f"_{c}" for c in columns))


def with_pct_change(compared: DataFrame) -> DataFrame:
    """An ablation's rows with the change in percent of what was there before; null where nothing was."""
    return compared.withColumn("pct_change", 100 * F.col("change") / F.nullif("before", F.lit(0.0)))


def candidates(counts: DataFrame, min_total_edits: int = 5) -> DataFrame:
    """A row for each user of enough edits: main property by TF-IDF and by lift, entropy in bits, all edits.

    (user, max_tfidf, top_property_by_tfidf, top_lift_property, top_lift_value, entropy_bits, total_edits). Ties go to
    the property that comes first by name.
    """
    scored = S.tfidf(counts).join(S.lift(counts), ["user", "property"])

    def best(score: str):
        # The largest score, of equal ones the first name: min over (-score, name).
        return F.min(F.struct((-F.round(score, _DIGITS)).alias("least"), F.col("property").alias("name"), F.col(score).alias("value")))

    tops = scored.groupBy("user").agg(best("tfidf").alias("t"), best("lift").alias("l"))
    users = S.entropy(counts).where(F.col("total") >= min_total_edits)
    return users.join(tops, "user").select(
        "user", F.col("t.value").alias("max_tfidf"), F.col("t.name").alias("top_property_by_tfidf"), F.col("l.name").alias("top_lift_property"),
        F.col("l.value").alias("top_lift_value"), F.col("entropy").alias("entropy_bits"), F.col("total").alias("total_edits"),
    )


def kind_summary(owners: DataFrame) -> DataFrame:
    """(kind, n_users, medians) of owners with specialist_kind(): those of one property and those of several."""
    columns = "owned_edit_fraction", "total_owned_edits", "mean_property_share"
    return owners.groupBy("kind").agg(F.count(F.lit(1)).alias("n_users"), *(F.median(c).alias(f"median_{c}") for c in columns))


def heads(df: DataFrame, by: tuple[str, ...], order: list, k: int) -> DataFrame:
    """The first k rows of each group in an order of mixed directions, with their place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def head(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of all, in an order of mixed directions: k rows a task, then k rows."""
    return df.orderBy(*order).limit(k)


def drill_down(counts: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """(user, class, edit_count, class_share, place): the k main classes of each of the users that are asked for."""
    own = counts.join(users.select("user").distinct(), "user", "left_semi").groupBy("user", "class").agg(F.sum("edit_count").alias("edit_count"))
    shares = own.withColumn("class_share", F.col("edit_count") / F.sum("edit_count").over(Window.partitionBy("user")))
    return heads(shares, ("user",), [F.desc("edit_count"), "class"], k)


def period_activity(edits: DataFrame, time: str, label: str, amount: str | None = None, k: int = 8, unit: str = "month") -> DataFrame:
    """(period, label, n) by calendar period for the k labels with most; rows without a time or a label count for none."""
    n = F.sum(amount) if amount else F.count(F.lit(1))
    rows = edits.where(F.col(time).isNotNull() & F.col(label).isNotNull())
    found = rows.groupBy(F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("period"), label).agg(n.alias("n"))
    top = found.groupBy(label).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), label).limit(k)
    return found.join(F.broadcast(top.select(label)), label, "left_semi").select("period", label, "n")  # k rows


def rolling_activity(found: DataFrame, label: str, rows: int = 3) -> DataFrame:
    """(period, label, n, rolling) of period_activity() with absent pairs as 0 and the mean of the last so many periods.

    The grid has a row for each period and each of the k labels.
    """
    grid = found.select("period").distinct().crossJoin(F.broadcast(found.select(label).distinct()))  # k labels
    full = grid.join(found, ["period", label], "left").fillna(0, ["n"])
    w = Window.partitionBy(label).orderBy("period").rowsBetween(-(rows - 1), 0)
    return full.withColumn("rolling", F.avg("n").over(w))


def creations(rows: DataFrame, types: DataFrame | None = None, flags: DataFrame | None = None, still_active: bool = False) -> DataFrame:
    """Rows (constraint_type, user, cdate, ddate, ...) that count as creations, with creator_type where flags are given.

    types: (constraint_type), the curated types; others go. flags: is_ip and is_bot by user; addresses and unknown users
    go, the rest are bot or human. still_active leaves out what has been deleted.
    """
    out = rows.where(F.col("ddate").isNull()) if still_active else rows
    out = out.where(F.col("cdate").isNotNull() & F.col("constraint_type").isNotNull())
    if types is not None:
        out = out.join(types.select("constraint_type").distinct(), "constraint_type", "left_semi")
    if flags is not None:
        out = out.join(flags.where(~F.col("is_ip")).select("user", "is_bot"), "user")
        out = out.withColumn("creator_type", F.when(F.col("is_bot"), "bot").otherwise("human")).drop("is_bot")
    return out


def participation_by(found: DataFrame, metadata: DataFrame, by: str) -> DataFrame:
    """(by, participation, n, share of the group): participation() merged with a statement's metadata.

    metadata: (statement, by, ...), one row for each time the statement was created: one that was created again counts
    once for each of its rows. A statement without metadata is of the null group.
    """
    met = found.join(metadata.select("statement", by), "statement", "left")
    n = met.groupBy(by, "participation").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def stability_by_type(stable: DataFrame, types: DataFrame) -> DataFrame:
    """Rates of stability() rows by constraint type: deleted, later qualifiers, deleted qualifiers, means and a median.

    types: (s, constraint_type); a statement of several rows there counts for each.
    """
    met = stable.join(types, "s")
    rate = lambda c: F.avg(c.cast("double"))
    return met.groupBy("window", "constraint_type").agg(
        F.count(F.lit(1)).alias("n_constraints"), rate(F.col("is_deleted")).alias("deletion_rate"), rate(F.col("n_later") > 0).alias("later_qualifier_rate"),
        rate(F.col("has_deleted_qualifier")).alias("deleted_qualifier_rate"), F.avg("n_qualifier_rows").alias("mean_qualifier_rows"),
        F.avg("n_later").alias("mean_later_qualifier_rows"), F.median("span_days").alias("median_qualifier_span_days"),
    )


def profile_mix(profiles: DataFrame, score: str, k: int = 100) -> DataFrame:
    """(profile, n, pct of k): the profiles of the k users with the highest scores, then most edits, then by name."""
    top = head(profiles, [F.desc(F.round(score, _DIGITS)), F.desc("total_edits"), "user"], k)
    return top.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(k)).alias("pct"))


def profile_examples(profiles: DataFrame, score: str, k: int = 3) -> DataFrame:
    """The k users of each profile but `Other` with the highest scores, then most edits, then by name."""
    return heads(profiles.where(F.col("profile") != "Other"), ("profile",), [F.desc(F.round(score, _DIGITS)), F.desc("total_edits"), "user"], k)


def merged_scores(swept: DataFrame, one: str, other: str, min_edits: int = 50) -> DataFrame:
    """(alpha, user, kl_one, kl_other): users scored under both baselines of kl_sweep()."""
    rows = swept.where(F.col("min_edits") == min_edits)
    side = lambda name, alias: rows.where(F.col("baseline") == name).select("alpha", "user", F.col("kl_divergence_smoothed").alias(alias))
    return side(one, "kl_one").join(side(other, "kl_other"), ["alpha", "user"])


def mean_lifetime(lifecycles: DataFrame, by: str) -> DataFrame:
    """(by, n, mean_days, max_days) of what has been deleted."""
    days = days_between(F.col("ddate"), F.col("cdate"))
    return lifecycles.where("ddate is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(days).alias("mean_days"), F.max(days).alias("max_days"))
