"""Specialists: how much of a contributor's work goes to few properties or classes, and how much of those is theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeloom.session import cut_lineage

#: Domination thresholds of an owned pair: edits of the property and of the user, share of the property, focus.
OWNED = {"min_prop_edits": 20, "min_user_edits": 50, "min_share": 0.75, "min_focus": 0.05}


def user_property_counts(lifecycles: DataFrame) -> DataFrame:
    """(user, property, count) of creations of direct properties by known users."""
    p = F.regexp_extract("p", r"^wdt:(P[1-9][0-9]*)$", 1)
    rows = lifecycles.where(F.col("cuser").isNotNull() & (F.col("cuser") != "")).select(F.col("cuser").alias("user"), p.alias("property"))
    return rows.where("property <> ''").groupBy("user", "property").agg(F.count(F.lit(1)).alias("count"))


#: Stages of the funnel, in order.
STAGES = ("raw", "after_ip_filter", "after_bot_filter", "after_min_property_users", "after_min_user_edits", "after_min_distinct_properties_per_user")


def funnel(counts: DataFrame, flags: DataFrame | None, min_users: int = 5, min_edits: int = 3, min_properties: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows left, one snapshot for each stage): addresses, bots, rare properties, then users of few edits or properties.

    counts has one row for each (user, property). Each filter is measured on the survivors of the one before it: a row
    carries the number of stages it passes, and users, properties and rows of a stage are those whose number, or
    whose rows' largest number, reaches it. Snapshots: (stage, rows, users, properties, total_edits).
    """
    first = F.lit(2)
    if flags is not None:
        counts = counts.join(flags.select("user", "is_ip", "is_bot"), "user", "left")
        first = F.when(F.coalesce("is_ip", F.lit(False)), 0).when(F.coalesce("is_bot", F.lit(False)), 1).otherwise(2)
    rows = cut_lineage(counts.select("user", "property", "count", first.alias("passed")))
    people = rows.where("passed = 2")
    known = people.groupBy("property").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_users).select("property", F.lit(True).alias("known"))
    kept = people.join(known, "property", "left_semi")
    own = kept.groupBy("user").agg(F.sum("count").alias("edits"), F.count(F.lit(1)).alias("n"))
    reach = own.select("user", F.when(F.col("edits") < min_edits, 3).when(F.col("n") < min_properties, 4).otherwise(5).alias("reach"))
    # Only rows that pass two stages and whose property is known get on; their user says how far.
    placed = rows.join(known, "property", "left").join(reach, "user", "left")
    far = F.when((F.col("passed") == 2) & F.col("known"), F.col("reach")).otherwise(F.col("passed"))
    placed = cut_lineage(placed.select("user", "property", "count", far.alias("passed")))
    zero = F.lit(0).cast("long")

    def of(key: str, name: str) -> DataFrame:
        best = placed.groupBy(key).agg(F.max("passed").alias("passed")).groupBy("passed").agg(F.count(F.lit(1)).alias("n"))
        return best.select("passed", *(F.col("n").alias(c) if c == name else zero.alias(c) for c in ("users", "properties")), zero.alias("rows"), zero.alias("edits"))

    sums = placed.groupBy("passed").agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("edits"))
    found = of("user", "users").unionByName(of("property", "properties")).unionByName(sums.select("passed", zero.alias("users"), zero.alias("properties"), "rows", "edits"))
    skipped = () if flags is not None else (1, 2)
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage")) for i, n in enumerate(STAGES) if i not in skipped)))
    at = found.withColumn("x", listed).select("x.*", *(F.when(F.col("passed") >= F.col("x.place"), F.col(c)).otherwise(0).alias(c) for c in ("users", "properties", "rows", "edits")))
    log = at.groupBy("stage").agg(
        F.sum("rows").alias("rows"), F.sum("users").alias("users"), F.sum("properties").alias("properties"), F.sum("edits").cast("double").alias("total_edits")
    )
    return placed.where("passed = 5").drop("passed"), log


def removals(counts: DataFrame, flags: DataFrame, key: str = "user", amount: str = "count") -> tuple[DataFrame, DataFrame]:
    """(rows of people, what went): addresses and bots taken out of counts, with statistics in one row.

    (n_users, n_ip_users, n_bot_users, n_removed_users, n_removed_rows, removed_edits, removed_user_share,
    removed_edit_share). A user that is both counts once among the removed. Rows without a user stay out of both.
    """
    met = counts.where(F.col(key).isNotNull()).join(flags.select(F.col("user").alias(key), "is_ip", "is_bot"), key, "left").fillna(False, ["is_ip", "is_bot"])
    gone = F.col("is_ip") | F.col("is_bot")
    users = met.groupBy(key).agg(
        F.first("is_ip").alias("is_ip"), F.first("is_bot").alias("is_bot"), F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("edits")
    )
    count = F.count(F.lit(1))
    stats = users.agg(
        count.alias("n_users"), F.count_if("is_ip").alias("n_ip_users"), F.count_if("is_bot").alias("n_bot_users"), F.count_if(gone).alias("n_removed_users"),
        F.coalesce(F.sum(F.when(gone, F.col("rows"))), F.lit(0)).alias("n_removed_rows"), F.coalesce(F.sum(F.when(gone, F.col("edits"))), F.lit(0)).alias("removed_edits"),
        (F.count_if(gone) / count).alias("removed_user_share"), (F.coalesce(F.sum(F.when(gone, F.col("edits"))), F.lit(0)) / F.sum("edits")).alias("removed_edit_share"),
    )
    return met.where(~gone).drop("is_ip", "is_bot"), stats


def matrix_stats(counts: DataFrame) -> DataFrame:
    """One row about the user x property matrix: users, properties, cells in use, density, medians and largest of both sides."""
    by_user = counts.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("edits"))
    by_property = counts.groupBy("property").agg(F.count(F.lit(1)).alias("n"))
    u = by_user.agg(
        F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("nnz"), F.sum("edits").alias("total_edits"), F.median("n").alias("median_properties_per_user"),
        F.median("edits").alias("median_edits_per_user"), F.max("n").alias("max_properties_per_user"),
    )
    p = by_property.agg(F.count(F.lit(1)).alias("n_properties"), F.median("n").alias("median_users_per_property"), F.max("n").alias("max_users_per_property"))
    return u.crossJoin(F.broadcast(p)).withColumn("density", F.col("nnz") / (F.col("n_users") * F.col("n_properties")))  # one row each


def _users(by: str = "user") -> Window:
    return Window.partitionBy(by)


def tfidf(counts: DataFrame) -> DataFrame:
    """(user, property, idf, tfidf): smooth idf ln((1 + n) / (1 + df)) + 1, rows scaled to length one."""
    df_ = counts.groupBy("property").agg(F.countDistinct("user").alias("df"))
    n = counts.agg(F.countDistinct("user").alias("n"))
    idf = df_.crossJoin(F.broadcast(n)).select("property", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    raw = counts.join(idf, "property").withColumn("raw", F.col("count") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(_users()))
    return raw.select("user", "property", "idf", (F.col("raw") / length).alias("tfidf"))


def top_per_user(scored: DataFrame, score: str, k: int = 5) -> DataFrame:
    """The k best rows of each user with rank; ties go to the property that comes first by name."""
    order = Window.partitionBy("user").orderBy(F.desc(score), "property")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lift(counts: DataFrame) -> DataFrame:
    """(user, property, lift): share in the user's edits over share in all edits."""
    total = counts.agg(F.sum("count").alias("total"))
    users, properties = (counts.groupBy(k).agg(F.sum("count").alias(n)) for k, n in (("user", "u"), ("property", "p")))
    shares = counts.join(users, "user").join(properties, "property").crossJoin(F.broadcast(total))  # one row
    return shares.select("user", "property", ((F.col("count") / F.col("u")) / (F.col("p") / F.col("total"))).alias("lift"))


def entropy(counts: DataFrame, key: str = "user", base2: bool = True) -> DataFrame:
    """(key, total, kinds, entropy) from the closed form log n - sum(c log c) / n: one aggregation, no window."""
    ln = F.log2("count") if base2 else F.log("count")
    sums = counts.where("count > 0").groupBy(key).agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("count") * ln).alias("s")
    )
    whole = F.log2("total") if base2 else F.log("total")
    return sums.select(key, "total", "kinds", F.greatest(F.lit(0.0), whole - F.col("s") / F.col("total")).alias("entropy"))


def extreme_users(counts: DataFrame, max_entropy: float = 0.01, min_edits: int = 1000) -> DataFrame:
    return entropy(counts).withColumn("is_extreme", (F.col("entropy") < max_entropy) & (F.col("total") > min_edits))


def leaders(counts: DataFrame) -> DataFrame:
    """The first user of each property: shares, gap to the second, concentration of the property and domination score.

    Totals and concentration are grouped sums with a map-side part (entropy from sums of c log c), and of each
    property's users only the first two go through the shuffle, so a property that everyone edits is no hot group.
    """
    c = F.col("count").cast("double")
    properties = counts.groupBy("property").agg(
        F.sum("count").alias("prop_total_edits"), F.count(F.lit(1)).alias("n_users"), F.sum(c * c).alias("squares"), F.sum(F.when(c > 0, c * F.log(c))).alias("logs")
    )
    users = counts.groupBy("user").agg(F.sum("count").alias("user_total_edits"))
    order = Window.partitionBy("property").orderBy(F.desc("count"), "user")
    two = counts.withColumn("place", F.row_number().over(order)).where("place <= 2")
    at = lambda place, column: F.max(F.when(F.col("place") == place, F.col(column)))
    first = two.groupBy("property").agg(
        at(1, "user").alias("user"), at(1, "count").alias("count"), F.coalesce(at(2, "count"), F.lit(0)).alias("second_count"), at(2, "user").alias("second_user")
    )
    rows = first.join(properties, "property").join(users, "user")
    total = F.col("prop_total_edits")
    uneven = F.when(F.col("n_users") > 1, (F.log(total) - F.col("logs") / total) / F.log("n_users")).otherwise(0.0)
    rows = rows.withColumns(
        {
            "rank_in_property": F.lit(1),
            "property_edit_share": F.col("count") / total,
            "user_focus_share": F.col("count") / F.col("user_total_edits"),
            "property_hhi": F.col("squares") / (total * total),
            "property_entropy_norm": uneven,
            "second_property_share": F.col("second_count") / total,
            "count_ratio_vs_second": F.col("count") / F.nullif("second_count", F.lit(0)),
            "solo_flag": F.col("n_users") == 1,
        }
    )
    score = F.col("property_edit_share") * F.sqrt("user_focus_share") * F.log1p("prop_total_edits") * (1.5 - F.col("property_entropy_norm"))
    added = {"share_gap": F.col("property_edit_share") - F.col("second_property_share"), "property_purity_users": 1 - F.col("property_entropy_norm"), "domination_score": score}
    return rows.withColumns(added).drop("squares", "logs")


def owned_pairs(led: DataFrame, min_prop_edits: int = 20, min_user_edits: int = 50, min_share: float = 0.75, min_focus: float = 0.05) -> DataFrame:
    return led.where(
        (F.col("prop_total_edits") >= min_prop_edits)
        & (F.col("user_total_edits") >= min_user_edits)
        & (F.col("property_edit_share") >= min_share)
        & (F.col("user_focus_share") >= min_focus)
    )


def portfolio(owned: DataFrame, top: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each user with owned properties: how many, how much of the user's work, and the largest by name."""
    order = Window.partitionBy(*keys, "user").orderBy(F.desc("count"), "property")
    ranked = owned.withColumn("place", F.row_number().over(order))
    named = F.sort_array(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "property"))))
    return (
        ranked.groupBy(*keys, "user")
        .agg(
            F.countDistinct("property").alias("n_owned_properties"),
            F.sum("count").alias("total_owned_edits"),
            F.avg("property_edit_share").alias("mean_property_share"),
            F.median("property_edit_share").alias("median_property_share"),
            F.avg("user_focus_share").alias("mean_user_focus"),
            F.max("user_focus_share").alias("max_user_focus"),
            F.max("user_total_edits").alias("total_user_edits"),
            F.array_join(F.transform(named, lambda x: x["property"]), ", ").alias("top_owned_properties"),
        )
        .withColumn("owned_edit_fraction", F.col("total_owned_edits") / F.col("total_user_edits"))
    )


def specialist_kind(owned: DataFrame) -> DataFrame:
    return owned.withColumn("kind", F.when(F.col("n_owned_properties") == 1, "property").otherwise("portfolio"))


def cluster_ownership(counts: DataFrame, clusters: DataFrame, alpha: float = 0.5, lam: float = 25.0) -> DataFrame:
    """Which community owns each property: smoothed shares over the whole property x cluster grid.

    counts: (user, property, count). clusters: (user, cluster). The grid has as many rows as properties times clusters,
    both labels of a model and not rows of data.
    """
    users = counts.select("user", "property").distinct().join(clusters, "user")
    n_pc = users.groupBy("property", "cluster").agg(F.countDistinct("user").alias("n_pc"))
    n_p = users.groupBy("property").agg(F.countDistinct("user").alias("n_p"))
    n_c = users.groupBy("cluster").agg(F.countDistinct("user").alias("n_c"))
    k = n_c.agg(F.count(F.lit(1)).alias("k"), F.sum("n_c").alias("n"))
    grid = n_p.crossJoin(n_c).crossJoin(F.broadcast(k)).join(n_pc, ["property", "cluster"], "left").fillna(0, ["n_pc"])
    share = (F.col("n_pc") + alpha) / (F.col("n_p") + alpha * F.col("k"))
    grid = grid.withColumns({"share": share, "coverage": (F.col("n_pc") + alpha) / (F.col("n_c") + 2 * alpha)})
    grid = grid.withColumn("enrichment", F.col("share") / (F.col("n_c") / F.col("n")))
    by = Window.partitionBy("property")
    order = by.orderBy(F.desc("share"), "cluster")
    ent = -F.sum(F.col("share") * F.log("share")).over(by)
    grid = grid.withColumns(
        {
            "place": F.row_number().over(order),
            "second_share": F.lead("share").over(order),
            "entropy_norm": F.when(F.col("k") > 1, ent / F.log("k")).otherwise(0.0),
        }
    )
    first = grid.where("place = 1").withColumns({"purity": 1 - F.col("entropy_norm"), "support_weight": F.col("n_p") / (F.col("n_p") + lam)})
    score = F.col("purity") * F.col("coverage") * F.log1p("enrichment") * F.col("support_weight")
    hard = (
        F.when(F.col("n_p") < 30, "rare/unstable")
        .when((F.col("share") >= 0.60) & (F.col("coverage") >= 0.05) & (F.col("enrichment") >= 2), "community-owned")
        .when((F.coalesce("second_share", F.lit(0.0)) >= 0.25) & (F.col("purity") >= 0.20), "bridge/multi-community")
        .otherwise("generic/mixed")
    )
    return first.select(
        "property", F.col("cluster").alias("owner_cluster"), F.col("n_pc").alias("owner_users"), "n_p", "n_c",
        F.col("share").alias("owner_share"), F.col("coverage").alias("owner_coverage"), F.col("enrichment").alias("owner_enrichment"),
        F.log2("enrichment").alias("owner_log2_enrichment"), "entropy_norm", "purity", F.coalesce("second_share", F.lit(0.0)).alias("second_share"),
        "support_weight", score.alias("owned_score"), hard.alias("class"),
    )


#: Soft ownership: users of the property, owner's share, enrichment and coverage, purity, and the second's share at most.
SOFT = {"min_users": 30, "min_share": 0.45, "min_enrichment": 3.0, "min_coverage": 0.02, "min_purity": 0.45, "max_second": 0.35}


def with_soft_class(owned: DataFrame) -> DataFrame:
    """Rows of cluster_ownership() with class_soft, the class under the softer thresholds."""
    soft = (
        F.when(F.col("n_p") < SOFT["min_users"], "rare/unstable")
        .when(
            (F.col("owner_share") >= SOFT["min_share"])
            & (F.col("owner_enrichment") >= SOFT["min_enrichment"])
            & (F.col("purity") >= SOFT["min_purity"])
            & (F.col("owner_coverage") >= SOFT["min_coverage"])
            & (F.col("second_share") <= SOFT["max_second"]),
            "community-owned-soft",
        )
        .when((F.col("second_share") >= 0.25) & (F.col("purity") >= 0.20), "bridge/multi-community")
        .otherwise("generic/mixed")
    )
    return owned.withColumn("class_soft", soft)


def borderline(owned: DataFrame, min_users: int = 30, min_enrichment: float = 3.0, low: float = 0.40, high: float = 0.60) -> DataFrame:
    """Rows of cluster_ownership() near the boundary: supported, enriched, and an owner's share from low to high."""
    return owned.where((F.col("n_p") >= min_users) & (F.col("owner_enrichment") >= min_enrichment) & F.col("owner_share").between(low, high))


def cluster_profile(counts: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """The main properties of each cluster: those among the first by mean TF-IDF or among the first by coverage.

    (cluster, property, users_in_cluster, total_edits_in_cluster, global_users, coverage, cluster_share, mean_tfidf,
    place_by_tfidf, place_by_coverage). clusters: (user, cluster). The mean is over all users of the cluster, those
    without the property as zero; coverage is the share of them that use it, cluster_share the share of the property's
    users that are in the cluster. Equal values go to the property that comes first by name.
    """
    size = clusters.groupBy("cluster").agg(F.countDistinct("user").alias("n_c"))
    everyone = counts.groupBy("property").agg(F.countDistinct("user").alias("global_users"))
    found = counts.join(tfidf(counts).select("user", "property", "tfidf"), ["user", "property"]).join(clusters, "user")
    found = found.groupBy("cluster", "property").agg(
        F.countDistinct("user").alias("users_in_cluster"), F.sum("count").alias("total_edits_in_cluster"), F.sum("tfidf").alias("s")
    )
    rows = found.join(size, "cluster").join(everyone, "property")
    rows = rows.withColumns(
        {
            "coverage": F.col("users_in_cluster") / F.col("n_c"),
            "cluster_share": F.col("users_in_cluster") / F.col("global_users"),
            "mean_tfidf": F.col("s") / F.col("n_c"),
        }
    )
    by = Window.partitionBy("cluster")
    rows = rows.withColumns(
        {
            "place_by_tfidf": F.row_number().over(by.orderBy(F.desc(F.round("mean_tfidf", 9)), "property")),
            "place_by_coverage": F.row_number().over(by.orderBy(F.desc("users_in_cluster"), "property")),
        }
    )
    return rows.where(F.least("place_by_tfidf", "place_by_coverage") <= top).drop("n_c", "s")


def class_profile(counts: DataFrame) -> DataFrame:
    """A row for each user of (user, class, edit_count): shares of the two main classes, entropy, effective classes."""
    by = Window.partitionBy("user")
    order = by.orderBy(F.desc("edit_count"), "class")
    rows = counts.withColumns({"total": F.sum("edit_count").over(by), "place": F.row_number().over(order)})
    rows = rows.withColumn("share", F.col("edit_count") / F.col("total"))
    ent = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log2("share")))
    out = rows.groupBy("user").agg(
        F.max("total").alias("total_edits"),
        F.count(F.lit(1)).alias("active_classes"),
        F.max("share").alias("max_class_share"),
        F.greatest(F.lit(0.0), ent).alias("entropy"),
        F.max(F.when(F.col("place") == 1, F.col("class"))).alias("top_class"),
        F.max(F.when(F.col("place") == 1, F.col("share"))).alias("top_class_share"),
        F.max(F.when(F.col("place") == 2, F.col("class"))).alias("second_class"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("share"))), F.lit(0.0)).alias("second_class_share"),
    )
    norm = F.when(F.col("active_classes") > 1, F.col("entropy") / F.log2("active_classes")).otherwise(0.0)
    return out.withColumns({"normalized_entropy": norm, "specialization_score": 1 - norm, "effective_classes": F.pow(F.lit(2.0), "entropy")})


def global_shares(counts: DataFrame) -> DataFrame:
    """(class, global_edits, global_share)."""
    sums = counts.groupBy("class").agg(F.sum("edit_count").alias("global_edits"))
    return sums.crossJoin(F.broadcast(counts.agg(F.sum("edit_count").alias("all")))).select("class", "global_edits", (F.col("global_edits") / F.col("all")).alias("global_share"))  # one row


def smoothed_kl(counts: DataFrame, baseline: DataFrame, alpha: float = 0.5, min_edits: int = 50, min_classes: int = 2) -> DataFrame:
    """(user, kl_divergence_smoothed, top_class_by_kl_contribution, top_kl_term) of each user against a baseline.

    counts: (user, class, edit_count). baseline: (class, mass). q = (m + alpha) / (sum m + alpha K), K the classes of
    users and baseline together; sum p log2(p / q) over the user's classes. Users need min_edits, then min_classes.
    """
    by = Window.partitionBy("user")
    rows = counts.withColumns({"total": F.sum("edit_count").over(by), "kinds": F.count(F.lit(1)).over(by)})
    rows = rows.where((F.col("total") >= min_edits) & (F.col("kinds") >= min_classes))
    kept = rows.select("class").union(baseline.select("class")).distinct()
    size = kept.agg(F.count(F.lit(1)).alias("k")).crossJoin(baseline.agg(F.coalesce(F.sum("mass"), F.lit(0)).alias("whole")))  # one row
    met = rows.join(baseline, "class", "left").crossJoin(F.broadcast(size))
    q = (F.coalesce("mass", F.lit(0)) + alpha) / (F.col("whole") + alpha * F.col("k"))
    p = F.col("edit_count") / F.col("total")
    terms = met.select("user", "class", (p * F.log2(p / q)).alias("term"))
    order = by.orderBy(F.desc("term"), "class")
    ranked = terms.withColumn("place", F.row_number().over(order))
    return ranked.groupBy("user").agg(
        F.sum("term").alias("kl_divergence_smoothed"),
        F.max(F.when(F.col("place") == 1, F.col("class"))).alias("top_class_by_kl_contribution"),
        F.max(F.when(F.col("place") == 1, F.col("term"))).alias("top_kl_term"),
    )


def baseline_mixture(edits: DataFrame, instances: DataFrame, lam: float) -> DataFrame:
    """(class, mass): lam of the class's share of edits and the rest of its share of added instances."""
    share = lambda df, n: df.crossJoin(F.broadcast(df.agg(F.sum("mass").alias("all")))).select("class", (F.col("mass") / F.col("all")).alias(n))  # noqa: E731 - one row
    e, i = share(edits, "e"), share(instances, "i")
    zero = F.lit(0.0)
    return e.join(i, "class", "full").select("class", (lam * F.coalesce("e", zero) + (1 - lam) * F.coalesce("i", zero)).alias("mass"))


def class_intensity(edits: DataFrame, adds: DataFrame) -> DataFrame:
    """Edits for each added instance and the share of deletions, over the classes of either table."""
    met = edits.join(adds, "class", "full").fillna(0)
    return met.withColumns(
        {
            "edits_per_added": F.col("global_edits") / F.nullif("n_total_instances_added", F.lit(0)),
            "delete_rate": F.col("n_instances_deleted") / F.nullif("n_total_instances_added", F.lit(0)),
        }
    )


def typology(profiles: DataFrame) -> DataFrame:
    """A: share from the 90th percentile on, at most 3 classes. B: 50th to 90th, 4 to 15. C: share below .6, 16 or more."""
    cuts = profiles.agg(F.percentile("max_class_share", 0.5).alias("p50"), F.percentile("max_class_share", 0.9).alias("p90"))
    s, n = F.col("max_class_share"), F.col("active_classes")
    kind = (
        F.when((s >= F.col("p90")) & (n <= 3), "A")
        .when((s >= F.col("p50")) & (s < F.col("p90")) & n.between(4, 15), "B")
        .when((s < 0.6) & (n >= 16), "C")
        .otherwise("Other")
    )
    return profiles.crossJoin(F.broadcast(cuts)).withColumn("profile", kind).drop("p50", "p90")  # one row


def average_rank(df: DataFrame, value: str, keys: list[str], name: str = "avg_rank") -> DataFrame:
    """Rank of descending value within keys, equal values sharing the mean of their ranks."""
    same = Window.partitionBy(*keys, value)
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2)
