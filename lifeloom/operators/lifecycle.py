"""Statement lifecycles from ordered snapshots: who added and who removed each statement, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lifecycle_from_snapshots(revisions: DataFrame, triples: DataFrame, page: str = "page", n: str = "ord") -> DataFrame:
    """(page, p, o, cdate, cuser, ddate, duser) from usable revisions and the statements each holds.

    revisions: (page, ord, ts, user), one row for each usable revision, also those without a statement, since they
    close what was there. triples: (page, ord, p, o), at most one row for each statement of a revision. A statement
    that stays over consecutive revisions is one row; one that comes back later gets another. Order is `ord`, never
    the time. Null ddate: still there after the last revision.

    Gaps and islands: revisions are numbered densely, and number less rank within the statement is constant over a
    run. Two shuffles, by page and by statement.
    """
    by_page = Window.partitionBy(page).orderBy(n)
    numbered = revisions.select(
        page,
        n,
        F.row_number().over(by_page).alias("n"),
        "ts",
        "user",
        F.lead("ts").over(by_page).alias("next_ts"),
        F.lead("user").over(by_page).alias("next_user"),
        F.lead(F.lit(1)).over(by_page).alias("has_next"),
    )
    held = triples.select(page, n, "p", "o").distinct().join(numbered, [page, n])
    runs = held.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy(page, "p", "o").orderBy("n")))
    last = F.max_by(F.struct("next_ts", "next_user", "has_next"), "n")
    return (
        runs.groupBy(page, "p", "o", "run")
        .agg(F.min_by(F.struct("ts", "user"), "n").alias("first"), last.alias("last"))
        .select(
            page,
            "p",
            "o",
            F.col("first.ts").alias("cdate"),
            F.col("first.user").alias("cuser"),
            F.when(F.col("last.has_next") == 1, F.col("last.next_ts")).alias("ddate"),
            F.when(F.col("last.has_next") == 1, F.col("last.next_user")).alias("duser"),
        )
    )


def truthy(lifecycles: DataFrame) -> DataFrame:
    """Rows of direct properties (wdt:)."""
    return lifecycles.where(F.trim("p").startswith("wdt:"))


def active(lifecycles: DataFrame) -> DataFrame:
    return lifecycles.where("ddate is null and duser is null")


def deleted(lifecycles: DataFrame) -> DataFrame:
    return lifecycles.where("ddate is not null")


def split_membership(lifecycles: DataFrame, instance_of: str = "wdt:P31", subclass_of: str = "wdt:P279") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instance-of rows, subclass-of rows, all other direct rows)."""
    rows = truthy(lifecycles)
    p = F.lower(F.trim("p"))
    kinds = instance_of.lower(), subclass_of.lower()
    return rows.where(p == kinds[0]), rows.where(p == kinds[1]), rows.where(~p.isin(*kinds))
