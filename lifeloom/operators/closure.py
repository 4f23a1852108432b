"""Temporal transitive closure, and subject-type validity and violations through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeloom.operators.intervals import intersect, merge, overlap_join, overlaps, subtract
from lifeloom.session import cut_lineage


def temporal_closure(edges: DataFrame) -> DataFrame:
    """(child, parent, start, end): all paths of edges (child, parent, start, end) whose validities have a time in common.

    Each round joins what the last one added with all that is known, on both sides, so known paths double in length and
    a chain of any depth takes its logarithm of rounds; it goes on until a round adds nothing. Contained or touching
    intervals of a pair are merged, and all ends are ends of edges, so cycles end too. Every round's table is
    checkpointed to the shared folder. Parallel edges and repeated rows are merged.
    """
    keys = ["child", "parent"]
    known = fresh = cut_lineage(merge(edges.where("child is not null and parent is not null"), keys))

    def joined(lower: DataFrame, upper: DataFrame) -> DataFrame:
        step = upper.select(F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("start").alias("e_start"), F.col("end").alias("e_end"))
        start, end = F.greatest("start", "e_start"), F.least("end", "e_end")
        met = lower.join(step, "parent").select("child", F.col("top").alias("parent"), start.alias("start"), end.alias("end"))
        return met.where("end is null or start < end")

    while not fresh.isEmpty():
        longer = joined(fresh, known).unionByName(joined(known, fresh))
        fresh = cut_lineage(subtract(longer, known, keys))
        known = cut_lineage(merge(known.unionByName(fresh), keys))
    return known


def subject_type_check(statements: DataFrame, membership: DataFrame, constraint: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(validity, violations) of statements under a subject-type constraint: tables of (s, o, start, end).

    statements: (s, o, start, end). membership: (s, class, start, end). constraint: (class, start, end), the classes
    asked for. closure: (child, parent, start, end). Valid while the subject is a member of one of the classes or of a
    class below it; violated for what is left of the time in which statement and constraint meet.
    """
    own = constraint.select(F.col("class").alias("parent"), "start", "end")
    below = overlap_join(closure, own, ["parent"], touching_point=False).select(F.col("child").alias("class"), F.col("i_start").alias("start"), F.col("i_end").alias("end"))
    asked = merge(below.unionByName(constraint.select("class", "start", "end")), ["class"])
    member = overlap_join(membership, asked, ["class"], touching_point=False).select("s", F.col("i_start").alias("start"), F.col("i_end").alias("end"))
    member = merge(member, ["s"])
    # The merged times of one constraint: at most as many rows as it has classes.
    time = F.broadcast(merge(constraint.select("start", "end"), []).select(F.col("start").alias("c_start"), F.col("end").alias("c_end")))
    met = statements.join(time, overlaps(F.col("start"), F.col("end"), F.col("c_start"), F.col("c_end")))
    required = met.select("s", "o", F.greatest("start", "c_start").alias("start"), F.least("end", "c_end").alias("end"))
    witnessed = statements.select("s", "o").distinct().join(member, "s").select("s", "o", "start", "end")
    keys = ["s", "o"]
    return intersect(required, witnessed, keys), subtract(required, witnessed, keys)
