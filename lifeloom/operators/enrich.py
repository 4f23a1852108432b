"""Corrections joined with the lifecycles of the statements they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeloom.functions.terms import match_key


def _matched(corrections: DataFrame, lifecycles: DataFrame, keys: list[str], files: DataFrame | None, extra: list[str]) -> DataFrame:
    hits = lifecycles.withColumn("hit", F.lit(True))
    out = corrections.join(hits, keys, "left").withColumn("match_status", F.when(F.col("hit"), "found").otherwise("not_found")).drop("hit")
    if files is not None:
        out = out.join(files, "s", "left")
    return out.drop(*extra)


def subject_files(lifecycles: DataFrame, file: str = "src_file") -> DataFrame:
    """(s, history_file): the file that holds a subject, the first by name."""
    return lifecycles.groupBy("s").agg(F.min(file).alias("history_file"))


def enrich_exact(corrections: DataFrame, lifecycles: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Corrections (row_id, constraint_id, s, p, o) with cdate, cuser, ddate, duser and match_status; a row for each hit."""
    own = corrections.withColumns({c: F.trim(c) for c in ("s", "p", "o")})
    return _matched(own, lifecycles.select("s", "p", "o", "cdate", "cuser", "ddate", "duser"), ["s", "p", "o"], files, [])


def enrich_normalised(corrections: DataFrame, lifecycles: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The same on normalised objects, with matched_history_o. Only objects of subjects that are asked for are normalised."""
    ks, kp, ko = match_key(F.col("s"), F.col("p"), F.col("o"))
    own = corrections.withColumns({"k_s": ks, "k_p": kp, "k_o": ko})
    asked = own.select("k_s", "k_p").distinct()
    near = lifecycles.withColumns({"k_s": F.coalesce(F.trim("s"), F.lit("")), "k_p": F.coalesce(F.trim("p"), F.lit(""))}).join(asked, ["k_s", "k_p"], "left_semi")
    held = near.select("k_s", "k_p", match_key(F.col("s"), F.col("p"), F.col("o"))[2].alias("k_o"), F.col("o").alias("matched_history_o"), "cdate", "cuser", "ddate", "duser")
    return _matched(own, held, ["k_s", "k_p", "k_o"], files, ["k_s", "k_p", "k_o"])
