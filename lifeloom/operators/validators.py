"""Historical validation: did a statement break a constraint while both were there?

Every validator takes corrections (row_id, constraint_id, s, p, o, cdate, ddate, match_status), entries and exceptions of
one kind (see constraints.entries) and, but for one-of, the lifecycles that witness or contradict. Each gives a status at
two levels: against all entries of the property, and against those of the row's own constraint only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeloom.functions.terms import wd_to_wdt, wdt_to_wd
from lifeloom.operators.intervals import far, merge
from lifeloom.session import cut_lineage

KINDS = ("one_of", "conflicts_with", "inverse", "symmetric", "item_requires_statement", "value_requires_statement", "none_of")
GOOD = {
    "conflicts_with": "not_violation_no_conflicting_statement",
    "inverse": "not_violation_inverse_covers_required_lifecycle",
    "symmetric": "not_violation_reverse_covers_required_lifecycle",
    "item_requires_statement": "not_violation_required_statement_covers_required_lifecycle",
    "value_requires_statement": "not_violation_required_statement_covers_required_lifecycle",
}


#: A correction is judged once at each level: against all entries of its property, and against those of its own constraint.
LEVELS = ("property", "constraint")
#: A number for each row and level, in place of what may be long texts.
ROW = ["rid"]


def _prepared(corrections: DataFrame, entries: DataFrame, as_of: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows with prop and interval, entries and exceptions), open ends at the far instant or at as_of."""
    end = F.lit(as_of).cast("timestamp_ntz") if as_of else far()
    rows = corrections.select(
        "row_id", "constraint_id", F.trim("s").alias("s"), F.trim("o").alias("o"), "match_status",
        wdt_to_wd(F.col("p")).alias("prop"), F.trim("p").alias("p"), F.col("cdate").cast("timestamp_ntz").alias("a"), F.coalesce(F.col("ddate").cast("timestamp_ntz"), end).alias("b"),
    )
    e = entries.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.coalesce(F.col("end").cast("timestamp_ntz"), end)})
    return rows, e.where("start is not null and start < end").withColumnRenamed("constraint_id", "cid")


def _at_levels(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows at both levels, numbered."""
    return rows.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("rid", F.monotonically_increasing_id()), listed


def _at_level() -> Column:
    return (F.col("level") == "property") | (F.col("cid") == F.col("constraint_id"))


def _with_presence(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with known_prop and has_entry: is there a constraint on the property, and an entry at this level?"""
    entry = listed.where("role = 'entry'")
    props = listed.groupBy("prop").agg(F.bool_or(F.col("role") == "entry").alias("any_entry")).withColumn("known_prop", F.lit(True))
    own = entry.select("prop", F.col("cid").alias("constraint_id"), F.lit(True).alias("own_entry")).distinct()
    met = rows.join(props, "prop", "left").join(own, ["prop", "constraint_id"], "left")
    has = F.when(F.col("level") == "property", F.col("any_entry")).otherwise(F.col("own_entry"))
    return met.withColumn("has_entry", F.coalesce(has, F.lit(False))).drop("any_entry", "own_entry")


def _cut(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries' intervals within the row's own time, one row each: where they meet."""
    met = rows.join(entries, "prop").where(_at_level())
    start, end = F.greatest("a", "start"), F.least("b", "end")
    return met.withColumns({"start": start, "end": end}).where("start < end")


def _exempt(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(rid, start, end) in which the row's subject is excepted."""
    own = exceptions.where("entity is not null").withColumnRenamed("entity", "s")
    met = rows.select(*ROW, "level", "prop", "s", "constraint_id", "a", "b").join(own, ["prop", "s"]).where(_at_level())
    start, end = F.greatest("a", "start"), F.least("b", "end")
    return met.select(*ROW, start.alias("start"), end.alias("end")).where("start < end")


def _witnesses(lifecycles: DataFrame) -> DataFrame:
    start, end = F.col("cdate").cast("timestamp_ntz"), F.coalesce(F.col("ddate").cast("timestamp_ntz"), far())
    return lifecycles.select(F.col("s").alias("w_s"), F.col("p").alias("w_p"), F.col("o").alias("w_o"), start.alias("w_start"), end.alias("w_end")).where("w_start < w_end")


def _one_of(rows: DataFrame, listed: DataFrame, forbidden: bool) -> DataFrame:
    """One sweep over a row's event points: how many entries are open at each, how many of them list the object, and how
    many exceptions are open."""
    entries, exceptions = listed.where("role = 'entry'"), listed.where("role = 'exception'")
    cut = _cut(rows, entries).select(*ROW, "start", "end", F.lit(1).alias("held"), F.col("entity").eqNullSafe(F.col("o")).cast("int").alias("listed"), F.lit(0).alias("freed"))
    own = _exempt(rows, exceptions).select(*ROW, "start", "end", F.lit(0).alias("held"), F.lit(0).alias("listed"), F.lit(1).alias("freed"))
    names = ("held", "listed", "freed")
    both = cut.unionByName(own)
    steps = both.select(*ROW, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("x"), *names)
    steps = steps.groupBy(*ROW, F.col("x.t").alias("t")).agg(*(F.sum(F.col(n) * F.col("x.d")).alias(n) for n in names))
    running = Window.partitionBy(*ROW).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    segments = steps.select(*ROW, *(F.sum(n).over(running).alias(n) for n in names)).where("held > 0")
    wrong = F.col("listed") > 0 if forbidden else F.col("listed") == 0
    seen = segments.groupBy(*ROW).agg(F.bool_or((F.col("freed") == 0) & wrong).alias("bad"), F.bool_or(F.col("freed") > 0).alias("excepted"))
    status = (
        F.when(~F.col("match_status").eqNullSafe("found"), "no_historical_row")
        .when(F.col("prop").isNull(), "non_wdt_property")
        .when(F.col("a").isNull(), "invalid_dates")
        .when(F.col("known_prop").isNull(), "no_constraint_for_property")
        .when(~F.col("has_entry"), "no_constraint_for_property_instance")
        .when(F.col("bad").isNull(), "no_constraint_lifecycle_intersection")
        .when(F.col("bad"), "historical_violation")
        .when(F.col("excepted"), "not_violation_exception")
        .otherwise("not_violation_object_allowed")
    )
    return _with_presence(rows, listed).join(seen, ROW, "left").select("row_id", "level", status.alias("status"))


def _minus(start: Column, end: Column, taken: Column) -> Column:
    """What an array of (start, end), in order of start, leaves of an interval: the rest as an array, in order."""
    empty = F.array().cast("array<struct<start:timestamp_ntz,end:timestamp_ntz>>")
    piece = lambda a, b: F.when(a < b, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(empty)
    step = lambda x, t: F.struct(F.greatest(x["at"], t["end"]).alias("at"), F.concat(x["left"], piece(x["at"], F.least(t["start"], end))).alias("left"))
    some = F.aggregate(taken, F.struct(start.alias("at"), empty.alias("left")), step, lambda x: F.concat(x["left"], piece(x["at"], end)))
    return F.when(F.coalesce(F.size(taken), F.lit(0)) <= 0, piece(start, end)).otherwise(some)


def _gathered(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of a key as an array of (columns), `start` first."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("held"))


def _merged_witnesses(w: DataFrame, anything: bool) -> DataFrame:
    """Witnesses' times by subject, property and object, overlapping ones made one; with anything also those of all objects,
    under a null one. What many witnesses cover together is few intervals."""
    w = w.select("w_s", "w_p", "w_o", F.col("w_start").alias("start"), F.col("w_end").alias("end")).where("w_s is not null and w_p is not null and w_o is not null")
    w = w.union(w.withColumn("w_o", F.lit(None).cast("string"))) if anything else w
    merged = merge(w, ["w_s", "w_p", "w_o"])
    return merged.withColumn("end", F.coalesce("end", far()))


def _judged(kind: str, rows: DataFrame, listed: DataFrame, lifecycles: DataFrame, strict: bool) -> DataFrame:
    """Statuses of both levels, a column each. All that a row meets is brought to it as arrays (the entries of its property,
    the exceptions of its subject, the witnesses of its subject or object), so that rows are not multiplied and shuffled."""
    entry = F.struct("start", "end", "cid", F.col("pq2306") if kind != "symmetric" else F.lit(None).alias("pq2306"), "pq2305", wd_to_wdt(F.col("pq2306")).alias("need"))
    usable = entry["need"].isNotNull() if kind != "symmetric" else F.lit(True)
    asked = F.collect_list(F.when((F.col("role") == "entry") & usable, entry))
    cids = F.collect_set(F.when(F.col("role") == "entry", F.col("cid")))
    props = listed.where("prop is not null").groupBy("prop").agg(F.bool_or(F.col("role") == "entry").alias("any_entry"), cids.alias("cids"), asked.alias("asked"))
    freed = _gathered(listed.where("role = 'exception' and entity is not null").withColumnRenamed("entity", "x_s"), "x_s", "start", "end", "prop", "cid").withColumnRenamed("held", "freed")
    w, by_object = _witnesses(lifecycles), kind in ("inverse", "symmetric", "value_requires_statement")
    if kind in ("inverse", "symmetric"):
        # The reverse statement of a row is by its subject and object: its key is both.
        w = _merged_witnesses(w, False).withColumn("who", F.struct(F.col("w_s").alias("x"), F.col("w_o").alias("y")))
        who = F.struct(F.col("o").alias("x"), F.col("s").alias("y"))
    else:
        w = (_merged_witnesses(w, kind != "conflicts_with" or strict)).withColumn("who", F.col("w_s"))
        who = F.col("o") if by_object else F.col("s")
    w = _gathered(w, "who", "start", "end", "w_p", "w_o").withColumnsRenamed({"who": "w_who", "held": "met"})
    all_rows = rows.join(props, "prop", "left").join(freed, F.col("s") == F.col("x_s"), "left").join(w, who == F.col("w_who"), "left")

    def own(level: str, x: Column) -> Column:
        return F.lit(True) if level == "property" else F.coalesce(x["cid"] == F.col("constraint_id"), F.lit(False))

    def meets(x: Column) -> Column:
        return F.greatest(F.col("a"), x["start"]) < F.least(F.col("b"), x["end"])

    def left(level: str, cut: Column) -> Column:
        """Cut entries with their interval replaced by what exceptions leave of it, an entry for each piece."""
        free = F.filter(F.coalesce("freed", F.array().cast(dict(freed.dtypes)["freed"])), lambda x: (x["prop"] == F.col("prop")) & own(level, x) & meets(x))
        pieces = lambda e: F.transform(
            _minus(F.greatest(F.col("a"), e["start"]), F.least(F.col("b"), e["end"]), free),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), e["cid"].alias("cid"), e["need"].alias("need"), e["pq2305"].alias("value")),
        )
        return F.flatten(F.transform(cut, pieces))

    none = F.array().cast(dict(w.dtypes)["met"])
    need = lambda e: F.col("p") if kind == "symmetric" else e["need"]

    def seen_by(e: Column, value: Column | None) -> Column:
        """Witnesses that have to do with a piece: of its property, and of the value or, where that is null, of any."""
        fits = lambda m: (m["w_p"] == need(e)) & (F.lit(True) if value is None else m["w_o"].eqNullSafe(value)) & (m["start"] < e["end"]) & (e["start"] < m["end"])
        return F.filter("met", lambda m: F.coalesce(fits(m), F.lit(False)))

    def broken(rest: Column) -> Column:
        if kind == "conflicts_with":
            hit = lambda e: F.size(seen_by(e, e["value"])) > 0
            return F.exists(rest, hit if strict else lambda e: e["value"].isNotNull() & hit(e))
        if kind in ("inverse", "symmetric"):
            return F.exists(rest, lambda e: need(e).isNotNull() & (F.size(_minus(e["start"], e["end"], seen_by(e, None))) > 0))
        # At each instant one of the values that are asked for then will do, or any if the property alone is.
        within = lambda e: F.transform(seen_by(e, e["value"]), lambda m: F.struct(F.greatest(m["start"], e["start"]).alias("start"), F.least(m["end"], e["end"]).alias("end")))
        same = lambda e: F.filter(rest, lambda x: x["cid"].eqNullSafe(e["cid"]) & (x["need"] == e["need"]))
        return F.exists(rest, lambda e: F.size(_minus(e["start"], e["end"], F.array_sort(F.flatten(F.transform(same(e), within))))) > 0)

    def cut(level: str) -> Column:
        """Entries that are in force at some time of the row's own."""
        return F.filter(F.coalesce("asked", F.array().cast(dict(props.dtypes)["asked"])), lambda e: own(level, e) & meets(e))

    all_rows = all_rows.withColumn("met", F.filter(F.coalesce("met", none), meets)).withColumns({f"cut_{level}": cut(level) for level in LEVELS})
    all_rows = all_rows.withColumns({f"rest_{level}": left(level, F.col(f"cut_{level}")) for level in LEVELS})

    def status(level: str) -> Column:
        has = F.col("any_entry") if level == "property" else F.array_contains("cids", F.col("constraint_id"))
        return (
            F.when(~F.col("match_status").eqNullSafe("found"), "no_historical_row")
            .when(F.col("prop").isNull(), "non_wdt_property")
            .when(F.col("any_entry").isNull(), "no_constraint_for_property")
            .when(F.col("a").isNull() | (F.col("a") >= F.col("b")), "invalid_dates")
            .when(~F.coalesce(has, F.lit(False)), "no_constraint_for_property_instance")
            .when(F.size(f"cut_{level}") == 0, "no_constraint_lifecycle_intersection")
            .when(F.size(f"rest_{level}") == 0, "not_violation_exception")
            .when(broken(F.col(f"rest_{level}")), "historical_violation")
            .otherwise(GOOD[kind])
        )

    return all_rows.select("row_id", *(status(level).alias(level) for level in LEVELS))


def validate(
    kind: str, corrections: DataFrame, entries: DataFrame, lifecycles: DataFrame | None = None, as_of: str | None = None, strict_any_value: bool = False
) -> DataFrame:
    """(row_id, historical_status_property_level, historical_status_constraint_id_level) of each correction.

    Both levels are judged in one pass. A conflict that names a property without a value never
    contradicts, as no object is null; strict_any_value makes any value of the property one. as_of stands for the end of
    what is still there (one-of); without it, it is far off.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    names = "historical_status_property_level", "historical_status_constraint_id_level"
    rows, listed = _prepared(corrections, entries, as_of)
    if kind in ("one_of", "none_of"):
        both = _one_of(*map(cut_lineage, _at_levels(rows, listed)), kind == "none_of")  # once written, numbers stay
        both = both.select("row_id", *(F.when(F.col("level") == level, F.col("status")).alias(level) for level in LEVELS))
    else:
        listed = cut_lineage(listed)
        # Only lifecycles of properties that some entry asks for can witness anything.
        asked = rows.select("p") if kind == "symmetric" else listed.where("role = 'entry'").select(wd_to_wdt(F.col("pq2306")).alias("p"))
        needed = asked.where("p is not null").distinct()
        lifecycles = lifecycles.select("s", "p", "o", "cdate", "ddate").join(needed, "p", "left_semi")
        both = _judged(kind, rows, listed, lifecycles, strict_any_value)
    return both.groupBy("row_id").agg(*(F.max(level).alias(n) for level, n in zip(LEVELS, names, strict=True)))


def summary(validated: DataFrame) -> DataFrame:
    """(level, status, n): the histogram of both status columns."""
    names = {"historical_status_property_level": "property_level", "historical_status_constraint_id_level": "constraint_id_level"}
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(k).alias("status")) for k, v in names.items())))
    return validated.select(pairs.alias("x")).groupBy("x.level", "x.status").agg(F.count(F.lit(1)).alias("n"))
