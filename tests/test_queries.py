import pytest

from lifeloom.plans import catalogue
from tests.oracle import from_sql, rows

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = from_sql(sf_dir, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_scan_and_interval_modes_agree_without_ties(spark):
    from lifeloom.operators.classes import class_edit_counts, class_edit_counts_by_scan

    member = spark.createDataFrame([("a", "X", 1, 5), ("a", "Y", 3, None), ("b", "X", 2, 4)], "item string, class string, cdate int, ddate int")
    edits = spark.createDataFrame([("a", "u", 2), ("a", "v", 4), ("a", "u", 6), ("b", "u", 7)], "item string, user string, t int")
    ts = lambda c: f"TIMESTAMP_NTZ '2024-01-01' + make_dt_interval({c})"
    m = member.selectExpr("item", "class", f"{ts('cdate')} AS cdate", f"{ts('ddate')} AS ddate")
    e = edits.selectExpr("item", "user", f"{ts('t')} AS t")
    by_interval = {(r["user"], r["class"]): r["count"] for r in class_edit_counts(e, m).groupBy("user", "class").sum("count").withColumnRenamed("sum(count)", "count").collect()}
    opened = m.selectExpr("item", "cdate AS t", "0L AS ord", "'_' AS user", "class")
    ends = m.where("ddate is not null").selectExpr("item", "class", "ddate AS t")
    scanned = class_edit_counts_by_scan(e.selectExpr("item", "t", "1L AS ord", "user"), opened, ends).where("user <> '_'")
    assert {(r["user"], r["class"]): r["edit_count"] for r in scanned.collect()} == by_interval == {("u", "X"): 1, ("v", "X"): 1, ("v", "Y"): 1, ("u", "Y"): 1}


def test_open_intervals_are_those_of_reading_in_order(spark):
    import random

    from lifeloom.operators.classes import open_intervals

    r = random.Random(3)
    asserted = [(f"i{r.randrange(4)}", r.choice("XY"), r.randrange(12), k) for k in range(60)] + [("i9", "X", 3, 0)]
    deleted = [(f"i{r.randrange(4)}", r.choice("XY"), r.randrange(12)) for _ in range(40)]
    at = "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(t)"
    a = spark.createDataFrame(asserted, "item string, class string, t int, ord long").selectExpr("item", "class", f"{at} AS t", "ord")
    d = spark.createDataFrame(deleted, "item string, class string, t int").selectExpr("item", "class", f"{at} AS t")
    day = lambda t: None if t is None else t.timetuple().tm_yday - 1
    got = sorted((x["item"], x["class"], day(x["cdate"]), x["ord"], day(x["ddate"])) for x in open_intervals(a, d).collect())
    want = []
    for key in {x[:2] for x in asserted}:
        ends, end = sorted(t for *k, t in deleted if tuple(k) == key), -1
        for *_, t, o in sorted(x for x in asserted if x[:2] == key):
            if end is not None and t >= end:
                ends = [e for e in ends if e >= t]
                end = ends.pop(0) if ends else None
                want.append((*key, t, o, end))
    assert got == sorted(want, key=lambda w: w)
