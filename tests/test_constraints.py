from datetime import datetime, timedelta

from lifeloom.operators import constraints as C

T0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def history(spark, extra=()):
    rows = []
    for name, kind in (("wds:a", "wd:Q21510859"), ("wds:b", "wd:Q21510859")):
        rows += [("wd:P1", "p:P2302", name, 0, None), (name, "ps:P2302", kind, 0, None), (name, "pq:P2305", f"wd:{name[-1]}", 0, 20)]
    rows += [("wds:a", "wikibase:rank", C.NORMAL, 0, None), ("wds:b", "wikibase:rank", C.NORMAL, 0, 5), ("wds:b", "wikibase:rank", C.PREFERRED, 5, 10), *extra]
    data = [(s, p, o, day(a), day(b)) for s, p, o, a, b in rows]
    return spark.createDataFrame(data, "s string, p string, o string, cdate timestamp_ntz, ddate timestamp_ntz")


def spans(df, key):
    return sorted((r[key], (r.start - T0).days, None if r.end is None else (r.end - T0).days) for r in df.collect())


def test_preferred_statement_overrides_normal_ones(spark):
    parts = C.statement_intervals(C.constraint_rows(history(spark)), C.kinds(spark))
    active = C.active_intervals(*parts[:3])
    assert spans(active, "statement") == [("wds:a", 0, 5), ("wds:a", 10, None), ("wds:b", 0, 10)]


def test_statement_without_link_is_left_out(spark):
    extra = [("wds:c", "ps:P2302", "wd:Q21510859", 0, None), ("wds:c", "wikibase:rank", C.NORMAL, 0, None)]
    types, *_ = C.statement_intervals(history(spark, extra), C.kinds(spark))
    assert {r.statement for r in types.collect()} == {"wds:a", "wds:b"}


def test_value_entries_hold_while_their_statement_is_in_force(spark):
    parts = C.statement_intervals(C.constraint_rows(history(spark)), C.kinds(spark))
    found = C.entries(*parts).where("kind = 'one_of' and role = 'entry'")
    assert spans(found, "entity") == [("wd:a", 0, 5), ("wd:a", 10, 20), ("wd:b", 0, 10)]


def test_property_alone_holds_for_what_its_values_leave(spark):
    kind = "wd:Q21502838"
    rows = [("wd:P1", "p:P2302", "wds:d", 0, None), ("wds:d", "ps:P2302", kind, 0, None), ("wds:d", "wikibase:rank", C.NORMAL, 0, None)]
    rows += [("wds:d", "pq:P2306", "wd:P9", 0, 10), ("wds:d", "pq:P2305", "wd:Q1", 3, 6)]
    parts = C.statement_intervals(C.constraint_rows(history(spark, rows)), C.kinds(spark))
    pairs = C.property_value_pairs(C.active_intervals(*parts[:3]), parts[3])
    got = sorted((r.pq2305 or "", (r.start - T0).days, (r.end - T0).days) for r in pairs.collect())
    assert got == [("", 0, 3), ("", 6, 10), ("wd:Q1", 3, 6)]


def test_rank_report_and_raw_documents(spark):
    parts = C.statement_intervals(C.constraint_rows(history(spark)), C.kinds(spark))
    report = C.rank_report(parts[2], parts[0]).collect()[0]
    assert (report.statements, report.without_rank, report.with_preferred, report.only_deprecated) == (2, 0, 1, 0)
    assert len(C.raw_documents(*parts).collect()[0].statements) == 2


def test_simplified_document(spark, tmp_path):
    text = '{"wd:P1": {"constraint_kind": "symmetric", "active_intervals": [{"start_date": "2020-01-01T00:00:00Z", "end_date": null, "constraint_id": "wds:x"}], "pq:P2303": [{"entity": "wd:Q1", "start_date": "bad"}]}}'
    (tmp_path / "c.json").write_text(text)
    got = C.load_simplified(spark, str(tmp_path / "c.json"), "symmetric").collect()
    assert [(r.prop, r.role, r.constraint_id) for r in got] == [("wd:P1", "entry", "wds:x")]


def test_conflict_without_value_contradicts_only_if_strict(spark):
    from lifeloom.operators.validators import validate

    cor = spark.createDataFrame([("r", "c", "wd:Q1", "wdt:P1", "wd:Q2", day(0), None, "found")], "row_id string, constraint_id string, s string, p string, o string, cdate timestamp_ntz, ddate timestamp_ntz, match_status string")
    ent = spark.createDataFrame([("wd:P1", "entry", "wd:P2", None, None, day(0), None, "c")], "prop string, role string, pq2306 string, pq2305 string, entity string, start timestamp_ntz, end timestamp_ntz, constraint_id string")
    lc = spark.createDataFrame([("wd:Q1", "wdt:P2", "wd:Q3", day(1), None)], "s string, p string, o string, cdate timestamp_ntz, ddate timestamp_ntz")
    status = lambda **k: validate("conflicts_with", cor, ent, lc, **k).collect()[0].historical_status_property_level
    assert status() == "not_violation_no_conflicting_statement"
    assert status(strict_any_value=True) == "historical_violation"


def _judge_days(kind, row, listed, wit, level, days):
    """The status of one row, day by day."""
    _, cid, s, o, a, b, found = row
    b = days if b is None else b
    at_level = [e for e in listed if level == "property" or e[6] == cid]
    entries = [e for e in at_level if e[0] == "entry"]
    if found != "found":
        return "no_historical_row"
    if not entries:
        return "no_constraint_for_property_instance"
    on = lambda x, d: x[4] <= d < (days if x[5] is None else x[5])
    free = [e for e in at_level if e[0] == "exception" and e[3] == s]
    met = [(e, d) for e in entries for d in range(a, b) if on(e, d) and (kind == "symmetric" or e[1])]
    rest = [(e, d) for e, d in met if not any(on(x, d) for x in free)]
    there = lambda d, who, p, value: any(w[0] == who and w[1] == p and (value is None or w[2] == value) and w[3] <= d < (days if w[4] is None else w[4]) for w in wit)
    need = lambda e: "wdt:P1" if kind == "symmetric" else e[1].replace("wd:", "wdt:")
    if kind == "conflicts_with":
        bad = any(e[2] and there(d, s, need(e), e[2]) for e, d in rest)
    elif kind in ("inverse", "symmetric"):
        bad = any(not there(d, o, need(e), s) for e, d in rest)
    else:
        who = s if kind == "item_requires_statement" else o
        bad = any(not any(there(d, who, need(x), x[2]) for x, k in rest if k == d and (x[6], x[1]) == (e[6], e[1])) for e, d in rest)
    from lifeloom.operators.validators import GOOD

    return "no_constraint_lifecycle_intersection" if not met else "not_violation_exception" if not rest else "historical_violation" if bad else GOOD[kind]


def test_validators_against_each_day(spark):
    import random

    from lifeloom.operators.validators import GOOD, validate

    r, days = random.Random(5), 14
    span = lambda: ((a := r.randrange(9)), None if r.random() < 0.2 else a + 1 + r.randrange(5))
    things = ["wd:Q1", "wd:Q2", "wd:Q3"]
    cor = [(f"r{i}", r.choice(["c0", "c1", "c2"]), r.choice(things), r.choice(things), *span(), "found" if i % 9 else "not_found") for i in range(60)]
    listed = [("entry", r.choice(["wd:P2", "wd:P3", None]), r.choice([None, *things]), None, *span(), r.choice(["c0", "c1"])) for _ in range(7)]
    listed += [("exception", None, None, r.choice(things), *span(), r.choice(["c0", "c1"])) for _ in range(4)]
    wit = [(r.choice(things), f"wdt:P{r.randrange(1, 4)}", r.choice(things), *span()) for _ in range(90)]
    times = "cdate timestamp_ntz, ddate timestamp_ntz"
    c = spark.createDataFrame([(i, k, s, "wdt:P1", o, day(a), day(b), f) for i, k, s, o, a, b, f in cor], f"row_id string, constraint_id string, s string, p string, o string, {times}, match_status string")
    e = spark.createDataFrame([("wd:P1", *x[:4], day(x[4]), day(x[5]), x[6]) for x in listed], "prop string, role string, pq2306 string, pq2305 string, entity string, start timestamp_ntz, end timestamp_ntz, constraint_id string")
    w = spark.createDataFrame([(*x[:3], day(x[3]), day(x[4])) for x in wit], f"s string, p string, o string, {times}")
    seen = set()
    for kind in GOOD:
        got = {x.row_id: tuple(x)[1:] for x in validate(kind, c, e, w).collect()}
        want = {x[0]: tuple(_judge_days(kind, x, listed, wit, level, days) for level in ("property", "constraint")) for x in cor}
        assert got == want, kind
        seen |= {s.split("_")[0] + s[-9:] for x in got.values() for s in x}
    assert len(seen) >= 4


def test_what_many_witnesses_cover_is_one_interval(spark):
    from lifeloom.operators.validators import _merged_witnesses, _witnesses

    rows = [("wd:Q5", "wdt:P4", f"wd:B{i % 3}", day(i), day(i + 4)) for i in range(300)]
    w = _witnesses(spark.createDataFrame(rows, "s string, p string, o string, cdate timestamp_ntz, ddate timestamp_ntz"))
    got = sorted((r.w_o or "", r.start, r.end) for r in _merged_witnesses(w, True).collect())
    assert got == [("", day(0), day(303)), ("wd:B0", day(0), day(301)), ("wd:B1", day(1), day(302)), ("wd:B2", day(2), day(303))]
