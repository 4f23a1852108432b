import bz2
import hashlib
import lzma

from pyspark.sql import functions as F

from lifeloom.sources import dumps, tables

PAGE = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><page><title>Q1</title>
<revision><id>1</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>ann</username></contributor><text>{"id": "Q1", "labels": {"en": {"value": "a"}}}</text></revision>
<revision><id>2</id><timestamp>2020-01-02T00:00:00Z</timestamp><contributor><ip>10.0.0.1</ip></contributor><text>broken</text></revision>
<revision><id>3</id><timestamp>2020-01-03T00:00:00Z</timestamp><contributor></contributor><text>{"redirect": "Q2"}</text></revision>
<revision><id>4</id><timestamp>2020-01-04T00:00:00Z</timestamp><contributor><username>bob</username></contributor><text>{"id": "Q1", "labels": {"en": {"value": "a"}}}</text></revision>
</page></mediawiki>"""


def test_dump_to_lifecycles(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(PAGE.encode()))
    got = sorted(map(tuple, dumps.read_lifecycles(spark, str(tmp_path / "d.xml.bz2")).collect()), key=repr)
    label = ("wd:Q1", "rdfs:label", '"a"@en')
    assert got == sorted([(*label, "2020-01-01T00:00:00Z", "ann", "2020-01-03T00:00:00Z", ""), (*label, "2020-01-04T00:00:00Z", "bob", None, None)], key=repr)


def test_csv_round_trip_keeps_literals(spark, tmp_path):
    odd = 'a\\"b,c\nd'
    df = spark.createDataFrame([("wd:Q1", "rdfs:label", odd, "2020-01-01T00:00:00Z", "u", None, None)], "s string, p string, o string, cdate string, cuser string, ddate string, duser string")
    tables.write_csv(df, str(tmp_path / "out"), order=["s"])
    row = tables.read_lifecycle_csv(spark, str(tmp_path / "out"), with_source=True).collect()[0]
    assert row.o == odd and row.ddate is None and row.cdate.year == 2020 and row.src_file.endswith(".csv")


def test_compressed_lines_and_subjects(spark, tmp_path):
    (tmp_path / "a.csv.xz").write_bytes(lzma.compress("s,p\nwd:Q1,x\n".encode()))
    assert [r.line for r in tables.read_compressed_text(spark, str(tmp_path / "a.csv.xz")).collect()] == ["s,p", "wd:Q1,x"]


def test_missing_column_is_named(spark):
    import pytest

    with pytest.raises(ValueError, match="duser"):
        tables.require(spark.createDataFrame([(1,)], "s int"), ["s", "duser"])


def test_range_written_subjects_are_found(spark, tmp_path):
    df = spark.createDataFrame([(f"wd:Q{i}", i) for i in range(50)], "s string, n int")
    tables.write_by_subject(df, str(tmp_path / "t"))
    keys = spark.createDataFrame([("wd:Q7",), ("wd:Q7",), ("wd:QX",)], "s string")
    assert [tuple(r) for r in tables.lookup(spark, str(tmp_path / "t"), keys).collect()] == [("wd:Q7", 7)]


def test_class_documents_round_trip(spark, tmp_path):
    from lifeloom.operators.classes import class_documents

    rows = spark.createDataFrame([("X", "u", "1", None, 2), ("X", "u", "1", None, 3)], "class string, user string, cdate string, ddate string, count long")
    class_documents(rows, merge_identical=True).write.json(str(tmp_path / "d"))
    back = tables.read_class_documents(spark, str(tmp_path / "d")).collect()
    assert [tuple(r) for r in back] == [("X", "u", "1", None, 5)]


def test_large_class_has_several_documents_in_order(spark, tmp_path):
    from lifeloom.operators.classes import class_documents, digests

    rows = [("X", f"u{i % 7:02}", f"{i // 7:04}", None if i % 2 else "9", 1) for i in range(700)] + [(c, "u", "1", None, 2) for c in ("A", "B", None, "Z")]
    rows += [("Y", f"u{i}", "1", None, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "class string, user string, cdate string, ddate string, count long").repartition(3)
    docs = class_documents(df, most=50)
    held = [(r["class"], [tuple(e) for e in r.edit_counts]) for r in docs.collect()]
    key = lambda e: (e[1], e[2] is not None, e[2] or "", e[0])
    assert max(len(e) for _, e in held) <= 50
    for c in ("A", "B", None, "Z", "X", "Y"):
        own = sorted((e for k, e in held if k == c), key=lambda e: key(e[0]))
        assert [e for d in own for e in d] == sorted(((u, a, b, n) for k, u, a, b, n in rows if k == c), key=key)
        assert c == "X" or len(own) == 1
    got = {r["class"]: tuple(r)[1:] for r in digests(docs, F.array_join(F.transform("edit_counts", lambda e: F.concat_ws(" ", e["user"], e["cdate"], e["ddate"])), "|")).collect()}
    text = lambda c: "|".join(" ".join(x for x in (u, a, b) if x) for u, a, b, _ in sorted(((u, a, b, n) for k, u, a, b, n in rows if k == c), key=key))
    assert got == {c: (sum(r[0] == c for r in rows), sum(r[4] for r in rows if r[0] == c), hashlib.sha256(text(c).encode()).hexdigest()) for c in ("A", "B", None, "Z", "X", "Y")}


def test_dump_files_are_documents_of_short_lines(spark, sf_dir, tmp_path):
    from xml.etree import ElementTree

    from lifeloom.plans import source_queries

    source_queries._dump(spark, sf_dir, str(tmp_path / "d"))
    texts = [bz2.decompress(f.read_bytes()).decode() for f in (tmp_path / "d").glob("*.bz2")]
    roots = [ElementTree.fromstring(x) for x in texts]
    titles = sorted(p.findtext("title") for r in roots for p in r)
    assert {r.tag for r in roots} == {"dump"} and {p.tag for r in roots for p in r} == {"page"}
    assert titles == sorted(f"Q{r.user_id}" for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect())
    assert all(x.count("<revision>") <= 2 for t in texts for x in t.splitlines())


def test_subjects_are_counted_over_several_files(spark, sf_dir, tmp_path, monkeypatch):
    from lifeloom.plans import source_queries

    monkeypatch.setattr(source_queries, "scratch_folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = source_queries.subjects_per_file(spark, sf_dir).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "files").glob("*.csv"))
    each = [tables.subjects(tables.read_lifecycle_csv(spark, str(f), with_source=True)).first() for f in files]
    assert len(files) > 1 and tuple(got) == (sum(r.n_rows for r in each), sum(r.n_subjects for r in each))
    assert tables.first_file(spark, str(tmp_path / "files")).endswith(files[0].name)
    subjects = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert got.n_subjects == subjects
