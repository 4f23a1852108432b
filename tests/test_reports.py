import lzma
import random
from itertools import combinations

from pyspark.sql import functions as F

from lifeloom.operators.governance import co_participation
from lifeloom.operators.specialists import funnel, leaders, removals
from lifeloom.sources.tables import first_file, read_compressed_text
from lifeloom.streaming.resumable import count_new_files


def test_pairs_of_users_against_brute_force(spark):
    r = random.Random(2)
    types = {f"u{i:02}": {t for t in "abcdefgh" if r.random() < (0.9 if t in "ab" else 0.3)} for i in range(40)}
    rows = [(u, t) for u, held in types.items() for t in held for _ in range(r.randint(1, 2))] + [(None, "a"), ("u01", None)]
    for least in (1, 2, 3, 9):
        got = {(x.user_1, x.user_2): x.shared for x in co_participation(spark.createDataFrame(rows, "user string, constraint_type string"), least).collect()}
        assert got == {(u, v): len(types[u] & types[v]) for u, v in combinations(sorted(types), 2) if len(types[u] & types[v]) >= least}


def test_leaders_of_ties_and_of_one_user(spark):
    counts = spark.createDataFrame([("b", "x", 3), ("a", "x", 3), ("c", "x", 1), ("a", "y", 5)], "user string, property string, count long")
    found = {r.property: r for r in leaders(counts).collect()}
    assert (found["x"].user, found["x"].second_user, found["x"].second_count, found["x"].solo_flag) == ("a", "b", 3, False)
    y = found["y"]
    assert y.solo_flag and y.second_user is None and y.count_ratio_vs_second is None and y.property_entropy_norm == 0.0 and y.property_hhi == 1.0


def test_funnel_without_flags_and_removals(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("b", "x", 1), ("a", "y", 5), ("c", "y", 1)], "user string, property string, count long")
    left, log = funnel(counts, None, 2, 3, 2)
    assert {r.stage: (r.rows, r.users, r.properties, r.total_edits) for r in log.collect()} == {
        "raw": (4, 3, 2, 10.0), "after_min_property_users": (4, 3, 2, 10.0), "after_min_user_edits": (2, 1, 2, 8.0), "after_min_distinct_properties_per_user": (2, 1, 2, 8.0),
    }
    assert {(r.user, r.property) for r in left.collect()} == {("a", "x"), ("a", "y")}
    flags = spark.createDataFrame([("b", True, True), ("c", False, True), ("z", True, False)], "user string, is_ip boolean, is_bot boolean")
    people, stats = removals(counts, flags)
    s = stats.first()
    assert (s.n_users, s.n_ip_users, s.n_bot_users, s.n_removed_users, s.n_removed_rows, s.removed_edits) == (3, 1, 2, 2, 2, 2) and people.count() == 2


def test_packed_lines_keep_what_is_no_line_end(spark, tmp_path):
    text = "a b\x0cc\n" + "x" * 3_000_000 + "\nlast"
    (tmp_path / "a.xz").write_bytes(lzma.compress(text.encode()) + lzma.compress(b"!\nmore\n"))
    (tmp_path / "b.txt").write_bytes(b"one\ntw\xff\n")
    got = sorted((r.path[-5:], r.line) for r in read_compressed_text(spark, str(tmp_path)).collect())
    assert got == [("/a.xz", "a b\x0cc"), ("/a.xz", "last!"), ("/a.xz", "more"), ("/a.xz", "x" * 3_000_000), ("b.txt", "one"), ("b.txt", "tw�")]
    assert first_file(spark, str(tmp_path)).endswith("a.xz")


def test_files_count_once_over_several_runs(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    counted = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for rows in ([1, 1, 2], [2, 3], []):
        if rows:
            spark.createDataFrame([(k,) for k in rows], "k int").coalesce(1).write.mode("append").parquet(source)
        found = count_new_files(spark, source, state, "k int", counted, files_a_step=1)
    assert {r.k: r.n for r in found.groupBy("k").agg(F.sum("n").alias("n")).collect()} == {1: 2, 2: 2, 3: 1}
