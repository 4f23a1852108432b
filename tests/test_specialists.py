import math

import pytest

from lifeloom.operators import specialists as S
from lifeloom.operators import sweeps


def test_soft_classes_and_borderline(spark):
    names = "property string, n_p long, owner_share double, owner_enrichment double, purity double, owner_coverage double, second_share double"
    rows = [("few", 29, 0.9, 9.0, 0.9, 0.9, 0.0), ("soft", 30, 0.45, 3.0, 0.45, 0.02, 0.35), ("two", 30, 0.45, 3.0, 0.45, 0.02, 0.36), ("thin", 30, 0.61, 3.0, 0.45, 0.01, 0.1)]
    owned = spark.createDataFrame(rows, names)
    found = {r.property: r.class_soft for r in S.with_soft_class(owned).collect()}
    assert found == {"few": "rare/unstable", "soft": "community-owned-soft", "two": "bridge/multi-community", "thin": "generic/mixed"}
    assert {r.property for r in S.borderline(owned).collect()} == {"soft", "two"}


def test_cluster_profile_counts_users_without_the_property(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "y", 2), ("c", "x", 5)], "user string, property string, count long")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "user string, cluster long")
    found = {(r.cluster, r.property): r for r in S.cluster_profile(counts, clusters).collect()}
    assert {k: (r.users_in_cluster, r.total_edits_in_cluster, r.global_users, r.coverage, r.cluster_share) for k, r in found.items()} == {(1, "x"): (1, 3, 2, 0.5, 0.5), (1, "y"): (2, 3, 2, 1.0, 1.0), (2, "x"): (1, 5, 2, 1.0, 0.5)}
    assert found[1, "x"].mean_tfidf == pytest.approx(3 / math.sqrt(10) / 2) and found[1, "y"].place_by_tfidf == 1


def test_sweep_gives_what_single_runs_give(spark):
    counts = spark.createDataFrame([(u, f"c{k}", (i * 7 + k * 3) % 11 + 1) for i, u in enumerate("abcdef") for k in range(i % 3 + 1)], "user string, class string, edit_count long")
    one = spark.createDataFrame([("c0", 3.0), ("c1", 9.0)], "class string, mass double")
    two = spark.createDataFrame([("c2", 1.0), ("c9", 4.0)], "class string, mass double")
    both = one.selectExpr("'one' AS baseline", "*").union(two.selectExpr("'two' AS baseline", "*"))
    got = {(r.baseline, r.min_edits, r.alpha, r.user): r.kl_divergence_smoothed for r in sweeps.kl_sweep(counts, both, [2, 15], [0.1, 1.0]).collect()}
    want = {(n, m, a, r.user): r.kl_divergence_smoothed for n, b in (("one", one), ("two", two)) for m in (2, 15) for a in (0.1, 1.0) for r in S.smoothed_kl(counts, b, a, m).collect()}
    assert len(want) > 8 and got == pytest.approx(want)


def test_factors_are_those_of_numpy(spark):
    import numpy as np

    from lifeloom.operators import factors

    rows = [(f"u{i}", f"p{j}", (i * 7 + j * 5) % 6 + 1) for i in range(30) for j in range(8) if (i + j) % 3]
    counts = spark.createDataFrame(rows, "user string, property string, count long")
    table = S.tfidf(counts).toPandas().pivot(index="user", columns="property", values="tfidf").fillna(0)
    left, values, _ = np.linalg.svd(table.to_numpy(), full_matrices=False)
    found, got = factors.factors(counts, 3)
    assert got == pytest.approx(values[:3].tolist(), rel=1e-6)
    placed = {r.user: r.features.toArray() for r in found.collect()}
    want = left[:, :3] * values[:3]
    assert np.allclose(np.abs([placed[u] for u in table.index]), np.abs(want), atol=1e-6)
    users, _ = factors.clusters(found, 3)
    assert users.count() == 30 and {r.cluster for r in users.collect()} == {0, 1, 2}
