import random

import pytest

from lifeloom.operators.lifecycle import lifecycle_from_snapshots


def sequential(pages):
    out = []
    for page, revs in pages.items():
        there = {}
        for ts, user, held in revs:
            for k in [k for k in there if k not in held]:
                out.append((page, *k, *there.pop(k), ts, user))
            for k in held:
                there.setdefault(k, (ts, user))
        out += [(page, *k, *v, None, None) for k, v in there.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_reading_revisions_in_order(spark, seed):
    r = random.Random(seed)
    pages = {
        f"p{i}": [(r.randint(0, 9), f"u{r.randint(0, 3)}", {(f"p{r.randint(0, 2)}", f"o{r.randint(0, 2)}") for _ in range(r.randint(0, 4))}) for _ in range(r.randint(1, 12))]
        for i in range(12)
    }
    revs = [(p, i, ts, u) for p, x in pages.items() for i, (ts, u, _) in enumerate(x)]
    triples = [(p, i, *t) for p, x in pages.items() for i, (_, _, held) in enumerate(x) for t in held]
    got = lifecycle_from_snapshots(
        spark.createDataFrame(revs, "page string, ord int, ts int, user string"), spark.createDataFrame(triples, "page string, ord int, p string, o string")
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sequential(pages)
