"""The stages of the corpus pipeline, one after the other and as a whole, against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lifeloom.llm import languages, packing, toxicity
from lifeloom.llm.common import table, words_of


def near_duplicates(rows, n=5, t=0.8):
    """Ids that stay: the least of each connected group of texts with the same or nearly the same n-grams."""
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else {text or ""})
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    group = {i: i for i in sets}
    for i, s in sets.items():
        for j, shared in Counter(j for g in s for j in holders[g]).items():
            if shared >= t * (len(s) + len(sets[j]) - shared) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i for i, v in group.items() if i == v}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Documents before each stage, filtered by ids that plain Python keeps, and the text of each id."""
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(texts) == docs.count()
    kept, out = set(texts), [docs]

    def keep(ids):
        nonlocal kept
        kept = ids
        out.append(docs.where(docs["doc_id"].isin(sorted(ids))))

    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scorer = toxicity.Scorer(model.toxic, model.ordinary)
    keep({i for i in kept if toxicity.score(model, scorer.gains(texts[i])) < 0.5})
    model = languages.train(out[-1])
    found = {i: languages.mixture(model, texts[i]) for i in kept}
    keep({i for i, m in found.items() if m and m[0][1] >= languages.MIN_SHARE})
    keep(near_duplicates([(i, texts[i]) for i in sorted(kept)]))
    return out, texts


def ids_of(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("k", [0, 1, 2])
def test_stage_keeps_what_plain_python_keeps(spark, sf_dir, stages, k):
    before, after = stages[0][k], ids_of(stages[0][k + 1])
    got = corpus_pipeline.STAGES[k][1](spark, before, sf_dir)
    assert got.columns == before.columns and ids_of(got) == after
    assert 0 < len(after) < len(ids_of(before)) or k == 1  # each text may have a language


ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "the cat sat on the mat " * 20_000), (5, "###"), (None, "a lost text"), (9, "a b")]


@pytest.mark.parametrize("k", range(4))
def test_stage_takes_odd_rows_and_empty_tables(spark, sf_dir, k):
    rows = [(i, t, None, "s", 0, 1.0, "x", 2) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, key int")
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, sf_dir)
    if k < 3:
        assert got.columns == docs.columns
        kept = [r.doc_id for r in got.collect()]
        # Without labels nothing is learned, and only texts without a letter go; copies go but for the rows of the least id.
        assert sorted(kept, key=str) == [sorted((i for i, _ in ODD), key=str), [3, 3, 4, 9, None], [1, 3, 3, 4, 5, None]][k]
    else:
        pieces, encode = got.collect(), packing.ByteBPE()
        assert {r.doc_id for r in pieces} == {i for i, _ in ODD} and sum(r.length for r in pieces) == sum(len(encode(t)) + 1 for _, t in ODD)
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_pipeline_packs_every_kept_document_once(spark, sf_dir, stages):
    out, texts = stages
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    kept = ids_of(out[-1])
    assert sorted({p.doc_id for p in pieces}) == kept
    encode = packing.ByteBPE()
    for i in kept:
        ids, at = np.array([*encode(texts[i]).tolist(), 1], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048
