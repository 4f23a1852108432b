"""Whole results of the queries without SQL on the smallest tables, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from lifeloom.llm import licenses, packing, queries, spotsigs
from lifeloom.llm.common import WORD_PATTERN, table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.text or "", r.lang) for r in rows}


def result(spark, sf_dir, name, columns):
    found = queries.queries()[name](spark, sf_dir)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    return found.collect()


def held_out(doc, n, rest):
    return zlib.crc32(str(doc).encode()) % n == rest


def test_license_scan(spark, sf_dir, texts):
    long = dict.fromkeys(("doc_id", "n_words", "n_base", "first_word", "last_word"), "bigint")
    rows = result(spark, sf_dir, "op1_license_scan", long | {"base_labels": "string", "labels": "string", "score": "double"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    found = 0
    for r in rows:
        lower = texts[r.doc_id][0].translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(WORD_PATTERN, lower)
        at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.BASE_PHRASES}
        places = sorted(i for v in at.values() for i in v)
        base = sorted({licenses.BASE_PHRASES[p] for p, v in at.items() if v})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(base))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r.score <= 1
        found += len(places)
    assert found


def test_packing(spark, sf_dir, texts):
    long = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    rows = result(spark, sf_dir, "op3_packing", dict.fromkeys(long, "bigint"))
    encode, by_doc, ends = packing.ByteBPE(), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids, at = np.array([*encode.exact.encode(texts[doc][0], add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and sum(ends.values()) > 0.98 * 2048 * (len(ends) - 1)


def test_toxicity(spark, sf_dir, texts):
    rows = result(spark, sf_dir, "op5_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_fingerprints(spark, sf_dir, texts):
    columns = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    rows = {r.doc_id: r for r in result(spark, sf_dir, "op6_spotsigs", columns)}
    order, prints = sorted(texts), {}
    assert sorted(rows) == order

    def near(a, b):
        x, y = ({p[i : i + 8] for i in range(0, len(p), 8)} for p in (a, b))
        return 1.0 if not x and not y else len(x & y) / len(x | y)

    for k, doc in enumerate(order):
        r, own, after = rows[doc], texts[doc][0], order[(k + 1) % len(order)]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + texts[after][0][:cut]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert r.near_edited == pytest.approx(near(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(near(r.fingerprint, rows[after].fingerprint))
    assert np.mean([r.near_edited for r in rows.values()]) > 0.4 > 2 * np.mean([r.near_next for r in rows.values()])
    assert spotsigs.GAP > 0


def test_languages(spark, sf_dir, texts):
    rows = result(spark, sf_dir, "op9_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    known = {lang for doc, (_, lang) in texts.items() if lang and not held_out(doc, 4, 2)}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id][0])
        assert r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 and (r.lang_pred in known if letters else r.lang_pred == "und")
    right = [r.lang_pred == texts[r.doc_id][1] for r in rows if r.held_out and texts[r.doc_id][1]]
    assert len(right) > 20 and np.mean(right) > 0.95


def test_pieces(spark, sf_dir, texts):
    rows = result(spark, sf_dir, "op10_sentencepiece", {"doc_id": "bigint", "n_ids": "bigint", "ids_crc32": "bigint", "decoded_sha256": "string"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id][0].replace("▁", " ")
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_ids > 0) == bool(text)
