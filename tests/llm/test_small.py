"""Operators on small and odd inputs, against brute force; no tables of the test data."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest

from lifeloom.llm import chat, languages, licenses, ngram_join, packing, pieces, spotsigs, topk, toxicity, warc
from lifeloom.llm.common import words_of
from lifeloom.llm.components import components

ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "the cat sat on the mat " * 3000), (5, "###"), (6, "Ünï \n\n  x" * 50)]
SCHEMA = "doc_id long, text string, score double, ids string"


def docs(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], SCHEMA)


# Packing


def test_pack_holds_each_id_once_and_wastes_little():
    r = random.Random(1)
    for lengths in ([r.randint(1, 5000) for _ in range(400)], [1500] * 300, [1], [2048] * 3, []):
        windows, left = packing.pack(np.array(lengths, np.int64), 2048, False)
        seen = sorted((i, s, n) for w in windows for i, s, n in w)
        assert not left and all(sum(n for *_, n in w) <= 2048 for w in windows)
        for i, length in enumerate(lengths):
            at = 0
            for _, s, n in (x for x in seen if x[0] == i):
                assert s == at
                at += n
            assert at == length
        assert len(windows) == -(-sum(lengths) // 2048)


def test_fill_is_the_best_subset_sum():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        items = [n for n, c in counts.items() for _ in range(c)]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= 40}
        taken = packing.fill(counts, 40)
        assert sum(n * c for n, c in taken) == max(sums) and all(c <= counts[n] for n, c in taken)


def test_fast_ids_are_those_of_the_tokenizers_library():
    encode = packing.ByteBPE()
    for text in ("Hello  wörld\n\n 'll 123 ???", "<|endoftext|> x", "日本 😀", "a" * 500, "  x"):
        assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids


def test_pack_documents(spark):
    rows = packing.pack_documents(docs(spark, ODD), block_tokens=3000).collect()
    encode = packing.ByteBPE()
    for i, t in ODD[:3] + ODD[4:]:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own][: None if i != 3 else 1])
        assert ids.tolist() == [*encode(t).tolist(), 1]
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(docs(spark, ODD).where("false")).count() == 0


# Licences


def test_license_scan(spark):
    text = "x Licensed under the Apache License, Version 2.0. CC-BY and CC BY-NC 4.0! MIT license"
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, [(9, text), *ODD])).collect()}
    words = words_of(text)
    places = [i for p in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == [w.encode() for w in p.split()]]
    r = rows[9]
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places), max(places))
    assert r.base_labels == "apache,cc-by,mit" and {"apache-2.0"} <= set(r.labels.split(",")) and r.score == 1.0
    assert rows[1].n_words == 0 and rows[1].first_word is None and rows[1].labels == ""


def test_label_needs_its_key_phrase():
    index = licenses.Index()
    assert "apache-2.0" not in index.scan(words_of("licensed under the apache version 2 0 license"))[4]


SHORT = {
    "CC0 1.0 Universal": "cc0",
    "released under CC0 1.0 Universal": "cc0",
    "GNU General Public License version 2": "gpl-2.0",
    "GNU General Public License, version 3": "gpl-3.0",
    "free and unencumbered software": "unlicense",
}


@pytest.mark.parametrize("notice", SHORT)
def test_short_notices_have_their_label(notice):
    index = licenses.Index()
    for text in (notice, "x " * 40 + notice + " y" * 40):
        *_, base, labels, score = index.scan(words_of(text))
        assert labels - base == {SHORT[notice]} and 0 < score <= 1


@pytest.mark.parametrize("label, keys", sorted({(x[0], x[2]) for x in licenses.TEMPLATES}))
def test_key_phrases_alone_give_the_label(label, keys):
    assert label in licenses.Index().scan(words_of(f"x {' and '.join(keys)} y"))[4]


def test_usual_file_notices_have_their_label():
    index = licenses.Index()
    notice = "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert index.scan(words_of(notice))[4] == {"gpl", "gpl-3.0"}
    far = words_of("gnu general public license") + [b"x"] * 500 + words_of("version 3 of the license")
    assert index.scan(far)[4] == {"gpl"}
    for label, text, _ in licenses.TEMPLATES:
        assert label in index.scan(words_of(text))[4] and index.scan(words_of(text))[5] == pytest.approx(1)


def plain_labels(words):
    """Labels and score of the wordings by looking at every place of the file."""
    docs_of = [words_of(x[1]) for x in licenses.TEMPLATES] + [words_of(p) for p in licenses.BASE_PHRASES]
    idf = {w: np.log((1 + len(docs_of)) / sum(w in d for d in docs_of)) for d in docs_of for w in d}
    stands = lambda k: [i for i in range(len(words)) if words[i : i + len(k)] == k]
    labels, best = set(), 0.0
    for label, text, keys in licenses.TEMPLATES:
        own = words_of(text)
        at = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in map(words_of, keys)]
        shifts = [[s - a for s in stands(words_of(k))] for k, a in zip(keys, at, strict=True)]
        for d in shifts[0]:
            if all(any(abs(e - d) <= len(own) for e in other) for other in shifts):
                labels.add(label)
                same = [w for i, w in enumerate(own) if 0 <= i + d < len(words) and words[i + d] == w]
                best = max(best, sum(idf[w] for w in same) / sum(idf[w] for w in own))
    return labels, min(1.0, best)


def test_labels_are_those_of_a_plain_search():
    index, r = licenses.Index(), random.Random(12)
    stock = sorted({w for x in licenses.TEMPLATES for w in words_of(x[1])})
    for _ in range(60):
        words = []
        for _ in range(r.randint(0, 6)):
            own = words_of(r.choice(licenses.TEMPLATES)[1])
            lo = r.randrange(len(own))
            piece = own[lo // 2 : lo + 12]
            if r.random() < 0.5:
                piece[r.randrange(len(piece))] = r.choice(stock)
            words += piece + [r.choice(stock) for _ in range(r.randint(0, 5))]
        *_, base, labels, score = index.scan(words)
        want, best = plain_labels(words)
        assert labels - base == want - base and labels == want | base and score == pytest.approx(1.0 if base else best)


def test_base_phrases_are_found_through_the_index():
    phrases = {**licenses.BASE_PHRASES, "zeta of zeta": "zeta", "a a": "aa"}
    index = licenses.Index(base=phrases)
    opened = {t for at in index.opened.values() for t, _ in at}
    assert {index.wordings[t].label for t in opened if index.wordings[t].base} == set(phrases.values())
    some = sorted({w for p in phrases for w in p.split()})
    r = random.Random(9)
    for n in (0, 1, 2, 3, 8, 60, 400):
        words = [w for _ in range(n) for w in (r.choice(list(phrases)).split() if r.random() < 0.4 else [r.choice(some)])]
        at = [(i, p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        got = index.scan([w.encode() for w in words])
        assert got[:4] == (len(at), min(places, default=None), max(places, default=None), {phrases[p] for _, p in at})


# Near-duplicates


def brute(rows, n=5, t=0.8):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    link = {
        i: {j for j in range(len(rows)) if j != i and ((sets[i] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])) or (not sets[i] and not sets[j] and (rows[i][1] or "") == (rows[j][1] or "")))}
        for i in range(len(rows))
    }
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((doc, min(rows[j][0] for j in seen), len(link[i])))
    return sorted(out)


def test_chunks_of_many_members_are_compared_in_bounded_memory():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i % 9 :], r.integers(0, 2**63, i % 5, dtype=np.uint64)])) for i in range(4096)]
    weight = 1 + np.arange(4096) % 3
    rows = pd.DataFrame({"side": (np.arange(4096) >= 2048).astype(int), "rep": np.arange(4096), "weight": weight, "grams": [s.tobytes() for s in sets]})
    for frame in (rows, rows[:2048].reset_index(drop=True)):
        tracemalloc.start()
        got = ngram_join.compare_chunks(0.8)(frame).set_index("rep")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 90e6
        other = np.arange(2048, 4096) if len(frame) == 4096 else np.arange(2048)
        for i in (0, 8, 13, 1000, 2047):
            near = [j for j in other if j != i and 1.8 * len(np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9]
            assert (got["links"].get(i, 0), got["parent"].get(i, i)) == (weight[near].sum(), 0 if near else i)


def test_the_slow_tokenizer_is_loaded_for_texts_that_need_it_only():
    encode = packing.ByteBPE()
    assert encode("a plain text").size and "exact" not in vars(encode)
    assert set(encode.added) == {t.content for t in encode.exact.get_added_tokens_decoder().values()}


def test_ngram_join_with_large_and_small_groups(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    rows = []
    for size in (40, 5, 2, 1, 1, 1):
        base = [word() for _ in range(80)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(80)] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a b", "A  b!", "###", "###", rows[0][1], rows[0][1]])]
    got = sorted(map(tuple, ngram_join.similar_documents(docs(spark, rows)).collect()))
    assert got == brute(rows)
    kept = {x.doc_id for x in ngram_join.keep_one_of_each(docs(spark, rows)).collect()}
    assert kept == {c for _, c, _ in got}


def test_bands_reach_the_recall():
    b = ngram_join.bands_for(0.8, 6, 0.9999)
    assert 1 - (1 - 0.8**6) ** b >= 0.9999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_paths_in_bad_orders(spark):
    edges, want = [], {}

    def path(ids):
        start = len(want)
        edges.extend((start + a, start + b) for a, b in zip(ids, ids[1:], strict=False))
        want.update({start + i: start for i in ids})

    path([*range(1, 400), 0])
    path([x for p in zip(range(200), range(399, 199, -1), strict=True) for x in p])
    path(sorted(range(400), key=lambda i: f"{i:09b}"[::-1]))
    for seed in range(3):
        ids = list(range(400))
        random.Random(seed).shuffle(ids)
        path(ids)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == want


def test_ngram_join_of_a_chain_of_revisions(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    rows = [(i % 100 + 1, " ".join(words[5 * k : 5 * k + 60])) for k, i in enumerate(range(1, 101))]
    got = sorted(map(tuple, ngram_join.similar_documents(docs(spark, rows)).collect()))
    assert got == brute(rows) and {c for _, c, _ in got} == {1} and max(n for *_, n in got) == 2


# WARC


def test_warc_round_trip_with_segments_and_revisits(spark, tmp_path):
    big = "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c", "x"), (4, "http://d", "x"), (5, "u", None), (6, "u", ""), (6, "u", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.read_segments(spark, str(tmp_path / "w")).where("record_type = 'continuation'").count() >= 4
    read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(read) == len(rows)
    by = {r.page_id: r for r in read}
    assert bytes(by[2].payload).decode() == big and by[1].record_type == "revisit" and by[1].refers_to == by[2].record_id
    assert all(by[i].record_type == "response" for i in (2, 3, 4, 5, 6)) and bytes(by[5].payload) == b""


def test_broken_segments_are_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 50_000)], "page_id long, url string, html string")
    whole = warc.records_of(1, 0, "u", b"a" * 50_000, "x", None)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_text("\r\n".join([*whole[:1], *whole[2:]]) + "\r\n", newline="")
    with pytest.raises(Exception, match="missing"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert pages.count() == 1


def test_archives_with_a_member_a_record_are_read(spark, tmp_path):
    import gzip

    (tmp_path / "w").mkdir()
    records = [r for i in range(3) for r in warc.records_of(i, 0, "u", b"b" * 40_000 * i, hashlib.sha1(b"b" * 40_000 * i).hexdigest(), None)]
    (tmp_path / "w" / "a.txt.gz").write_bytes(b"".join(gzip.compress((r + "\r\n").encode()) for r in records))
    got = {r.page_id: len(r.payload) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {0: 0, 1: 40_000, 2: 80_000}


def archive(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(r + "\r\n" for r in records), newline="")


def test_records_that_lie_together_are_read_without_moving_them(spark, tmp_path):
    r = random.Random(5)
    pages = [(i, f"http://{i}", "".join(r.choices("0123456789abcdef", k=40_000 if i % 4 else 3000))) for i in range(80)]
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        none = spark.sparkContext._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, quantiles, none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert {(x.page_id, x.url, bytes(x.payload).decode()) for x in read} == set(pages) and len(read) == len(pages)
    assert 0 < shuffled() - before < sum(len(h) for *_, h in pages) / 20


def test_segments_in_any_order_and_archive_are_put_together(spark, tmp_path):
    data = {i: bytes([97 + i]) * 50_000 for i in range(3)}
    whole = {i: warc.records_of(i, 0, "u", d, hashlib.sha1(d).hexdigest(), None) for i, d in data.items()}
    assert all(len(x) == 4 for x in whole.values())
    archive(tmp_path / "w", "a.txt", [whole[0][2], whole[1][0], whole[0][0], whole[1][1], *whole[2]])
    archive(tmp_path / "w", "b.txt", [*whole[1][:1:-1], whole[0][3], whole[0][1]])
    got = sorted((x.page_id, bytes(x.payload), x.record_type, x.url) for x in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [(i, d, "response", "u") for i, d in data.items()]


def test_repeated_records_and_segments_are_found(spark, tmp_path):
    short, long = (warc.records_of(i, 0, "u", d, hashlib.sha1(d).hexdigest(), None) for i, d in enumerate((b"a", b"b" * 50_000)))
    for i, (a, b) in enumerate(((short * 2, []), (short, short), (long, long), (long, long[1:2]), (long[:2], long[1:]), (long[:3], []))):
        archive(tmp_path / f"w{i}", "a.txt", a)
        archive(tmp_path / f"w{i}", "b.txt", b)
        with pytest.raises(Exception, match="missing or repeated|total length"):
            warc.read_warc(spark, str(tmp_path / f"w{i}")).collect()


def test_page_ids_beyond_the_whole_numbers_of_a_float(spark, tmp_path, monkeypatch):
    from lifeloom.llm import queries

    big, long, longer = 2**60, "x" * 2000, "z" * 40_000
    rows = [(big + 1, "u", long), (big + 3, "u", long), (big + 5, "u", "y"), (big + 7, "u", longer), (-big - 1, "u", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    want = {(i, len(h or ""), "revisit" if i == big + 1 else "response", big + 3 if i == big + 1 else None) for i, _, h in rows}
    for records in (warc.RECORDS, 2):  # the second cuts a record's segments between archives
        monkeypatch.setattr(warc, "RECORDS", records)
        got = queries.op4_warc(spark, str(tmp_path)).collect()
        assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    tail = warc.records_of(big + 9, 0, "u", b"", "x", (big + 3, 2))
    head = warc.records_of(big + 7, 0, "u", longer.encode(), hashlib.sha1(longer.encode()).hexdigest(), None)
    archive(tmp_path / "w", "a.txt", [head[1], *tail, *head[:1]])
    archive(tmp_path / "w", "b.txt", head[2:])
    read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert {(r.page_id, r.refers_to_page) for r in read} == {(big + 7, None), (big + 9, big + 3)}


def test_chunk_framing():
    for n in (0, 1, 4096, 4097, 20_000):
        data = ("ü" * n).encode()
        assert warc.unchunk(warc.chunked(data)) == data
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nab\r\n0\r\n\r\n")


# Toxicity and languages


def made(r, n, extra=()):
    out = []
    for _ in range(n):
        words = ["".join(r.choice(["th", "er", "on", "an", "re", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(60)]
        for _ in range(4 if extra else 0):
            words.insert(r.randrange(len(words)), r.choice(extra))
        out.append(" ".join(words))
    return out


def test_toxicity_tells_classes_apart():
    r = random.Random(4)
    bad = ["grumblefoot", "zonkhead", "plonkwit"]
    model = toxicity.fit(made(r, 120, bad), made(r, 120))
    scorer = toxicity.Scorer(model.toxic, model.ordinary)
    hit = np.mean([toxicity.score(model, scorer.gains(t)) >= 0.5 for t in made(r, 60, bad)])
    false = np.mean([toxicity.score(model, scorer.gains(t)) >= 0.5 for t in made(r, 60)])
    assert hit > 0.9 and false < 0.1


def test_toxicity_of_odd_texts_and_without_labels(spark):
    empty = toxicity.fit([], [])
    got = toxicity.score_documents(docs(spark, ODD), empty).collect()
    assert len(got) == len(ODD) and all(0 <= x.score <= 1 for x in got)
    assert toxicity.keep_ordinary(docs(spark, ODD), empty).columns == docs(spark, ODD).columns


def test_languages():
    en, fr = "the cat sat on the mat and then it was of that ", "le chat est sur la table et puis il dans une des "
    model = languages.fit([(en * 5, "en")] * 5 + [(fr * 5, "fr")] * 5)
    assert languages.mixture(model, en * 3)[0][0] == "en" and languages.mixture(model, fr * 3)[0][0] == "fr"
    both = languages.mixture(model, (en + fr) * 20)
    assert {x for x, _ in both} == {"en", "fr"} and abs(sum(v for _, v in both) - 1) < 1e-3
    assert languages.mixture(model, "12 ?!") == [] and languages.mixture(languages.fit([]), en) == []


def test_language_rows(spark):
    model = languages.fit([("the cat", "en"), ("le chat", "fr")])
    got = {r.doc_id: r for r in languages.predict(docs(spark, ODD), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[5].lang_pred == "und" and got[4].lang_pred == "en"
    assert {r.doc_id for r in languages.keep_known(docs(spark, ODD), model).collect()} == {3, 4, 6}


def test_language_fit_takes_long_texts_and_each_language(spark, monkeypatch):
    monkeypatch.setattr(languages, "SAMPLE_ROWS", 3)
    rows = [(i, "the cat sat on that mat and was there " * 2000, "en") for i in range(40)] + [(900 + i, "le chat est sur la table " * 500, "fr") for i in range(4)]
    rows += [(i, "zzz", "en") for i in range(5)] * 3 + [(7, None, "xx"), (None, "der hund ist", "de")]
    model = languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "fr") and languages.mixture(model, "the cat was there and that cat sat")[0][0] == "en"
    assert languages.train(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == ()
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_filter_drops_texts_without_a_main_language(spark):
    words = {k: [f"{k}{c}{d}" for c in "mnop" for d in "mnop"] for k in "abcde"}
    model = languages.fit([(" ".join(w) * 5, k) for k, w in words.items()])
    rows = [(1, " ".join(words["a"]) * 4), (2, " ".join(x for w in words.values() for x in w) * 4), (3, "12"), (4, None), (5, "")]
    assert {r.doc_id for r in languages.keep_known(docs(spark, rows), model).collect()} == {1}
    assert languages.keep_known(docs(spark, rows).where("false"), model).count() == 0


def test_toxicity_fit_is_bounded_by_documents_and_takes_long_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 4)
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary: seen.update(toxic=toxic, ordinary=ordinary))
    texts = [(i, "bad " * 30_000 + str(i)) for i in range(40)]
    repeated = [(1, "bad")] * 50
    labels = [(i, int(i < 20)) for i in range(40)] * 2 + [(1, 0), (None, 1), (2, None)]
    toxicity.train(docs(spark, texts + repeated), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(seen["toxic"]) == len(seen["ordinary"]) == 4 and min(map(len, seen["ordinary"])) > 100_000


# Fingerprints


def plain_signatures(text):
    import re

    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    anchors = {a for x in spotsigs.ANCHORS.values() for a in x}
    out, since = set(), None
    for i, w in enumerate(words):
        if w in anchors:
            since = 0
            out.add(" ".join([x for x in words[i + 1 :] if x not in anchors][:2]))
            continue
        if since is None or since >= spotsigs.GAP:
            out.add(" ".join([w, *(x for x in words[i + 1 : i + 2] if x not in anchors)]))
        since = None if since is None else since + 1
    return out - {""}


def test_spotsigs_against_plain_python(spark):
    r = random.Random(5)
    some = ["the", "is", "and", "le", "cat", "dog", "mat", "sun", "sky", "run"]
    rows = [(i * 3, " ".join(r.choice(some) for _ in range(r.randint(0, 40)))) for i in range(12)] + [(50, None), (51, "")]
    rows += [(60 + i, " ".join(r.choice(["the", *"bcdfg"]) if r.random() < 0.02 else f"w{r.randrange(30)}" for _ in range(r.choice([5, 30, 200])))) for i in range(12)]
    got = {x.doc_id: x for x in spotsigs.fingerprint_edits(docs(spark, rows)).collect()}
    order = sorted(rows)
    sets = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain_signatures(t), plain_signatures(edited), plain_signatures(after)
        near = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        assert got[i].n_chars == len(t) and len(got[i].fingerprint) == 8 * len(a)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert sets.setdefault(edited, got[i].edited_fingerprint) == got[i].edited_fingerprint and len(got[i].edited_fingerprint) == 8 * len(b)
        assert got[i].near_edited == pytest.approx(near(a, b)) and got[i].near_next == pytest.approx(near(a, c))
        assert sets.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_spotsigs_where_all_rows_have_one_id(spark):
    got = spotsigs.fingerprint_edits(docs(spark, [(7, "the cat sat on the mat"), (7, "a dog ran"), (None, "the")])).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {7} and all(0 <= r.near_next <= 1 for r in got)
    assert spotsigs.fingerprint_edits(docs(spark, ODD).where("false")).count() == 0


def test_chat_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, place int")
    made = chat.formatted_turns(none)
    assert chat.read_back(made, chat.examples(made)).count() == chat.render_examples(made).count() == 0


def test_one_more_anchor_changes_few_signatures():
    words = [f"w{i}" for i in range(60)]
    text = plain_signatures(" ".join(words))
    for i in (0, 5, 30, 59):
        other = plain_signatures(" ".join([*words[:i], "the", *words[i:]]))
        assert len(text ^ other) <= spotsigs.GAP + 4


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_similar_pairs_against_brute_force(spark, threshold):
    r = random.Random(8)
    some = ["the", "is", "and", "of", *("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60))]
    rows = []
    for size in (12, 6, 3, 3, 1, 1, 1, 1):
        base = [r.choice(some[:4]) if r.random() < 0.4 else r.choice(some[4:]) for _ in range(r.choice([6, 20, 60, 120]))]
        for _ in range(size):
            own = [w for w in base if r.random() > 0.01]
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(some)
            rows.append((r.randrange(10**6), " ".join(own)))
    a, b = "the a1 b1 the a2 b2 the a3 b3 the a4 b4", " the a5 b5"
    rows += [(5, a), (3, a + b), (1, None), (2, "?"), (7, rows[0][1]), (7, rows[14][1]), (8, rows[0][1])]
    got = {(x.doc_id, x.other_id): x.likeness for x in spotsigs.similar_pairs(docs(spark, [*rows, (None, a)]), threshold).collect()}
    want = {}
    for i, t in rows:
        for j, u in rows:
            x, y = plain_signatures(t), plain_signatures(u)
            near = 1.0 if x == y else len(x & y) / len(x | y)
            if i < j and near >= threshold:
                want[i, j] = max(near, want.get((i, j), 0))
    assert len(want) > 4 and got == pytest.approx(want) and ((3, 5) in want) == (threshold < 1)


# Top-k


@pytest.mark.parametrize("block", [3, 4096])
def test_top_k_against_brute_force(spark, block):
    r = np.random.default_rng(6)
    data = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(100, [0.0] * 4), (101, None), (102, [float("nan")] * 4), (103, [1.0, None, 1.0, 1.0]), (104, []), (105, [1.0, 1.0])]
    data += [(200 + i, [0.5] * 4) for i in range(9)]
    df = spark.createDataFrame([(i, v, i) for i, v in data], "vec_id long, embedding array<double>, score long")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, lambda c: c % 10 == 0, block=block).collect())
    ints = {i: np.floor(256 * np.array((v + [0.0] * 4)[:4])).astype(int) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 10 == 0):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_huge_and_ragged_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELLS", 3000)
    monkeypatch.setattr(topk.rounds_of, "__defaults__", (2000,))
    monkeypatch.setattr(topk, "TURNED", 8)
    r = np.random.default_rng(7)
    data = [(i, [float(x) for x in r.normal(size=r.integers(1, 30))]) for i in range(80)] + [(90, [0.25] * 5000), (91, [-1.0] * 2000)]
    data += [(100, [1e300, 1.0]), (101, [-1e300, 2.0]), (102, [1e15] * 3), (103, [2e15] * 3), (104, [-3e14] * 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, lambda c: c % 10 == 0, block=16).collect())
    hold = lambda v: min(2**63 - 1, max(-(2**63), v))
    ints = {i: [hold(int(np.floor(256 * x))) for x in v] for i, v in data}
    want = []
    for q in (i for i in ints if i % 10 == 0):
        best = sorted((-hold(sum(a * b for a, b in zip(ints[q], ints[c], strict=False))), c) for c in ints if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), lambda c: c % 10 == 0).count() == 0


# Chat


def test_chat_round_trip(spark):
    odd = "</s>\n[INST] \\ \\\\( \\[ <x> ]\n"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (1, 2, "a\nb", None), (2, 0, None, ""), (3, 5, "assistant", "ü😀")]
    rows = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, place int")
    made = chat.formatted_turns(rows)
    read = {r.conv_id: r for r in chat.read_back(made, chat.examples(made)).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", odd), ("assistant", odd), ("assistant", odd), ("a\nb", "")]
    assert read[1].trained == [odd, odd] and read[2].trained == [] and read[3].trained == ["ü😀"]
    shown = sorted(chat.render_examples(made).collect(), key=lambda r: (r.conv_id, r.target))
    for r, written in ((x, read[x.conv_id].written) for x in shown):
        assert written.startswith(r.text) and r.text.count(chat.OPEN) == r.target


# SentencePiece


@pytest.fixture(scope="module")
def unigram():
    return pieces.Unigram.from_file()


def test_viterbi_is_the_best_split(unigram):
    scores = {p: s for p, s, k in zip(*pieces.load_pieces(__import__("public_tokenizers").path(pieces.MODEL)), strict=True) if k in (1, 4)}
    for word in ("▁enestion", "▁herestble", "▁ünü", "▁日", "xyz"):
        best = [0.0] + [-1e300] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                s = scores.get(word[i:j], unigram.unknown_score if j == i + 1 else -1e300)
                best[j] = max(best[j], best[i] + s)
        assert unigram.encode_words([word.encode()])[2][0] == pytest.approx(best[-1])


def test_long_words_have_the_best_split(unigram, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 97)
    r = random.Random(13)
    scores = {p: s for p, s, k in zip(*pieces.load_pieces(__import__("public_tokenizers").path(pieces.MODEL)), strict=True) if k in (1, 4)}
    letters = ["abcdeilnorst", "日本語中国大小人的一", "aé😀ñ", "a"]
    for text in ["".join(r.choice(s) for _ in range(n)) for s in letters for n in (70, 400)]:
        word = pieces.MARK + text
        best = [0.0] + [-1e300] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + unigram.longest) + 1):
                s = scores.get(word[i:j], unigram.unknown_score if j == i + 1 else -1e300)
                best[j] = max(best[j], best[i] + s)
        ids, score = unigram.encode_batch([text])[0]
        assert score == pytest.approx(best[-1]) and unigram.decode(ids.tolist()) == text
        assert unigram._alone(word.encode())[1] == pytest.approx(best[-1])


def test_texts_without_spaces_take_time_in_proportion(unigram):
    import time

    took = []
    for n in (20_000, 80_000):
        for text in ("日本語の中国大小" * (n // 8), "a" * n, "abcdefghij0123456789" * (n // 20)):
            start = time.perf_counter()
            assert unigram.decode(unigram.encode(text)) == text
            took.append(time.perf_counter() - start)
    assert max(took) < 4


def test_never_below_the_library(unigram):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ("the cat", "Erthenanreedsh.", "hello world"):
        ids, score = unigram.encode_batch([text])[0]
        assert score >= sum(library.get_score(i) for i in library.encode(text)) - 1e-6 and library.decode(ids.tolist()) == text


def test_round_trip(spark, unigram):
    for text in ("a  b", "  lead", "x\n\ny 日本語 😀", "", "é" * 50, "tab\tend "):
        assert unigram.decode(unigram.encode(text)) == text
    got = {r.doc_id: r for r in pieces.encode_documents(docs(spark, ODD)).collect()}
    assert got[1].n_ids == 0 and got[1].decoded == "" and all(got[i].decoded == (t or "") for i, t in ODD)


def test_crc_split_is_that_of_the_contract(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    held = {r.doc_id for r in rows.where(toxicity.held_out(rows["doc_id"])).collect()}
    assert held == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}
