"""SpotSigs fingerprints, with DataFrame functions only.

A signature is the chain of content words that follows an anchor, a common word such as an article; the fingerprint of
a text is the set of its hashed signatures. Anchors stand everywhere in running text and hardly in page furniture, so
the set describes the text and not its frame. Where there is no anchor, before the first one and more than GAP words
after another, every word begins a chain, so texts that are short or in another language are described as well; the rule
looks at the words nearby only, so a small edit never changes more than the signatures around it. Two sets can only reach a Jaccard likeness t if the smaller has at least
t times the size of the larger, so the comparisons of similar_pairs() are partitioned by set size and pruned by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeloom.llm.common import durable

#: Anchors, by language: articles, forms of "to be" and the commonest links.
ANCHORS = {
    "en": ("a", "an", "the", "is", "was", "of", "and"),
    "fr": ("le", "la", "les", "un", "une", "des", "est", "et"),
    "de": ("der", "die", "das", "ein", "eine", "ist", "war", "und"),
    "es": ("el", "los", "las", "una", "es", "era", "y", "que"),
}
#: Content words of a chain.
CHAIN = 2
#: Content words after an anchor beyond which, as before the first one, each begins a chain.
GAP = 24
#: Likeness from which documents are similar.
THRESHOLD = 0.8
#: Room for rounding in the bounds that rule pairs out; the likeness itself is compared without it.
_SLACK = 1e-9
_MARK = "#"


def _all_anchors() -> tuple[str, ...]:
    return tuple(sorted({w for words in ANCHORS.values() for w in words}))


def _pattern(words: tuple[str, ...]) -> str:
    """A regular expression of the words that shares their beginnings, so that few letters decide."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    ends = "" in by_first
    parts = [k + (_pattern(tuple(v)) if v != [""] else "") for k, v in sorted(by_first.items()) if k]
    joined = "|".join(parts)
    return f"(?:{joined}){'?' * ends}" if len(parts) > 1 or ends else joined


def with_signatures(df: DataFrame, columns: dict[str, str], chain: int = CHAIN) -> DataFrame:
    """df with, for each name: text column, the sorted distinct signature hashes of the text as array<int>.

    Empty for a text without words. The text becomes a line of content words with a mark for each anchor; a look-ahead
    at every mark takes the next content words over further marks, so chains may overlap. Chains that follow no anchor
    don't reach over marks. Each step is a column of its own, so that what is used twice is computed once.
    """
    next_word = rf"[{_MARK} ]*+[^{_MARK} ]++"
    chains = rf"{_MARK}(?=({next_word}(?:{next_word}){{0,{chain - 1}}}))"
    every = F.lit(rf"(?<= )(?=([^ ]++(?: ++[^ ]++){{0,{chain - 1}}}))")
    long_runs = F.lit(rf"{_MARK}((?: ++[^{_MARK} ]++){{{GAP + 1},}}+)")
    kept = df.columns
    for name, text in columns.items():
        words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", "  "))
        df = df.withColumn(f"{name}_line", F.concat(F.lit(" "), words, F.lit(" ")))
    for name in columns:
        df = df.withColumn(f"{name}_marked", F.regexp_replace(f"{name}_line", f" {_pattern(_all_anchors())} ", f" {_MARK} "))
    for name in columns:
        marked = F.col(f"{name}_marked")
        head = F.regexp_extract_all(F.substring_index(marked, _MARK, 1), every, F.lit(1))
        ends = F.transform(F.regexp_extract_all(marked, long_runs, F.lit(1)), lambda r: F.regexp_extract_all(F.regexp_replace(r, rf"^(?: ++[^ ]++){{{GAP}}}", ""), every, F.lit(1)))
        df = df.withColumn(f"{name}_chosen", F.concat(F.regexp_extract_all(marked, F.lit(chains), F.lit(1)), head, F.flatten(ends)))
    hashed = [
        F.array_sort(
            F.array_distinct(
                F.transform(f"{name}_chosen", lambda s: F.hash(F.trim(F.regexp_replace(s, rf"[{_MARK} ]++", " "))))
            )
        ).alias(name)
        for name in columns
    ]
    return df.select(*kept, *hashed)


def as_string(hashes: Column) -> Column:
    """Fingerprint as text: the hashes as eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones. Below the threshold by size alone: 0, without comparing."""
    x, y = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    value = F.when(F.least(x, y) < F.greatest(x, y) * F.lit(threshold), F.lit(0.0)).otherwise(shared / (x + y - shared))
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(value)


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next larger distinct id; after the last the first. One of one document is its own next.

    Ids alone are sorted, in ranges; a range's last id is followed by the first of the next range that isn't empty.
    The ranges are written to the shared folder first, so that every later read sees the same ones.
    """
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    ranged = durable(ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("range")))
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first"))
    # One row for each range: as many as there are shuffle partitions.
    following = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("after"), F.min("first").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("very_first"))
    within = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    met = within.join(following, "range")
    return met.select("doc_id", F.coalesce("next_id", "after", "very_first").alias("next_id"))


def with_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, text, edited): each text, and its edited text.

    The last floor(n_chars / 4) code points give way to the first as many (or all) of the next document. Null texts
    are empty; null ids take no part. Of a repeated doc_id every row stays; what counts as the next document's text is
    the least of them.

    Whole texts are shuffled once, by id. What goes from a document to the one before it is the quarter that the
    edit needs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where("doc_id is not null")
    links = next_ids(texts)
    lengths = texts.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    wanted = links.join(lengths, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("wanted")
    )
    # The start of the least text is the least of the starts.
    heads = texts.join(wanted, "doc_id").select(
        F.col("before").alias("doc_id"),
        F.col("doc_id").alias("next_id"),
        F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("head"),
    )
    heads = heads.groupBy("doc_id").agg(F.max("next_id").alias("next_id"), F.min("head").alias("head"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("head"), F.lit(1), cut))
    return texts.join(heads, "doc_id").select("doc_id", "next_id", "text", edited.alias("edited"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and the likeness to the edited and to the next document.

    Signatures are computed once for each text and edited text and written to the shared folder; signatures, not texts,
    are then brought to the document before. Equal texts have equal fingerprints; a text without words has the empty
    one. Null texts are empty, null ids take no part. Each row of a repeated doc_id gives a row; where all rows have one
    id, it is its own next document. Empty tables give no row. Other columns are ignored.
    """
    signed = durable(
        with_signatures(with_edited(docs), {"own": "text", "changed": "edited"}).select(
            "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "changed"
        )
    )
    # Of a repeated doc_id, the next document is the same for all rows and is described by the least of its sets.
    ahead = signed.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("own").alias("next_own"))
    return signed.join(ahead, "next_id").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def near_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness), once for each two rows of sets (set, own) that reach the threshold; no set may occur twice.

    A set's partition is the logarithm of its size to the base 1 / threshold, so sets that can be similar are in the
    same or in neighbouring partitions. Signatures are ordered by the number of sets that hold them. Similar sets share
    one of their first n - ceil(threshold * n) + 1 signatures, so only these rare ones give candidates. A candidate is
    compared if sizes, and what is left of both sets after the first shared signature, let it reach the threshold.
    Empty sets give no pair.
    """
    entries = sets.select("set", F.size("own").alias("n"), F.explode("own").alias("sig"))
    often = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    ordered = entries.join(often, "sig").groupBy("set").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("held", "sig"))).alias("order"))
    rare = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - _SLACK) + 1).cast("int")
    partition = F.floor(F.log("n") / F.lit(_SLACK - math.log(threshold)))
    heads = ordered.select("set", "n", partition.alias("partition"), F.posexplode(F.slice("order", F.lit(1), rare)).alias("at", "x")).where("x.held > 1")
    heads = durable(heads.select("set", "n", "partition", "at", F.col("x.sig").alias("sig")))
    larger = heads.select("sig", "partition", F.col("set").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"))
    other = heads.select(
        "sig", F.explode(F.array(F.col("partition"), F.col("partition") + 1)).alias("partition"), F.col("partition").alias("own_partition"),
        F.col("set").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"),
    )
    once = (F.col("own_partition") < F.col("partition")) | (F.col("a") < F.col("b"))
    fits = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(threshold) - _SLACK
    met = larger.join(other, ["sig", "partition"]).where(once & fits)
    first = met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.min("a_at").alias("a_at"), F.min("b_at").alias("b_at"))
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    candidates = first.where(most * F.lit(1 + threshold) >= (F.col("a_n") + F.col("b_n")) * F.lit(threshold) - _SLACK).select("a", "b")
    own, its = sets.select(F.col("set").alias("a"), F.col("own").alias("a_own")), sets.select(F.col("set").alias("b"), F.col("own").alias("b_own"))
    compared = candidates.join(own, "a").join(its, "b").select("a", "b", likeness(F.col("a_own"), F.col("b_own"), threshold - _SLACK).alias("likeness"))
    return compared.where(F.col("likeness") >= threshold)


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, other_id, likeness) of all documents, doc_id < other_id, whose signature sets reach the threshold.

    Documents with equal sets are one set in the comparisons and are paired at the end, as those without words are, with
    likeness 1; a group of n similar documents has about n * n / 2 rows in the result. Of a repeated doc_id the most
    similar rows count. Null ids take no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = with_signatures(texts.where("doc_id is not null"), {"own": "text"})
    signed = durable(signed.select("doc_id", F.sha2(as_string(F.col("own")), 256).alias("set"), "own"))
    near = near_sets(durable(signed.groupBy("set").agg(F.first("own").alias("own"))), threshold)
    members = signed.select("doc_id", "set").distinct()
    one, two = members.select(F.col("doc_id").alias("x"), F.col("set").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("set").alias("b"))
    same = one.join(two.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y", F.lit(1.0).alias("likeness"))
    pairs = near.join(one, "a").join(two, "b").where("x <> y").select("x", "y", "likeness").union(same)
    return pairs.groupBy(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other_id")).agg(F.max("likeness").alias("likeness"))
