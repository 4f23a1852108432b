"""Revision dumps: XML pages to usable revisions and statements."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.operators.lifecycle import lifecycle_from_snapshots
from lifeloom.schema import PAGE
from lifeloom.session import cut_lineage

RANKED = {"preferred": "wikibase:PreferredRank", "normal": "wikibase:NormalRank", "deprecated": "wikibase:DeprecatedRank"}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of plain, .gz or .bz2 dump files; times stay text."""
    return spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)


def revisions(pages: DataFrame) -> DataFrame:
    """(page, ord, ts, user, text): ord is document order; the user is the name, else the address, else empty."""
    r = pages.select(F.col("title").alias("page"), F.posexplode("revision").alias("ord", "r"))
    name, address = F.trim("r.contributor.username"), F.trim("r.contributor.ip")
    user = F.coalesce(F.nullif(name, F.lit("")), F.nullif(address, F.lit("")), F.lit(""))
    return r.select("page", F.col("ord").cast("long").alias("ord"), F.trim("r.timestamp").alias("ts"), user.alias("user"), F.col("r.text").alias("text"))


def _literal(text: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(plain, escaped)
    return f'"{text}"'


def value_term(value: dict) -> str:
    """Term of a data value {type, value}; see functions.terms.datavalue_term for the column form."""
    kind, v = value.get("type"), value.get("value")
    if kind == "string":
        return _literal(str(v))
    if isinstance(v, dict):
        letter = {"item": "Q", "property": "P"}.get(str(v.get("entity-type")))
        number = v.get("numeric-id")
        if kind == "wikibase-entityid" and letter and isinstance(number, int):
            return f"wd:{letter}{number}"
        if kind == "monolingualtext":
            return f"{_literal(str(v.get('text', '')))}@{str(v.get('language', '')) or 'und'}"
    return _literal(json.dumps(v, ensure_ascii=False, sort_keys=True))


def _snak(snak: dict) -> str:
    """Term of a snak: one without a usable value, or of an unknown kind, is the empty literal."""
    kind, value = snak.get("snaktype"), snak.get("datavalue")
    if kind in ("novalue", "somevalue"):
        return f"wikibase:{kind}"
    return value_term(value) if kind == "value" and isinstance(value, dict) else _literal("")


def _text(x, default: str) -> str:
    return x if isinstance(x, str) and x else default


def _of_properties(x) -> list[tuple[str, list[dict]]]:
    """(property, its objects) of a mapping from properties to lists; anything of another shape is passed over."""
    found = x.items() if isinstance(x, dict) else ()
    return [(p, [d for d in listed if isinstance(d, dict)]) for p, listed in found if p.startswith("P") and isinstance(listed, list)]


def _claims(doc: dict, qid: str):
    """Statements, their qualifiers and ranks, and direct triples of an entity document."""
    for pid, listed in _of_properties(doc.get("claims")):
        best: dict[str, set[str]] = {"preferred": set(), "normal": set()}
        for x in listed:
            main = x.get("mainsnak")
            if not isinstance(main, dict):
                continue
            prop, term = main["property"] if isinstance(main.get("property"), str) else pid, _snak(main)
            name = _text(x.get("id"), f"{qid}$NOID-{prop}-{main.get('hash', '')}")
            subject, rank = "wds:" + name.replace("$", "-"), x["rank"] if isinstance(x.get("rank"), str) else "normal"
            yield f"wd:{qid}", f"p:{prop}", subject
            yield subject, f"ps:{prop}", term
            yield subject, "wikibase:rank", RANKED.get(rank, RANKED["normal"])
            for q, snaks in _of_properties(x.get("qualifiers")):
                for snak in snaks:
                    yield subject, f"pq:{q}", _snak(snak)
            if main.get("snaktype") == "value" and rank in best:
                best[rank].add(term)
        for term in best["preferred"] or best["normal"]:
            yield f"wd:{qid}", f"wdt:{pid}", term


def triples_of(text: str | None) -> list[tuple[str, str, str]] | None:
    """Distinct triples of a revision's text; none for a document without a text id, null for a text that can't be used.

    The text is unescaped once more than XML does. Labels and descriptions, statements, ranks, qualifiers and direct
    properties are read; a preferred statement with a value hides the normal ones from the direct properties.
    """
    try:
        doc = json.loads(html.unescape(text or "").strip())
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    qid = doc.get("id")
    if not _text(qid, ""):
        return []
    found = set(_claims(doc, qid))
    for field, prop in (("labels", "rdfs:label"), ("descriptions", "schema:description")):
        texts = doc.get(field)
        for lang, x in texts.items() if isinstance(texts, dict) else ():
            if isinstance(x, dict) and "value" in x:
                found.add((f"wd:{qid}", prop, f"{_literal(str(x['value']))}@{lang or 'und'}"))
    return sorted(found)


def usable(revs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable revisions, their triples): unreadable, empty or non-object texts are skipped as if they weren't there.

    Texts are parsed once: what they hold is written to the shared folder, and both tables are read from there.
    """
    kind = "array<struct<s:string,p:string,o:string>>"

    @F.pandas_udf(kind)
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (x := triples_of(t)) is None else [dict(zip("spo", r, strict=True)) for r in x])

    kept = cut_lineage(revs.withColumn("triples", parsed("text")).drop("text").where("triples is not null"))
    return kept.drop("triples"), kept.select("page", "ord", F.explode("triples").alias("t")).select("page", "ord", "t.s", "t.p", "t.o")


def read_lifecycles(spark: SparkSession, path: str) -> DataFrame:
    """Lifecycles (s, p, o, cdate, cuser, ddate, duser) of a dump, times as text."""
    revs, triples = usable(revisions(read_pages(spark, path)))
    paired = triples.select("page", "ord", F.to_json(F.struct("s", "p")).alias("p"), "o")
    rows = lifecycle_from_snapshots(revs, paired)
    key = F.from_json("p", "s string, p string")
    return rows.select(key["s"].alias("s"), key["p"].alias("p"), "o", "cdate", "cuser", "ddate", "duser")
