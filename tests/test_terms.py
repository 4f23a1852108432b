import json
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from lifeloom.functions import terms
from lifeloom.functions.actors import humans_only, with_flags
from lifeloom.sources.dumps import triples_of, value_term
from pyspark.sql import functions as F


KEYS = {
    None: "",
    "": "",
    "  wd:Q42\t": "wd:Q42",
    "wds:Q1-x": "wds:Q1-x",
    "wdt:P9": "wdt:P9",
    '"17"': "17",
    '""" seventeen """': "seventeen",
    '"""odd"': '""odd',
    '"': '"',
    "caf\\u00e9": "café",
    "\\ud83d\\ude00!": "😀!",
    "\\U0001F600": "😀",
    "a\\nb": "a\\nb",
    '"0007.250"^^http://example.org/t#decimal': "7.25",
    "-12e2^^http://example.org/t#integer": "-1200",
    "x1^^http://example.org/t#decimal": "x1",
    "+1987-03-00T00:00:00Z^^http://example.org/t#dateTime": "1987-03-00T00:00:00Z",
    "+0000000312-01-01T00:00:00Z^^http://example.org/t#dateTime": "312-01-01T00:00:00Z",
    "0312-01-01T00:00:00Z^^http://example.org/t#dateTime": "0312-01-01T00:00:00Z",
    "plain^^http://example.org/t#string": "plain",
    '{"time":"+00000002001-02-03T00:00:00Z","zone":0}': "2001-02-03T00:00:00Z",
    '{"amount":"+0.50","unit":"u"}': "0.5",
    "{'amount': '-007', 'unit': 'u'}": "-7",
    "{'time': '+1999-01-01T00:00:00Z'": "1999-01-01T00:00:00Z",
    '{"unit":"u"}': '{"unit":"u"}',
    '"guten \"Tag\""@de': 'guten "Tag"@de',
    '"x"@y"@en': 'x"@y@en',
}


def test_match_objects(spark):
    rows = spark.createDataFrame([(k,) for k in KEYS], "o string")
    got = {r.o: r.k for r in rows.select("o", terms.match_object(F.col("o")).alias("k")).collect()}
    assert got == KEYS


@settings(max_examples=15, deadline=None)
@given(st.lists(st.from_regex(r"\A[-+]?([0-9]{1,6}\.?[0-9]{0,6}|\.[0-9]{1,6})([eE][-+]?[0-9]{1,2})?\Z"), min_size=1, max_size=40))
def test_canonical_decimals_are_those_of_python(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in set(numbers)], "n string")
    got = {r.n: r.k for r in rows.select("n", terms.canonical_decimal(F.col("n")).alias("k")).collect()}
    assert got == {n: format(Decimal(n).normalize(), "f") for n in set(numbers)}


def test_value_terms():
    assert value_term({"type": "wikibase-entityid", "value": {"entity-type": "item", "numeric-id": 5}}) == "wd:Q5"
    assert value_term({"type": "string", "value": 'a"\\\n'}) == '"a\\"\\\\\\n"'
    assert value_term({"type": "monolingualtext", "value": {"text": "x", "language": ""}}) == '"x"@und'
    assert value_term({"type": "quantity", "value": {"b": 1, "a": "é"}}) == '"{\\"a\\": \\"é\\", \\"b\\": 1}"'
    assert value_term({"type": "wikibase-entityid", "value": {"entity-type": "lexeme", "id": "L1"}}).startswith('"{')


def test_column_terms_are_those_of_python(spark):
    rows = [("string", '"a\\"b"'), ("monolingualtext", '{"text": "x", "language": "de"}'), ("quantity", '{"b": 1, "a": 2}'), ("wikibase-entityid", '{"entity-type": "item", "numeric-id": 7}')]
    df = spark.createDataFrame(rows, "k string, v string")
    got = [r[0] for r in df.select(terms.datavalue_term(F.col("k"), F.col("v"))).collect()]
    assert got == ['"a\\"b"', '"x"@de', '"{\\"a\\": 2, \\"b\\": 1}"', "wd:Q7"]


def test_unusable_and_empty_revisions():
    assert triples_of("not json") is None and triples_of("") is None and triples_of("[]") is None
    assert triples_of('{"redirect": "Q1"}') == []


def test_odd_snaks_ids_and_ranks():
    def of(statement, pid="P1"):
        return triples_of(json.dumps({"id": "Q1", "claims": {pid: [statement]}}))

    bare = {"mainsnak": {"snaktype": "value", "property": "P1"}, "id": "Q1$a", "rank": "normal"}
    direct = ("wd:Q1", "wdt:P1", '""')
    assert set(of(bare)) == {("wd:Q1", "p:P1", "wds:Q1-a"), ("wds:Q1-a", "ps:P1", '""'), ("wds:Q1-a", "wikibase:rank", "wikibase:NormalRank"), direct}
    assert ("wds:Q1-a", "ps:P1", '""') in of(bare | {"mainsnak": {"snaktype": "other"}}) and direct not in of(bare | {"mainsnak": {"snaktype": "other"}})
    assert ("wd:Q1", "p:P1", "wds:Q1-NOID-P1-h") in of({"mainsnak": {"hash": "h"}, "id": 7, "rank": ["preferred"]})
    assert ("wds:Q1-a", "pq:P2", '""') in of(bare | {"qualifiers": {"P2": [{"snaktype": "value"}, 3], "x": [{}], "P3": 1}})
    assert of(bare, "x1") == [] and triples_of('{"id": 5, "labels": {"en": {"value": "a"}}}') == []
    assert triples_of('{"id": "Q1", "labels": {"": {"value": "a"}, "en": 3}, "claims": []}') == [("wd:Q1", "rdfs:label", '"a"@und')]


def test_preferred_value_hides_normal_ones_but_somevalue_does_not():
    def doc(first):
        normal = '{"rank": "normal", "id": "Q1$b", "mainsnak": {"snaktype": "value", "property": "P1", "datavalue": {"type": "string", "value": "n"}}}'
        return '{"id": "Q1", "claims": {"P1": [%s, %s]}}' % (first, normal)

    value = '{"rank": "preferred", "id": "Q1$a", "mainsnak": {"snaktype": "value", "property": "P1", "datavalue": {"type": "string", "value": "p"}}}'
    some = '{"rank": "preferred", "id": "Q1$a", "mainsnak": {"snaktype": "somevalue", "property": "P1"}}'
    direct = lambda t: [o for _, p, o in triples_of(t) if p == "wdt:P1"]
    assert direct(doc(value)) == ['"p"'] and direct(doc(some)) == ['"n"']


def test_actor_rules_differ(spark):
    users = spark.createDataFrame([(u,) for u in ["10.0.0.1", "::1", "Botany", "xBot", "bOT", "Listed", "ann", None]], "user string")
    names = spark.createDataFrame([("LISTED",)], "name string")
    found = {r.user: (r.is_ip, r.is_bot) for r in with_flags(users, names, "class").collect()}
    assert found["10.0.0.1"][0] and found["::1"][0] and found["Botany"][1] and found["Listed"][1] and not found["ann"][1]
    other = {r.user: r.is_bot for r in with_flags(users, names, "property").collect()}
    assert not other["Botany"] and not other["Listed"] and other["bOT"] and other["xBot"]
    assert {r.user for r in humans_only(users, with_flags(users, names)).collect()} == {"ann"}
