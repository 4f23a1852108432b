"""Constraint histories: which constraint statements held when, seen through their ranks, in a form ready to validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.operators.intervals import intersect, merge, subtract
from lifeloom.session import cut_lineage

#: Constraint kinds and their items in the public knowledge graph.
KINDS = {
    "one_of": "wd:Q21510859",
    "none_of": "wd:Q52558054",
    "conflicts_with": "wd:Q21502838",
    "inverse": "wd:Q21510855",
    "symmetric": "wd:Q21510862",
    "item_requires_statement": "wd:Q21503247",
    "value_requires_statement": "wd:Q21510864",
}
TYPE, LINK, RANK, QUALIFIER = "ps:P2302", "p:P2302", "wikibase:rank", "pq:"
NORMAL, PREFERRED = "wikibase:NormalRank", "wikibase:PreferredRank"
VALUE, PROPERTY, EXCEPTION = "pq:P2305", "pq:P2306", "pq:P2303"
#: Which qualifiers a kind exports, besides exceptions.
EXPORTS = {
    "one_of": "values",
    "none_of": "values",
    "conflicts_with": "pairs",
    "inverse": "properties",
    "symmetric": "active",
    "item_requires_statement": "pairs",
    "value_requires_statement": "pairs",
}


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KINDS.items()), "kind string, type string")


def constraint_rows(lifecycles: DataFrame) -> DataFrame:
    """Rows about constraint statements: their links, and all rows whose subject is such a statement."""
    statements = lifecycles.where(F.col("p") == LINK).select(F.trim("o").alias("s")).distinct()
    return lifecycles.join(statements, "s", "left_semi").unionByName(lifecycles.where(F.col("p") == LINK))


def statement_intervals(rows: DataFrame, kind_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(type, link, rank, qualifier) rows of constraint statements with start and end.

    Statements without a link are left out: they belong to no property. type and link carry (prop, statement, kind).
    """
    r = rows.select("s", "p", "o", F.col("cdate").alias("start"), F.col("ddate").alias("end"))
    types = r.where(F.col("p") == TYPE).join(F.broadcast(kind_table), F.col("o") == F.col("type")).select(F.col("s").alias("statement"), "kind", "start", "end")
    links = r.where(F.col("p") == LINK).select(F.col("o").alias("statement"), F.col("s").alias("prop"), "start", "end")
    owner = links.select("statement", "prop").distinct()
    types = types.join(owner, "statement")
    own = types.select("statement", "prop", "kind").distinct()
    links = links.drop("prop").join(own, "statement")
    ranks = r.where(F.col("p") == RANK).select(F.col("s").alias("statement"), F.col("o").alias("rank"), "start", "end").join(own, "statement")
    qualifiers = r.where(F.col("p").startswith(QUALIFIER)).select(F.col("s").alias("statement"), F.col("p").alias("qualifier"), F.col("o").alias("value"), "start", "end")
    return types, links, ranks, qualifiers.join(own, "statement")


def active_intervals(types: DataFrame, links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(prop, kind, statement, start, end) during which a statement is in force.

    In force: typed and linked, and of preferred rank; or of normal rank while no statement of the property and kind is
    preferred.
    """
    keys, whole = ["prop", "kind", "statement"], ["prop", "kind"]
    base = intersect(types.select(*keys, "start", "end"), links.select(*keys, "start", "end"), keys)
    ranked = [*keys, "rank"]
    own = ranks.where(F.col("rank").isin(NORMAL, PREFERRED)).select(*ranked, "start", "end")
    # Both ranks at once; what follows reads it more than once, so it is written.
    held = cut_lineage(intersect(own.select(*ranked).distinct().join(base, keys).select(*ranked, "start", "end"), own, ranked))
    normal, preferred = (held.where(F.col("rank") == rank).drop("rank") for rank in (NORMAL, PREFERRED))
    reigning = merge(preferred.select(*whole, "start", "end"), whole)
    # What any statement of the property takes away, it takes from each of them.
    taken = normal.select(*keys).distinct().join(reigning, whole).select(*keys, "start", "end")
    return cut_lineage(merge(subtract(normal, taken, keys).unionByName(preferred), keys))


def rank_report(ranks: DataFrame, own: DataFrame) -> DataFrame:
    """(prop, kind, statements, without_rank, with_preferred, only_deprecated)."""
    seen = ranks.groupBy("prop", "kind", "statement").agg(
        F.bool_or(F.col("rank") == PREFERRED).alias("preferred"), F.bool_and(~F.col("rank").isin(NORMAL, PREFERRED)).alias("deprecated")
    )
    met = own.select("prop", "kind", "statement").distinct().join(seen, ["prop", "kind", "statement"], "left")
    return met.groupBy("prop", "kind").agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_if(F.col("preferred").isNull()).alias("without_rank"),
        F.count_if(F.coalesce("preferred", F.lit(False))).alias("with_preferred"),
        F.count_if(F.coalesce("deprecated", F.lit(False))).alias("only_deprecated"),
    )


def index_report(lifecycles: DataFrame, kind_table: DataFrame) -> DataFrame:
    """What the constraint index holds, a row for each kind, statements without a link to a property included.

    (kind, type, n_constraint_type_rows, n_constraint_statements, n_property_links, n_linked_constraint_statements,
    n_properties, n_rank_rows, n_ranked_constraint_statements, n_qualifier_rows, qualifier_counts map<qualifier, rows>,
    n_statements_without_property_link, n_statements_without_rank).
    """
    typed = lifecycles.where(F.col("p") == TYPE).join(F.broadcast(kind_table), F.col("o") == F.col("type")).select("kind", F.col("s").alias("statement"))
    own = typed.distinct()
    about = lifecycles.select(F.when(F.col("p") == LINK, F.col("o")).otherwise(F.col("s")).alias("statement"), "s", "p").join(own, "statement")
    link, rank, qualifier = F.col("p") == LINK, F.col("p") == RANK, F.col("p").startswith(QUALIFIER)
    # Counts of each statement first: the distinct statements of a kind are then plain sums.
    each = about.where(link | rank | qualifier).groupBy("kind", "statement").agg(*(F.count_if(c).alias(n) for n, c in (("links", link), ("ranks", rank), ("qualifiers", qualifier))))
    sums = own.join(each, ["kind", "statement"], "left").fillna(0).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_constraint_statements"), F.sum("links").alias("n_property_links"), F.count_if(F.col("links") > 0).alias("n_linked_constraint_statements"),
        F.sum("ranks").alias("n_rank_rows"), F.count_if(F.col("ranks") > 0).alias("n_ranked_constraint_statements"), F.sum("qualifiers").alias("n_qualifier_rows"),
        F.count_if(F.col("links") == 0).alias("n_statements_without_property_link"), F.count_if(F.col("ranks") == 0).alias("n_statements_without_rank"),
    )
    props = about.where(link).groupBy("kind").agg(F.countDistinct("s").alias("n_properties"))
    named = about.where(qualifier).groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"))
    named = named.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("qualifier_counts"))
    rows = typed.groupBy("kind").agg(F.count(F.lit(1)).alias("n_constraint_type_rows"))
    return kind_table.join(rows, "kind").join(sums, "kind").join(props, "kind", "left").join(named, "kind", "left").fillna(0, ["n_properties"])


def raw_documents(types: DataFrame, links: DataFrame, ranks: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """(prop, kind, statements array): each statement with its type, link, rank and qualifier intervals, nested."""
    span = F.struct("start", "end")
    keys = ["prop", "kind", "statement"]
    t = types.groupBy(*keys).agg(F.sort_array(F.collect_list(span)).alias("types"))
    k = links.groupBy(*keys).agg(F.sort_array(F.collect_list(span)).alias("links"))
    r = ranks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "rank"))).alias("ranks"))
    q = qualifiers.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("qualifier", "value", "start", "end"))).alias("qualifiers"))
    met = t.join(k, keys).join(r, keys, "left").join(q, keys, "left")
    return met.groupBy("prop", "kind").agg(F.sort_array(F.collect_list(F.struct("statement", "types", "links", "ranks", "qualifiers"))).alias("statements"))


def held_qualifiers(active: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """(prop, kind, statement, qualifier, value, start, end) of qualifiers while their statement is in force."""
    keys = ["prop", "kind", "statement", "qualifier", "value"]
    own = qualifiers.select(*keys, "start", "end")
    held = own.select(*keys).distinct().join(active, ["prop", "kind", "statement"]).select(*keys, "start", "end")
    return intersect(own, held, keys)


def active_qualifiers(active: DataFrame, qualifiers: DataFrame, qualifier: str) -> DataFrame:
    """The same of one qualifier, (prop, kind, statement, value, start, end)."""
    return held_qualifiers(active, qualifiers.where(F.col("qualifier") == qualifier)).drop("qualifier")


def _pairs(props: DataFrame, values: DataFrame) -> DataFrame:
    keys = ["prop", "kind", "statement"]
    props, values = props.withColumnRenamed("value", "pq2306"), values.withColumnRenamed("value", "pq2305")
    met = props.join(values.withColumnsRenamed({"start": "v_start", "end": "v_end"}), keys)
    start, end = F.greatest("start", "v_start"), F.least("end", "v_end")
    pairs = met.select(*keys, "pq2306", "pq2305", start.alias("start"), end.alias("end")).where("end is null or start < end")
    own = [*keys, "pq2306"]
    alone = subtract(props.select(*own, "start", "end"), pairs.select(*own, "start", "end"), own)
    return pairs.unionByName(alone.withColumn("pq2305", F.lit(None).cast("string")))


def property_value_pairs(active: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """(prop, kind, statement, pq2306, pq2305, start, end): property and value while both hold, and the property alone
    (null value) during what is left of its time."""
    return _pairs(active_qualifiers(active, qualifiers, PROPERTY), active_qualifiers(active, qualifiers, VALUE))


def entries(types: DataFrame, links: DataFrame, ranks: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """All kinds' entries and exceptions in one table: (prop, kind, role, pq2306, pq2305, entity, start, end, constraint_id)."""
    active = active_intervals(types, links, ranks)
    none = F.lit(None).cast("string")

    def made(df: DataFrame, role: str, **cols) -> DataFrame:
        c = {k: cols.get(k, none) for k in ("pq2306", "pq2305", "entity")}
        return df.select("prop", "kind", F.lit(role).alias("role"), *(v.alias(k) for k, v in c.items()), "start", "end", F.col("statement").alias("constraint_id"))

    def of(form: str):
        return F.col("kind").isin(*(k for k, v in EXPORTS.items() if v == form))

    held = cut_lineage(held_qualifiers(active, qualifiers.where(F.col("qualifier").isin(VALUE, PROPERTY, EXCEPTION))))
    value, prop, excepted = (held.where(F.col("qualifier") == q).drop("qualifier") for q in (VALUE, PROPERTY, EXCEPTION))
    pairs = _pairs(prop.where(of("pairs")), value.where(of("pairs")))
    out = made(value.where(of("values")), "entry", entity=F.col("value"))
    out = out.unionByName(made(prop.where(of("properties")), "entry", pq2306=F.col("value")))
    out = out.unionByName(made(active.where(of("active")), "entry"))
    out = out.unionByName(made(pairs, "entry", pq2306=F.col("pq2306"), pq2305=F.col("pq2305")))
    return out.unionByName(made(excepted, "exception", entity=F.col("value")))


#: The list that holds a kind's entries in a simplified document.
_LISTS = {"values": VALUE, "properties": PROPERTY, "active": "active_intervals"}


def _list_of(kind: str) -> str:
    return _LISTS.get(EXPORTS[kind], "conflicts" if kind == "conflicts_with" else "requirements")


def simplified_documents(found: DataFrame, kind: str) -> DataFrame:
    """(prop, document): entries and exceptions of one kind as JSON {prop: {list name: [...]}}, a document a property."""
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.when(F.col("role") == "exception", EXCEPTION).otherwise(_list_of(kind))
    entity = F.when(name == PROPERTY, F.col("pq2306")).otherwise(F.col("entity"))
    pair = F.when(name == PROPERTY, None).otherwise(F.col("pq2306"))
    row = F.struct(
        entity.alias("entity"), pair.alias(PROPERTY), F.col("pq2305").alias(VALUE), when("start").alias("start_date"), when("end").alias("end_date"), F.col("constraint_id").alias("constraint_id")
    )
    lists = found.where(F.col("kind") == kind).groupBy("prop", name.alias("name")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    docs = lists.groupBy("prop").agg(F.map_from_entries(F.collect_list(F.struct("name", "rows"))).alias("lists"))
    return docs.select("prop", F.to_json(F.create_map("prop", "lists")).alias("document"))


def write_simplified(found: DataFrame, kind: str, path: str) -> None:
    """Simplified documents of one kind, a line each."""
    simplified_documents(found, kind).select("document").write.mode("overwrite").text(path)


def load_simplified(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Entries from simplified constraint documents: {prop: {list name: [{..., start_date, end_date, constraint_id}]}}.

    A file is one document, or, with lines, each of its lines is one.
    """
    row = "struct<`pq:P2306`:string,`pq:P2305`:string,entity:string,start_date:string,end_date:string,constraint_id:string>"
    lists = "active_intervals", "requirements", "conflicts", VALUE, PROPERTY, EXCEPTION
    schema = f"map<string,struct<{','.join(f'`{x}`:array<{row}>' for x in lists)}>>"
    text = spark.read.text(path, wholetext=not lines)
    props = text.select(F.explode(F.from_json("value", schema)).alias("prop", "doc"))
    out = None
    for name in lists:
        one = props.select("prop", F.explode(f"doc.`{name}`").alias("r"))
        single = F.col("r.entity") if name not in (PROPERTY,) else F.lit(None).cast("string")
        made = one.select(
            "prop", F.lit(kind).alias("kind"), F.lit("exception" if name == EXCEPTION else "entry").alias("role"),
            F.coalesce("r.`pq:P2306`", F.col("r.entity") if name == PROPERTY else F.lit(None)).alias("pq2306"),
            F.col("r.`pq:P2305`").alias("pq2305"), single.alias("entity"),
            F.try_to_timestamp("r.start_date").cast("timestamp_ntz").alias("start"), F.try_to_timestamp("r.end_date").cast("timestamp_ntz").alias("end"),
            F.col("r.constraint_id").alias("constraint_id"),
        )
        out = made if out is None else out.unionByName(made)
    return out.where("start is not null")
