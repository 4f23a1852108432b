"""Queries on constraint histories: what was in force when, as intervals, entries, documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.operators import constraints as C
from lifeloom.plans import projections as P
from lifeloom.plans.catalogue import query
from lifeloom.session import cut_lineage, scratch_folder

_K, _SQ = "CAST(k AS STRING)", "'wds:' || CAST(k AS STRING)"
_TYPES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(C.KINDS.values()))
_RANKED = "k % 11 <> 0"
#: Suppliers as constraint statements, in SQL that both engines read: a and b are days, a null b is open.
_HISTORY = f"""
SELECT 'wd:P' || CAST(k % 5 AS STRING) AS s, '{C.LINK}' AS p, {_SQ} AS o, k % 4 AS a, CASE WHEN k % 6 = 0 THEN 50 END AS b FROM {{t}} WHERE k % 9 <> 4
UNION ALL SELECT {_SQ}, '{C.TYPE}', CASE k % 8 {_TYPES} ELSE 'wd:Q999' END, k % 3, CASE WHEN k % 10 = 3 THEN 45 END FROM {{t}}
UNION ALL SELECT {_SQ}, '{C.RANK}', '{C.NORMAL}', 0, CASE WHEN k % 3 = 0 THEN 20 + k % 5 END FROM {{t}} WHERE {_RANKED}
UNION ALL SELECT {_SQ}, '{C.RANK}', CASE WHEN k % 2 = 0 THEN '{C.PREFERRED}' ELSE 'wikibase:DeprecatedRank' END, 20 + k % 5, CASE WHEN k % 4 = 0 THEN 35 + k % 3 END FROM {{t}} WHERE {_RANKED} AND k % 3 = 0
UNION ALL SELECT {_SQ}, '{C.VALUE}', 'wd:V' || CAST(k % 6 AS STRING), k % 8, 30 + k % 9 FROM {{t}}
UNION ALL SELECT {_SQ}, '{C.VALUE}', 'wd:V' || CAST(k % 6 + 1 AS STRING), 10 + k % 5, NULL FROM {{t}} WHERE k % 5 <> 1
UNION ALL SELECT {_SQ}, '{C.PROPERTY}', 'wd:P' || CAST(k % 9 AS STRING), 2, CASE WHEN k % 2 = 0 THEN 38 END FROM {{t}}
UNION ALL SELECT {_SQ}, '{C.EXCEPTION}', 'wd:X' || CAST(k % 13 AS STRING), 5 + k % 5, CASE WHEN k % 4 = 1 THEN 25 END FROM {{t}}"""
_DAYS = 70  # later than every end


def history(spark: SparkSession, sf: str) -> DataFrame:
    """(s, p, o, cdate, ddate) of the suppliers' constraint statements."""
    k = P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = spark.sql(_HISTORY.replace("{t}", "{k}"), k=k)
    day = lambda c: F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval({c})")
    return rows.select("s", "p", "o", day("a").alias("cdate"), day("b").alias("ddate"))


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return C.statement_intervals(C.constraint_rows(history(spark, sf)), C.kinds(spark))


_SQL = f"""h AS ({_HISTORY.replace("{t}", "(SELECT s_suppkey AS k FROM supplier)")}),
kd AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{t}')" for k, t in C.KINDS.items())}) AS x(kind, type)),
held AS (SELECT s, p, o, d FROM h, range(0, {_DAYS}) AS r(d) WHERE d >= a AND (b IS NULL OR d < b)),
base AS (
  SELECT DISTINCT l.s AS prop, kind, t.s AS st, t.d FROM held t JOIN kd ON t.p = '{C.TYPE}' AND t.o = type JOIN held l ON l.p = '{C.LINK}' AND l.o = t.s AND l.d = t.d
),
pf AS (SELECT base.* FROM base SEMI JOIN held r ON r.p = '{C.RANK}' AND r.o = '{C.PREFERRED}' AND r.s = st AND r.d = base.d),
nm AS (SELECT base.* FROM base SEMI JOIN held r ON r.p = '{C.RANK}' AND r.o = '{C.NORMAL}' AND r.s = st AND r.d = base.d),
ac AS (SELECT * FROM pf UNION SELECT nm.* FROM nm ANTI JOIN pf ON pf.prop = nm.prop AND pf.kind = nm.kind AND pf.d = nm.d),
qa AS (SELECT DISTINCT prop, kind, st, p AS q, o AS v, ac.d FROM ac JOIN held ON s = st AND held.d = ac.d AND p LIKE 'pq:%'),
pr AS (SELECT x.prop, x.kind, x.st, x.v AS pq2306, y.v AS pq2305, x.d FROM qa x LEFT JOIN qa y ON y.prop = x.prop AND y.kind = x.kind AND y.st = x.st AND y.d = x.d AND y.q = '{C.VALUE}' WHERE x.q = '{C.PROPERTY}'),
en AS (
  SELECT prop, kind, 'entry' AS role, NULL::VARCHAR AS pq2306, NULL::VARCHAR AS pq2305, v AS entity, st, d FROM qa WHERE q = '{C.VALUE}' AND kind IN ('one_of', 'none_of')
  UNION ALL SELECT prop, kind, 'entry', v, NULL, NULL, st, d FROM qa WHERE q = '{C.PROPERTY}' AND kind = 'inverse'
  UNION ALL SELECT prop, kind, 'entry', NULL, NULL, NULL, st, d FROM ac WHERE kind = 'symmetric'
  UNION ALL SELECT prop, kind, 'entry', pq2306, pq2305, NULL, st, d FROM pr WHERE kind IN ('conflicts_with', 'item_requires_statement', 'value_requires_statement')
  UNION ALL SELECT prop, kind, 'exception', NULL, NULL, v, st, d FROM qa WHERE q = '{C.EXCEPTION}'
)"""


def _islands(table: str, keys: str) -> str:
    """Intervals of a table of days."""
    day = "TIMESTAMP '2024-01-01' + to_days(CAST({} AS INTEGER))"
    return f"""SELECT {keys}, {day.format('min(d)')} AS "start", CASE WHEN max(d) < {_DAYS - 1} THEN {day.format('max(d) + 1')} END AS "end"
    FROM (SELECT *, d - row_number() OVER (PARTITION BY {keys} ORDER BY d) AS g FROM {table}) GROUP BY {keys}, g"""


_ENTRIES = f"SELECT * EXCLUDE (st), st AS constraint_id FROM ({_islands('en', 'prop, kind, role, pq2306, pq2305, entity, st')})"


@query("constraint_active_intervals", f"WITH {_SQL} SELECT * EXCLUDE (st), st AS statement FROM ({_islands('ac', 'prop, kind, st')})")
def constraint_active_intervals(spark: SparkSession, sf: str) -> DataFrame:
    types, links, ranks, _ = _parts(spark, sf)
    return C.active_intervals(types, links, ranks)


@query("constraint_entries", f"WITH {_SQL} {_ENTRIES}")
def constraint_entries(spark: SparkSession, sf: str) -> DataFrame:
    return C.entries(*_parts(spark, sf))


@query("constraint_documents_read_back", f"WITH {_SQL} {_ENTRIES}")
def constraint_documents_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of all kinds by way of their simplified documents: written to the shared folder and loaded."""
    found, out = cut_lineage(C.entries(*_parts(spark, sf))), None
    root = scratch_folder(spark, "simplified")
    for kind in C.KINDS:
        C.write_simplified(found, kind, f"{root}/{kind}")
        own = C.load_simplified(spark, f"{root}/{kind}", kind, lines=True)
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "constraint_rank_report",
    f"""WITH {_SQL}, o AS (SELECT DISTINCT l.s AS prop, kind, t.s AS st FROM h t JOIN kd ON t.p = '{C.TYPE}' AND t.o = type JOIN h l ON l.p = '{C.LINK}' AND l.o = t.s),
    r AS (SELECT prop, kind, st, bool_or(h.o = '{C.PREFERRED}') AS pre, bool_and(h.o NOT IN ('{C.NORMAL}', '{C.PREFERRED}')) AS dep, count(h.o) AS n FROM o LEFT JOIN h ON h.s = st AND h.p = '{C.RANK}' GROUP BY ALL)
    SELECT prop, kind, count(*) AS statements, count(*) FILTER (n = 0) AS without_rank, count(*) FILTER (pre) AS with_preferred, count(*) FILTER (dep) AS only_deprecated FROM r GROUP BY ALL""",
)
def constraint_rank_report(spark: SparkSession, sf: str) -> DataFrame:
    types, _, ranks, _ = _parts(spark, sf)
    return C.rank_report(ranks, types)


def _count(p: str) -> str:
    return f"(SELECT count(*) FROM ow JOIN h ON {'h.o' if p == C.LINK else 'h.s'} = st AND h.p LIKE '{p}' WHERE ow.kind = kd.kind)"


def _statements(p: str) -> str:
    return f"(SELECT count(DISTINCT st) FROM ow JOIN h ON {'h.o' if p == C.LINK else 'h.s'} = st AND h.p = '{p}' WHERE ow.kind = kd.kind)"


@query(
    "constraint_index_report",
    f"""WITH {_SQL}, ty AS (SELECT kind, s AS st FROM h JOIN kd ON p = '{C.TYPE}' AND o = type), ow AS (SELECT DISTINCT * FROM ty),
    qc AS (SELECT kind, h.p, count(*) AS n FROM ow JOIN h ON h.s = st AND h.p LIKE 'pq:%' GROUP BY ALL), qs AS (SELECT kind, string_agg(p || '=' || n, ',' ORDER BY p) AS qualifier_counts FROM qc GROUP BY kind),
    n AS (SELECT kind, count(*) AS n FROM ow GROUP BY kind)
    SELECT kd.kind, kd.type, (SELECT count(*) FROM ty WHERE ty.kind = kd.kind) AS n_constraint_type_rows, n.n AS n_constraint_statements, {_count(C.LINK)} AS n_property_links, {_statements(C.LINK)} AS n_linked_constraint_statements,
    (SELECT count(DISTINCT h.s) FROM ow JOIN h ON h.o = st AND h.p = '{C.LINK}' WHERE ow.kind = kd.kind) AS n_properties, {_count(C.RANK)} AS n_rank_rows, {_statements(C.RANK)} AS n_ranked_constraint_statements,
    {_count('pq:%')} AS n_qualifier_rows, qualifier_counts, n.n - {_statements(C.LINK)} AS n_statements_without_property_link, n.n - {_statements(C.RANK)} AS n_statements_without_rank
    FROM kd JOIN n USING (kind) LEFT JOIN qs USING (kind)""",
)
def constraint_index_report(spark: SparkSession, sf: str) -> DataFrame:
    report = C.index_report(history(spark, sf), C.kinds(spark))
    pairs = F.transform(F.map_entries("qualifier_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.withColumn("qualifier_counts", F.array_join(F.array_sort(pairs), ","))


def _spans(p: str, value: str = "''", order: str = "a, b NULLS FIRST, h.o") -> str:
    day = lambda c: f"coalesce(strftime(TIMESTAMP '2024-01-01' + to_days(CAST({c} AS INTEGER)), '%m-%d'), '')"
    who = "h.o" if p == C.LINK else "h.s"
    return f"coalesce((SELECT string_agg({value} || {day('a')} || '..' || {day('b')}, ' ' ORDER BY {order}) FROM h WHERE {who} = o.st AND h.p LIKE '{p}'), '')"


@query(
    "constraint_raw_documents",
    f"""WITH {_SQL}, o AS (SELECT DISTINCT l.s AS prop, kind, t.s AS st FROM h t JOIN kd ON t.p = '{C.TYPE}' AND t.o = type JOIN h l ON l.p = '{C.LINK}' AND l.o = t.s)
    SELECT prop, kind, st AS statement, {_spans(C.TYPE)} AS types, {_spans(C.LINK)} AS links, {_spans(C.RANK, "h.o || ' '")} AS ranks, {_spans('pq:%', "h.p || ' ' || h.o || ' '", 'h.p, h.o, a, b NULLS FIRST')} AS qualifiers FROM o""",
)
def constraint_raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The statements of the nested documents, their lists as text in their order."""
    one = C.raw_documents(*_parts(spark, sf)).select("prop", "kind", F.explode("statements").alias("x")).select("prop", "kind", "x.*")
    day = lambda c: F.coalesce(F.date_format(c, "MM-dd"), F.lit(""))

    def text(name: str, *fields: str):
        spans = F.transform(name, lambda e: F.concat(*(x for f in fields for x in (e[f], F.lit(" "))), day(e["start"]), F.lit(".."), day(e["end"])))
        return F.coalesce(F.array_join(spans, " "), F.lit("")).alias(name)

    return one.select("prop", "kind", "statement", text("types"), text("links"), text("ranks", "rank"), text("qualifiers", "qualifier", "value"))
