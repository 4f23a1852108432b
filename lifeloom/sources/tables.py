"""Tables in and out: lifecycle CSV, subject lookups, class documents, name lists, partitioned and nested sinks."""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.functions.terms import parse_time
from lifeloom.schema import LIFECYCLE_TEXT
from lifeloom.session import cut_lineage

#: Doubled quotes, as the files have them: Spark's default escape character would change literals with backslashes.
DIALECT = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
#: Compressed bytes that are decoded at once.
PIECE = 1 << 20


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, sep: str = ",", normalise: bool = False, single_lines: bool = False) -> DataFrame:
    """All columns as text; normalise trims and lower-cases header names and trims cells. Short rows end in nulls.

    Cells may hold line ends, so a file is one task; with single_lines they may not, and plain files are split. Large
    tables are converted to Parquet once (write_by_subject) and read from there.
    """
    df = spark.read.options(**DIALECT).options(sep=sep, mode="PERMISSIVE", multiLine=str(not single_lines).lower()).csv(path)
    if normalise:
        df = df.toDF(*(c.strip().lower() for c in df.columns))
        df = df.select(*(F.trim(c).alias(c) for c in df.columns))
    return df


def read_lifecycle_csv(spark: SparkSession, path: str, sep: str = ",", with_source: bool = False) -> DataFrame:
    """Lifecycle table with times parsed; empty cells are null. with_source adds src_file."""
    names = [c.split()[0] for c in LIFECYCLE_TEXT.split(", ")]
    df = require(read_csv(spark, path, sep), names)
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) for c in names] + ([F.col("_metadata.file_name").alias("src_file")] if with_source else [])
    return df.select(*kept).withColumns({c: parse_time(F.col(c)) for c in ("cdate", "ddate")})


def read_compressed_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of plain, .gz, .bz2 and .xz files; lines end at a line feed, bytes that are no UTF-8 are replaced.

    Spark's own reader takes all but .xz, plain and .bz2 files in splits. An .xz file is one task, which decodes it piece
    by piece; Spark hands it over as a whole, so it is bounded by what a binary cell holds (2 GB compressed).
    """

    def lines(data: bytes) -> Iterator[str]:
        decoder, rest, at = lzma.LZMADecompressor(), b"", 0
        while at < len(data):
            if decoder.eof:  # another stream in the same file
                decoder = lzma.LZMADecompressor()
            piece = decoder.decompress(data[at : at + PIECE])
            at = min(len(data), at + PIECE) - len(decoder.unused_data)
            *whole, rest = (rest + piece).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                found = lines(data)
                while held := list(islice(found, 10_000)):
                    yield pd.DataFrame({"path": name, "line": held})

    plain = spark.read.option("pathGlobFilter", "{*[^z],*.gz}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(path).select("path", "content")
    return plain.union(packed.mapInPandas(run, "path string, line string"))


def first_file(spark: SparkSession, path: str) -> str:
    """The file of a folder (or of a glob) that comes first by name."""
    files = spark.read.format("binaryFile").load(path).select("path")  # names only
    return files.agg(F.min("path")).first()[0]


def read_corrections(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(row_id, constraint_id, s, p, o) of a correction table, cells trimmed; row_id is unique and stays the same as long
    as the files do."""
    df = require(read_csv(spark, path, sep, normalise=True), ["constraint_id", "s", "p", "o"])
    return df.select(F.monotonically_increasing_id().alias("row_id"), "constraint_id", "s", "p", "o")


def subjects(lifecycles: DataFrame, file: str = "src_file") -> DataFrame:
    """(file, n_rows, n_subjects) of entity subjects."""
    rows = lifecycles.where(F.col("s").rlike("^wd:.+$"))
    return rows.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("s").alias("n_subjects"))


def write_by_subject(df: DataFrame, path: str, key: str = "s") -> None:
    """Parquet in ranges of the key, sorted within files: minima and maxima then find a subject's file."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "s") -> DataFrame:
    return spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_semi")


def read_class_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(class, user, cdate, ddate, count) of nested class documents: a JSON array of them, or, with lines, one a line."""
    entry = "array<struct<user:string,cdate:string,ddate:string,count:long>>"
    docs = spark.read.schema(f"class string, edit_counts {entry}").option("multiLine", str(not lines).lower()).json(path)
    return docs.select("class", F.explode("edit_counts").alias("e")).select("class", "e.user", "e.cdate", "e.ddate", "e.count")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a JSON array of names."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("name"))


def read_constraint_types(spark: SparkSession, path: str) -> DataFrame:
    """(type, label) of a JSON array of {cid, cidLabel}."""
    rows = spark.read.option("multiLine", "true").schema("cid string, cidLabel string").json(path)
    return rows.select(F.concat(F.lit("wd:"), F.substring_index("cid", "/", -1)).alias("type"), F.col("cidLabel").alias("label"))


def with_labels(df: DataFrame, labels: DataFrame, key: str, name: str = "label") -> DataFrame:
    """df with the label of its key from (id, label); the key itself where there is none."""
    dim = labels.select(F.col("id").alias(key), F.col("label").alias(name))
    return df.join(dim, key, "left").withColumn(name, F.coalesce(name, key))


def write_csv(df: DataFrame, path: str, sep: str = ",", order: list[str] | None = None, line_end: str = "\n") -> None:
    """CSV with doubled quotes, nulls empty; sorted as a whole by `order`. An existing result is replaced as a whole."""
    out = df.orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order)) if order else df
    flat = out.select(*(F.col(c).cast("string") for c in out.columns))
    flat.write.mode("overwrite").options(header="true", quote='"', escape='"', sep=sep, lineSep=line_end, emptyValue="", nullValue="").csv(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One pass over df into a folder for each value of `by`."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write unless a result is there already."""
    df.write.mode("ignore").parquet(path)


def split_bad_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, text of rows that do not fit the schema); the files are parsed once, into the shared folder."""
    own = f"{schema}, _bad string"
    df = cut_lineage(spark.read.options(**DIALECT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(own).csv(path))
    return df.where("_bad is null").drop("_bad"), df.where("_bad is not null").select("_bad")
