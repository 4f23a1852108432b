"""What the training-data operators share: durable tables, words, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.session import delete_folder, scratch_folder

#: A-Z become a-z; every other ASCII character that is no digit or letter becomes a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Texts that are Python strings at once.
BATCH_ROWS = 512
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as UTF-8, split as WORD_PATTERN splits them; null gives none."""
    if not text:
        return []
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Durable:
    """A DataFrame written once to the shared folder and read from there: short lineage that outlives lost executors."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = scratch_folder(self.spark, "table")
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing reads them any more."""
        delete_folder(self.spark, self.path)


def durable(df: DataFrame) -> DataFrame:
    return Durable(df).df


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a Python worker for later tasks, and it what its largest task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run() of mapInArrow that gives its memory back at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def kept_rows(docs: DataFrame, decide: Callable[[str | None], bool]) -> DataFrame:
    """Rows of docs for whose texts decide() is true; the other columns stay in the JVM."""

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        kept = []
        for k in range(0, len(texts), BATCH_ROWS):
            kept += map(decide, texts[k : k + BATCH_ROWS].to_pylist())
        give_back()
        return pa.array(kept, pa.bool_())

    return docs.where(keep(docs["text"].cast("string")))
