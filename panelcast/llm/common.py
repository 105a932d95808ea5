"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word definitions here, as a regular expression class (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitted(rows: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """``fit`` of all ``rows`` as dictionaries, a bounded sample, worked out in one task; the driver gets only the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(taken))], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of words of a text, split at white space (null and empty texts: no word)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def blocks(texts: Iterable[str | None], limit: int) -> Iterator[list[str]]:
    """Consecutive texts of ``limit`` characters in all, or one longer text."""
    block: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def keep_rows(docs: DataFrame, test: Callable[[list[str]], np.ndarray], limit: int) -> DataFrame:
    """The rows of ``docs`` whose ``text`` (null: empty) passes ``test``, which sees blocks of texts."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [test(texts) for texts in blocks((x.as_py() for x in batch.column(at)), limit)]
            if passed:
                yield batch.filter(pa.array(np.concatenate(passed), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
