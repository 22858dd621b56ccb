"""Reading the corpus tables and keeping intermediate tables where all executors see them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    """A temporary folder of this process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="spark-tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all run in one
    process (tests), as executors of a cluster could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if _kept:
        _kept[-1].append(out)
    return out


#: The tables that keep() wrote, for each result that is being made.
_kept: list[list[DataFrame]] = []


def finished(what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build()`` gives, written as a table; those that :func:`keep` wrote on the way are deleted, if it fails too."""
    mine: list[DataFrame] = []
    out = None
    _kept.append(mine)
    try:
        out = keep(build(), what)
    finally:
        _kept.pop()
        for df in mine:
            if df is not out:
                discard(df)
    if _kept:
        _kept[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`keep` returned, once nothing will be computed from it any more."""
    remove(df.sparkSession, df.kept_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`keep` or a writer made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` clashes with."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


#: Words of 64 bits of a table of bits, and so the most rows of one that is broadcast.
BIT_WORDS = 1 << 20


def may_be_in(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: false only if no row of ``keys`` (one column) equals ``key``, both being hashes.

    The keys become bits of a table with at most ``BIT_WORDS`` rows, so it can be broadcast however many they are; the more
    keys, the more rows are true by chance. Rows that are false need no shuffle to learn that they have no partner."""
    word = lambda k: F.pmod(F.shiftrightunsigned(k, 6), F.lit(BIT_WORDS))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    own = F.col(keys.columns[0])
    where, bits = fresh("word", df.columns), fresh("bits", df.columns)
    table_ = keep(keys.groupBy(word(own).alias(where)).agg(F.bit_or(bit(own)).alias(bits)), "bits")
    met = df.join(F.broadcast(table_), word(key) == F.col(where), "left")
    return met.select(*df.columns, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False)).alias(flag))


_shipped: set[str] = set()


#: Bytes of an Arrow batch that a task sends to Python at once, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, so that tasks find it wherever it was started from, and
    bounds the text that they get at once, unless the session sets its own bound."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        _shipped.add(application)
        if spark.sparkContext.getConf().get(BATCH_SETTING) is None:
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp()) / "tessera.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "tessera").rglob("*.py")):
                out.write(path, path.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None, schema: str | StructType, whole: Callable | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch, or of all batches of a task (``whole``)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(whole or run, schema)
