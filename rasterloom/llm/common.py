"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the ASCII blanks. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def use_checkpoints(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where the session names none, a local one is made in local mode (tests), and a cluster is an error: its executors share no such folder."""
    context = spark.sparkContext
    there = context.getCheckpointDir()
    if there:
        return there
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rasterloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through the file system that Spark itself uses."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: the files are shared, so a lost executor costs nothing."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def slices(texts: list, budget: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about ``budget`` bytes each, so that token lists stay small. One long text stands alone."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= budget:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have this session hand Python ``rows`` rows at a time, unless its owner chose a number: whole documents are wide, and a batch is held on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":  # Spark's default
        spark.conf.set(setting, str(rows))


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(column(doc_id).cast("string").cast("binary")) % mod


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, with underscores before it until no column (compared as Spark does, without case) has that name."""
    names = {x.lower() for x in taken}
    while wish.lower() in names:
        wish = "_" + wish
    return wish


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
