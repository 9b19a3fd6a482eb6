"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import xxhash64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a checkpoint, and columns are read as needed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Only a local session without it gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that df lacks, whatever columns a caller brings along."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__llm_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unclaimed(df: DataFrame, *names: str | None) -> None:
    """Refuse result columns that the input already has."""
    taken = {c.lower() for c in df.columns}
    if clash := [n for n in names if n is not None and n.lower() in taken]:
        raise ValueError(f"the input already has the columns {clash}; choose other names for the results")


def numbered(docs: DataFrame, name: str, is_table: bool = False) -> DataFrame:
    """docs with the column `name`, which tells rows apart and stays the same however often and wherever a row is read:
    the file of the row and its place there. docs is stored first, unless it is known to be read from Parquet files as they are."""
    docs = docs if is_table else stored(docs)
    file = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.struct(xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("at")))


def frugal(batches: Callable) -> Callable:
    """A function for mapInArrow that hands freed memory back to the system after each partition: Python workers are
    reused, and what one stage's arrays took would stay with them beside the next stage's."""

    @wraps(batches)
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(rows)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run
