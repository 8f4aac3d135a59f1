"""Helpers shared by the corpus operators: durable intermediate tables, text bytes, Arrow output."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at a time; whole texts of this many rows are held at once.
BATCH_ROWS = 512
#: Bytes handed to a Python worker at a time, about; one text may be longer, and is then alone.
BATCH_BYTES = 64 << 20

#: Lower-case table for A-Z alone, as the contracts ask (no other letter changes).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-process session (``local[...]``) without that setting gets a folder of its own,
    removed at exit; a cluster without it is refused, as executors could not see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidelane-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no recomputation of what came before. The files are
    removed by ``release``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    if _scopes:
        _scopes[-1].append(table)
    return table


_scopes: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Tables stored inside are released at the end, but for those that the block puts into the list it is given."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        paths = {table._stored_at for table in kept}
        release(*[table for table in _scopes.pop() if table._stored_at not in paths])


def release(*tables: DataFrame) -> None:
    """Remove the files of tables from ``stored`` that nothing will read any more; the tables can't be used after."""
    for table in tables:
        _remove(table.sparkSession, table._stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already: a local folder can still be removed
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, by rows and by bytes: few whole texts at a time.

    Frames run when their user asks for rows, so the bounds must outlast the call: they stay in the session. They are
    only ever lowered; a smaller value of the user's is kept.
    """
    lower_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    lower_setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lower_setting(spark: SparkSession, key: str, most: int) -> None:
    now = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", spark.conf.get(key).lower())
    size = int(now[1]) << (10 * " bkmgt".index(now[2] or "b") - 10) if now else 0
    if not 0 < size <= most:
        spark.conf.set(key, str(most))


def plain_names(df: DataFrame) -> DataFrame:
    """The columns under names that need no quotes, as Python functions over whole rows ask for."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4: remainder 2 marks rows held out from learning."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


def held_out(doc_id: Column) -> Column:
    """True for the held-out fold; a null id belongs to no fold and is never learned from."""
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(True))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A model or vocabulary file, read on the driver (any Hadoop path, or a local one)."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])
