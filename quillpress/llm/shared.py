"""Helpers that the operators of this folder share: tables, shared work folders, names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship  # noqa: F401  the operators of this folder take it from here

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset: the warehouse, which a cluster shares; only a local master, whose executors
    are this process, gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillpress-work"
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="quillpress-")
    return "file://" + _OWN_DIR["dir"]


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    It cuts the lineage, survives a lost executor, and lets a result be read twice
    without being computed twice.  The files go with forget() or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(start: int = 0, keep: int = 0) -> None:
    """Delete what materialize() wrote from the table number start on, but for the last `keep` ones; results that still read it must be stored first."""
    last = [_WRITTEN.pop() for _ in range(min(keep, len(_WRITTEN) - start))]
    gone = [_WRITTEN.pop() for _ in range(len(_WRITTEN) - start)]
    _WRITTEN.extend(reversed(last))
    for session, path in gone:
        try:
            target = session._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  at exit the session may be gone; the other tables get their turn
            continue


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often, and within whatever lambda, body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; its cleaner waits for a collection."""
    gc.collect()
    spark._jvm.System.gc()


def written() -> int:
    """The number of tables that materialize() has written and forget() has not deleted."""
    return len(_WRITTEN)


atexit.register(forget)


def binary_column(batch, name: str):
    """The values of a string or binary column of an Arrow batch as bytes, one at a time; null stays None."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
    return (x.as_py() for x in col)
