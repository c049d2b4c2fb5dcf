"""Reading of the named tables and session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; it need not be installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_scholion_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="scholion-")) / "scholion_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._scholion_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where it has fewer: a small file is else one task's work. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fanned(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as shuffles have, which small sizes don't merge: for steps that compute much from few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all tasks run on this machine (tests)."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return conf or f"file://{os.path.abspath('/tmp/scholion-checkpoints')}"


def _paths(spark: SparkSession) -> tuple[str, list[str]]:
    sc = spark.sparkContext
    if not hasattr(sc, "_scholion_tables"):
        sc._scholion_tables = []
        atexit.register(_drop_all, sc)
    return f"{shared_dir(spark)}/scholion-{sc.applicationId}", sc._scholion_tables


def _drop(sc, path: str) -> None:
    jvm = sc._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(sc) -> None:
    try:
        for path in list(sc._scholion_tables):
            _drop(sc, path)
    except Exception:  # noqa: BLE001 - the session may be gone already; its folder is then left to the cluster
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, dropped at the end of the session."""
    root, known = _paths(spark)
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    known.append(path.rpartition("/")[0])
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files go as soon as it ends, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: it is written once as a table in the shared folder and read back; survives the loss of executors.

    The table lives until :func:`release` or the end of the session; the shuffle files that it was made from are dropped once it is written.
    """
    root, known = _paths(df.sparkSession)
    path = f"{root}/{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    known.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scholion_path = path
    return out


def gathered(parts: Iterator[DataFrame]) -> DataFrame:
    """One table of all parts, as :func:`cut` has it; each part is computed and written before the next is asked for, so the plan doesn't grow with them."""
    first = cut(next(parts))
    with _shuffles_dropped(first.sparkSession):
        for part in parts:
            part.write.mode("append").parquet(first._scholion_path)
    out = first.sparkSession.read.schema(first.schema).parquet(first._scholion_path)
    out._scholion_path = first._scholion_path
    return out


def merged(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sort and merge only. Spark sizes a cut table by its bytes on disk, and rankings, whose rows are much alike, take a hundred times that when the driver broadcasts them."""
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Drop a table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_scholion_path", None)
    if path:
        known = df.sparkSession.sparkContext._scholion_tables
        known.remove(path)
        _drop(df.sparkSession.sparkContext, path)


def prefixed(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that further columns of the caller cannot clash with its own."""
    return df.select(*names)
