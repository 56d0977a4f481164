"""Tables that cut lineage, in the shared folder the cluster names.

``spark.checkpoint.dir`` is read from the session.  Only where it is unset and
the master is local (tests, a laptop) is a folder of our own made.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "panelwright.code.shipped"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session, as a Hadoop path."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="panelwright-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/panelwright/{name}-{uuid.uuid4().hex}"


GATHER_BYTES = 1 << 20  # of a table in files for each task that writes what is made of it


def materialise(df: DataFrame, name: str, of: DataFrame | None = None) -> DataFrame:
    """Write df once and read it back: a recomputation after a lost executor starts from the files.

    With of, a table in files that df is made of, what df's last exchange deals out is written by as many tasks as of's
    bytes ask for, the number of cores at least, rather than by one for each partition, most of which are empty if of is small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    if of is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-plan_bytes(of) // GATHER_BYTES)))
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_panelwright_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="panelwright-code-")) / "panelwright_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join(root.name, f.relative_to(root)))
    sc.addPyFile(str(target))
    sc._panelwright_shipped = True


UNKNOWN = 1 << 60  # bytes; the optimizer's estimate is beyond that for rows that are in no file


def plan_bytes(df: DataFrame) -> int:
    """Size of df as the optimizer estimates it: for a scan, the files' size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int, least: int = 64, most: int = 1 << 22) -> int:
    """How many groups of about bytes_each the rows of df make; 1024 where their size is not known."""
    size = plan_bytes(df)
    return max(least, min(most, -(-size // bytes_each))) if size < UNKNOWN else 1024


DEAL_BYTES = 2 << 20  # of the input for each task that a large exchange deals to
DEAL_MOST = 100_000


def dealt(rows: DataFrame, key: str, like: DataFrame, always: bool = False) -> DataFrame:
    """rows dealt by key to as many tasks as a table of the size of like asks for, where that is known and more than the session's number.

    always keeps the session's number as the least, so that few bytes with much work are not gathered in a task or two.
    """
    size = plan_bytes(like)
    n = min(DEAL_MOST, -(-size // DEAL_BYTES)) if size < UNKNOWN else 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, least), key) if always or n > least else rows


def free_names(columns, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as it takes to be none of columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_number_ids(df: DataFrame, id_col: str) -> None:
    """Refuse ids that are no whole numbers, before any job runs."""
    kind = df.schema[id_col].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
