"""Shared folders: where operators put tables that executors and driver must both see.

`spark.checkpoint.dir` names the folder on a cluster.  It is read from the
session; where it is unset a local folder is used, but only if Spark itself
runs on this machine alone.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash; a path without a scheme is of Hadoop's default file system."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_FOLDER
    if not re.match(r"[A-Za-z][\w+.-]*:", folder):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", folder).rstrip("/")


def fresh(stem: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    name, k = stem, 0
    while name.lower() in taken:
        name, k = f"{stem}{k}", k + 1
    return name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/stratalog/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and return the written table.

    This cuts the lineage and survives lost executors: the table has the
    durability of the shared folder, not of an executor's disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that may be broadcast: 8 or 16 bytes each, so 32 MB before hashing.
BROADCAST_IDS = 2_000_000
#: Rows and bytes handed to Python at a time where the session names no number; Spark's defaults suit short rows, not texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "33554432"}


_shipped: set[str] = set()


def python_ready(spark: SparkSession) -> None:
    """What operators that run Python need of a session, once each.

    The package goes to the executors, whose Python may not have it on its
    path, and Arrow batches become smaller, by rows and by bytes, unless the
    session says how large they are.
    """
    app = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parent.parent
    if app not in _shipped and package.is_dir():  # a package inside an archive was shipped already
        _shipped.add(app)
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
    own = spark._jsparkSession.sessionState().conf()
    for name, value in BATCHES.items():
        if not own.contains(name):  # what the user set stays
            spark.conf.set(name, value)


def drop_rows(df: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of `df` whose keys are not a row of `gone`, with all their columns; nulls are equal.

    The rows of `gone` are counted; up to `BROADCAST_IDS` they are broadcast
    and `df` is not shuffled, beyond that both sides are.
    """
    names = [fresh(f"_gone{k}_", df) for k in range(len(keys))]
    gone = materialise(gone.toDF(*names).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    test = keys[0].eqNullSafe(F.col(names[0]))
    for key, name in zip(keys[1:], names[1:]):
        test = test & key.eqNullSafe(F.col(name))
    return df.join(gone, test, "left_anti")


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `df` whose id is not in the one column of `ids`."""
    return drop_rows(df, ids, [F.col(id_col).cast("long")])


def clear(spark: SparkSession) -> None:
    """Delete the tables that operators left in the shared folder.

    Results are lazy and read them, so this is for after the results were written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stratalog")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
