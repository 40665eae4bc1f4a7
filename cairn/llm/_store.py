"""Intermediate tables in the folder that all executors share.

An operator that reads a result twice, or that must cut its lineage, writes it
as Parquet below ``spark.checkpoint.dir``.  Only where that setting is absent
and the session is local, as in tests, is a folder of this machine used; on a
cluster its absence is an error.  The tables stay, since a result may still be
computed from them, until :func:`clear` deletes them.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of one Arrow batch; texts may be long.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI; a local session without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[(\d+|\*)(,.*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        atexit.register(shutil.rmtree, folder[7:], True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they have it on their path."""
    package = Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or _shipped.get("to") == spark.sparkContext.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="cairn-code-")
    atexit.register(shutil.rmtree, folder, True)
    with ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")
    _shipped["to"] = spark.sparkContext.applicationId


_shipped: dict[str, str] = {}


_made: list[str] = []


def made() -> tuple[str, ...]:
    """The folders of all workspaces that are not cleared yet."""
    return tuple(_made)


def clear(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders of all workspaces but ``keep``, once nothing reads from them any more."""
    for path in [p for p in _made if p not in keep]:
        remove(spark, path)
        _made.remove(path)


class Workspace:
    """A folder for one call of an operator.

    Sets three options of the session: the bounds of Arrow batches, which all
    operators on whole texts need for bounded memory, and the removal of shuffle
    files of finished writes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables = 0
        _made.append(self.path)
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        # Shuffle files of a finished write are of no more use.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def save(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back; its lineage ends here."""
        self.tables += 1
        path = f"{self.path}/{name}{self.tables}"
        df.write.option("compression", codec).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._cairn_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that :meth:`save` wrote and nothing reads any more."""
        remove(self.spark, df._cairn_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
