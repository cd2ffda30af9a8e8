"""Session helpers: table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def _own_folder() -> str:
    """A folder of this driver process, removed at its end (for what the driver serves, never for shared data)."""
    made = tempfile.mkdtemp(prefix="grovework-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    made = Path(_own_folder()) / "grovework.zip"
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(made))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting (tests) gets a folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder would not survive the loss of its machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = _own_folder()
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def _app_folder(spark: SparkSession) -> str:
    """The application's folder for cuts; it is deleted when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/grovework/{sc.applicationId}"
    if folder not in _folders:
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _folders.add(folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: a lineage cut any executor can re-read."""
    spark = df.sparkSession
    path = f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._grovework_path = path
    return back


def release(*cuts: DataFrame) -> None:
    """Delete the files of superseded ``cut`` results (nothing may read them afterwards)."""
    for df in cuts:
        path = getattr(df, "_grovework_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current_rows(df: DataFrame, keys: list[str], columns: list[str], order: str = "indexed_at") -> DataFrame:
    """Of each key the row with the greatest ``order``; an aggregate combined before the shuffle.

    Only fixed-width columns are hashed in place; texts and arrays make it a sort by key on both sides of the shuffle.
    Rows with a null key are dropped. A null ``order`` is older than any value. Among rows equal in ``order``
    the greatest by ``columns`` wins (nulls are smallest), so the result does not depend on row order.
    """
    newest = F.max(F.struct(order, *columns)).alias("_newest")
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in columns])
