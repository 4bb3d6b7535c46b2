"""Session defaults and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packetflow")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; fall back to a local folder only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="packetflow-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: computed once, safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a loop, written into the shared checkpoint folder and removed at the end of the with block.

    A checkpoint keeps the size its plan estimated, and estimates of joins multiply: after some twenty rounds they have more
    digits than a round takes to compute. A written table has the size it has.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.n, self._paths = spark, 0, {}
        self.root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, *over: DataFrame) -> DataFrame:
        """df as a written table. Its shuffle files go as soon as it is written, and so do the kept tables that are over."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(self._CLEANUP, None)
        self.spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.option("compression", "lz4_raw").parquet(path)
        finally:
            self.spark.conf.set(self._CLEANUP, before) if before is not None else self.spark.conf.unset(self._CLEANUP)
        for x in over:
            self._delete(self._paths.pop(id(x))[0])
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = path, kept
        return kept

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.root)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitions in a number that adaptive execution keeps: for stages that are small in bytes but heavy in work."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, where their Python path may not have it."""
    context = spark.sparkContext
    if getattr(context, "_packetflow_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="packetflow-package-")  # on the driver, which serves the file for as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "packetflow.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"packetflow/{path.relative_to(root)}")
    context.addPyFile(archive)
    context._packetflow_shipped = True
