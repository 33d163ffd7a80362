"""Session settings and the few helpers that every plan shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch that is made for a Python worker.
ARROW_BYTES = 4 << 20
#: Folder that holds the package; Python workers need it on their path.
ROOT = str(Path(__file__).resolve().parent.parent)


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName("quakeloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers of a running session import this package from its folder; times are UTC, and rows go to
    Python workers a few megabytes at a time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *known]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors see: spark.checkpoint.dir.

    Only a local session that names none (a test) gets a temporary one; on a cluster, where executors
    wouldn't see it, that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quakeloom-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


#: Tables that `cut` has written and `drop_cuts` not yet deleted, by application; and those that `reused` keeps.
_CUTS: dict[str, list[str]] = {}
_REUSED: dict[tuple, DataFrame] = {}
#: Spark's setting that deletes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it from there, so that lost executors can't take it along.

    A written table has a size of its own; a checkpoint would keep the estimate of its plan, which grows without bound
    from join to join. The table stays until `drop_cuts`, or until the process ends. What its plan has shuffled goes as
    soon as it is written: nothing else reads that, and it would lie on the disks until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not _CUTS:
        atexit.register(_drop_at_exit)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that plans of this session have written so far. Results that haven't been read or written yet need theirs."""
    context = spark.sparkContext
    for path in _CUTS.pop(context.applicationId, []):
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    for key in [k for k in _REUSED if k[0] == context.applicationId]:
        del _REUSED[key]


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_cuts(spark)


def reused(name: str, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` made from the files of `source`, cut when it is first asked for in a session.

    It is made anew once any of the files has another path, size or time.
    """
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    key = (source.sparkSession.sparkContext.applicationId, name, *state)
    if key not in _REUSED:
        _REUSED[key] = cut(make())
    return _REUSED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
