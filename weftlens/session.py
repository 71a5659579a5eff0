"""Session settings that the operators expect, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "weftlens", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only where it is unset (tests) a local one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftlens-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; ``release`` removes the shuffle files that it took, which else stay until the driver collects its garbage."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if release:
        release_shuffles(df)
    return kept


def release_shuffles(df: DataFrame) -> None:
    """Removes the shuffle files of ``df``, which was computed and won't be again."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    seen, todo = set(), [df._jdf.queryExecution().toRdd()]
    while cleaner.isDefined() and todo:
        dependencies = todo.pop().dependencies()
        for dependency in (dependencies.apply(i) for i in range(dependencies.size())):
            if dependency.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(dependency.shuffleId(), True)
            if dependency.rdd().id() not in seen:
                seen.add(dependency.rdd().id())
                todo.append(dependency.rdd())


def default_parallelism(spark: SparkSession) -> int:
    return max(int(os.environ.get("WEFTLENS_MIN_PARTITIONS", "0")), spark.sparkContext.defaultParallelism)
