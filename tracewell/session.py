"""Session settings and the shared folder that stage tables are written to.

Stages replace long lineages: a stage is an ordinary Parquet table in the folder the cluster names in
``spark.checkpoint.dir``, so losing an executor never costs more than the work since the last stage. A stage also
gives the optimizer real file sizes, which is what decides whether a later join may broadcast.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHARED: dict[str, str] = {}
_MEMO: dict[tuple, DataFrame] = {}
_RECORDERS: list[list[str]] = []

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # hot addresses are split even when the join feeds an aggregation on the same key
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "tracewell", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every job here relies on (UTC time, AQE with skew splitting)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A fresh local one only in local mode: elsewhere executors would not share it."""
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tracewell-")
        _SHARED[app] = f"{root.rstrip('/')}/tracewell-{app}"
    return _SHARED[app]


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    With ``by`` the rows are bucketed by that column, into as many buckets as a shuffle has partitions: joins and groupings on
    it then move no row of the table. Keys should be bounded groups, since a bucket is read by one task.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:12]
    path = f"{shared_dir(spark)}/{label}-{mark}"
    if by is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        name = f"stage_{mark}"
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
        out = spark.table(name)
    for paths in _RECORDERS:
        paths.append(path)
    out._tracewell_stage = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a stage table that no later plan reads (older rounds of an iteration)."""
    path = getattr(df, "_tracewell_stage", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths that stage() writes (and note() names) meanwhile, for an owner who deletes them when nothing reads them any more."""
    paths: list[str] = []
    _RECORDERS.append(paths)
    try:
        yield paths
    finally:
        _RECORDERS[:] = [p for p in _RECORDERS if p is not paths]


def note(path: str) -> None:
    """Let recorders know of a folder that something else than stage() writes."""
    for paths in _RECORDERS:
        paths.append(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded folders and let both sides collect, so that Spark's cleaner deletes the shuffle files of dropped plans."""
    while paths:
        delete(spark, paths.pop())
    gc.collect()
    spark._jvm.System.gc()


def memo_stage(spark: SparkSession, key: tuple, label: str, build, by: str | None = None) -> DataFrame:
    """Stage a table once per application and reuse it."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _MEMO:
        _MEMO[full] = stage(build(), label, by)
    return _MEMO[full]


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
