"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "codeprep", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects.

    On a cluster, pass ``master=None`` and let ``spark-submit`` decide; the
    adaptive settings below are what make the plans hold at scale (runtime
    coalescing, skew-join splitting, size-checked broadcast conversion).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # per-document joins on (doc_id, token) over children already
        # hash-partitioned by doc_id must not re-shuffle both sides by all keys;
        # the partial key is the document, which one task processes anyway
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started:
    once a context, its modules go to the executors with ``addPyFile``."""
    sc = spark.sparkContext
    if getattr(sc, "_codeprep_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="codeprep-"), "codeprep.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._codeprep_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only if none is set.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system path).  Only when nothing is configured – local tests – a
    fresh folder under the system temp directory is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="codeprep-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    For tables used by several later steps (the token table feeds both the
    vocabulary and the [UNK] replacement): lineage is cut, a lost executor
    recomputes nothing, and the copy is compressed and columnar, so later
    steps read only the columns that they use.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_if_narrow(df, key: str):
    """Hash-partition ``df`` (a scan, at most with projections and filters) by
    ``key`` only when it has fewer input splits than the cluster has cores.

    Regex tokenization is the CPU hot spot; a parquet row group cannot be
    split, so a table stored as one small file would be tokenized by one
    task.  On a large table (many splits) nothing is added.
    """
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return partition_by_key(df, key)
    return df


def partition_by_key(df, *cols):
    """Hash-partition by ``cols`` into ``spark.sql.shuffle.partitions`` parts.

    Used before CPU-heavy per-row work (regex tokenization, obfuscation).
    The partition count is explicit on purpose: adaptive execution coalesces
    a by-column repartition by *bytes*, and a small text shuffle would be
    merged into one task although the work after it is CPU-bound.  On a
    cluster, ``spark.sql.shuffle.partitions`` is sized to the cluster.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
