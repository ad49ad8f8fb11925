"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Timestamps in the data have no zone (TIMESTAMP_NTZ);
# a UTC session zone keeps NTZ <-> TIMESTAMP casts neutral.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # Static planning broadcasts only what its file-size estimate puts under 1 MB (small
    # dimensions); anything else is planned as a shuffle join and AQE switches it to a
    # broadcast only when the *measured* shuffle output is under 16 MB.  Facts are never
    # broadcast on an optimistic estimate.
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
}


def build_session(
    master: str | None = None,
    app_name: str = "emporion",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the library expects.

    On a cluster, leave ``master`` unset and let spark-submit decide; size
    ``shuffle_partitions`` so one shuffle partition stays around 128-256 MB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system every executor can reach).
    Only when it is unset — local runs and tests — a private folder is created.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = None
    try:  # classic sessions expose the context's checkpoint folder as well
        jsc = spark.sparkContext._jsc.sc()
        if not root and jsc.getCheckpointDir().isDefined():
            root = jsc.getCheckpointDir().get()
    except Exception:  # e.g. a Spark Connect session: only the conf is visible
        jsc = None
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                "(HDFS, S3, ...) that every executor can reach"
            )
        root = tempfile.mkdtemp(prefix="emporion-ckpt-")  # local runs and tests only
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:
            pass
    if jsc is not None and not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root."""
    root = checkpoint_root(spark)
    sep = "" if root.endswith("/") else "/"
    path = f"{root}{sep}{name}-{uuid.uuid4().hex[:12]}"  # the writer creates it
    spark.__dict__.setdefault("_emporion_folders", []).append(path)
    return path


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as Parquet under the shared checkpoint folder and
    reading it back.  One job computes the data (a reliable ``checkpoint()`` computes it a
    second time to write its files unless it was persisted), and the read-back plan has real
    file statistics.  Executors lost later recompute nothing: the files are on shared
    storage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # known schema: no footer job
    out._emporion_scratch = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder (Hadoop FileSystem API, so it works on HDFS / object stores as on
    local disks)."""
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # no JVM handle (e.g. Spark Connect): leave it to retention
        pass


def drop_all_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder of this session, once none of its results is read any more
    (results are lazy: only their reader knows when).  How many there were."""
    folders = spark.__dict__.pop("_emporion_folders", [])
    for path in folders:
        drop_folder(spark, path)
    return len(folders)


def drop_scratch(df) -> None:
    """Delete the folder behind a :func:`materialize`d DataFrame once nothing reads it."""
    path = getattr(df, "_emporion_scratch", None)
    if path:
        drop_folder(df.sparkSession, path)
