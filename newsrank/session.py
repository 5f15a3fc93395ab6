"""Session helpers shared by the jobs."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made inside the open ``tidy`` blocks of each thread.
_open: dict[int, list[list[str]]] = {}


def build_session(app: str = "newsrank", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder; inside ``tidy`` it is dropped at the end."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if blocks := _open.get(threading.get_ident()):
        blocks[-1].append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidy(spark: SparkSession):
    """Drops the folders that were made inside the block when it ends."""
    blocks = _open.setdefault(threading.get_ident(), [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            drop_folder(spark, path)


def settled(fn):
    """A step whose result is written to the shared folder, after which its working folders are dropped."""
    @functools.wraps(fn)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        path = new_folder(df.sparkSession, "out")
        with tidy(df.sparkSession):
            return cut_lineage(fn(df, *args, **options), path)

    return run


#: Frees what a write has shuffled when the write ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to a Python worker together; both sides hold several such batches for each task.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; what the write shuffled is freed.

    A lost executor then never replays a loop, and the plan of the next round starts at a plain scan.
    (A checkpointed frame keeps the constraints of the plan it came from; in loops of joins they grow
    with every round.)
    """
    spark = df.sparkSession
    path = path or new_folder(spark, "cut")
    held = {key: spark.conf.get(key) for key in (SHUFFLE_CLEANUP, BATCH_BYTES[0])}
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    spark.conf.set(*BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
