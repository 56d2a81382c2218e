"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import getpass
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # explicit broadcasts are guarded by size checks (see operators.joins);
    # keep Spark's own threshold at its default 10 MB
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # the feature plans are wide (hundreds of columns): keep the driver from
    # retaining thousands of full plan descriptions across a long session
    "spark.sql.ui.retainedExecutions": "50",
    "spark.sql.maxPlanStringLength": str(256 * 1024),
}


# Cluster sizing (applied when running under spark-submit, i.e. no master
# given): ~256 MB scan splits and post-shuffle partitions, a high initial
# shuffle width that AQE coalesces, and skew splitting for hot keys.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.shuffle.partitions": "4000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "hazecast", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine defaults.

    On a cluster ``master`` is left to spark-submit; local runs pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false")
    conf = dict(DEFAULT_CONF)
    if not master:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # session-level settings also apply when the session already existed
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset and gets a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="hazecast-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def model_folder(spark: SparkSession) -> str:
    """Where fitted models are kept from process to process: beside the working
    folders in the shared folder the session names; where a local session names
    none, a folder of the user's."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local"):
        return f"{ensure_checkpoint_dir(spark).rstrip('/')}/hazecast/models"
    return f"file:{tempfile.gettempdir()}/hazecast-models-{getpass.getuser()}"


_MADE: list[tuple] = []          # (store, path) of this process's working folders


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables
    and streaming checkpoints, made in whatever store that folder is in.  It
    serves the queries of this process and is removed when that ends."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/hazecast/{name}-{uuid.uuid4().hex[:12]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    if not _MADE:
        atexit.register(remove_working_folders)
    _MADE.append((store, place))
    return path


def remove_working_folders() -> None:
    """Delete the folders that ``shared_dir`` made in this process."""
    while _MADE:
        store, place = _MADE.pop()
        try:
            store.delete(place, True)
        except Exception:       # the JVM is gone or the store is: nothing more to do at exit
            return


def file_stamp(spark: SparkSession, path: str) -> str:
    """What tells a version of an input from another: length and modification
    time of the file, or of the files of a folder, in whatever store it is in
    (empty: there is none)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return ""
    files = fs.listStatus(place)
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


class SharedFolder:
    """A folder of whatever store Hadoop reads, with the few steps that are
    atomic there: making a new file and renaming."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        place = self.at(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def claim(self, name: str) -> bool:
        """Make an empty file; false if it is there already."""
        self._fs.mkdirs(self.at(name).getParent())
        try:
            return self._fs.createNewFile(self.at(name))
        except Py4JJavaError:           # stores that raise where others say false
            return False

    def write_once(self, name: str, text: str) -> bool:
        """Make a file with this text, whole or not at all; false if there is
        one of that name already."""
        aside = f"_writing-{uuid.uuid4().hex}"
        out = self._fs.create(self.at(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.has(name) or not self.rename(aside, name):
            self._fs.delete(self.at(aside), False)
            return False
        return True

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> bool:
        self._fs.mkdirs(self.at(new).getParent())
        return self._fs.rename(self.at(old), self.at(new))
