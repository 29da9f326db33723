"""Session helpers: a tuned local session and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dossier")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Root folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster the setting is required, because a machine-local folder is lost with
    its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="dossier-")
    context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold about ``BATCH_BYTES`` at most; a smaller bound stays.

    A task holds a batch of whole texts several times, in the JVM and in Python, and the
    default lets it grow to 10,000 rows or 64 MB. What a batch holds never changes a result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created until written."""
    return f"{shared_folder(spark)}/dossier-{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Cut lineage through the shared folder, reliably (survives lost executors)."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` on any Hadoop file system."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file, True for exactly one of all callers that ask for the same path.

    Rests on the file system's atomic create: HDFS and local disks have it; an
    object store needs a connector that refuses to overwrite on create.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    try:
        if target.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":
            # Hadoop's local file system looks first and creates then; the operating system does both at once.
            plain = jvm.java.io.File(target.toUri().getPath()).toPath()
            none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            jvm.java.nio.file.Files.createFile(plain, none)
        else:
            fs.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path`` on any Hadoop file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isFile())


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in its place; one that is there already goes."""
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True)
    if not fs.rename(old, new):
        raise RuntimeError(f"{source} cannot be moved to {target}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on any Hadoop file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rename_suffix(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give the files of a folder another suffix, one by one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.endswith(old):
            fs.rename(status.getPath(), path(f"{folder}/{name.removesuffix(old)}{new}"))
