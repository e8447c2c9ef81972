"""Session helpers: reading tables, partition counts and durable intermediate tables.

Intermediate results that are read more than once, or whose physical layout must not
change between two reads, are written as Parquet into the shared folder named by
``spark.checkpoint.dir``. Such tables survive the loss of any executor and cut the
lineage. They are removed when the interpreter ends or by :func:`release`.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each context.

    Workers get the package's folder on their path; beyond one machine they also get the
    package itself as a zip file.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cairnlake_ready", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not sc.master.startswith("local["):
        path = os.path.join(tempfile.mkdtemp(), "cairnlake.zip")  # read by the driver only, which hands it out
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
    sc._cairnlake_ready = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTES_PER_PARTITION = 256 << 20
MOST_PARTITIONS = 200_000


def partitions(df: DataFrame) -> int:
    """Partition count of an explicit range exchange of ``df``.

    At least the session's shuffle setting, and enough for about 256 MB of scanned files
    a partition. The count is bounded, since one row a partition may come to the driver.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = sum(n for n in sizes if n < 2**60)  # others are rows of unknown size, not files
    return max(1, least, min(MOST_PARTITIONS, known // BYTES_PER_PARTITION))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its scan has splits for half of them at most; otherwise as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores
    return df.repartition(cores) if few else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the
    session runs inside one machine (``local[...]``, as in tests) a temporary folder is
    used; on a cluster without the setting this raises ``RuntimeError``.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    found = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session's application."""
    try:
        for path in _written.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception:  # the session may have ended
        return


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, deleted with the intermediate tables."""
    prepare(spark)
    path = f"{shared_dir(spark)}/cairnlake/{tag}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(release, spark)
    _written[app].append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and return the written table."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, shuffle: int = 8, memory: str = "4g", name: str = "cairnlake") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark
