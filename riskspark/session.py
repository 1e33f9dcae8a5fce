"""Session construction and staged tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


_staged: dict = {}  # session -> paths written inside `staged_tables`


def local_session(cores="*", app="riskspark", shuffle_partitions=8, memory="8g"):
    """A session for tests and benchmarks; on a cluster use the given one."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the session names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="riskspark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage, so several passes cost one computation, later passes read
    only the columns they need, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _staged.get(spark) is not None:
        _staged[spark].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the folder of a staged frame that nothing reads any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Partitions of training rows, at least, and rows in one above that.
TRAIN_PARTITIONS, TRAIN_ROWS = 8, 100_000


def arranged(df: DataFrame, key="LoanID") -> DataFrame:
    """Training rows by a hash of their id, in order inside a partition.

    Forests and boosting draw per partition, so the layout must depend on the
    rows alone, never on the number of cores.
    """
    parts = max(TRAIN_PARTITIONS, -(-df.count() // TRAIN_ROWS))
    return df.repartition(parts, key).sortWithinPartitions(key)


def kept(df: DataFrame) -> DataFrame:
    """Training rows in the executors' disk stores, with their layout.

    Fits keep their own rows in memory; these would take it from them.
    """
    return df.persist(StorageLevel.DISK_ONLY)


@contextmanager
def staged_tables(spark: SparkSession):
    """Removes the tables staged inside the block when it ends."""
    outer, own = _staged.get(spark), []
    _staged[spark] = own
    try:
        yield
    finally:
        _staged[spark] = outer
        for path in own:
            _delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """Small data over all cores, for a table that much work will follow on.

    Takes a frame without shuffles, whose partitions are file splits. One with
    enough of them stays as it is, so large data is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
