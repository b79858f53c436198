"""Session helpers: a local session for tests and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "histloom") -> SparkSession:
    """A local session for tests and timing runs. On a cluster, pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a written table, in the folder that `spark.checkpoint.dir` names.

    Only a local session without that setting gets a temporary folder, one per application and
    kept here, as Spark takes the setting at its start only; on a cluster a machine-local folder
    would be lost with its machine, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="histloom-")
        root = _FOLDERS[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With this setting, the shuffle files of a query are removed when it ends, not when the driver collects them.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """`df` as a table in the shared folder: computed once, read back as often as needed.

    With `drop_shuffles`, the shuffle files of the computation go when the table is there, for jobs
    of many such steps, whose shuffles would add up on the disks."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_SHUFFLES_GO, None)
    if drop_shuffles:
        spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables that `written` gave and that nothing reads any more.

    Only whole folders inside the session's folder for written tables are removed; a table that
    was derived from a written one and not written itself must not be used afterwards."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        root = scratch_path(spark, "").rpartition("/")[0]
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            inside = path.getParent().equals(
                path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root))
            )
            if inside:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_LOADED: dict[tuple[int, str], DataFrame] = {}


def load_once(spark: SparkSession, name: str, load: Callable[[], DataFrame]) -> DataFrame:
    """The table `name`, loaded and kept in the executors by the first call of this session."""
    key = (id(spark), name)
    if key not in _LOADED:
        _LOADED[key] = load().persist(StorageLevel.MEMORY_AND_DISK)
    return _LOADED[key]


def clear_loaded(spark: SparkSession) -> int:
    """Forget all tables that `load_once` keeps for this session; how many there were."""
    mine = [key for key in _LOADED if key[0] == id(spark)]
    for key in mine:
        _LOADED.pop(key).unpersist()
    return len(mine)
