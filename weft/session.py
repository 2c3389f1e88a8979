"""Session helpers: builder defaults, table access and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "weft", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame) -> int:
    """The splits of a plan without shuffles, or the number of cores if that is more."""
    return max(df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().toRdd().getNumPartitions())


def spread(df: DataFrame) -> DataFrame:
    """df, a plan without shuffles, over all cores if its files come in fewer splits than there are
    cores, for steps whose work per row is heavy; larger inputs have more splits and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


@contextmanager
def sized(spark: SparkSession, rows: int, per: int = 100_000) -> Iterator[None]:
    """Shuffles of eager steps over `rows` short rows in as many partitions as they need, at least one for
    each core and never more than the session's setting: many tiny ones cost more than the rows."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), max(spark.sparkContext.defaultParallelism, -(-rows // per))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names in spark.checkpoint.dir,
    else one already set, else (tests on one machine only) a temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


_CUT: set[tuple[str, str]] = set()


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read back: its lineage ends
    there, any executor can read it, and it is compressed, unlike checkpoint()'s files."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUT.add((df.sparkSession.sparkContext.applicationId, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


_KEPT: dict = {}


def kept(spark: SparkSession, directory: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The derived table `name` of a data directory, written once by cut and read by all later queries
    of the session; written anew if a file of the directory has changed."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(directory)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in where.getFileSystem(conf).listStatus(where)))
    key = (spark.sparkContext.applicationId, directory, name)
    if key in _KEPT and _KEPT[key][0] == state:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT[key][1]._weft_path)
        if path.getFileSystem(conf).exists(path):
            return _KEPT[key][1]
    _KEPT[key] = (state, cut(make()))
    return _KEPT[key][1]


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _CUT.discard((spark.sparkContext.applicationId, path))


def release(df: DataFrame) -> None:
    """Removes the table behind a cut that is no longer needed, and lets the driver notice the
    shuffles that went before it, which otherwise stay on disk until its next collection."""
    path = getattr(df, "_weft_path", None)
    if path:
        _remove(df.sparkSession, path)
        gc.collect()
        df.sparkSession._jvm.System.gc()


def release_all(spark: SparkSession) -> int:
    """Removes every table that cuts of this session have left, once their results are written; how many there were."""
    own = [p for a, p in _CUT if a == spark.sparkContext.applicationId]
    for path in own:
        _remove(spark, path)
    return len(own)
