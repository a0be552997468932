"""Session helpers that every subpackage may use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that setting
    is absent on a local master (tests, a laptop) a temporary folder of our own
    is set. A cluster without the setting is an error: its machines share no
    temporary folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    Lineage ends there, so a lost executor costs a re-read and not a re-run.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, lie: bool = False) -> DataFrame:
    """As :func:`cut`, but as Parquet: smaller, and columns not asked for are not read.

    The folder goes when the application ends. ``lie``: rows of
    :func:`stored_by` tables are joined as they lie, also by further keys.
    """
    return _written(df, lie)[0]


@contextmanager
def _shuffles_go(spark: SparkSession, lie: bool = False) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: else those of all steps stay until the driver happens to collect its garbage.

    ``lie``: a join by several keys takes rows that lie together by one of them as they lie.
    """
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.requireAllClusterKeysForCoPartition": "false"} if lie else {})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written(df: DataFrame, lie: bool = False) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_go(spark, lie):
        df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


#: A table of a run's rows with more bytes than this is joined by shuffles: a few MB of files are hundreds of MB as a hash table.
_BROADCAST_BYTES = 1_000_000


def _shuffled(df: DataFrame, path: str, most: int) -> DataFrame:
    """Spark takes the bytes of files for those of rows, so it would collect millions of rows that compress well at the driver, to broadcast them."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return df.hint("merge") if size > most else df


def stored_rows(df: DataFrame, most: int = _BROADCAST_BYTES) -> DataFrame:
    """As :func:`stored`, for rows of a run rather than of a model.

    A table of more than ``most`` bytes asks for merge joins; sides that a
    model bounds must say ``F.broadcast``.
    """
    return _shuffled(*_written(df), most)


def stored_by(df: DataFrame, key: str, n: int | None, dealt: bool = False, most: int = _BROADCAST_BYTES) -> DataFrame:
    """As :func:`stored_rows`, in ``n`` buckets of ``key``: what is grouped or joined by it afterwards is not shuffled again.

    ``dealt``: ``df`` comes from tables in as many buckets of this key, so its
    rows lie as they shall. Without ``n`` there are no buckets.
    """
    if n is None:
        return stored_rows(df, most)
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path, at = f"{shared_dir(spark)}/{name}", f"spark_catalog.default.{name}"
    rows = df if dealt else df.repartition(n, key)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    # made first and filled then: a table made by its query would keep the query's shuffles
    spark.sql(f"CREATE TABLE {at} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}'")
    with _shuffles_go(spark, lie=True):
        rows.write.insertInto(at)
    out = spark.table(at)
    spark.sql(f"DROP TABLE {at}")  # the catalog's entry; the files are ours
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return _shuffled(out, path, most)


def buckets(spark: SparkSession, rows: int, most: int = 500_000) -> int:
    """For :func:`stored_by`: some ``most`` rows in each, and work for all cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def table_rows(spark: SparkSession, sf_dir: str, name: str, most: int = _BROADCAST_BYTES) -> DataFrame:
    """As :func:`table`, for one that grows with the run: beyond ``most`` bytes it is not broadcast."""
    return _shuffled(table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet", most)


def together(df: DataFrame, key: str, rows: int, most: int = 500_000) -> DataFrame:
    """``df`` dealt out by ``key``, some ``most`` of its ``rows`` to a task.

    Spark lays small partitions together by their compressed bytes; narrow rows
    compress so well that a task would get millions of them. A number that is
    said holds.
    """
    spark = df.sparkSession
    if rows <= most * spark.sparkContext.defaultParallelism:
        return df.repartition(key)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), key)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Delete the files of :func:`stored` tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts can be long: let Arrow hand a Python worker at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
