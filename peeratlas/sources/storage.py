"""Tables and files in the folder that the driver and all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where it is unset on a local master (tests)
    a temporary folder; elsewhere executors would not share it, so that is an error."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        place = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="shared-")
        _OWN[app] = place
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as a shared table and go on from there: lineage ends here,
    so a lost executor costs a reread, not a rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._shared_path = path
    return kept


def checked(table: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A table of short rows marked for broadcast where its counted rows are at most
    most_rows; else left to a join by shuffle."""
    return F.broadcast(table) if table.count() <= most_rows else table


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, path: str | None = None, dealt: bool = False) -> DataFrame:
    """Write the rows once, dealt by key, as a table whose layout Spark knows: joins and sums
    by key read it where it lies, without a shuffle. (Spark makes no use of an order in
    buckets, and the writer's sort by two keys cost more than a round of votes.) Where path holds a
    table that was written to its end (by an earlier run, with as many buckets), it is
    taken as it is. By default a bucket holds what a shuffle partition would. dealt: the rows
    come out of an exchange into these buckets already."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = path or new_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    else:
        rows = df if dealt else df.repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    kept = spark.table(table)
    kept._shared_path, kept._shared_table = path, table
    return kept


def buckets_for(rows: int, each: int = 500_000) -> int:
    """Buckets for a table of so many short rows: as many as the session's shuffles have
    partitions, fewer (a core's one at least) where a bucket would hold less than each rows:
    a task a bucket writes a block for every partition of the next shuffle, however small."""
    spark = SparkSession.active()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // each)))


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by cut() or bucketed() that no later step reads."""
    table = getattr(df, "_shared_table", None)
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
