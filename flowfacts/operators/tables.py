"""Tables written to the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A model or delta side is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; set here only where it is unset, on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowfacts-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a written table, in folders by a column if asked: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowfacts/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowfacts_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_flowfacts_path", None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows up to which Spark may send a side of a join to all tasks, by way of the driver, and join small tasks, by their bytes.
SENT_ROWS = 20_000
#: Rows of wide tables (a row may hold some arrays) that one task joins or gathers, about.
WIDE_ROWS = 100_000
#: Rows of narrow tables (a row is a few numbers or digests) for which a further task is worth its start, about.
TASK_ROWS = 20_000


def _tasks(df: DataFrame, rows: int, narrow: bool) -> int:
    """Tasks for so many rows: all shuffle partitions at least, of narrow tables one for TASK_ROWS up to these; so rounds over
    tables that shrink do not start all partitions for little."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(least, -(-rows // TASK_ROWS)) if narrow else least, -(-rows // WIDE_ROWS))


def dealt(df: DataFrame, rows: int, *by: str, narrow: bool = False) -> DataFrame:
    """df dealt over tasks by so many counted rows, if these are not few: Spark goes by bytes of files and exchanges, and packed
    numbers and repeated arrays are many times as large in memory."""
    if rows <= SENT_ROWS:
        return df
    return df.repartition(_tasks(df, rows, narrow), *by)


def joined(left: DataFrame, right: DataFrame, rows: int, on: list[str], how: str = "inner", narrow: bool = False) -> DataFrame:
    """The join of two tables on columns, both dealt over tasks and neither sent whole, if so many counted rows are not few.
    narrow: both are narrow, and right has no key twice if its other columns are read. Spark raises the tasks of a join of two
    exchanges to all shuffle partitions; so a narrow right is grouped by its keys behind its exchange, where this changes nothing."""
    if rows <= SENT_ROWS:
        return left.join(right, on, how)
    near = dealt(right.select(*on) if how in ("left_semi", "left_anti") else right, rows, *on, narrow=narrow)
    if _tasks(right, rows, narrow) < _tasks(right, rows, False):
        others = [c for c in near.columns if c not in on]
        near = near.groupBy(*on).agg(*[F.first(c).alias(c) for c in others]) if others else near.distinct()
    return dealt(left, rows, *on, narrow=narrow).join(near.hint("merge"), on, how)
