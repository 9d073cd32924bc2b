"""What the corpus operators share: reading, cutting lineage, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but these: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage gone.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is
    unset (tests in local mode) is a temporary one made. Nothing reads the shuffle
    files of a written checkpoint again, so Spark is told to drop them at once.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


class Scratch:
    """Tables in the shared folder that go when they are dropped, or all at the end of a ``with`` block.

    Unlike a checkpoint a table has its true size, so that in a loop of joins the
    planner's estimates don't multiply from round to round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back."""
        before, path = self.spark.conf.get(DROP_SHUFFLES, "false"), f"{self.folder}/{uuid.uuid4().hex}"
        self.spark.conf.set(DROP_SHUFFLES, "true")
        try:
            df.select("*").write.parquet(path)
        finally:
            self.spark.conf.set(DROP_SHUFFLES, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            remove(self.spark, self.paths.pop(id(table))[1])

    def __exit__(self, *error) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the store that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(keys: DataFrame, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``keys`` with a dense position from 0 in the given total order.

    Range partitions are numbered on their own and shifted by the sizes of those
    before, so no task sees more than a partition; the only table that meets in
    one task has a row for each partition.
    """
    spark = keys.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(keys.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        spread.withColumn("_within", within)
        .join(F.broadcast(before), "_part")  # a row for each partition
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_part", "_before", "_within")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_hashes(*columns: str) -> list[Column]:
    """128 bits that tell rows apart by these columns, as two longs; a null is told from an empty value."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(k), *parts) for k in (21, 22)]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; on a cluster it names a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()
