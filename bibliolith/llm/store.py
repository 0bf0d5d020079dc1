"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_with_the_driver, shared_folder

class Scratch:
    """Parquet tables that cut lineage.  They survive the loss of executors, unlike cached blocks.

    A table is deleted by ``drop``, as soon as nothing reads it, and what a result still reads when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/bibliolith-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, free: bool = False) -> DataFrame:
        """``df`` as a written table.  ``free``: the shuffles behind it are large, and their files are to go at once.

        Spark deletes the files of a shuffle when the driver's garbage collection finds that no plan refers to it, which
        otherwise happens every half an hour.  The last references go with the events of the write, a moment later.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        if self.count == 1:
            delete_with_the_driver(self.spark, self.root)
        df.write.option("compression", "zstd").parquet(path)
        if free:
            time.sleep(1)
            self.spark._jvm.System.gc()
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def write_buckets(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """``df`` as a written table whose files are dealt by ``column``: grouping by it doesn't move the rows again.

        The catalog only names the table while it is read; its files stay in the shared folder."""
        self.count += 1
        if self.count == 1:
            delete_with_the_driver(self.spark, self.root)
        path, name = f"{self.root}/{self.count}", f"scratch_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
        back = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        self.paths[id(back)] = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if path := self.paths.pop(id(df), None):
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
