"""Written tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesift.session import new_output

_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one job; `close` deletes those that its result does not read.

    `keep` marks the tables that the returned DataFrame still reads; they stay in the shared
    folder, whose owner clears it with the application. With `tidy` the shuffle files of a table's
    job go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, job: str, tidy: bool = False):
        self.spark = spark
        self.job = job
        self.tidy = tidy
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = new_output(self.spark, f"{self.job}-{name}")
        before = self.spark.conf.get(_CLEANUP_KEY, "false")
        if self.tidy:
            self.spark.conf.set(_CLEANUP_KEY, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(_CLEANUP_KEY, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                self._delete(path)

    def close(self, *keep: DataFrame) -> None:
        kept = {getattr(table, "_scratch_path", None) for table in keep}
        for key, path in list(self.paths.items()):
            if path not in kept:
                self._delete(path)
            self.paths.pop(key)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, which stay until the driver happens
        to collect its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
