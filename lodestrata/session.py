"""Session helpers: defaults for local runs and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lodestrata") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset and the session is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a lost executor costs no recomputation of its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def numbered(df: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in ``order``, without gathering rows in one task."""
    from pyspark.sql import functions as F

    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    offsets, at = [], start
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row a partition
        offsets.append((r["_part"], at))
        at += r["n"]
    begins = df.sparkSession.createDataFrame(offsets, "_part int, _begin long")
    return placed.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")  # one row a partition


class Folder:
    """A folder on any file system that Spark reads, by the JVM's Hadoop client."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole under a name that nobody has yet; false if it exists."""
        import uuid

        part = f".{uuid.uuid4().hex}.new"
        stream = self._fs.create(self._at(part), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        try:
            if self.exists(name):
                return False
            self._fs.mkdirs(self._at(name).getParent())
            context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            qualified = [self._fs.makeQualified(self._at(n)) for n in (part, name)]
            try:
                context.rename(*qualified, options)
            except Exception:
                if self.exists(name):  # another writer was first
                    return False
                raise
            return True
        finally:
            self.delete(part)
