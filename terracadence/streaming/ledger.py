"""Content-addressed increments (S-22, X-04): what was taken once is not taken again, however often it is delivered or a batch is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the named values as JSON, names in order, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


class Ledger:
    """A table of increments in a folder: rows in data/batch=N, the hashes of batch N in ledger/batch=N.

    A batch first writes its new rows, then its hashes; the hashes are what makes it count. Each of the two replaces what
    an earlier try of the same batch left, and rows are new if no other batch holds their hash, so a batch that is run
    again, whether it died before, between or after the two writes, gives the same table. Readers see the batches that
    have hashes.
    """

    def __init__(self, folder: str, schema: str, columns: list[str] | None = None):
        """schema: the rows'; columns: those that make up the content, all if None."""
        self.folder, self.schema, self.columns = folder, schema, columns

    def _part(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _known(self, spark: SparkSession) -> DataFrame:
        self._ready(spark)
        return spark.read.schema("hash string, batch long").parquet(f"{self.folder}/ledger")

    def _ready(self, spark: SparkSession) -> None:
        """Folders of a first run."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for kind in ("data", "ledger"):
            store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch that no other batch has, each content once. Fits foreachBatch."""
        spark = rows.sparkSession
        taken = self._known(spark).where(F.col("batch") != batch).select("hash")
        fresh = rows.withColumn("hash", content_hash(self.columns or rows.columns)).dropDuplicates(["hash"]).join(taken, "hash", "left_anti")
        fresh.write.mode("overwrite").parquet(self._part("data", batch))
        written = spark.read.schema(f"hash string, {self.schema}").parquet(self._part("data", batch))
        written.select("hash").write.mode("overwrite").parquet(self._part("ledger", batch))

    def batches(self, spark: SparkSession) -> DataFrame:
        """The batches that count."""
        return self._known(spark).select("batch").distinct()

    def table(self, spark: SparkSession, keep_batch: bool = False) -> DataFrame:
        """All rows that count."""
        counted = self.batches(spark)
        rows = spark.read.schema(f"hash string, {self.schema}, batch long").parquet(f"{self.folder}/data")
        return rows.join(F.broadcast(counted), "batch", "left_semi").drop("hash", *([] if keep_batch else ["batch"]))  # a row a batch

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start taking a stream; with all that is there for now when it is awaited."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(requests: DataFrame, producer: Callable[[DataFrame], DataFrame], folder: str, key: list[str], schema: str) -> DataFrame:
    """S-22: an answer for each request, asking the producer only for those that no earlier call answered.

    Answers lie under the SHA-256 of their request's key. producer: a table of requests -> their answers, key columns
    first; schema: the answers'. Returns the answers with cached (whether they were there before). Requests that repeat
    are asked once; what the producer does not answer has no row, and is asked again next time. A call that dies leaves
    no answers or all of them.
    """
    spark = requests.sparkSession
    ledger = Ledger(folder, schema, key)
    wanted = requests.select(*key).distinct()
    batch = (ledger.batches(spark).agg(F.max("batch")).first()[0] or 0) + 1
    missing = wanted.join(ledger.table(spark).select(*key), key, "left_anti")
    if not missing.isEmpty():
        ledger.add(producer(missing), batch)
    return ledger.table(spark, keep_batch=True).join(wanted, key, "left_semi").withColumn("cached", F.col("batch") < batch).drop("batch")
