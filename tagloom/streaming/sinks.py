"""A sink that writes every micro-batch exactly once, into several tables at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Ledger:
    """Tables below a folder that grow by numbered batches.

    A batch writes its rows to folders of its own and then creates one marker that names them; creating a file that is there already
    fails, so of several tries at a batch one counts, and all its tables with it. Folders that no marker names are never read: a
    writer that dies between the two leaves nothing behind that a reader sees. A batch number that is there already is not written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    def _marker(self, batch: int):
        return self._path(f"{self.folder}/commits/{batch:020d}")

    def committed(self, batch: int) -> bool:
        return self._fs.exists(self._marker(batch))

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Write the tables of a batch; whether they count (false: the batch was there)."""
        if self.committed(batch):
            return False
        turn = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/{name}/{batch:020d}-{turn}")
        return self._created(self._marker(batch), turn)

    def _created(self, marker, turn: str) -> bool:
        from py4j.protocol import Py4JJavaError

        self._fs.mkdirs(marker.getParent())
        try:
            out = self._fs.create(marker, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(turn.encode()))
        out.close()
        return True

    def batches(self) -> dict[int, str]:
        """Committed batches and the try that counts. There are as many as micro-batches, whatever their rows."""
        root = self._path(f"{self.folder}/commits")
        if not self._fs.exists(root):
            return {}
        found = {}
        for status in self._fs.listStatus(root):
            if status.getPath().getName().isdigit():
                stream = self._fs.open(status.getPath())
                found[int(status.getPath().getName())] = self._text.toString(stream, "UTF-8")
                stream.close()
        return found

    def read(self, name: str, schema: StructType) -> DataFrame:
        """All committed rows of a table, with the number of their batch."""
        from pyspark.sql import functions as F

        paths = [f"{self.folder}/{name}/{batch:020d}-{turn}" for batch, turn in sorted(self.batches().items())]
        there = [p for p in paths if self._fs.exists(self._path(p))]
        rows = self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)
        number = F.regexp_extract(F.input_file_name(), r"/(\d{20})-[0-9a-f]+/[^/]*$", 1)
        return rows.withColumn("__batch", number.cast("long"))


def drain(frame: DataFrame, folder: str, tables: Callable[[DataFrame], dict[str, DataFrame]], mode: str = "update") -> Ledger:
    """Run a stream over all that is there now; ``tables`` makes a batch's tables of its rows. Run again, it takes what is new."""
    ledger = Ledger(frame.sparkSession, f"{folder}/tables")

    def each(rows: DataFrame, batch: int) -> None:
        made = tables(rows)
        if len(made) > 1 and not ledger.committed(batch):  # several tables read the rows: they are written once, and the tables are made of that
            staged = f"{folder}/staged/{batch:020d}-{uuid.uuid4().hex}"
            rows.write.parquet(staged)
            made = tables(rows.sparkSession.read.schema(rows.schema).parquet(staged))
        ledger.commit(batch, made)

    query = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(each).start()
    query.awaitTermination()
    return ledger
