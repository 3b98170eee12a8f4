"""Start streams over files and collect their output in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrascope.session import remove, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings that a stream's own session takes over from the session that starts it.
TAKEN_OVER = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for streams alone, so that their settings never reach other queries.

    The number of state partitions is the configured number of shuffle partitions; a
    checkpoint keeps it, whatever cluster resumes the stream.
    """
    session = spark.newSession()
    for name in TAKEN_OVER:
        if (value := spark.conf.get(name, None)) is not None:
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    return session


def file_stream(session: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Stream of one table, whether ``name.parquet`` is a file or a folder of part files."""
    only = f"{folder}/{name[:-1]}[{name[-1]}].parquet"  # a pattern, which a file or a folder can match
    return session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(only)


def _finish(query: StreamingQuery) -> None:
    """Wait for the end; rows that came later than the stated delay are an error, not a smaller result."""
    query.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    if late:
        raise RuntimeError(f"{late} rows came after the watermark had passed them; state a longer delay")


def run_append(stream: DataFrame, label: str, closing: Callable[[], None] | None = None) -> DataFrame:
    """Process everything available into Parquet files and read them back.

    Checkpoint and output live in the shared folder, so a lost executor or a restart
    resumes from the last committed batch. The checkpoint goes once the stream is done.
    ``closing`` is called when all is processed, to add the rows that end the stream; the query
    then goes on from its checkpoint, and what was waiting for the watermark comes out.
    """
    spark = stream.sparkSession
    base = shared_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
    )
    _finish(writer.start())
    if closing is not None:
        closing()
        _finish(writer.start())
    remove(spark, f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


class Closing:
    """Rows that end a stream: a second source beside it, empty until they are written.

    Their time lies so far ahead that the watermark passes everything before them.
    """

    def __init__(self, session: SparkSession, schema: StructType):
        self.session, self.schema = session, schema
        self.path = shared_path(session, "closing")
        session.createDataFrame([], schema).write.parquet(self.path)

    def after(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(self.session.readStream.schema(self.schema).parquet(self.path))

    def write(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("append").parquet(self.path)


def run_update(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available in update mode; every batch is its own folder.

    Rows carry the ``batch`` that wrote them. A replayed batch overwrites its folder.
    """
    spark = stream.sparkSession
    base = shared_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)
    remove(spark, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/data")


def saved(session: SparkSession, table: DataFrame, label: str) -> DataFrame:
    """A batch result as a static table of a stream's session, written once."""
    path = shared_path(session, label)
    table.write.parquet(path)
    return session.read.schema(table.schema).parquet(path)
