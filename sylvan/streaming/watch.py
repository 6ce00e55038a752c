"""Continuous indexing: files that arrive in a folder are parsed as they come.

Each micro-batch of new files is parsed once and its relations appended to a table, with
the file's modification time as version. Questions read the newest version of each file,
so a file that is written again replaces what it said before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylvan.functions.languages import EXTENSIONS, extensions
from sylvan.runtime import ship
from sylvan.sources import files as sources


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """path, lang, source, version of source files as they arrive below a folder."""
    known = sorted(extensions())
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for e in known for x in (e, EXTENSIONS[e])])
    return found.where(ext.isin(*known)).select("path", F.element_at(table, ext).alias("lang"), F.decode("content", "UTF-8").alias("source"), F.col("modificationTime").alias("version"))


def index(files: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start to append the relations of arriving files to a Parquet table. A batch that is run again after
    a failure writes the same rows to the same place."""
    ship(files.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        # of a file that is twice in a batch the newest counts
        newest = batch.groupBy("path").agg(F.max(F.struct("version", "lang", "source")).alias("f")).select("path", "f.*")
        rel = sources.relations(newest).join(newest.select("path", "version"), "path")
        rel.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The relations of the newest version of each file."""
    rel = spark.read.parquet(table)
    newest = rel.groupBy("path").agg(F.max(F.struct("version", "batch")).alias("n")).select("path", F.col("n.version").alias("version"), F.col("n.batch").alias("batch"))
    return rel.join(newest, ["path", "version", "batch"], "left_semi").drop("version", "batch")
