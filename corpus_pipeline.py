"""The corpus pipeline over ``documents``: drop toxic texts, keep one document of each group of
near-duplicates, interleave the sources by their target weights, and encode what is left.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs, so a lost executor costs no more than a stage. All but the last return
the columns of documents, so the order of the mix is that of the rows in the files, and the last stage
turns it into a column.

Null texts count as empty: they are not toxic, copies of each other, and have no tokens. Rows of a null
doc_id take part and are kept last of their group. Texts of any length are read whole. Repeated rows are
one group, of which one row stays. An empty table gives an empty result. Columns besides those of documents
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import bpe, mixing, near_dup, toxicity
from sylvan.runtime import discard, free, materialise, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is trained on the table's labelled rows,
    whichever of them ``docs`` still holds."""
    ship(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, a Jaccard similarity of 0.8 or more; candidates
    by operator 4's keys, completed by an exact join) the document of the smallest doc_id stays."""
    ship(spark)
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule: files in order of name, rows in order within. Rows without
    a source, and those of sources without a quota, share one quota."""
    ship(spark)
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the text's tokens with their digest, and ``position``: sorted by it, the rows are in the
    order in which the mixing stage wrote them. Null and empty texts have no tokens."""
    ship(spark)
    placed, position = ordered(docs)
    return bpe.encode_with_digest(placed.select("doc_id", "source", "text", F.col(position).alias("position")), keep=("position",))


def ordered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column for the place of each row in its files, taken in order of name: the file's number from
    2 ** 40 on, the row's below. A frame that doesn't come from files is numbered as it is read."""
    (position,) = free(docs, "position")
    number = F.regexp_extract("_metadata.file_name", r"\Apart-(\d+)-", 1).cast("long")
    try:
        out = docs.withColumn(position, number * (1 << 40) + F.col("_metadata.row_index"))
        out.schema  # noqa: B018  analysed here
        return out, position
    except AnalysisException:
        return docs.withColumn(position, F.monotonically_increasing_id()), position


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL: the first stage trains a model. tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage has read is deleted once its result is written."""
    docs = table(ship(spark), sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
        before = docs
    return docs
