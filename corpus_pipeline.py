"""From documents to token ids: stages that each call one operator on what the stage before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, mixing, near_copies, pieces, quality, queries
from tidewatch.llm.shared import store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't say the classifier, the fingerprints' hash, the draw of the mix or the encoding; tests do it by brute force.
ORACLE_SQL = None


#: Rows that a Python worker holds at a time; texts of some kilobytes make that a few megabytes.
ROWS_A_BATCH = 2000


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A model that has learned from no row rejects none."""
    _in_small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.rows:
        return docs.select(*COLUMNS)
    return docs.filter(quality.quality_score(F.col("text"), model) >= queries.GOOD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents hold; a document that loses them all stays, empty."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    text = F.col("kept_text")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (0.8 of their five-word shingles) stays, one with the smallest doc_id.

    Copies within 2 bits come from fingerprints by their positional bytes, as in op9 but of five words; the others, whose
    fingerprints may share no byte at all, from bands of MinHash values. Both are compared on the sets.
    """
    _in_small_batches(spark)
    # a written number of each row, as rows may share a doc_id or have none
    numbered = store(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    return numbered.join(near_copies.first_rows(numbered), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("of"), F.col("source").alias("from"), "size").agg(F.max("copies").alias("copies"))
    sized = docs.withColumn("words", mixing.size_in_words(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("words") == F.col("size"))
    taken = sized.join(copies.filter("copies > 0"), same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text of the mix."""
    _in_small_batches(spark)
    coded = docs.select("doc_id", "source", pieces.encode_pieces(F.col("text"), queries.PIECE_MODEL).alias("ids"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_poor),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("piece_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
