"""Exact dedup by combining: locally, within salted digest groups, then over the salts, each time on the full content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import store


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_groups(docs: DataFrame, digest=sha_digest, salts: int = 32, hot_rows: int = 1000, most_hot: int = 10_000) -> DataFrame:
    """(doc_id, sha, keep_id, group_size), one row for each row of docs (doc_id, text).

    Rows are equal when their normalised texts are; digest only brings them together, so that a digest that collides
    splits into its contents. A digest is hot with more rows than hot_rows and than its share of most_hot; hence no
    more than most_hot of them are broadcast. Hot digests are dealt over `salts` groups and their winners combined
    again; all others are whole after the first grouping. Both groupings compare the contents themselves, and combine
    on the map side first. Null texts are empty. A null doc_id never stays while a group has another; rows that share
    doc_id and text are one document and carry the same result, each counted in group_size.
    """
    content = docs.select("doc_id", normalised(F.col("text")).alias("content"))
    prints = store(content.select("doc_id", digest(F.col("content")).alias("digest"), sha_digest(F.col("content")).alias("sha")), "prints")
    bound = max(hot_rows, prints.count() // most_hot)
    hot = prints.groupBy("digest").count().filter(F.col("count") > bound).select("digest", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(-1))
    salted = (
        content.withColumn("digest", digest(F.col("content")))
        .join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", salt)
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("digest", "keep_id", "group_size", F.when(F.col("salt") >= 0, F.col("content")).alias("content"))
    )
    salted = store(salted, "salt_winners")
    winners = salted.filter("content IS NULL").select("digest", "keep_id", "group_size").unionByName(
        salted.filter("content IS NOT NULL")
        .groupBy("digest", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("digest", "keep_id", "group_size")
    )
    clash = winners.groupBy("digest").count().filter("count > 1").select("digest")
    if clash.isEmpty():
        return prints.join(winners, "digest").select("doc_id", "sha", "keep_id", "group_size")
    # a digest with several contents: its rows find their group by content
    clash = store(clash, "clash")
    rows = content.select("doc_id", "content", digest(F.col("content")).alias("digest")).join(clash, "digest", "left_semi")
    own = rows.groupBy("content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return (
        prints.join(winners.join(clash, "digest", "left_anti"), "digest")
        .select("doc_id", "sha", "keep_id", "group_size")
        .unionByName(rows.join(own, "content").select("doc_id", sha_digest(F.col("content")).alias("sha"), "keep_id", "group_size"))
    )
