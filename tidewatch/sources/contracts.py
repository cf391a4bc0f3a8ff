"""Contracts and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unknown_fields(doc: Column, schema: T.StructType, path: str = "") -> Column:
    """Names found in the document and not in the schema, nested structs included."""
    here = F.json_object_keys(F.get_json_object(doc, f"${path}") if path else doc)
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.transform(F.array_except(F.coalesce(here, F.array().cast("array<string>")), names),
                        lambda k: F.concat(F.lit(f"{path[1:]}." if path else ""), k))
    parts = [extra]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            parts.append(_unknown_fields(doc, f.dataType, f"{path}.{f.name}"))
    return F.flatten(F.array(*parts)) if len(parts) > 1 else extra


def enforce_strict_schema(df: DataFrame, schema: T.StructType, column: str = "document", strict: bool = True) -> DataFrame:
    """The parsed row and, for a document that does not fit, the reason. Unknown fields count when ``strict``."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    d = df.withColumn("_p", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    unknown = F.array_sort(_unknown_fields(F.col(column), schema)) if strict else F.array().cast("array<string>")
    bad = F.col("_p._bad").isNotNull() | F.col("_p").isNull()
    is_object = F.json_object_keys(column).isNotNull()
    reason = (
        F.when(~is_object, "not_json")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown_field:"), F.array_join(unknown, ",")))
        .when(bad, "wrong_type")
    )
    row = F.struct(*[F.col("_p")[f.name].alias(f.name) for f in schema.fields])
    return d.withColumn("reason", reason).withColumn("row", F.when(F.col("reason").isNull(), row)).drop("_p")


def split_by_contract(df: DataFrame, contract: Column, index: str, now) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the contract, and the others as {index, document, error, timestamp}."""
    ok = F.coalesce(contract, F.lit(False))
    rejects = df.where(~ok).select(
        F.lit(index).alias("index"), F.to_json(F.struct(*df.columns)).alias("document"),
        F.lit("contract violated").alias("error"), F.lit(now).cast("timestamp").alias("timestamp"),
    )
    return df.where(ok), rejects


def write_with_rejects(df: DataFrame, contract: Column, target: str, rejects: str, index: str, now) -> None:
    """S8 as a sink, also for ``foreachBatch``."""
    good, bad = split_by_contract(df, contract, index, now)
    good.write.mode("append").parquet(target)
    bad.write.mode("append").parquet(rejects)


def replay_rejects(rejects: DataFrame, schema: T.StructType, contract: Column, written: DataFrame, row_id: str, limit: int = 100) -> DataFrame:
    """Re-validate the first ``limit`` stored rejects, oldest first; written ids are not repeated.

    The result has every reject, its parsed row and its outcome: success, duplicate, failed (to be queued again), or
    queued for those after the limit. Equal rejects of one time are tried together.
    """
    place = F.struct("timestamp", "document")
    cut = rejects.orderBy("timestamp", "document").limit(limit).agg(F.max(place).alias("_cut"))
    d = rejects.withColumn("_place", place).crossJoin(cut)  # a single row
    d = d.withColumn("_later", F.col("_place") > F.col("_cut")).withColumn("row", F.from_json("document", schema)).select("index", "document", "timestamp", "_later", "row", "row.*")
    ok = F.coalesce(contract, F.lit(False))
    seen = written.select(F.col(row_id).alias("_seen")).distinct()
    d = d.join(seen, F.col(row_id) == F.col("_seen"), "left")
    outcome = F.when(F.col("_later"), "queued").when(~ok, "failed").when(F.col("_seen").isNotNull(), "duplicate").otherwise("success")
    return d.select("index", "document", "timestamp", "row", outcome.alias("outcome"))


def replay_counts(replayed: DataFrame) -> DataFrame:
    return replayed.agg(
        F.count_if(F.col("outcome") != "queued").alias("retried"), F.count_if(F.col("outcome") == "success").alias("success"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
