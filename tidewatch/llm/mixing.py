"""Mixing sources to target weights by dependent rounding.

Each document of a source should stand in the mix target / source size times. The whole part is certain; the fractional
parts are rounded in pairs: one document gives words to the other, at random, until one of the two is whole, and the
other goes on. The expected copies of each document stay what they were and the words of the source stay constant up to
the last residual. Pairs are folded inside groups of about `fold` documents; each group leaves one residual, and the
residuals of up to `fold` groups make a group of the next level, until a source has one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import WORD, store

WEIGHTS = (3, 1, 2)


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(*parts) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """(source, source_size, items, target) from (source, source_size, items), one row for each source.

    Sources by code point, null last, weigh weights, repeating. They share `share` of all sizes by weight; a target stops
    at most_copies of its source, and the excess goes to the others by weight until none is above.
    """
    # a rank over one row per source
    ranked = store(
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("most", most_copies * F.col("source_size")),
        "sources",
    )
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("most") <= level * F.col("weight") if capped >= 0 else F.lit(False)
        got = ranked.agg(F.sum(F.when(above, F.col("most")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if got[2] == capped or not got[1]:
            level = level if got[1] else float("inf")
            break
        level, capped = (total - got[0]) / got[1], got[2]
    return ranked.select("source", "source_size", "items", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _pairing(level: int, seed: int):
    """A step of the fold over (id, mass, part, ...), part in (0, 1): the state holds what is decided and one residual."""

    def within(part: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))

    def step(state: Column, new: Column) -> Column:
        old = state["rest"]
        # words that may flow to the old one until it or the giver is whole, and the same the other way
        to_old = F.least(old["mass"] * (1 - old["part"]), new["mass"] * new["part"])
        to_new = F.least(old["mass"] * old["part"], new["mass"] * (1 - new["part"]))
        # the direction decides who can be done, not the sign of the words: they may be 0 where a part is as good as whole
        up = _draw(F.lit(seed), F.lit(level), old["id"], new["id"]) * (to_old + to_new) < to_new
        gain = F.when(up, to_old).otherwise(-to_new)
        old_full, new_none = up & (old["mass"] * (1 - old["part"]) <= to_old), up & (new["mass"] * new["part"] <= to_old)
        old_none, new_full = ~up & (old["mass"] * old["part"] <= to_new), ~up & (new["mass"] * (1 - new["part"]) <= to_new)
        old_done, new_done = old_full | old_none, new_full | new_none
        done = F.concat(
            F.when(old_done, F.array(F.struct(old.alias("item"), old_full.alias("up")))).otherwise(F.array()),
            F.when(new_done, F.array(F.struct(new.alias("item"), new_full.alias("up")))).otherwise(F.array()),
        )
        rest = F.when(old_done & new_done, F.lit(None)).when(old_done, new.withField("part", within(new["part"] - gain / new["mass"])))
        rest = rest.otherwise(old.withField("part", within(old["part"] + gain / old["mass"])))
        return F.struct(
            F.when(old.isNull(), new).otherwise(rest).alias("rest"),
            F.when(old.isNull(), state["done"]).otherwise(F.concat(state["done"], done)).alias("done"),
        )

    return step


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = 1.5, most_copies: int = 2, fold: int = 64, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row for each row of docs (doc_id, source, text).

    size defaults to the words of the text; null counts as 0. copies is 0 to most_copies. Documents of size 0 take only
    the whole part of their copies. A null source is a source. Rows that share doc_id, source and size are rounded as
    one item and get the same copies. The draw depends on ids and seed only, so that reruns agree.
    """
    sized = docs.select("doc_id", "source", (size_in_words(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("size"))
    items = store(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "items")
    totals = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("items"))
    targets = store(source_targets(totals, weights, share, most_copies), "targets").withColumnRenamed("source", "of")
    aimed = items.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.withColumns({"whole": F.floor(wanted), "part": wanted - F.floor(wanted)}).withColumn("mass", (F.col("size") * F.col("n")).cast("double"))
    aimed = aimed.withColumn("split", (F.col("part") > 0) & (F.col("mass") > 0)).withColumn("groups", F.ceil(F.col("items") / fold))
    out = ["doc_id", "source", "size", "n", "source_size", "target"]
    done = [aimed.filter("NOT split").select(*out, F.col("whole").alias("copies"))]
    item = F.struct(F.xxhash64(F.lit(seed), "doc_id", "size").alias("draw"), F.col("doc_id").alias("id"), "mass", "part", "size", "n", "source_size", "target", "whole")
    level_rows = aimed.filter("split").select(
        "source", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.col("groups")).alias("group"), "groups", item.alias("item")
    )
    most = targets.agg(F.max(F.ceil(F.col("items") / fold))).first()[0] or 0
    level = 0
    while True:
        grouped = level_rows.groupBy("source", "group", "groups").agg(F.sort_array(F.collect_list("item")).alias("items"))
        shape = level_rows.schema["item"].dataType.simpleString()
        start = F.struct(F.lit(None).cast(shape).alias("rest"), F.array().cast(f"array<struct<item:{shape},up:boolean>>").alias("done"))
        folded = store(grouped.select("source", "group", "groups", F.aggregate("items", start, _pairing(level, seed)).alias("state")), f"fold_{level}")
        won = folded.select("source", F.explode("state.done").alias("x")).select("source", "x.item", "x.up")
        rest = folded.filter("state.rest IS NOT NULL").select("source", "group", "groups", F.col("state.rest").alias("item"))
        if most <= 1:
            # the last residual of a source goes up with the probability that is left
            won = won.unionByName(rest.select("source", "item", (_draw(F.lit(seed), F.lit(-1), F.col("item.id")) < F.col("item.part")).alias("up")))
        done.append(
            won.select(
                F.col("item.id").alias("doc_id"), "source", *[F.col(f"item.{c}") for c in out[2:]],
                (F.col("item.whole") + F.col("up").cast("long")).alias("copies"),
            )
        )
        if most <= 1:
            break
        level_rows = rest.select("source", F.floor(F.col("group") / fold).alias("group"), F.ceil(F.col("groups") / fold).alias("groups"), "item")
        most, level = -(-most // fold), level + 1
    rounded = done[0]
    for part in done[1:]:
        rounded = rounded.unionByName(part)
    return rounded.select(
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row")
    ).drop("row")
