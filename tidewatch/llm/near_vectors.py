"""Embedding near-dedup with a flat, robust-pruned graph over overlapping cluster shards.

Vectors of one label are sharded by their nearest centroids, each vector into two shards; a shard that is still too
large is split again with other centroids. A shard links each vector to its nearest ones, prunes those that a closer one
covers, and takes the union of the links and their reverses. Each vector of the shard then searches the graph greedily
from the medoid and from itself, and the search goes on through everything within the range. What it finds is verified
in double precision. A pair is counted in the first shard that both share, so nothing is counted twice and only sums per
vector and links to one representative per local component leave a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.shared import store

#: Rows that centroids are fitted on at most, and centroids of one splitting.
SAMPLE, CENTROIDS = 4096, 16
DEPTH = 4


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and all components finite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(rows: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def nearest_two(vector: Column, centres: np.ndarray) -> Column:
    """Numbers of the two nearest centroids, nearest first, as array<int>; a vector of another length is cut or filled with 0."""
    bound = centres.copy()
    vector = F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(bound.shape[1]) - F.size(vector)))), 1, bound.shape[1])

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        sims = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) @ bound.T
        return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :2].astype(np.int32)))

    return near(vector)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def build_graph(v: np.ndarray, degree: int = 24, candidates: int = 64, alpha: float = 1.2, seed: int = 0) -> np.ndarray:
    """Neighbours of each row, degree of its own and as many reverse ones, -1 where there are less.

    Candidates are the nearest rows and some at random; the nearest is kept, and candidates that it covers (alpha times
    closer to it than to the row) go, until degree are kept or none is left.
    """
    n = len(v)
    rng = np.random.default_rng(seed)
    near = min(candidates, n - 1)
    own = np.full((n, degree), -1, dtype=np.int64)
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        sims = v[rows] @ v.T
        sims[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near < n else np.argsort(-sims, axis=1)[:, :near]
        pool = np.concatenate([top, rng.integers(0, n, (len(rows), 8))], axis=1)
        dist = np.maximum(0, 2 - 2 * np.take_along_axis(sims, pool, axis=1))
        dist[pool == rows[:, None]] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")
        pool, dist = np.take_along_axis(pool, order, axis=1), np.take_along_axis(dist, order, axis=1)
        between = np.maximum(0, 2 - 2 * np.einsum("ikd,ijd->ikj", v[pool], v[pool]))
        left = np.isfinite(dist)
        each = np.arange(len(rows))
        for k in range(degree):
            some = left.any(axis=1)
            pick = left.argmax(axis=1)
            own[rows[some], k] = pool[each[some], pick[some]]
            covered = alpha * alpha * between[each, pick] <= dist
            left &= ~(covered & some[:, None])
            left[each, pick] = False
            left &= ~((pool == pool[each, pick][:, None]) & some[:, None])
    src = np.repeat(np.arange(n), degree)
    dst = own.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    place = np.arange(len(dst)) - np.searchsorted(dst[order], dst[order])
    back = np.full((n, 2 * degree), -1, dtype=np.int64)
    fits = place < 2 * degree
    back[dst[order][fits], place[fits]] = src[order][fits]
    return np.concatenate([own, back], axis=1)


def range_search(v: np.ndarray, graph: np.ndarray, query: int, medoid: int, least: float, slack: float = 0.04, beam: int = 8) -> np.ndarray:
    """Rows within the range of a row: greedy from the medoid and the row itself, then through all rows in the range."""
    seen = np.zeros(len(v), dtype=bool)
    front = np.unique([medoid, query])
    seen[front] = True
    got, sims = front, v[front] @ v[query]
    while True:
        around = np.unique(graph[front])
        around = around[(around >= 0)]
        around = around[~seen[around]]
        if not len(around):
            break
        seen[around] = True
        near = v[around] @ v[query]
        bar = min(least - slack, np.partition(sims, -beam)[-beam] if len(sims) >= beam else -np.inf)
        front = around[near >= bar] if len(sims) < beam or bar >= least - slack else around[near > bar]
        got, sims = np.concatenate([got, around]), np.concatenate([sims, near])
        if not len(front):
            break
    found = got[sims >= least - 1e-9]
    return found[found != query]


def _roots(n: int, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    up = np.arange(n)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, others in pairs:
        for b in others.tolist():
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    return np.array([top(k) for k in range(n)])


def _search_shard(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    frame = frame.sort_values("vec_id", ignore_index=True)
    v = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in frame["embedding"]]))
    ids, copies = frame["vec_id"].to_numpy(), frame["copies"].to_numpy()
    shard, shards = frame["shard"].iloc[0], frame["shards"].tolist()
    n = len(v)
    links, pairs = np.zeros(n, dtype=np.int64), []
    if n > 1:
        graph = build_graph(v)
        medoid = int((v @ v.mean(axis=0)).argmax())
        found = [set(range_search(v, graph, q, medoid, least).tolist()) for q in range(n)]
        first = [{s: k for k, s in enumerate(x)} for x in shards]
        for a in range(n):
            # a search may find what the search from the other side missed
            others = np.array(sorted(b for b in found[a] if b > a or a not in found[b]), dtype=np.int64)
            if not len(others):
                continue
            others = others[np.einsum("ij,j->i", v[others], v[a]) >= least]
            mine = [b for b in others.tolist() if min(s for s in first[a] if s in first[b]) == shard]
            links[a] += copies[mine].sum()
            links[mine] += copies[a]
            pairs.append((a, others))
    return pd.DataFrame({"vec_id": ids, "links": links, "root": ids[_roots(n, pairs)]})


def _block_pair(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """All pairs of two blocks of a shard that no centroid splits, compared directly."""
    frame = frame.sort_values("vec_id", ignore_index=True)
    v = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in frame["embedding"]]))
    ids, copies, block, shards = frame["vec_id"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy(), frame["shards"].tolist()
    shard = frame["shard"].iloc[0]
    two = frame["low"].iloc[0] != frame["high"].iloc[0]
    first = [set(x) for x in shards]
    links, pairs = np.zeros(len(v), dtype=np.int64), []
    for a in range(len(v)):
        others = np.flatnonzero(v @ v[a] >= least)
        others = others[(others > a) & ((block[others] != block[a]) if two else True)]
        mine = [b for b in others.tolist() if min(first[a] & first[b]) == shard]
        links[a] += copies[mine].sum()
        links[mine] += copies[a]
        pairs.append((a, others))
    return pd.DataFrame({"vec_id": ids, "links": links, "root": ids[_roots(len(v), pairs)]})


def shard_vectors(vectors: DataFrame, most: int, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame | None]:
    """(label, vec_id, embedding, copies, shard, shards) in shards of `most` rows or fewer; those that stay larger.

    Centroids are fitted on a bounded sample, the `sample` vectors with the smallest hashes; every vector is sharded.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    now = vectors.withColumn("shard", F.col("label").cast("string"))
    if not len(rows):
        return now.withColumn("shards", F.array("shard")), None
    width = rows.map(len).mode()[0]
    points = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in rows if len(x) == width]))
    done, left = [], None
    for depth in range(DEPTH + 1):
        sizes = now.groupBy("shard").agg(F.count("*").alias("size"))
        now = store(now.join(sizes, "shard"), f"shards_{depth}")
        done.append(now.filter(F.col("size") <= most).drop("size"))
        large = now.filter(F.col("size") > most).drop("size")
        if large.isEmpty():
            break
        if depth == DEPTH:
            left = large
            break
        centres = fit_centroids(points, CENTROIDS, seed=depth)
        near = large.withColumn("near", F.explode(nearest_two(F.col("embedding"), centres)))
        now = near.select("label", "vec_id", "embedding", "copies", F.concat_ws("/", "shard", F.col("near").cast("string")).alias("shard"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    whole = out if left is None else out.unionByName(left)
    whole = store(whole.select("label", "vec_id", "embedding", "copies", "shard"), "sharded")
    of = whole.groupBy(F.col("vec_id").alias("id")).agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    whole = store(whole.join(of, F.col("vec_id") == F.col("id")).drop("id"), "sharded")
    if left is None:
        return whole, None
    kept = left.select("shard").distinct()
    return whole.join(kept, "shard", "left_anti"), whole.join(kept, "shard", "left_semi")


def near_vectors(vectors: DataFrame, least: float = 0.98, most_in_shard: int = 2500, block_rows: int = 1000) -> DataFrame:
    """(vec_id, n_links, component_id), one row for each row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is `least` or more, in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors of a label are one node that counts each of them. Rows that share a vec_id, label
    and vector are one; a row without a vec_id links with nothing. Shards that stay too large (their vectors are too much
    alike for any centroid) are compared directly, pair of blocks by pair of blocks.
    """
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plain = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    members = store(plain.filter(good).withColumn("size", F.size("embedding")), "vectors")
    copied = members.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"))
    nodes = store(copied.withColumn("label", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))), "vector_nodes")
    shards, large = shard_vectors(nodes, most_in_shard)
    schema = "vec_id bigint, links bigint, root bigint"
    found = shards.groupBy("shard").applyInPandas(lambda f: _search_shard(f, least), schema)
    if large is not None:
        blocks = large.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("shard")) / block_rows)).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
        meets = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda other: F.struct(F.least(other, F.col("block")).alias("low"), F.greatest(other, F.col("block")).alias("high")),
        )
        dealt = blocks.select("*", F.explode(meets).alias("m")).select("*", "m.low", "m.high").drop("m", "blocks")
        found = found.unionByName(dealt.groupBy("shard", "low", "high").applyInPandas(lambda f: _block_pair(f, least), schema))
    found = store(found, "vector_links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select("vec_id", "root")).withColumnRenamed("node", "vec_id")
    of = nodes.join(counts, "vec_id").join(roots, "vec_id", "left").select(
        "label", "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")
    )
    labelled = members.withColumn("label", F.concat_ws(":", F.col("label").cast("string"), F.col("size").cast("string")))
    linked = labelled.join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = plain.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def audit_recall(vectors: DataFrame, found: DataFrame, least: float = 0.98, every: int = 50) -> float:
    """Links found of the vectors whose id is divisible by `every`, as a share of those that direct comparison finds.

    The queries are compared with all rows of their label in blocks; the search's counts are summed against it.
    """
    good = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.filter(good).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    both = queries.withColumn("asks", F.lit(True)).unionByName(rows.withColumn("block", block).withColumn("asks", F.lit(False)))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        q, r = frame[asks], frame[~asks]
        if not len(q) or not len(r):
            return pd.DataFrame({"vec_id": q["vec_id"].to_numpy(), "links": np.zeros(len(q), dtype=np.int64)})
        sims = _unit(np.stack(q["embedding"].to_list())) @ _unit(np.stack(r["embedding"].to_list())).T
        other = q["vec_id"].to_numpy()[:, None] != r["vec_id"].to_numpy()[None, :]
        return pd.DataFrame({"vec_id": q["vec_id"].to_numpy(), "links": ((sims >= least) & other).sum(axis=1)})

    true = both.groupBy("label", "block").applyInPandas(count, "vec_id bigint, links bigint").groupBy("vec_id").agg(F.sum("links").alias("true"))
    got = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return 1.0 if not got[0] else got[1] / got[0]
