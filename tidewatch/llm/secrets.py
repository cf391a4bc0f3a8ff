"""Secret scans with ownership frequency over the whole corpus.

Every candidate value is hashed, and for each hash the distinct owners and repositories that hold it are counted. A value
that many owners hold, or many repositories of one owner, is an example that has been copied; one that stays with few
looks live. Values that no base
pattern names (long mixed tokens of high entropy) become spans only if they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import store

KINDS = ("assign", "access", "hex", "live")
# Fixed patterns of the base kinds; (?a...) keeps letters to ASCII.
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter run is no match to drop
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
#: A token of the method: mixed, long, and not inside another run of the same characters.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.0


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def find_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in code points: base matches by start and kind, then tokens that touch none of them."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], x[0]))
    tokens, k, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        while k < len(found) and found[k][1] < m.end():
            reach = max(reach, found[k][2])
            k += 1
        if reach <= m.start() and _entropy(m[0]) >= LEAST_BITS:
            tokens.append((3, m.start(), m.end(), m[0]))
    return found + tokens


def candidates(text: Column) -> Column:
    """array of (kind, start, end, hash); hash is 128 bits of the value's SHA-256 in hex."""

    @F.arrow_udf("array<struct<kind:int,start:int,end:int,hash:string>>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            found = find_candidates(t.as_py() or "")
            rows.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, s, e, v in found])
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())])))

    return scan(text)


def span_list(spans: Column, names: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, names))
    parts = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repos) from (hash, owner, repo): distinct owners, and distinct repositories within each owner.

    A null owner or repository is one of its own. Repeats are removed before anything is counted per hash, and counts
    are summed owner by owner on the map side, so that a value in a third of all rows is no hot group.
    """
    held = spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", copied_by: int = 3, copied_within: int = 25) -> DataFrame:
    """(doc_id, base, spans, n_live, n_example), one row for each row of docs (doc_id, text, owner, repo).

    base and spans are arrays of (start, kind, end); base holds the matches of the base patterns, whoever owns them,
    and spans also the tokens that look live. n_live and n_example count base spans and candidate tokens by class: a
    value is an example with copied_by owners or more, or in copied_within repositories or more, even of one owner. Null
    and empty texts have no spans, very long ones are scanned whole, an empty table gives none; rows that repeat count once
    per repository.
    """
    columns = [F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).alias("owner"), F.col(repo).alias("repo")]
    scanned = store(docs.select(*columns, candidates(F.col("text")).alias("found")), "secret_candidates")
    each = scanned.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    judged = each.join(ownership(each), "hash").withColumn("example", (F.col("owners") >= copied_by) | (F.col("repos") >= copied_within))
    live = ~F.col("example")
    by_row = judged.groupBy(F.col("row").alias("of")).agg(
        F.count_if(live).alias("n_live"),
        F.count_if("example").alias("n_example"),
        F.collect_list(F.when((F.col("kind") == 3) & live, F.struct("start", "kind", "end"))).alias("added"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.transform(F.filter("found", lambda x: x["kind"] < 3), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    plain = scanned.filter(F.size("found") == 0).select("doc_id", none.alias("base"), none.alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    rich = scanned.filter(F.size("found") > 0).join(by_row, F.col("row") == F.col("of")).withColumn("base", F.sort_array(base))
    return plain.unionByName(rich.select("doc_id", "base", F.sort_array(F.concat("base", "added")).alias("spans"), "n_live", "n_example"))
