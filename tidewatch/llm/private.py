"""Personal data by bootstrapped contextual extraction, in Spark expressions only.

Base patterns give seed entities. The words before an identifier are its lexical pattern. Patterns and the values they
stand before make a graph; patterns score by the share of their values that are known, unseen values by their patterns,
in turns. Unseen identifiers behind a high-confidence pattern become spans of kind ctx_<kind>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import store

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds. A start guard keeps long runs linear and changes no match: a run that fails from its
# start fails from each later character too. Possessive repeats keep the engine from recursing.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What must be in a text for its pattern to match.
SIGNS = ("@", r"[0-9]\.[0-9]", r"[0-9]", r"\+[0-9]")
#: Unseen identifiers: groups of letters and digits joined by one sign each, with a digit. A run without one in its first 41
#: signs is taken whole, so that none is looked through from each of its groups, and counts by the digits it has further on.
UNSEEN = r"(?<![A-Za-z0-9])(?=[A-Za-z._/@+-]{0,40}[0-9]|[A-Za-z._/@+-]{41})[A-Za-z0-9]++(?:[._/@+-][A-Za-z0-9]++)*+"
LEAST_DIGITS = 5
#: Code points before a match that its lexical pattern is taken from.
REACH = 64
#: Matches of one kind that these hold at most: each has a character, and the next one another or a gap before it.
PASSED = REACH // 2


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    n = F.char_length(_digits(value))
    small = F.forall(F.split(value, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 2) | F.forall(
        F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    )
    card = n.between(13, 19) & F.when(n.between(13, 19), F.call_function("luhn_check", _digits(value))).otherwise(F.lit(False))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, small)
        .when(kind == 2, card)
        .when(kind == 3, n.between(9, 15))
        .otherwise(n >= LEAST_DIGITS)
    )


def _hits(text: Column, kind: int) -> Column:
    """(kind, found, gaps): the matches, and for the stretch before each its length and its last code points."""
    pattern, sign = (PATTERNS + (UNSEEN,))[kind], (SIGNS + (SIGNS[2],))[kind]
    there = text.rlike(sign) if len(sign) > 1 else F.contains(text, F.lit(sign))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.char_length(g).alias("size"), F.right(g, F.lit(REACH)).alias("left")))
    return F.when(there, F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gaps")))


def _before(found: Column, gaps: Column, i: Column) -> Column:
    """The last code points of the text before match i, whatever stands there; other matches of the kind are put back."""
    first = F.greatest(i - PASSED, F.lit(0))
    passed = F.transform(F.slice(found, first + 1, F.least(i, F.lit(PASSED))), lambda v, k: F.concat(F.get(gaps, first + k)["left"], v))
    own = F.get(gaps, i)
    return F.when(own["size"] >= REACH, own["left"]).otherwise(F.right(F.concat(F.array_join(passed, ""), own["left"]), F.lit(REACH)))


def find_hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits), one row for each row of docs, stored."""
    text = F.coalesce("text", F.lit(""))
    hits = F.filter(F.array(*[_hits(text, k) for k in range(5)]), lambda h: h.isNotNull() & (F.size(h["found"]) > 0))
    return store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", hits.alias("hits")), "private_hits")


def matches(hits: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left) of each valid match, in code points; kind 4 is an unseen identifier."""
    by_kind = hits.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    found, gaps = F.col("found"), F.col("gaps")
    whole = F.transform(found, lambda v, i: F.struct(v.alias("value"), F.get(gaps, i)["size"].alias("gap"), _before(found, gaps, i).alias("left")))
    each = by_kind.select("row", "kind", F.posexplode(whole).alias("i", "x")).select("row", "kind", "i", "x.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.char_length("value")).over(before)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    return placed.filter(_valid(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value", "left")


def apart(found: DataFrame) -> DataFrame:
    """Without unseen identifiers that overlap a base match of their row."""
    by_start = Window.partitionBy("row").orderBy("start")
    base = F.col("kind") < 4
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    onward = F.min(F.when(base, F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(onward, F.col("end")) >= F.col("end"))
    return found.withColumn("clear", clear).filter(base | F.col("clear")).drop("clear")


def lexical_pattern(left: Column) -> Column:
    """The last two words before a match, A-Z in lower case and digits as 0; null where there are none."""
    words = F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 0)
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(words)), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0")
    return F.when(plain != "", plain)


def score_graph(edges: DataFrame, rounds: int, support: int) -> DataFrame:
    """Scores of (pattern, kind), from distinct (pattern, value, kind, seed).

    A seed scores 1 for its kind. A pattern scores the sum over its values divided by one more than their number, and
    only with `support` values or more; an unseen value scores the mean over its patterns that have so many, so rare
    words before it take nothing away. Only sums by pattern and by value are shuffled; a common pattern is one row after
    the map side.
    """
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n")).filter(F.col("n") >= support)
    seeds = edges.filter("seed").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    links = edges.select("pattern", "value").distinct()
    open_links = store(edges.filter("NOT seed").select("pattern", "value").distinct().join(sizes.select("pattern"), "pattern"), "open_links")
    spread = open_links.groupBy("value").agg(F.count("*").alias("patterns"))
    for _ in range(rounds):
        known = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        patterns = store(known.join(sizes, "pattern").select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("score")), "pattern_scores")
        reached = open_links.join(patterns, "pattern").groupBy("value", "kind").agg(F.sum("score").alias("total"))
        unseen = reached.join(spread, "value").select("value", "kind", (F.col("total") / F.col("patterns")).alias("score"))
        scores = seeds.unionByName(unseen)
    return patterns


def find_private(docs: DataFrame, rounds: int = 2, support: int = 5, confident: float = 0.8) -> DataFrame:
    """(doc_id, base, spans), one row for each row of docs (doc_id, text).

    base and spans are sorted arrays of (kind, start, end), kind by its place in KINDS; spans also holds what the
    patterns discovered, with 4 added to the kind. A discovered identifier overlaps no base match, and the pattern before
    it scores `confident` or more, whatever it stands behind elsewhere; of several kinds the best, then the first, counts. Null and empty texts have no
    spans, repeated rows each have theirs. Without seeds nothing is discovered.
    """
    hits = find_hits(docs)
    found = store(apart(matches(hits)).withColumn("pattern", lexical_pattern(F.col("left"))).drop("left"), "private_matches")
    seed = F.col("kind") < 4
    edges = store(found.filter("pattern IS NOT NULL").select("pattern", "value", F.when(seed, F.col("kind")).alias("kind"), seed.alias("seed")).distinct(), "pattern_edges")
    patterns = score_graph(edges, rounds, support)
    best = (
        found.filter(~seed)
        .select("row", "start", "end", "pattern")
        .join(patterns.filter(F.col("score") >= confident), "pattern")
        .groupBy("row", "start", "end")
        .agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"))
        .select("row", (F.col("kind") + 4).alias("kind"), "start", "end")
    )
    spans = found.filter(seed).select("row", "kind", "start", "end").unionByName(best)
    by_row = spans.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    all_rows = hits.select("row", "doc_id").join(by_row, F.col("row") == F.col("of"), "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return all_rows.select("doc_id", F.filter("spans", lambda s: s["kind"] < 4).alias("base"), "spans")
