"""Quality and safety of prompts and responses as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.slices import running_totals
from tidewatch.operators import cost, governance, requests

DIMENSIONS = ("technical", "cognitive", "finops", "compliance")


def cognitive_facts(pairs: DataFrame) -> DataFrame:
    """All of C1-C12 in one pass over (prompt, response) rows; an array column ``sources`` is used where present."""
    p, r = F.col("prompt"), F.col("response")
    lost = text.unsupported_claims(r, F.col("sources")) if "sources" in pairs.columns else None
    return pairs.withColumns({
        "prompt_analysis": F.struct(
            text.prompt_scores(p).alias("scores"), text.classify_intent(p).alias("intent"), text.prompt_risk_flags(p).alias("risk")),
        "response_analysis": F.struct(
            text.response_shape(r).alias("shape"), text.response_format(r).alias("format"), text.response_flags(r).alias("flags")),
        "quality": text.quality_scores(p, r),
        "hallucination": text.hallucination_markers(r, lost),
        "bias": text.bias_scores(r),
        "toxicity": text.toxicity_scores(r),
        "sentiment": text.sentiment(r),
        "prompt_sentiment": text.sentiment(p),
    })


def attach_feedback(facts: DataFrame, feedback: DataFrame, order: Sequence[str] = ("version",)) -> DataFrame:
    """The latest feedback of each request; feedback without a request is ignored."""
    given = [c for c in feedback.columns if c != "request_id"]
    latest = feedback.groupBy("request_id").agg(F.max_by(F.struct(*given), F.struct(*order)).alias("human_feedback"))
    return facts.join(latest, "request_id", "left")


def cognitive_summary(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """C14: number, mean quality and the rates of hallucination, bias and toxicity; zeros for an empty input."""
    def rate(c):
        return F.coalesce(F.avg(F.col(f"{c}.detected").cast("int")), F.lit(0.0)).alias(f"{c}_rate")
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_analyzed"),
        F.coalesce(F.avg("quality.overall_score"), F.lit(0.0)).alias("avg_quality_score"),
        rate("hallucination"), rate("bias"), rate("toxicity"),
    )


def conversation_context(turns: DataFrame, span: int = 1000) -> DataFrame:
    """Number of each turn in its conversation and the length of the text before it.

    Turns are ordered inside spans of ``span`` turn numbers, so an endless conversation is not one task.
    """
    d = running_totals(
        turns, ["conv_id"], "turn", ["turn"],
        {"turn_number": F.lit(1).cast("bigint"), "_upto": F.length("text").cast("bigint")},
        slice_by=F.floor(F.col("turn") / span),
    )
    return d.withColumn("context_length", F.col("_upto") - F.length("text")).drop("_upto")


def record_requests(reqs: DataFrame, rates: DataFrame, enabled: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The facts of every enabled dimension in one pass over the requests.

    A missing id becomes a uuid, a missing environment production, a missing actor anonymous.
    """
    def or_default(name, default):
        return F.coalesce(F.col(name).cast("string"), default) if name in reqs.columns else default

    d = reqs.withColumns({
        "request_id": or_default("request_id", F.expr("uuid()")),
        "environment": or_default("environment", F.lit("production")),
        "actor_id": or_default("user_id", F.lit("anonymous")),
    })
    base = list(d.columns)
    if "technical" in enabled:
        d = requests.request_facts(d)
        d = d.withColumn("technical", F.struct("tokens_total", "tokens_per_second", "latency_ms", "status")).select(*base, "technical")
    if "cognitive" in enabled:
        made = ("prompt_analysis", "response_analysis", "quality", "hallucination", "bias", "toxicity", "sentiment")
        d = cognitive_facts(d).withColumn("cognitive", F.struct(*made)).drop(*made)
    if "finops" in enabled:
        made = ("input_cost", "output_cost", "total_cost", "cached_savings", "input_rate", "output_rate", "pricing_input", "pricing_output")
        d = cost.request_cost(d, rates).withColumn("finops", F.struct(*made)).drop(*made)
    if "compliance" in enabled:
        kept = [c for c in d.columns]
        d = governance.request_audit(d, actor="actor_id")
        made = [c for c in d.columns if c not in kept]
        d = d.withColumn("compliance", F.struct(*made)).drop(*made)
    return d
