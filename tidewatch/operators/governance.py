"""Privacy and governance of AI requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.columns import as_map, hash16
from tidewatch.functions.slices import asof_join

# Days that each retention policy keeps its rows; any other policy keeps 90.
RETENTION_DAYS = {"default": 90, "audit": 365, "compliance": 2555, "legal_hold": 3650}
UNKNOWN_RETENTION = 90
DATA_RETENTION_DAYS = 90


def request_audit(requests: DataFrame, actor: str = "user_id") -> DataFrame:
    """Audit columns of each request: resource, hashes and lengths of the texts, personal data of both."""
    d = requests.withColumns({"_p": text.detect_pii(F.col("prompt")), "_r": text.detect_pii(F.col("response"))})
    resource = F.concat_ws("/", "provider", "model")
    email = F.col("actor_email") if "actor_email" in requests.columns else F.lit("")
    return d.withColumns({
        "action": F.lit("execute"), "resource_type": F.lit("ai_model"), "resource_id": resource, "outcome": F.lit("success"),
        "actor": F.col(actor).cast("string"), "email_hash": hash16(email),
        "prompt_hash": hash16(F.col("prompt")), "prompt_length": F.length("prompt"),
        "response_hash": hash16(F.col("response")), "response_length": F.length("response"),
        "pii_detected": F.col("_p.detected") | F.col("_r.detected"),
        "pii_types": F.array_sort(F.array_union("_p.types", "_r.types")),
        "pii_count": F.col("_p.count") + F.col("_r.count"),
        "pii_confidence": F.greatest("_p.confidence", "_r.confidence"),
    }).drop("_p", "_r")


def model_approvals(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """P5: approval of the model in force at each request: the newest registration at or before it, else pending."""
    facts = ["approved_by", "risk_level", "use_case"]
    d = asof_join(requests, approvals, ["provider", "model"], "ts", facts, tie=["approved_by"])
    return d.withColumn("approval_status", F.when(F.col("approved_by").isNotNull(), "approved").otherwise("pending"))


def consent_as_of(requests: DataFrame, consents: DataFrame, erasures: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Consent of the subject in force at each request. An erasure ends it; without a record it is not given."""
    events = consents.select(subject, "ts", F.col("given").cast("boolean").alias("consent_given"), F.lit(0).alias("_rank")).unionByName(
        erasures.select(subject, "ts", F.lit(None).cast("boolean").alias("consent_given"), F.lit(1).alias("_rank")))
    d = asof_join(requests, events, [subject], "ts", ["consent_given"], tie=["_rank"])
    return d.withColumn("consent_given", F.coalesce("consent_given", F.lit(False)))


def retention_dates(facts: DataFrame, schedules: dict[str, int] = RETENTION_DAYS, policy: str = "retention_policy") -> DataFrame:
    """When personal data and the row itself are due for deletion."""
    days = F.coalesce(as_map(schedules)[F.col(policy)], F.lit(UNKNOWN_RETENTION))
    return facts.withColumns({
        "retention_days": days,
        "deletion_scheduled": F.col("ts") + F.make_dt_interval(F.lit(DATA_RETENTION_DAYS)),
        "deletion_date": F.col("ts") + F.make_dt_interval(days),
    })


def compliance_violations(facts: DataFrame) -> DataFrame:
    """A row for each rule that a request breaks."""
    def row(kind, severity, detail):
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail"))

    def when(cond, *args):
        return F.when(F.coalesce(cond, F.lit(False)), row(*args))

    found = F.filter(F.array(
        when(F.col("pii_detected") & ~F.col("consent_given"), "pii_without_consent", "high", F.array_join("pii_types", ",")),
        when(F.col("approval_status") == "pending", "unapproved_model", "medium", F.concat_ws("/", "provider", "model")),
        when(F.col("policy_violation"), "content_policy_violation", "high", F.col("violation_type")),
        when(F.col("oversight_required") & ~F.col("oversight_present"), "missing_human_oversight", "high", F.col("risk_category")),
    ), lambda x: x.isNotNull())
    return facts.select("request_id", "ts", F.explode(found).alias("v")).select("request_id", "ts", "v.*")


def apply_erasure(facts: DataFrame, erasures: DataFrame, subject: str = "subject_id", hold: str = "legal_hold") -> tuple[DataFrame, DataFrame]:
    """The rows that stay (those of other subjects and those on legal hold), and an audit row per request."""
    gone = erasures.select(hash16(F.col(subject)).alias("_gone")).distinct()
    held = F.coalesce(F.col(hold), F.lit(False))
    d = facts.withColumn("_subject", hash16(F.col(subject)))
    kept = d.join(gone, (F.col("_subject") == F.col("_gone")) & ~held, "left_anti").drop("_subject")
    audit = erasures.select(
        "ts", F.lit("delete").alias("action"), F.lit("user_data").alias("resource_type"), hash16(F.col(subject)).alias("resource_id"),
        F.col("requester_id").alias("actor"), F.lit("success").alias("outcome"), F.lit("consent").alias("processing_basis"),
    )
    return kept, audit


def compliance_summary(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """P10: events, detections and violations with their rates, approved models, subjects with consent, open violations."""
    n = F.count(F.lit(1))

    def rate(x):
        return F.when(n > 0, x / n).otherwise(F.lit(0.0))

    pii, bad = F.count_if("pii_detected"), F.count_if("policy_violation")
    open_rows = F.coalesce(F.sum(
        (F.col("pii_detected") & ~F.col("consent_given")).cast("int") + (F.col("approval_status") == "pending").cast("int")
        + F.col("policy_violation").cast("int") + (F.col("oversight_required") & ~F.col("oversight_present")).cast("int")), F.lit(0))
    return facts.groupBy(*keys).agg(
        n.alias("total_events"), pii.alias("pii_detections"), rate(pii).alias("pii_detection_rate"),
        bad.alias("policy_violations"), rate(bad).alias("violation_rate"),
        F.countDistinct(F.when(F.col("approval_status") == "approved", F.concat_ws("/", "provider", "model"))).alias("approved_models"),
        F.countDistinct(F.when(F.col("consent_given"), F.col("subject_id"))).alias("consents"),
        open_rows.alias("open_violations"),
    )


def audit_trail(events: DataFrame) -> DataFrame:
    """Access and change events with hashed e-mail and address. An empty e-mail is hashed, an empty address is not."""
    return events.withColumns({
        "actor_type": F.coalesce("actor_type", F.lit("user")),
        "outcome": F.coalesce("outcome", F.lit("success")),
        "email_hash": hash16(F.coalesce("email", F.lit(""))),
        "address_hash": F.when(F.coalesce("address", F.lit("")) != "", hash16(F.col("address"))).otherwise(""),
    }).drop("email", "address")


def audit_counts(trail: DataFrame) -> DataFrame:
    return trail.groupBy("action", "outcome").agg(F.count(F.lit(1)).alias("events"))


def consent_events(consents: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Audit rows of consent changes."""
    given = F.col("given")
    return consents.select(
        subject, "ts", "given", hash16(F.col(subject)).alias("subject_hash"),
        F.when(given, "consent").otherwise("legitimate_interest").alias("processing_basis"),
        F.when(given, "update").otherwise("delete").alias("action"),
    )


def consent_register(consents: DataFrame, subject: str = "subject_id") -> DataFrame:
    """The latest consent of each subject."""
    return consents.groupBy(subject).agg(F.max_by("given", "ts").alias("given"), F.max("ts").alias("since"))
