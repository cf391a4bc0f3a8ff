"""Text expressions: prompt and response analysis (C1-C12) and personal data.

All are native column expressions. Patterns use ASCII classes; letters fold case by ``lower``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts of a clear instruction.
INSTRUCTION_STARTS = ("please", "can you", "write", "explain", "create", "help")
# Words of each intent, tried in this order.
INTENT_WORDS = (
    ("coding", ("code", "function", "program", "script", "debug", "fix this")),
    ("creative", ("write a story", "poem", "creative", "imagine")),
    ("translation", ("translate", "translation", "in french", "in spanish")),
    ("summarization", ("summarize", "summary", "tldr", "brief")),
    ("analysis", ("analyze", "analysis", "explain why", "compare")),
)
# How questions start, and what asks for something.
QUESTION_STARTS = ("what", "who", "where", "when", "why", "how")
INSTRUCTION_WORDS = ("please", "can you", "would you", "help me")
# Personal data in prompts and responses. The patterns name both cases, so case needs no flag.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}",
    "ssn": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "credit_card": r"\b\d{4}[-]?\d{4}[-]?\d{4}[-]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "date_of_birth": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
}
# What a text must hold for the pattern to match somewhere; most texts hold none of it.
PII_SIGNS = {"email": "@", "phone": r"\d{3}", "ssn": r"\d{3}", "credit_card": r"\d{4}", "ip_address": r"\d\.\d", "date_of_birth": r"\d[/-]\d"}
PROMPT_PII = ("email", "phone", "ssn", "credit_card", "ip_address")
# Longer numbers go first, so that a card number is not cut up by the phone pattern.
REDACTION_ORDER = ("email", "credit_card", "ssn", "ip_address", "date_of_birth", "phone")
# Prompt injection and jailbreak.
INJECTION_PATTERNS = (
    r"ignore\s+(previous|all|above)\s+instructions",
    r"disregard\s+(previous|all)\s+",
    r"system\s*:\s*you\s+are",
    r"pretend\s+you\s+are",
    r"act\s+as\s+(if|a)\s+",
    r"\[INST\]|\[/INST\]",
    r"<\|im_start\|>|<\|im_end\|>",
)
JAILBREAK_PATTERNS = (
    r"dan\s*mode", r"developer\s*mode", r"jailbreak", r"bypass\s+(safety|filter|restriction)",
    r"evil\s*mode", r"uncensored\s*mode", r"no\s*restrictions",
)
# Code in a response.
CODE_PATTERNS = (
    r"```[\s\S]*?```", r"def\s+\w+\s*\(", r"class\s+\w+\s*[:\(]", r"function\s+\w+\s*\(", r"import\s+\w+",
    r"from\s+\w+\s+import",
)
# Phrases of a refusal.
REFUSAL_PHRASES = (
    "i cannot", "i can't", "i'm not able to", "i am not able to", "i won't", "i will not", "i'm unable to",
    "as an ai", "as a language model", "against my guidelines", "violates my policy",
)
# Weights of the overall quality.
QUALITY_WEIGHTS = {"fluency": 0.15, "coherence": 0.20, "relevance": 0.25, "completeness": 0.20, "helpfulness": 0.20}
# Markers of an unfounded answer and their weights; claims.
HALLUCINATION_MARKERS = (
    (r"according to\s+(?!the|my|your)", 0.3),
    (r"studies show|research shows", 0.2),
    (r"\d+%\s+of\s+people", 0.3),
    (r"in\s+\d{4}(?:\s|,)", 0.2),
    (r"dr\.|professor\s+\w+", 0.2),
)
CLAIM_PATTERNS = (
    r"(?:is|are|was|were)\s+(?:a|an|the)?\s*(\w+(?:\s+\w+){0,3})",
    r"(\d+(?:\.\d+)?(?:%|percent))",
)
HALLUCINATION_THRESHOLD = 0.8
# Phrases of bias per category, positive then negative.
BIAS_PHRASES = {
    "gender": (
        ("women are better at", "men are better at", "female employees", "male employees"),
        ("women can't", "men can't", "women shouldn't", "men shouldn't"),
    ),
    "age": (
        ("young people are more", "older people are wiser"), ("too old to", "too young to", "millennials are"),
    ),
    "race": ((), ("typical of", "always do", "people like them")),
}
BIAS_CATEGORIES = ("gender", "race", "age", "religion", "political")
BIAS_THRESHOLD = 0.3
# Patterns of toxicity per category.
TOXICITY_PATTERNS = {
    "hate_speech": (r"\b(hate|despise)\s+(all|every)\s+\w+", r"\b(inferior|superior)\s+race"),
    "harassment": (r"\byou\s+(idiot|moron|stupid)", r"\bshut\s+up\b"),
    "violence": (r"\b(kill|murder|attack)\s+(you|them|him|her)", r"\bviolent\s+action"),
    "profanity": (r"\b(damn|hell)\b",),
}
TOXICITY_THRESHOLD = 0.5
# Words of sentiment.
POSITIVE_WORDS = ("good", "great", "excellent", "amazing", "wonderful", "happy", "love", "best")
NEGATIVE_WORDS = ("bad", "terrible", "awful", "horrible", "sad", "hate", "worst", "poor")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return _any([text.contains(p) for p in phrases])


def _matches_any(text: Column, patterns: Sequence[str], flags: str = "(?i)") -> Column:
    return _any([text.rlike(flags + p) for p in patterns])


def _at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def _add(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def prompt_scores(prompt: Column) -> Column:
    """Complexity (share of distinct words) and clarity (question mark, clear start)."""
    w = words(prompt)
    low = F.lower(prompt)
    clear = _any([low.startswith(s) for s in INSTRUCTION_STARTS])
    distinct = F.size(F.array_distinct(F.transform(w, F.lower)))
    return F.struct(
        F.least(F.lit(1.0), distinct / _at_least_one(F.size(w))).alias("complexity_score"),
        (F.lit(0.5) + F.when(prompt.contains("?"), 0.25).otherwise(0.0) + F.when(clear, 0.25).otherwise(0.0)).alias("clarity_score"),
    )


def classify_intent(prompt: Column) -> Column:
    """First group of words that occurs."""
    low = F.lower(prompt)
    out = F.when(_contains_any(low, INTENT_WORDS[0][1]), INTENT_WORDS[0][0])
    for name, group in INTENT_WORDS[1:]:
        out = out.when(_contains_any(low, group), name)
    out = out.when(prompt.contains("?") | _any([low.startswith(s) for s in QUESTION_STARTS]), "question")
    return out.when(_contains_any(low, INSTRUCTION_WORDS), "instruction").otherwise("other")


def prompt_risk_flags(prompt: Column) -> Column:
    """Personal data, injection and jailbreak attempts."""
    return F.struct(
        _matches_any(prompt, [PII_PATTERNS[k] for k in PROMPT_PII], "").alias("contains_pii"),
        _matches_any(prompt, INJECTION_PATTERNS).alias("injection_attempt"),
        _matches_any(prompt, JAILBREAK_PATTERNS).alias("jailbreak_attempt"),
    )


def response_shape(response: Column) -> Column:
    """C4: words, groups of sentence marks, reading level by mean word length."""
    w = words(response)
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    mean = letters / _at_least_one(F.size(w))
    return F.struct(
        F.size(w).alias("word_count"),
        F.regexp_count(response, F.lit("[.!?]+")).alias("sentence_count"),
        F.when(mean < 4, "elementary").when(mean < 5, "middle_school").when(mean < 6, "high_school")
        .when(mean < 7, "college").otherwise("graduate").alias("reading_level"),
    )


def response_format(response: Column) -> Column:
    """Form of the response and whether it has code."""
    fence = response.contains("```")
    form = (
        F.when(fence, "code_block").when(response.rlike(r"(?md)^\s*[-*]\s"), "list")
        .when(response.rlike(r"(?md)^\s*\d+\.\s"), "numbered_list").when(response.rlike(r"(?md)^\s*#"), "markdown").otherwise("text")
    )
    return F.struct(form.alias("format_type"), (fence | _matches_any(response, CODE_PATTERNS, "")).alias("contains_code"))


def response_flags(response: Column) -> Column:
    """Addresses and refusal."""
    refusal = _contains_any(F.lower(response), REFUSAL_PHRASES)
    return F.struct(
        response.rlike(r"https?://\S+").alias("contains_urls"), refusal.alias("refusal"),
        F.when(refusal, "content_policy").alias("refusal_reason"),
    )


def quality_scores(prompt: Column, response: Column) -> Column:
    """Fluency, coherence, relevance, completeness, helpfulness and the weighted overall; accuracy stays 0."""
    first = F.substring(response, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    sentences = F.split(response, "[.!?]+", -1)
    per_sentence = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(words(s))) / _at_least_one(F.size(sentences))
    asked = F.array_distinct(words(F.lower(prompt)))
    shared = F.size(F.array_intersect(asked, words(F.lower(response))))
    ratio = F.length(response) / _at_least_one(F.length(prompt))
    structured = response.contains("```") | response.rlike(r"(?md)^\s*[-*]") | response.rlike(r"(?md)^\s*\d+\.")
    scores = {
        "fluency": F.lit(0.5) + F.when(response.rlike(r"[.!?]\s*\z"), 0.25).otherwise(0.0) + F.when(capital, 0.25).otherwise(0.0),
        "coherence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.lit(15) - per_sentence) / 30)),
        "relevance": F.least(F.lit(1.0), shared / _at_least_one(F.size(asked))),
        "completeness": F.least(F.lit(1.0), ratio / 2),
        "helpfulness": F.lit(0.6) + F.when(structured, 0.4).otherwise(0.0),
    }
    overall = _add([scores[k] * F.lit(w) for k, w in QUALITY_WEIGHTS.items()])
    return F.struct(*[c.alias(f"{k}_score") for k, c in scores.items()], F.lit(0.0).alias("accuracy_score"), overall.alias("overall_score"))


def hallucination_markers(response: Column, unsupported: Column | None = None, threshold: float = HALLUCINATION_THRESHOLD) -> Column:
    """Marker score, whether it passes the threshold, severity; claims without support add 0.2 each."""
    raw = _add([F.when(response.rlike("(?i)" + p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in HALLUCINATION_MARKERS])
    claims = F.size(unsupported) if unsupported is not None else F.lit(0)
    score = F.least(F.lit(1.0), raw + claims * F.lit(0.2))
    found = score > threshold
    return F.struct(
        score.alias("confidence"), found.alias("detected"),
        F.when(found & (claims > 0), "factual").when(found, "fabrication").alias("type"),
        F.when(found & (score > 0.8), "high").when(found & (score > 0.6), "medium").when(found, "low").alias("severity"),
    )


def unsupported_claims(response: Column, sources: Column) -> Column:
    """Claims of the response that the joined sources of its request do not contain; none without sources."""
    known = F.lower(F.array_join(sources, " "))
    claims = F.concat(*[F.regexp_extract_all(response, F.lit("(?i)" + p), 1) for p in CLAIM_PATTERNS])
    lost = F.filter(claims, lambda c: ~F.contains(known, F.lower(c)))
    return F.when(F.size(sources) > 0, lost).otherwise(F.array().cast("array<string>"))


def bias_scores(response: Column, categories: Sequence[str] = BIAS_CATEGORIES, threshold: float = BIAS_THRESHOLD) -> Column:
    """Hit categories with score, direction and phrases; the overall score and whether it passes the threshold."""
    low = F.lower(response)

    def hits(phrases):
        return F.filter(F.array(*[F.lit(p) for p in phrases]).cast("array<string>"), lambda p: F.contains(low, p))

    found, total = [], []
    for name, (positive, negative) in BIAS_PHRASES.items():
        if name not in categories:
            continue
        good, bad = hits(positive), hits(negative)
        score = (F.size(good) + F.size(bad)) * F.lit(0.5)
        total.append(score)
        found.append(F.when(score > 0, F.struct(
            F.lit(name).alias("category"), F.least(F.lit(1.0), score).alias("score"),
            F.when(F.size(bad) > 0, "negative").otherwise("positive").alias("direction"), F.concat(good, bad).alias("examples"))))
    overall = F.least(F.lit(1.0), _add(total))
    return F.struct(
        F.filter(F.array(*found), lambda x: x.isNotNull()).alias("categories"), overall.alias("overall_score"),
        (overall > threshold).alias("detected"),
    )


def toxicity_scores(response: Column, threshold: float = TOXICITY_THRESHOLD) -> Column:
    """C11: hit categories with score and flag; overall score, whether it passes the threshold, and the action."""
    low = F.lower(response)
    found, total = [], []
    for name, patterns in TOXICITY_PATTERNS.items():
        score = _add([F.when(low.rlike(p), 0.5).otherwise(0.0) for p in patterns])
        total.append(score)
        found.append(F.when(score > 0, F.struct(
            F.lit(name).alias("category"), F.least(F.lit(1.0), score).alias("score"), (score > threshold).alias("flagged"))))
    overall = F.least(F.lit(1.0), _add(total))
    return F.struct(
        F.filter(F.array(*found), lambda x: x.isNotNull()).alias("categories"), overall.alias("overall_score"),
        (overall > threshold).alias("detected"),
        F.when(overall > 0.8, "blocked").when(overall > 0.5, "flagged").otherwise("allowed").alias("action_taken"),
    )


def sentiment(text: Column) -> Column:
    """Label and signed share of sentiment words."""
    w = words(F.lower(text))
    good = F.size(F.filter(w, lambda x: x.isin(*POSITIVE_WORDS)))
    bad = F.size(F.filter(w, lambda x: x.isin(*NEGATIVE_WORDS)))
    n = _at_least_one(F.size(w))
    label = F.when(good + bad == 0, "neutral").when(good > bad, "positive").when(bad > good, "negative").otherwise("mixed")
    score = F.when(good > bad, good / n).when(bad > good, -(bad / n)).otherwise(F.lit(0.0))
    return F.struct(label.alias("label"), score.alias("score"))


def _shows(text: Column, kind: str) -> Column:
    """Whether the text holds the sign without which the kind's pattern can't match."""
    sign = PII_SIGNS[kind]
    return F.contains(text, F.lit(sign)) if len(sign) == 1 else text.rlike(sign)


def detect_pii(text: Column) -> Column:
    """Types found, number of matches over all types, and a confidence of 0.2 per match."""
    def count(k: str) -> Column:
        return F.when(~_shows(text, k), 0).otherwise(F.regexp_count(text, F.lit(PII_PATTERNS[k])))

    counts = F.struct(*[count(k).alias(k) for k in PII_PATTERNS])

    def summary(c):
        n = _add([c[k] for k in PII_PATTERNS])
        found = F.filter(F.array(*[F.when(c[k] > 0, F.lit(k)) for k in PII_PATTERNS]), lambda x: x.isNotNull())
        return F.struct(
            (n > 0).alias("detected"), found.alias("types"), n.alias("count"), F.least(F.lit(1.0), n * F.lit(0.2)).alias("confidence"),
        )

    return _let(counts, summary)


def redact_pii(text: Column, method: str = "mask", compat_order: bool = False) -> Column:
    """Matches masked, removed or replaced by the start of their hash; ``compat_order`` tries phone second."""
    if method not in ("mask", "remove", "hash"):
        raise ValueError(f"unknown method {method}")
    out = text
    for name in (tuple(PII_PATTERNS) if compat_order else REDACTION_ORDER):
        out = _let(out, functools.partial(_redacted, name, method))
    return out


def _redacted(name: str, method: str, text: Column) -> Column:
    p = PII_PATTERNS[name]
    new = _hash_matches(text, p) if method == "hash" else F.regexp_replace(text, p, "[REDACTED]" if method == "mask" else "")
    return F.when(_shows(text, name), new).otherwise(text)


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in several places."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash_matches(text: Column, pattern: str) -> Column:
    def token(m):
        return F.concat(F.lit("["), F.substring(F.sha2(m, 256), 1, 16), F.lit("]"))

    def replaced(t):
        between = F.split(t, pattern, -1)
        tokens = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), token)
        joined = F.zip_with(between, tokens, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(joined, "")).otherwise(t)

    return _let(text, replaced)
