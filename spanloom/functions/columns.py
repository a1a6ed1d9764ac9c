"""Column functions: ids, sampling, text measures, roles. All run inside the JVM except ``nfc_fold``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespace of URL-based version-5 ids, in hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(key: Column) -> Column:
    """The version-5 UUID of a key in the URL namespace, as text."""
    raw = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), key.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(raw, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63))).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)),
                       F.concat(variant, F.substring(raw, 19, 2)), F.substring(raw, 21, 12))


def sampled(key: Column, percent: float) -> Column:
    """True for the share of keys whose sha256, as a number, is below ``percent`` modulo 100."""
    digits = F.regexp_extract_all(F.sha2(key.cast("binary"), 256), F.lit("(.{4})"), F.lit(1))
    rest = F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 65536 + F.conv(d, 16, 10).cast("int")) % 100)
    return rest < F.lit(percent)


def repetition_ratio(text: Column) -> Column:
    """1 - distinct / all tokens in lower case; 0 under four tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("\\S+"), F.lit(0))
    n = F.size(tokens)
    return F.when(n < 4, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(tokens)) / n)


def degenerate(text: Column, most: float = 0.75) -> Column:
    """Null, blank, or repetitive text."""
    return text.isNull() | (F.trim(text) == "") | (repetition_ratio(F.trim(text)) >= most)


def judge_window(text: Column, head: int = 12 * 1024, tail: int = 4 * 1024) -> Column:
    """The first ``head`` and last ``tail`` bytes of a longer text, with the number of bytes left out between them."""
    raw = text.cast("binary")
    n = F.octet_length(text)
    # A cut inside a character loses that character's bytes on either side.
    first = F.make_valid_utf8(F.substring(raw, 1, head).cast("string"))
    last = F.make_valid_utf8(F.substring(raw, n - tail + 1, F.lit(tail)).cast("string"))
    marker = F.concat(F.lit("\n[... "), (n - head - tail).cast("string"), F.lit(" bytes ...]\n"))
    clean = lambda c: F.regexp_replace(c, "^�+|�+$", "")
    return F.when(n > head + tail, F.concat(clean(first), marker, clean(last))).otherwise(text)


# The vocabularies of roles.
VERIFIER_TOKENS = [
    "qa", "qc", "eval", "evals", "evaluate", "evaluator", "evaluation", "review", "reviews", "reviewer", "critique", "critic",
    "criticism", "verify", "verifier", "verification", "verified", "validate", "validator", "validation", "check", "checks",
    "checker", "checking", "audit", "audits", "auditor", "auditing", "gate", "gates", "gatekeeper", "gating", "judge",
    "judgement", "judgment", "adjudicator", "test", "tests", "tester", "testing", "inspect", "inspector", "inspection", "grade",
    "grader", "grading", "lint", "linter", "linting", "guard", "guardrail", "guardrails", "moderate", "moderator", "moderation",
    "approve", "approver", "approval", "assess", "assessor", "assessment", "referee", "arbiter", "arbitrator", "adjudicate",
    "scorer", "scoring", "rater", "rating", "ranker", "ranking", "screener", "screening", "examiner", "examination", "watchdog",
    "sentinel", "jury",
]
VERIFIER_PHRASES = ["quality assurance", "quality control", "fact check", "red team", "peer review", "code review", "acceptance test"]
VERIFIER_STEMS = ["verif", "validat", "review", "audit", "critic", "evaluat", "inspect"]
PLANNER_PREFIXES = [
    "think", "plan", "orchestrat", "rout", "coordinat", "supervis", "dispatch", "manag", "delegat", "schedul", "triage",
    "director", "controll",
]
RETRIEVER_PREFIXES = [
    "collect", "fetch", "retriev", "gather",
]


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name, cut at separators and at humps (qaGate: qa, gate)."""
    humps = F.regexp_replace(F.coalesce(name, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(humps, "[^0-9a-zA-Z]+", " ")), " "), lambda t: t != "")


def is_verifier(name: Column) -> Column:
    tokens = name_tokens(name)
    phrase = F.array_join(tokens, " ").rlike("|".join(VERIFIER_PHRASES))
    stem = F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(VERIFIER_STEMS))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, VERIFIER_TOKENS))) | phrase | stem


def _any_prefix(name: Column, prefixes: list[str]) -> Column:
    return F.exists(name_tokens(name), lambda t: t.rlike(f"^(?:{'|'.join(prefixes)})"))


def is_planner(name: Column) -> Column:
    return _any_prefix(name, PLANNER_PREFIXES)


def is_retriever(name: Column) -> Column:
    return _any_prefix(name, RETRIEVER_PREFIXES)


def role(name: Column, deliverable: Column | None = None) -> Column:
    """verifier, planner, deliverable, retriever or intermediate, the first that fits."""
    produces = F.lit(False) if deliverable is None else F.coalesce(deliverable, F.lit(False))
    return F.when(is_verifier(name), "verifier").when(is_planner(name), "planner").when(produces, "deliverable").when(is_retriever(name), "retriever").otherwise("intermediate")


def glob_regex(glob: Column) -> Column:
    """A version glob (* and ?) as an anchored pattern."""
    quoted = F.regexp_replace(glob, "([\\\\.^$|()\\[\\]{}+])", "\\\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


@F.pandas_udf(T.StringType())
def nfc_fold(text: pd.Series) -> pd.Series:
    """Canonical composition and case folding, which no built-in function has. Arrow batches."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Rate and its Wilson interval; null without observations."""
    n = F.when(n > 0, n)
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return p, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)), F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n))
