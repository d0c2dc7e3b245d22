"""Secret and active-payload detection and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must find what the checked corpora are checked for.
SECRET_PATTERNS = {
    "sk_key": r"\bsk-[A-Za-z0-9_-]{12,}\b",
    "ark_key": r"(?i)(?<![A-Za-z0-9_-])ark-[A-Za-z0-9][A-Za-z0-9_-]{20,127}(?![A-Za-z0-9_-])",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}",
    "assigned": r"(?i)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password)\s*[:=]\s*['\"]?[^\s'\"]{8,}",
}
ACTIVE_PATTERNS = {
    "script_tag": r"(?i)<\s*script\b",
    "script_url": r"(?i)javascript\s*:",
    "sql_statement": r"(?i)\b(?:union\s+select|drop\s+table)\b",
    "dynamic_code": r"(?i)\b(?:eval|exec)\s*\(",
    "miner": r"(?i)\b(?:stratum\+tcp|coinhive)\b",
}
REVIEWED_CODE_PATTERNS = {
    "inner_html": r"(?i)\binnerHTML\b",
    "inline_handler": r"(?i)<[^>]*\bon[A-Za-z]+\s*=\s*(?!\{)",
}
INSTRUCTION_PATTERNS = {
    "instruction_override": r"(?i)\b(ignore|disregard|override)\b.{0,48}\b(previous|prior|system|developer)\b",
    "secret_exfiltration": r"(?i)\b(read|print|reveal|send|upload|exfiltrat\w*)\b.{0,80}\b(api[_ -]?key|credential\w*|secret\w*|private[_ -]?key|\.env)\b",
    "external_command": r"(?im)(?:^|[\s`])(?:curl|wget|invoke-webrequest)\s+",
    "safety_bypass": r"(?i)\b(disable|bypass|remove|weaken)\b.{0,64}\b(safety|security|policy|guardrail|tests?)\b",
}
LOG_SECRET = r"(?i)(?<![A-Za-z0-9_-])(?:(?:sk|key)-[A-Za-z0-9_-]{8,}|ark-[A-Za-z0-9][A-Za-z0-9_-]{20,127})(?![A-Za-z0-9_-])"
PLACEHOLDER = "[DEFENSIVE_ACTIVE_CONTENT_PLACEHOLDER]"
CODE_LIMIT = 12_000
# End of fixed values.


def _any(text: Column, patterns: dict[str, str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns.values()))


def codes(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]))


def has_secret(text: Column) -> Column:
    return _any(text, SECRET_PATTERNS)


def has_active_payload(text: Column) -> Column:
    return _any(text, ACTIVE_PATTERNS)


def redacted(text: Column) -> tuple[Column, Column]:
    """(text with placeholders, how many): each pattern in turn, counted on what the one before left."""
    count = F.lit(0)
    for p in ACTIVE_PATTERNS.values():
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, PLACEHOLDER.replace("$", "\\$"))
    return text, count


def masked_log(text: Column) -> Column:
    """Log text without keys."""
    return F.regexp_replace(text, LOG_SECRET, "[REDACTED]")


def stage_violation(stage: Column, payload: Column, code: Column, reviewed: Column) -> Column:
    """The first rule that a stage's record breaks; null if it is safe.

    Secrets are refused everywhere; long code in code stages; active payloads in
    all but the code-writing stage; raw HTML sinks in what security reviewed.
    """
    return (F.when(has_secret(payload), F.lit("secret_material"))
            .when(stage.isin("frontend", "review") & (F.length(code) > CODE_LIMIT), F.lit("code_too_long"))
            .when(stage.isin("plan", "tool_policy", "security") & has_active_payload(payload), F.lit("active_payload"))
            .when((stage == "security") & _any(reviewed, REVIEWED_CODE_PATTERNS), F.lit("unsafe_reviewed_code"))
            .when((stage == "review") & has_active_payload(payload), F.lit("active_payload")))


def instruction_codes(text: Column) -> Column:
    """Names of the rules that a skill's or tool's instructions break."""
    return codes(text, INSTRUCTION_PATTERNS)
