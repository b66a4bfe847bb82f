"""Findings, score and verdict: each rule is a nullable struct, a list of findings is the array of those that apply."""

from __future__ import annotations

from legajo.functions import checks
from legajo.functions.text import lit, nz

FINDING = "struct<code:string,severity:string,field:string,message:string,evidence:string,suggested_fix:string>"


def finding(when: str, code: str, severity: str, field: str, message: str, evidence: str = "cast(null as string)", fix: str | None = None) -> str:
    """The finding if the condition ``when`` holds, else NULL."""
    fix_ = lit(fix) if fix else "cast(null as string)"
    return f"if({when}, named_struct('code', {lit(code)}, 'severity', {lit(severity)}, 'field', {lit(field)}, 'message', {lit(message)}, 'evidence', {evidence}, 'suggested_fix', {fix_}), null)"


def collected(findings: list[str]) -> str:
    if not findings:
        return f"cast(array() as array<{FINDING}>)"
    return f"filter(array({', '.join(findings)}), f_ -> f_ is not null)"


def count_of(array_: str, severity: str) -> str:
    return f"size(filter({array_}, f_ -> f_.severity = {lit(severity)}))"


def missing(fields: list[str]) -> str:
    """How many of the fields are NULL or empty."""
    return " + ".join(f"if({nz(f)} is null, 1, 0)" for f in fields)


def score(errors: str, alerts: str, missing_: str, confidence: str) -> str:
    counts = [f"{count_of(errors, s)} + {count_of(alerts, s)}" for s in ("critical", "error", "warning")]
    return checks.score(*counts, missing_, confidence)


def no_critical(errors: str) -> str:
    return f"not exists({errors}, f_ -> f_.severity = 'critical')"


def envelope(kind: str, data: str, valid: str, good: str = "document processed", bad: str = "document needs review") -> dict[str, str]:
    """Columns of a result row; expects columns _errors, _alerts, _missing, ocr_engine and ocr_confidence."""
    return {
        "valido": valid,
        "confianza_global": score("_errors", "_alerts", "_missing", "ocr_confidence"),
        "tipo_documento": lit(kind),
        "datos": data,
        "alertas": "_alerts",
        "errores_detectados": "_errors",
        "raw": "named_struct('ocr_engine', ocr_engine, 'ocr_confidence', bround(cast(ocr_confidence as double), 1))",
        "meta": f"named_struct('success', {valid}, 'message', '[' || ocr_engine || '] ' || if({valid}, {lit(good)}, {lit(bad)}))",
    }
