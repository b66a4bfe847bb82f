"""Decisions on results: second OCR pass, acceptance tier, document type."""

from __future__ import annotations

from legajo.functions import checks, fixed
from legajo.functions.text import any_of, lit, nz

ACCEPTED = "accepted"


def identity_fallback(datos: str, confidence: str, text: str) -> str:
    """Reason for a second OCR pass over an identity card, or 'accepted'; the first that applies."""
    f = lambda name: nz(f"{datos}.{name}")
    upper = f"upper(coalesce({text}, ''))"
    no_place = " and ".join(f"{f(x)} is null" for x in ("domicilio", "municipio", "provincia"))
    zone = f"(contains({text}, 'IDESP') or contains({text}, '<<<'))"
    points = " + ".join(f"if({f(x)} is null, 0, 20)" for x in ("numero_documento", "nombre", "apellidos", "fecha_nacimiento", "fecha_caducidad"))
    return f"""case when not {checks.person_id_ok(f('numero_documento'))} then 'number missing or invalid'
        when {f('nombre')} is null then 'name missing' when {f('apellidos')} is null then 'surname missing'
        when {any_of(upper, fixed.BACK_WORDS)} and {no_place} and {confidence} < 70 then 'back side without address'
        when {zone} and not {any_of(upper, fixed.FRONT_WORDS)} and length({text}) < 250 and {confidence} < 70 then 'machine-readable zone only'
        when {points} < 60 then 'few fields' when {confidence} < 35 then 'low confidence' else {lit(ACCEPTED)} end"""


def vehicle_fallback(datos: str, confidence: str) -> str:
    """Reason for a second OCR pass over a vehicle registration, or 'accepted'."""
    plate = nz(f"{datos}.matricula")
    return f"""case when {plate} is null then 'plate missing' when {nz(datos + '.marca')} is null then 'brand missing'
        when {confidence} < 50 then 'low confidence' when {checks.plate_fault(plate)} is not null then 'plate invalid' else {lit(ACCEPTED)} end"""


def tier(valid: str, score: str) -> str:
    """What a client does with a result."""
    return f"case when not {valid} then 'INVALIT' when {score} >= 90 then 'ACCEPTAT' when {score} >= 70 then 'ACCEPTAT_AMB_AVIS' else 'REVISAR_MANUALMENT' end"


def doc_type(text: str) -> str:
    """Family of a text by its labels; NULL if none is told."""
    u = f"upper(coalesce({text}, ''))"
    cases = " ".join(f"when {any_of(u, words)} then {lit(family)}" for family, words in fixed.FAMILY_WORDS.items())
    return f"case {cases} end"
