"""Vehicle registrations: fields behind coded labels (D.1, P.2, ...) and their validation.

Blank lines are dropped first, so the value of a label is the next line. Branches are independent: several may apply to one
line; the last label wins unless noted. ``as_of`` is the day that counts as today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import checks, dates, fixed
from legajo.functions.text import all_matches, array, first, first_word, group, in_range, indexes, kept_lines, last, lit, matches, nz, present
from legajo.operators import rules
from legajo.operators.stages import as_struct, null, with_exprs

TYPES = {"cilindrada_cc": "int", "potencia_kw": "double", "potencia_fiscal": "double", "emissions_co2": "double", "masa_maxima": "int", "masa_orden_marcha": "int", "plazas": "int"}
FIELDS = (
    "numero_permiso", "matricula", "numero_bastidor", "marca", "modelo", "variante_version", "categoria", "fecha_matriculacion",
    "fecha_primera_matriculacion", "fecha_expedicion", "titular_nombre", "titular_nif", "domicilio", "municipio", "provincia", "codigo_postal",
    "servicio", "cilindrada_cc", "potencia_kw", "potencia_fiscal", "combustible", "emissions_co2", "masa_maxima", "masa_orden_marcha", "plazas",
    "tipo_vehiculo", "fecha_ultima_transferencia", "proxima_itv", "observaciones",
)


def code(*parts: str) -> str:
    """Pattern of a field code, with or without dots and blanks: code('C', '1', '1')."""
    return r"\b" + r"\.?\s*".join(parts) + r"\b"


def at(label: str) -> str:
    """Indexes of the lines ``u`` for which the label condition holds."""
    return f"filter({indexes('_ln')}, i -> exists(array(get(_up, i)), u -> {label}))"


def values(label: str, value: str) -> str:
    """``value`` of the line ``i`` and the next line ``v`` for each label, NULLs dropped."""
    pairs = f"transform({at(label)}, i -> named_struct('i', i, 'v', get(_ln, i + 1)))"
    return present(f"transform({pairs}, p -> {value})")


def coded(parts: tuple[str, ...], value: str) -> str:
    return last(values(matches("u", code(*parts)), value))


def number(v: str, pattern: str, kind: str, low: float, high: float) -> str:
    return in_range(group(v, pattern), kind, low, high)


def skipping(labels: tuple[str, ...]) -> str:
    """The next line, or the one after it if the next is a sub-label."""
    return f"if(upper(p.v) in ({', '.join(map(lit, labels))}), get(_ln, p.i + 2), p.v)"


def power() -> str:
    """Kilowatts (P.2) line by line; horsepower counts while nothing is there."""
    kw = number("p.v", r"(?iu)^(\d+\.?\d*)\s*(?:kW)?$", "double", 1, 1000)
    cv = number("p.v", r"(?iu)^(\d+\.?\d*)\s*(?:CV|HP)?$", "double", 1, 1500)
    is_kw = f"({matches('p.u', code('P', '2'))} or {matches('p.u', r'\bP\s*\.?\s*2\b')})"
    lines_ = f"transform({indexes('_ln')}, i -> named_struct('u', get(_up, i), 'v', get(_ln, i + 1)))"
    both = f"transform({lines_}, p -> named_struct('k', if({is_kw}, {kw}, null), 'c', if({matches('p.u', r'\b(CV|HP)\b')}, {checks.kw_from_cv(cv)}, null)))"
    return f"aggregate({both}, {null('double')}, (n, p) -> coalesce(p.k, n, p.c))"


def model() -> str:
    """Model behind D.3 among up to five lines: one with the brand known so far, else the first of the first label."""
    brand = first_word(fixed.BRANDS, "upper(get(_ln, i + 1))")
    brands = present(f"transform({at(matches('u', code('D', '1')))}, i -> named_struct('i', i, 'b', {brand}))")
    so_far = f"try_element_at(filter({brands}, b -> b.b is not null and b.i <= m), -1).b"
    usable = f"filter(slice(_ln, m + 2, 5), c -> not {matches('c', '[/(*]')} and {matches('c', r'^[A-Za-z0-9 \-.]{3,40}$')})"
    labels = f"transform({at(matches('u', code('D', '3')))}, m -> named_struct('b', {so_far}, 'c', {usable}))"
    tried = f"transform({labels}, l -> named_struct('b', get(filter(l.c, c -> contains(upper(c), l.b)), 0), 'f', get(l.c, 0)))"
    return f"aggregate({tried}, {null()}, (n, l) -> coalesce(l.b, n, l.f))"


def extract(df: DataFrame, as_of: str = "current_date()") -> DataFrame:
    """``df`` (text) with ``datos``. ``as_of`` is not needed here and taken for the other families' sake."""
    names = df.columns
    df = df.withColumn("_text", F.coalesce("text", F.lit("")))
    df = with_exprs(df, {"_ln": kept_lines("_text")})
    df = with_exprs(df, {"_up": "transform(_ln, l -> upper(l))"})
    plate = f"coalesce({group('_text', r'\b(\d{4}[A-Z]{3})\b')}, {group('_text', r'\b([A-Z]{1,2}\d{4}[A-Z]{2})\b')})"
    holder = f"if(not {matches('upper(p.v)', r'\bC\.?\s*1\b')}, p.v, null)"
    owner = checks.id_fixed("p.v")
    cc = f"if({matches('p.v', r'^\(?\d\.\d\)?$')}, coalesce(get(_ln, p.i + 2), p.v), p.v)"
    province = f"get(filter(_ln, l -> upper(l) in ({', '.join(map(lit, fixed.VEHICLE_PROVINCES))})), 0)"
    remarks = last(f"transform(filter({at("contains(u, 'OBSERVACION') or contains(u, 'OBSERVACIÓ')")}, i -> i + 1 < size(_ln)), i -> array_join(slice(_ln, i + 2, 5), ' '))")
    any_brand = f"get(filter({array(fixed.BRANDS)}, b -> regexp_like(_text, concat('(?iu)\\\\b\\\\Q', b, '\\\\E\\\\b'))), 0)"
    df = with_exprs(
        df,
        {
            "_plate": plate,
            "_vin": group("_text", r"\b([A-HJ-NPR-Z0-9]{17})\b"),
            "_brand": f"coalesce({coded(('D', '1'), first_word(fixed.BRANDS, 'upper(p.v)'))}, {any_brand})",
            "_variant": coded(("D", "2"), f"if({matches('p.v', '[/(]')}, p.v, null)"),
            "_model": model(),
            "_cc": coded(("P", "1"), number(cc, r"^(\d{3,5})$", "int", 50, 10000)),
            "_kw": power(),
            "_fuel": coded(("P", "3"), f"if({matches('upper(p.v)', '^[A-ZÁÉÍÓÚÜ/ ]{3,20}$')}, upper(p.v), null)"),
            "_co2": last(values(f"({matches('u', code('V', '7'))} or {matches('u', r'\bV\s*\.?\s*7\b')})", number("p.v", r"(?iu)^(\d+\.?\d*)\s*(?:g/km)?$", "double", 0, 999))),
            "_most": coded(("F", "1"), number(skipping(("B",)), r"^(\d{3,5})$", "int", 500, 50000)),
            "_kerb": last(values(f"({matches('u', r'^G\s*$')} or {matches('u', r'\bG\s+I\b')})", number(skipping(("I", "1")), r"^(\d{3,5})$", "int", 300, 20000))),
            "_seats": coded(("S", "1"), number("p.v", r"^(\d{1,2})$", "int", 1, 100)),
            "_surname": coded(("C", "1", "1"), holder),
            "_name": coded(("C", "1", "2"), holder),
            "_owner": coded(("C", "1", "3"), f"if({matches(owner, checks.DNI)} or {matches(owner, checks.NIE)}, {owner}, null)"),
            "_itv": last(present(f"transform({at("contains(u, 'PROXIMA ITV') or contains(u, 'PRÓXIMA ITV')")}, i -> {dates.any_iso('get(_ln, i)')})")),
            "_remarks": remarks,
            "_province": province,
            "_date": first(present(f"transform({all_matches('_text', r'\d{2}[-/.]\d{2}[-/.]\d{4}')}, d -> {dates.any_iso('d')})")),
        },
    )
    plain = f"get(filter(_ln, l -> contains(upper(l), upper(_brand)) and length(l) > length(_brand) + 2 and not {matches('l', '[/()*]')}), 0)"
    category = "case when _seats <= 9 then 'M1' when _seats <= 16 then 'M2' end"
    fields = {k: null(TYPES.get(k, "string")) for k in FIELDS} | {
        "matricula": checks.plate_fixed("_plate"),
        "numero_bastidor": "_vin",
        "marca": "_brand",
        "modelo": f"coalesce(_model, {plain})",
        "variante_version": "_variant",
        "categoria": category,
        "fecha_matriculacion": "_date",
        "titular_nombre": "if(_name is not null and _surname is not null, _name || ' ' || _surname, coalesce(_surname, _name))",
        "titular_nif": "_owner",
        "provincia": "_province",
        "servicio": "'PARTICULAR'",
        "cilindrada_cc": "_cc",
        "potencia_kw": "_kw",
        "combustible": "_fuel",
        "emissions_co2": "_co2",
        "masa_maxima": "_most",
        "masa_orden_marcha": "_kerb",
        "plazas": "_seats",
        "tipo_vehiculo": checks.vehicle_type(category),
        "proxima_itv": "_itv",
        "observaciones": nz("_remarks"),
    }
    return with_exprs(df, {"datos": as_struct(fields)}).select(*[c for c in names if c != "datos"], "datos")


def validate(df: DataFrame, as_of: str = "current_date()") -> DataFrame:
    """``df`` (datos, ocr_engine, ocr_confidence) with the result columns."""
    names, today = df.columns, f"date_format({as_of}, 'yyyy-MM-dd')"
    d = lambda f: nz(f"datos.{f}") if f not in TYPES else f"datos.{f}"
    plate, vin, owner, brand, model_ = d("matricula"), d("numero_bastidor"), d("titular_nif"), d("marca"), d("modelo")
    reg, first_reg, issued = d("fecha_matriculacion"), d("fecha_primera_matriculacion"), d("fecha_expedicion")
    fault, vin_faults = checks.plate_fault(plate), checks.vin_faults(vin)
    known = "map(" + ", ".join(f"{lit(k)}, {array(v)}" for k, v in fixed.MODELS.items()) + ")"
    models = f"try_element_at({known}, upper({brand}))"
    kw, cc, most, kerb = (f"datos.{f}" for f in ("potencia_kw", "cilindrada_cc", "masa_maxima", "masa_orden_marcha"))
    ratio = f"try_divide({kw}, {cc})"
    bad_vin = lambda e, message: rules.finding(f"coalesce(array_contains({vin_faults}, '{e}'), false)", "VEH_VIN_INVALID_CHARS", "critical", "numero_bastidor", message, vin)
    absent = lambda x, f, s, message: rules.finding(f"{x} is null", "VEH_MISSING_FIELD", s, f, message)
    dated = lambda when, s, f, message, evidence: rules.finding(f"coalesce({when}, false)", "VEH_DATES_INCONSISTENT", s, f, message, evidence)
    errors = [
        rules.finding(f"{fault} is not null and {plate} is not null", "VEH_PLATE_INVALID", "critical", "matricula", "plate is not four digits and three consonants", plate, "check the plate by eye"),
        absent(plate, "matricula", "critical", "no plate found"),
        bad_vin("length", "a VIN has 17 characters"),
        bad_vin("forbidden", "a VIN has no I, O or Q"),
        bad_vin("charset", "characters that no VIN has"),
        rules.finding(f"{owner} is not null and not {checks.owner_id_ok(owner)}", "VEH_OWNER_ID_INVALID", "error", "titular_nif", "control letter or format of the holder's id is wrong", owner, "check the holder's id by eye"),
        dated(f"{reg} < '1970-01-01' or {reg} > {today}", "error", "fecha_matriculacion", "registration date out of range", reg),
        dated(f"{kerb} > {most} and {most} > 0", "error", "masa_orden_marcha", "kerb mass above the maximum mass", f"{kerb} || ' > ' || {most}"),
        absent(brand, "marca", "critical", "no brand found"),
    ]
    alerts = [
        rules.finding(f"{vin} is not null and coalesce({checks.vin_check_differs(vin)}, false)", "VEH_VIN_CHECKDIGIT", "warning", "numero_bastidor", "check digit of the VIN differs, as is common outside North America", vin),
        absent(vin, "numero_bastidor", "error", "no VIN found"),
        dated(f"{first_reg} > {reg}", "warning", "fecha_primera_matriculacion", "first registration after the registration", f"{first_reg} || ' > ' || {reg}"),
        dated(f"{issued} < {reg}", "warning", "fecha_expedicion", "issued before the registration", f"{issued} || ' < ' || {reg}"),
        rules.finding(f"{model_} is not null and {models} is not null and not exists({models}, m_ -> contains(upper({model_}), m_))", "VEH_OCR_SUSPECT", "warning", "modelo", "model unknown for the brand", model_, "rare model or misread, check by eye"),
        rules.finding(f"coalesce({kw} > 0 and {cc} > 0 and not {ratio} between 0.02D and 0.20D, false)", "VEH_OCR_SUSPECT", "warning", "potencia_kw", "unusual power for the displacement", f"{kw} || ' kW / ' || {cc} || ' cc'"),
        absent(d("titular_nombre"), "titular_nombre", "error", "no holder found"),
    ]
    lost = rules.missing([f"datos.{f}" for f in ("matricula", "numero_bastidor", "marca", "modelo", "titular_nombre")])
    df = with_exprs(df, {"_errors": rules.collected(errors), "_alerts": rules.collected(alerts), "_missing": lost})
    power_ = f"if({kw} > 0 and coalesce(datos.potencia_fiscal, 0) = 0, {checks.fiscal_power(kw)}, datos.potencia_fiscal)"
    data = as_struct({k: f"datos.{k}" for k in FIELDS} | {"potencia_fiscal": power_})
    out = rules.envelope("permiso_circulacion", data, f"{rules.no_critical('_errors')} and {plate} is not null and {brand} is not null")
    out["error"] = null()
    return df.select(*[c for c in names if c not in out], *[F.expr(e).alias(k) for k, e in out.items()])
