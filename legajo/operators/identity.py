"""Identity cards (DNI, NIE): fields from the machine-readable zone and labelled lines, and their validation.

``extract`` adds ``datos`` and ``raw_mrz``; ``validate`` adds the result columns. Both are projections without a shuffle.
``as_of`` is the day that counts as today. Faithful to line-wise reading: labels are substrings, one branch applies to a line in a
fixed order, and later lines overwrite earlier ones, also with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import checks, dates, fixed
from legajo.functions.text import W, all_matches, any_of, first, gather, group, indexes, last, last_line_with, lines, lit, matches, nz, present, split_keeping, strip, sub, upto, without_leading_letter, without_mixed_tokens
from legajo.operators import rules
from legajo.operators.stages import as_struct, null, with_exprs

FIELDS = (
    "numero_documento", "tipo_numero", "nombre", "apellidos", "nombre_completo", "sexo", "nacionalidad", "fecha_nacimiento",
    "fecha_expedicion", "fecha_caducidad", "domicilio", "calle", "numero", "piso_puerta", "municipio", "provincia", "codigo_postal",
    "nombre_padre", "nombre_madre", "lugar_nacimiento", "soporte_numero",
)
MRZ = ("raw", "document_number", "surname", "name", "nationality", "birth_date", "expiry_date", "sex")
NUMBER = r"\d{8}[A-Z]|[XYZ]\d{7}[A-Z]"
DATE = r"(\d{2})[\s/](\d{2})[\s/](\d{4})"
#: Fields that the text adds to a record from the machine-readable zone.
FROM_TEXT = ("domicilio", "calle", "numero", "piso_puerta", "municipio", "provincia", "lugar_nacimiento", "nombre_padre", "nombre_madre")


def has(*words: str) -> str:
    return "(" + " or ".join(f"contains(u, {lit(w)})" for w in words) + ")"


def line_kind() -> str:
    """Branch of an upper-cased line ``u``."""
    family = has("PADRE", "PARE", "MADRE", "MARE")
    cases = [
        (has("APELLIDOS", "COGNOMS"), "surname"),
        (f"{has('NOMBRE', 'NOM')} and {family}", "none"),
        (has("NOMBRE", "NOM"), "name"),
        (f"({matches('u', 'D[O0]MICILI[O0]')} or {has('DOMICILI')}) and not {has('LUGAR', 'LLOC')}", "address"),
        (f"({has('FECHA')} and {has('NACIMIENTO')}) or ({has('DATA')} and {has('NAIXEMENT')})", "birth"),
        (f"{has('NACIMIENTO', 'NAIXEMENT')} and not {has('FECHA', 'DATA', 'LUGAR', 'LLOC')}", "born"),
        (has("VALIDEZ", "VALIDESA"), "expiry"),
        (has("SEXO", "SEXE"), "sex"),
        (has("NACIONALIDAD", "NACIONALITAT"), "nation"),
        (f"({has('LUGAR')} and {has('NACIMIENTO')}) or ({has('LLOC')} and {has('NAIXEMENT')})", "place"),
        (has("PADRE", "PARE"), "father"),
        (has("MADRE", "MARE"), "mother"),
    ]
    return "case " + " ".join(f"when {c} then '{k}'" for c, k in cases) + " end"


def following(kinds: str, value: str, keep: str = "true") -> str:
    """``value`` of ``v``, the stripped line after each line of the kinds that has one and for which ``keep`` holds; in order."""
    at = f"filter({indexes('_ln')}, i -> get(_kind, i) in ({kinds}) and i + 1 < size(_ln))"
    return f"transform(filter(transform({at}, i -> get(_st, i + 1)), v -> {keep}), v -> {value})"


def address_lines() -> str:
    """The lines of the address whose label stands at line ``i``."""
    line = "get(_ln, i)"
    tails = [group(line, f"{W}D[O0]MICILI[O0]/D[O0]MICILI\\s+(.+)$"), group(line, f"{W}D[O0]MICILI[O0]\\s+(.+)$"), group(line, f"{W}DOMICILI\\s+(.+)$")]
    tail = strip(f"coalesce({', '.join(tails)})")
    label = rf"{W}^/\s*(D[O0]MICILI[O0]?|DOMICILI?|LLOC\s+DE\s+D[O0]MICILI[O0]?|LUGAR\s+DE\s+D[O0]MICILI[O0]?)$"
    skip = f"({any_of('upper(a)', fixed.ADDRESS_LABELS)} and not {matches('a', r'\d')})"
    stop = f"(a = '' or (not {skip} and {any_of('upper(a)', fixed.ADDRESS_STOPS)}))"
    below = f"filter({upto('slice(_st, i + 2, 8)', stop, 'a')}, a -> not {skip})"
    return f"if({tail} is not null and not {matches(tail, label)}, {split_keeping(tail, r'\d{5}')}, {below})"


#: Patterns of the floor and of an address line with street, number and floor, and without a floor.
FLOOR = r"(P[O0]?\d+\s*\d*|[PB]\d+|[ESC]+[A-Z0-9\s]+|\d+[ºª°]?\s*[A-Z]?)(?:\s|$)"
FULL_ADDRESS = rf"{W}^(.*?)[,\s]+(\d{{1,4}}[A-Z]?)(?=\s+{FLOOR})(.*)$"
SHORT_ADDRESS = r"(?d)^(.*?)[,\s]+(\d+[A-Z]?)\s*$"


def address_parts() -> str:
    """Street, number, floor and places of the address lines ``a``."""
    d = "get(a, 0)"
    full, short = FULL_ADDRESS, SHORT_ADDRESS
    rest = strip(f"regexp_extract({d}, {lit(full)}, 4)")
    place = lambda x: nz(strip(sub(x, r"^\d{5}\s+")))
    at = last_line_with("a", fixed.PROVINCES, 1)
    return as_struct(
        {
            "domicilio": d,
            "numero": f"if({matches(d, full)}, {group(d, full, 2)}, {group(d, short, 2)})",
            "piso_puerta": f"if({matches(d, full)}, coalesce({strip(group(rest, r'(?d)^([^\n,]+?)(?:\s*(?:ESCB?|ESC\s|,|$))'))}, {rest}), null)",
            "calle": f"case when {matches(d, full)} then {strip(f'regexp_extract({d}, {lit(full)}, 1)')} when {matches(d, short)} then {strip(f'regexp_extract({d}, {lit(short)}, 1)')} else {d} end",
            "codigo_postal": first(present(f"transform(a, z -> {group('z', r'\b(\d{5})\b')})")),
            "provincia": strip(f"get(a, {at})"),
            "municipio": f"if({at} is not null, {place(f'get(a, {at} - 1)')}, {place('get(a, 1)')})",
        }
    )


def address() -> str:
    """One record from all addresses of a text: the last one's line and street, what others leave open from earlier ones."""
    blocks = f"transform(filter(transform(filter({indexes('_ln')}, i -> get(_kind, i) = 'address'), i -> {address_lines()}), a -> size(a) > 0), a -> {address_parts()})"
    keep = {
        "domicilio": "b.domicilio",
        "numero": "coalesce(b.numero, c.numero)",
        "piso_puerta": "coalesce(b.piso_puerta, c.piso_puerta)",
        "calle": "b.calle",
        "codigo_postal": "coalesce(c.codigo_postal, b.codigo_postal)",
        "provincia": "coalesce(b.provincia, c.provincia)",
        "municipio": "if(b.provincia is not null, b.municipio, coalesce(c.municipio, b.municipio))",
    }
    return f"aggregate({blocks}, {as_struct({k: null() for k in keep})}, (c, b) -> {as_struct(keep)})"


def slashed(v: str, low: str, high: str, k: int = 0) -> str:
    return dates.iso(f"regexp_replace({v}, {lit(r'\s')}, '/')", "/", True, low, high)


def from_text(as_of: str) -> dict[str, str]:
    """Fields from labelled lines; needs _ln, _st, _kind."""
    number = group("_text", rf"\b({NUMBER})\b")
    sex = {"M": ("M", "H", "HOME", "HOMBRE"), "F": ("F", "D", "V", "DONA", "MUJER")}
    sexes = " ".join(f"when upper(v) in ({', '.join(map(lit, words))}) then '{s}'" for s, words in sex.items())
    nation = f"case when length(v) <= 3 and {matches('v', r'^\p{L}+$')} then upper(v) when contains(upper(v), 'ESPA') then 'ESP' end"
    born = f"year({as_of})"
    # the first kind of label always writes, the second only while nothing is there
    births = f"transform(filter({indexes('_ln')}, i -> get(_kind, i) in ('birth', 'born') and regexp_like(coalesce(get(_ln, i + 1), ''), {lit(DATE)})), i -> named_struct('k', get(_kind, i), 'd', {slashed(group('get(_ln, i + 1)', DATE, 0), '1900', born)}))"
    tail = lambda kind, e: f"transform(filter({indexes('_ln')}, i -> get(_kind, i) = '{kind}' and i + 1 < size(_ln)), i -> {e})"
    below = gather("_st", "(i + 1)", fixed.FIELD_STOPS)
    return {
        "numero_documento": number,
        "tipo_numero": checks.person_id_type(number),
        "apellidos": nz(last(tail("surname", without_mixed_tokens(below)))),
        "nombre": nz(last(tail("name", without_leading_letter(below)))),
        "fecha_nacimiento": f"aggregate({births}, {null()}, (c, b) -> if(b.k = 'birth' or c is null, b.d, c))",
        "fecha_caducidad": last(f"transform(filter(transform({following(lit('expiry'), 'v')}, v -> {all_matches('v', DATE)}), m -> size(m) > 0), m -> {slashed('element_at(m, -1)', '2000', '2060')})"),
        "sexo": last(present(following(lit("sex"), f"case {sexes} end"))),
        "nacionalidad": last(present(following(lit("nation"), nation))),
        "lugar_nacimiento": nz(last(following(lit("place"), "v"))),
        "nombre_padre": nz(last(following(lit("father"), "v"))),
        "nombre_madre": nz(last(following(lit("mother"), "v"))),
        "addr": address(),
    }


def mrz(as_of: str) -> tuple[dict[str, str], dict[str, str]]:
    """Two stages of fields from the machine-readable zone: three long lines from the first that starts with ID."""
    long = f"filter(transform(_st, l -> upper(l)), l -> length(l) >= 30)"
    start = f"array_position(transform({long}, l -> startswith(l, 'ID')), true)"
    zone = f"if({start} > 0, slice({long}, cast({start} as int), 3), array())"
    one, two = "replace(get(_mrz, 0), ' ', '')", "replace(get(_mrz, 1), ' ', '')"
    three = f"replace(regexp_replace(get(_mrz, 2), ' *< *', '<'), ' ', '<')"
    number = group(one, f"({NUMBER})")
    spaced = lambda x: nz(strip(f"replace({x}, '<', ' ')"))
    date_ = lambda at: f"{dates.century(f'substring({two}, {at}, 2)', as_of)} || '-' || substring({two}, {at + 2}, 2) || '-' || substring({two}, {at + 4}, 2)"
    good = f"size(_mrz) = 3 and {matches(f'substring({two}, 1, 2)', '^[0-9]{1,2}$')} and {matches(f'substring({two}, 9, 2)', '^[0-9]{1,2}$')}"
    nation = f"if(length({two}) >= 18, {strip(f"replace(substring({two}, 16, 3), '<', '')")}, null)"
    parsed = as_struct(
        {
            "raw": "array_join(_mrz, '\n')",
            "document_number": number,
            "surname": spaced(f"split({three}, '<<', 2)[0]"),
            "name": spaced(f"get(split({three}, '<<', 2), 1)"),
            "nationality": nation,
            "birth_date": f"if(length({two}) >= 6, substring({two}, 1, 6), null)",
            "expiry_date": f"if(length({two}) >= 14, substring({two}, 9, 6), null)",
            "sex": f"if(length({two}) > 7, substring({two}, 8, 1), null)",
            "birth": date_(1),
            "expiry": date_(9),
        }
    )
    return {"_mrz": zone}, {"_m": f"if({good}, {parsed}, null)"}


def extract(df: DataFrame, as_of: str = "current_date()") -> DataFrame:
    """``df`` (text) with ``datos`` and ``raw_mrz``. as_of: SQL expression of a date."""
    names = df.columns
    df = df.withColumn("_text", F.coalesce("text", F.lit("")))
    df = with_exprs(df, {"_ln": lines("_text")})
    df = with_exprs(df, {"_st": f"transform(_ln, l -> {strip('l')})", "_kind": f"transform(transform(_ln, l -> upper(l)), u -> {line_kind()})"})
    zone, parsed = mrz(as_of)
    df = with_exprs(with_exprs(df, zone | {"_t": as_struct(from_text(as_of))}), parsed)
    use = "_m.document_number is not null"
    merged_surname = "if(contains(_t.apellidos, ' ') and not coalesce(contains(_m.surname, ' '), false), _t.apellidos, _m.surname)"
    full = lambda n, s: f"if({n} is not null and {s} is not null, {n} || ' ' || {s}, null)"
    text = {k: f"_t.{k}" for k in ("numero_documento", "tipo_numero", "nombre", "apellidos", "sexo", "nacionalidad", "fecha_nacimiento", "fecha_caducidad", "lugar_nacimiento", "nombre_padre", "nombre_madre")}
    text |= {k: f"_t.addr.{k}" for k in ("domicilio", "calle", "numero", "piso_puerta", "municipio", "provincia", "codigo_postal")}
    text |= {k: null() for k in ("fecha_expedicion", "soporte_numero")} | {"nombre_completo": full("_t.nombre", "_t.apellidos")}
    zone_ = {
        "numero_documento": "_m.document_number",
        "tipo_numero": checks.person_id_type("_m.document_number"),
        "nombre": "_m.name",
        "apellidos": merged_surname,
        "nombre_completo": full("_m.name", merged_surname),
        "sexo": "if(_m.sex in ('M', 'F'), _m.sex, null)",
        "nacionalidad": f"coalesce({nz('_m.nationality')}, 'ESP')",
        "fecha_nacimiento": "_m.birth",
        "fecha_caducidad": "_m.expiry",
    } | {k: text[k] for k in FROM_TEXT}
    fields = {k: f"if({use}, {zone_.get(k, null())}, {text[k]})" for k in FIELDS}
    fields["mrz"] = f"if({use}, {as_struct({k: '_m.' + k for k in MRZ})}, null)"
    df = with_exprs(df, {"datos": as_struct(fields), "raw_mrz": f"if({use}, _m.raw, null)"})
    return df.select(*[c for c in names if c not in ("datos", "raw_mrz")], "datos", "raw_mrz")


NAMES = ("nombre", "apellidos", "nombre_completo", "lugar_nacimiento", "nombre_padre", "nombre_madre")


def validate(df: DataFrame, as_of: str = "current_date()") -> DataFrame:
    """``df`` (datos, ocr_engine, ocr_confidence) with the result columns and ``error``, set for impossible dates."""
    names, today = df.columns, f"date_format({as_of}, 'yyyy-MM-dd')"
    id_, birth, expiry = nz("datos.numero_documento"), nz("datos.fecha_nacimiento"), nz("datos.fecha_caducidad")
    typed = checks.person_id_type(id_)
    noise = [rules.finding(checks.has_noise(f"datos.{n}"), "DNI_NAME_OCR_NOISE", "warning", n, f"unexpected characters in {n}", f"datos.{n}", "check the value by eye") for n in NAMES]
    cleaned = {n: checks.clean_name(f"datos.{n}") for n in NAMES}
    whole = f"if({cleaned['nombre']} is not null and {cleaned['apellidos']} is not null, {cleaned['nombre']} || ' ' || {cleaned['apellidos']}, {cleaned['nombre_completo']})"
    day = dates.twin(birth)
    years = f"datediff({as_of}, {day}) div 365"
    later, past = f"coalesce({birth} > {today}, false)", f"coalesce({expiry} < {today}, false)"
    ok = checks.person_id_ok(id_)
    df = with_exprs(df, {f"_{n}": e for n, e in (cleaned | {"nombre_completo": whole}).items()} | {"_id": f"if({ok}, {id_}, null)"})
    lost = [f"if({x} is null, 1, 0)" for x in ("_id", "_nombre", "_apellidos", birth)]
    gone = [rules.finding(f"{x} is null", "DNI_MISSING_FIELD", "error", n, f"{n} not found", fix="check that the image shows the right side") for n, x in (("nombre", "_nombre"), ("apellidos", "_apellidos"), ("fecha_nacimiento", birth))]
    mismatch = f"coalesce(datos.mrz.document_number <> _id, false)"
    errors = [
        rules.finding(f"{id_} is null", "DNI_MISSING_FIELD", "critical", "numero_documento", "no document number found", fix="check the quality and orientation of the image"),
        rules.finding(f"{id_} is not null and not {ok} and {typed} is not null", "DNI_CHECKLETTER_MISMATCH", "critical", "numero_documento", "control letter does not fit the number", f"'read ' || right({id_}, 1) || ', expected ' || {checks.expected_letter(id_)}", "check the last letter by eye"),
        rules.finding(f"{id_} is not null and not {ok} and {typed} is null", "DNI_NUMBER_INVALID", "critical", "numero_documento", "unknown format of the document number", id_),
        *gone,
        rules.finding(later, "DNI_BIRTHDATE_INVALID", "critical", "fecha_nacimiento", "birth lies in the future", birth),
        rules.finding(past, "DNI_EXPIRED", "error", "fecha_caducidad", "document has expired", expiry, "ask for a valid document"),
        rules.finding(mismatch, "DNI_MRZ_MISMATCH", "critical", "numero_documento", "number differs from the machine-readable zone", "'text ' || _id || ', zone ' || datos.mrz.document_number", "check by eye"),
    ]
    alerts = [*noise, rules.finding(f"coalesce(not {later} and {years} < 18, false)", "DNI_UNDERAGE", "warning", "fecha_nacimiento", "holder is a minor", birth)]
    df = with_exprs(df, {"_errors": rules.collected(errors), "_alerts": rules.collected(alerts), "_missing": " + ".join(lost)})
    valid = f"{rules.no_critical('_errors')} and _id is not null and _nombre is not null and _apellidos is not null"
    changed = {f"{n}": f"_{n}" for n in NAMES} | {
        "numero_documento": "_id",
        "fecha_nacimiento": f"if({later}, null, {birth})",
        "nacionalidad": f"if({matches('datos.nacionalidad', '^[A-Z]{2,3}$')}, datos.nacionalidad, null)",
    }
    data = as_struct({k: changed.get(k, f"datos.{k}") for k in (*FIELDS, "mrz")})
    out = rules.envelope("dni", data, valid)
    out["error"] = f"if({birth} is not null and not {later} and {day} is null, 'impossible birth date', null)"
    done = df.select(*[c for c in names if c not in out], *[F.expr(e).alias(k) for k, e in out.items()])
    return done
