"""Company tax cards: fields from labelled lines, addresses in one line or a block, and their validation.

One branch applies to a line, in a fixed order. ``as_of`` is the day that counts as today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import checks, dates, fixed
from legajo.functions.text import W, any_of, first, group, indexes, last, last_line_with, lines, lit, matches, nz, present, strip, sub, upto
from legajo.operators import rules
from legajo.operators.stages import as_struct, null, with_exprs

PARTS = ("calle", "numero", "piso_puerta", "municipio", "provincia", "codigo_postal")
FIELDS = (
    "numero_nif", "tipo_nif", "denominacion", "razon_social", "anagrama_comercial",
    "domicilio_social", *(f"domicilio_social_{p}" for p in PARTS), "domicilio_fiscal", *(f"domicilio_fiscal_{p}" for p in PARTS),
    "fecha_nif_definitivo", "fecha_expedicion", "administracion_aeat", "codigo_administracion", "nombre_administracion", "codigo_electronico",
)
#: Patterns of a date, a floor, and an address line with street, number and floor.
DATE = r"(\d{2})[-/](\d{2})[-/](\d{4})"
FLOOR = r"(PLANTA\s*\d+[,]?\s*PUERTA\s*\d+|P[O0]?\d+\s*\d*|[PB]\d+|\d+[ºª°]?\s*[A-Z]?)?"
STREET = rf"{W}^(.*?)[,\s]+(?:NUM\.?\s*)?(\d{{1,4}}[A-Z]?)\s*[,]?\s*{FLOOR}"


def has(*words: str) -> str:
    return "(" + " or ".join(f"contains(u, {lit(w)})" for w in words) + ")"


def line_kind() -> str:
    office = f"{has('ADMINISTRACIÓN', 'ADMINISTRACION')} and {has('AEAT')}"
    cases = [
        (f"{has('DENOMINACIÓN', 'DENOMINACION')} and not {has('FISCAL')}", "name"),
        (has("RAZÓN SOCIAL", "RAZON SOCIAL"), "legal"),
        (has("ANAGRAMA COMERCIAL"), "trade"),
        (f"{has('DOMICILIO')} and not {has('SOCIAL', 'FISCAL')}", "bare"),
        (has("DOMICILIO"), "address"),
        (office, "office"),
        (has("FECHA N.I.F. DEFINITIVO", "FECHA NIF DEFINITIVO"), "nif_date"),
        (has("FECHA DE EXPEDICIÓN", "FECHA DE EXPEDICION"), "issued"),
        (has("CÓDIGO ELECTRÓNICO", "CODIGO ELECTRONICO"), "code"),
    ]
    return "case " + " ".join(f"when {c} then '{k}'" for c, k in cases) + " end"


def at(*kinds: str) -> str:
    return f"filter({indexes('_ln')}, i -> get(_kind, i) in ({', '.join(map(lit, kinds))}))"


def same_or_next(pattern: str) -> str:
    """The label's tail on line ``i``, else the next line."""
    return f"coalesce({strip(group('get(_ln, i)', W + pattern))}, get(_st, i + 1))"


def street_fields() -> dict[str, str]:
    """Street, number and floor of the first address line ``d``."""
    full, short = matches("d", STREET), r"(?d)^(.*?)[,\s]+(\d+[A-Z]?)\s*$"
    return {
        "numero": f"if({full}, {group('d', STREET, 2)}, {group('d', short, 2)})",
        "piso_puerta": strip(group("d", STREET, 3)),
        "calle": f"case when {full} then {sub(strip(f'regexp_extract(d, {lit(STREET)}, 1)'), rf'{W},?\s*NUM\.?\s*$')} when {matches('d', short)} then {strip(f'regexp_extract(d, {lit(short)}, 1)')} else d end",
    }


def inline_address(head: str) -> str:
    """Address whose first line is ``head``; up to four more lines follow line ``i``."""
    stop = f"(s = '' or {any_of('upper(s)', fixed.FISCAL_STOPS)})"
    more = f"transform({upto('slice(_st, i + 2, 4)', stop, 's')}, s -> if({matches('upper(s)', '^(SOCIAL|FISCAL)')}, {group('s', r'(?U)^\S+\s+(.*)$')}, s))"
    all_ = f"concat(array({head}), {present(more)})"
    floors = r"(PLANTA\s*\d+[,]?\s*PUERTA\s*\d+|PLANTA\s*\d+|PUERTA\s*\d+|P[O0]?\d+\s*\d*)"
    coded = r"\b(\d{5})\b"
    place = f"split({strip(f"regexp_extract(c, {lit(r'\b\d{5}\b(.*)$')}, 1)")}, {lit(r'\s*-\s*|\s*\(\s*')})"
    bare = lambda x: nz(f"rtrim(')', {strip(x)})")
    inner = street_fields() | {"piso_puerta": f"coalesce({strip(group('d', STREET, 3))}, {first(present(f'transform(slice(a, 2, 5), x -> {strip(group("x", W + floors))})'))})"}
    # an address in one line has no short form of the number
    inner["numero"] = group("d", STREET, 2)
    inner["calle"] = f"if({matches('d', STREET)}, {sub(strip(f'regexp_extract(d, {lit(STREET)}, 1)'), rf'{W},?\s*NUM\.?\s*$')}, d)"
    fields = {"completo": "array_join(a, ' ')"} | {k: f"element_at(transform(array(a[0]), d -> {e}), 1)" for k, e in inner.items()}
    with_code = lambda e: first(f"transform(slice(filter(a, x -> {matches('x', coded)}), 1, 1), c -> {e})")
    fields |= {
        "codigo_postal": with_code(group("c", coded)),
        "municipio": with_code(bare(f"get({place}, 0)")),
        "provincia": with_code(bare(f"get({place}, 1)")),
    }
    return f"element_at(transform(array({all_}), a -> {record(fields)}), 1)"


def block_address() -> str:
    """Address on up to seven lines below line ``i``; NULL fields without any."""
    stop = f"(s = '' or {any_of('upper(s)', fixed.FISCAL_STOPS)})"
    where = last_line_with("a", (*fixed.PROVINCES, *fixed.ISLANDS), 0)
    uncoded = lambda x: nz(strip(sub(x, r"^\d{5}\s+")))
    fields = {"completo": "array_join(a, ' ')"} | {k: f"element_at(transform(array(a[0]), d -> {e}), 1)" for k, e in street_fields().items()}
    fields |= {
        "codigo_postal": first(present(f"transform(a, x -> {group('x', r'\b(\d{5})\b')})")),
        "provincia": uncoded(f"get(a, {where})"),
        "municipio": f"if({where} > 0, {uncoded(f'get(a, {where} - 1)')}, {uncoded('get(a, 1)')})",
    }
    return f"element_at(transform(array({upto('slice(_st, i + 2, 7)', stop, 's')}), a -> if(size(a) > 0, {record(fields)}, {record({})})), 1)"


def record(fields: dict[str, str]) -> str:
    return as_struct({k: fields.get(k, null()) for k in ("completo", *PARTS)})


def addresses(word: str, other: str) -> str:
    """The address of one kind (SOCIAL or FISCAL): labelled ones overwrite, bare ones count while there is none."""
    next_, tail = "upper(coalesce(get(_ln, i + 1), ''))", strip(group("get(_ln, i)", rf"{W}DOMICILIO\s+(.+)"))
    said = lambda w: f"contains({next_}, '{w}')"
    mine = f"{said(word)} and not contains({next_}, 'DOMICILIO')" + (f" and not {said(other)}" if word == "FISCAL" else "")
    bare = f"get(_kind, i) = 'bare' and {tail} is not null and {mine}"
    value = strip(group("get(_ln, i)", rf"{W}DOMICILIO\s+(?:SOCIAL|FISCAL)?\s*(.+)"))
    labelled = f"get(_kind, i) = 'address' and {value} is not null and contains(get(_up, i), '{word}')" + (f" and not contains(get(_up, i), '{other}')" if word == "FISCAL" else "")
    inside = f"if({matches(f'upper({value})', 'SOCIAL|FISCAL')} or {value} = '', {block_address()}, {inline_address(value)})"
    events = f"transform(filter({indexes('_ln')}, i -> ({bare}) or ({labelled})), i -> named_struct('k', get(_kind, i), 'a', if(get(_kind, i) = 'bare', {inline_address(tail)}, {inside})))"
    return f"aggregate({events}, {record({})}, (c, e) -> if(e.k = 'address' or c.completo is null, e.a, c))"


def extract(df: DataFrame, as_of: str = "current_date()") -> DataFrame:
    """``df`` (text) with ``datos``."""
    names = df.columns
    df = df.withColumn("_text", F.coalesce("text", F.lit("")))
    df = with_exprs(df, {"_ln": lines("_text")})
    df = with_exprs(df, {"_st": f"transform(_ln, l -> {strip('l')})", "_up": "transform(_ln, l -> upper(l))"})
    df = with_exprs(df, {"_kind": f"transform(_up, u -> {line_kind()})"})
    number = f"upper({group('_text', rf'\b([{fixed.COMPANY_HEADS}]\d{{7}}[A-J0-9])\b')})"
    named = f"case get(_kind, i) when 'name' then {same_or_next(r'(?:DENOMINACIÓN|DENOMINACION)[:\s]+(.+)')} else {strip(group('get(_ln, i)', W + r'(?:RAZÓN SOCIAL|RAZON SOCIAL)[:\s]+(.+)'))} end"
    events = f"filter(transform({at('name', 'legal')}, i -> named_struct('k', get(_kind, i), 'v', {nz(named)})), e -> e.v is not null and not contains(e.v, ':') and not (e.k = 'name' and e.v in ('0', 'o', 'O')))"
    office = present(f"transform({at('office')}, i -> {nz(same_or_next(r'ADMINISTRACI[OÓ]N\s+(?:DE\s+LA\s+)?AEAT\s+(.+)'))})")
    split_office = f"filter({office}, v -> {matches('v', r'(?U)^[0-9]+\s+\S')})"
    dated = lambda kind: last(f"transform(filter({at(kind)}, i -> regexp_like(coalesce(get(_ln, i + 1), ''), {lit(DATE)})), i -> {dates.dash_iso(group('get(_ln, i + 1)', DATE, 0), '1980', f'year({as_of})')})")
    df = with_exprs(
        df,
        {
            "_nif": number,
            "_name": f"aggregate({events}, {null()}, (c, e) -> if(e.k = 'name' or c is null, e.v, c))",
            "_trade": last(present(f"transform({at('trade')}, i -> {nz(same_or_next(r'ANAGRAMA COMERCIAL[:\s]+(.+)'))})")),
            "_social": addresses("SOCIAL", "FISCAL"),
            "_fiscal": addresses("FISCAL", "SOCIAL"),
            "_office": last(office),
            "_coded": last(split_office),
            "_defined": dated("nif_date"),
            "_issued": dated("issued"),
            "_code": last(f"filter(transform({at('code')}, i -> upper(get(_st, i + 1))), v -> {matches('v', '^[A-F0-9]{10,}$')})"),
        },
    )
    fields = {"numero_nif": "_nif", "tipo_nif": "if(_nif is not null, 'CIF', null)", "denominacion": "_name", "razon_social": "_name", "anagrama_comercial": "_trade"}
    for kind in ("social", "fiscal"):
        fields[f"domicilio_{kind}"] = f"_{kind}.completo"
        fields |= {f"domicilio_{kind}_{p}": nz(f"_{kind}.{p}") for p in PARTS}
    fields |= {
        "fecha_nif_definitivo": "_defined",
        "fecha_expedicion": "_issued",
        "administracion_aeat": "_office",
        "codigo_administracion": group("_coded", r"(?U)^([0-9]+)\s+(.*)$", 1),
        "nombre_administracion": group("_coded", r"(?U)^([0-9]+)\s+(.*)$", 2),
        "codigo_electronico": "_code",
    }
    return with_exprs(df, {"datos": as_struct({k: fields[k] for k in FIELDS})}).select(*[c for c in names if c != "datos"], "datos")


def validate(df: DataFrame, as_of: str = "current_date()") -> DataFrame:
    """``df`` (datos, ocr_engine, ocr_confidence) with the result columns. A missing number is reported twice, as the score expects."""
    names, today = df.columns, f"date_format({as_of}, 'yyyy-MM-dd')"
    number, name, home = (nz(f"datos.{f}") for f in ("numero_nif", "razon_social", "domicilio_fiscal"))
    absent = lambda x, f, s: rules.finding(f"{x} is null", "NIF_MISSING_FIELD", s, f, f"{f} not found")
    late = lambda f: rules.finding(f"coalesce(datos.{f} > {today}, false)", "NIF_DATE_INVALID", "error", f, "date lies in the future")
    errors = [
        absent(number, "numero_nif", "critical"),
        rules.finding(f"{number} is not null and not {checks.company_id_ok(number)}", "NIF_CHECKDIGIT_MISMATCH", "critical", "numero_nif", "control character does not fit the number", f"'read ' || right({number}, 1) || ', expected ' || {checks.company_expected(number)}"),
        absent(number, "numero_nif", "critical"),
        absent(name, "razon_social", "error"),
        absent(home, "domicilio_fiscal", "error"),
        late("fecha_nif_definitivo"),
        late("fecha_expedicion"),
    ]
    df = with_exprs(df, {"_errors": rules.collected(errors), "_alerts": rules.collected([]), "_missing": rules.missing(["datos.numero_nif", "datos.razon_social", "datos.domicilio_fiscal"])})
    out = rules.envelope("nif", "datos", f"{rules.no_critical('_errors')} and {number} is not null and {name} is not null and {home} is not null")
    out["error"] = null()
    return df.select(*[c for c in names if c not in out], *[F.expr(e).alias(k) for k, e in out.items()])
