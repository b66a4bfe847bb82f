"""More registered queries: rules and fields that the plain texts don't reach, each case told from the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions import checks
from legajo.functions.text import lit
from legajo.operators import decisions, fiscal, identity, vehicle
from legajo.operators.stages import as_struct, null
from legajo.plans import compare
from legajo.plans.pipeline import date_expr
from legajo.plans.synthetic import AS_OF, LETTERS
from legajo.sources import images
from legajo.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def case(index: str, values: dict[int, str | None], other: str | None) -> str:
    """SQL of both engines: the string for a remainder, else ``other``; None is NULL."""
    text = lambda v: "cast(null as varchar(100))" if v is None else f"'{v}'"
    return "case " + " ".join(f"when {index} = {k} then {text(v)}" for k, v in values.items()) + f" else {text(other)} end"


def listed(*pairs: tuple[str, str]) -> str:
    """DuckDB: the findings whose conditions hold, joined by commas."""
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{code}' end" for c, code in pairs) + "], lambda x: x is not null), ',')"


def total(conditions: list[str]) -> str:
    return " + ".join(f"(case when {c} then 1 else 0 end)" for c in conditions) or "0"


def scored(critical: list[str], error: list[str], warning: list[str], missing: list[str], confidence: float = 95.0) -> str:
    return f"cast(greatest(0, least(100, round_even((100 - 35 * ({total(critical)}) - 15 * ({total(error)}) - 5 * ({total(warning)}) - 20 * ({total(missing)})) * 0.85::double + {confidence} * 0.15::double, 0))) as int)"


def judged(ops, table: str, key: str, fields: dict[str, str], types: dict[str, str], extra: dict[str, str], *shown: str) -> Query:
    """Results of ``validate`` for records given field by field."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = as_struct({k: fields.get(k, null(types.get(k, "string"))) for k in ops.FIELDS} | extra)
        df = read_table(spark, sf_dir, table).selectExpr(f"{key} as doc_id", f"{data} as datos", "'google_vision' as ocr_engine", "95D as ocr_confidence")
        codes = "array_join(transform({}, f -> f.code || ':' || f.severity || ':' || f.field), ',')"
        return ops.validate(df, date_expr(AS_OF)).selectExpr("doc_id", "valido", "confianza_global", f"{codes.format('errores_detectados')} as errors", f"{codes.format('alertas')} as alerts", *shown)

    return query


def parsed(ops, table: str, key: str, text: str, *fields: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, table).selectExpr(f"{key} as doc_id", f"{text} as text")
        return ops.extract(df, date_expr(AS_OF)).selectExpr("doc_id", *[f"datos.{f} as {f.replace('.', '_')}" for f in fields])

    return query


def lines(*parts: str) -> str:
    return "concat_ws('\n', " + ", ".join(parts) + ")"


def duck(columns: dict[str, str], table: str, key: str) -> str:
    return f"select {key} as doc_id, " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {table}"


WORD = lambda k: f"translate(cast({k} as varchar), '0123456789', 'ABCDEFGHIJ')"

# Rules of the identity card: every finding, also those that no parsed text can give ------------------------------------
K = "c_custkey"
id_ = case(f"{K} % 5", {1: "12345678A", 2: "ABC", 3: None}, "12345678Z")
first = case(f"{K} % 7", {0: "ANA4", 1: None}, "ANA")
last = case(f"{K} % 11", {0: None}, "PRUEBA")
birth = case(f"{K} % 6", {0: "2030-01-01", 1: None, 2: "2010-05-05", 3: "1980-02-31"}, "1980-06-15")
expiry = case(f"{K} % 3", {0: "2020-01-01"}, "2035-01-01")
nation = case(f"{K} % 8", {0: "española", 1: "E", 2: "FR"}, "ESP")
zone = case(f"{K} % 4", {0: "00000000T"}, "12345678Z")
record = {"numero_documento": id_, "nombre": first, "apellidos": last, "fecha_nacimiento": birth, "fecha_caducidad": expiry, "nacionalidad": nation}
mrz = as_struct({k: zone if k == "document_number" else null() for k in identity.MRZ})
no_id, wrong, odd = f"{K} % 5 = 3", f"{K} % 5 = 1", f"{K} % 5 = 2"
bad_id, no_first, no_last, no_birth, future = f"{K} % 5 in (1, 2, 3)", f"{K} % 7 = 1", f"{K} % 11 = 0", f"{K} % 6 = 1", f"{K} % 6 = 0"
expired, other_zone, noisy, minor = f"{K} % 3 = 0", f"{K} % 4 = 0 and not ({bad_id})", f"{K} % 7 = 0", f"{K} % 6 = 2"
add(
    "d_rules",
    judged(identity, "customer", K, record, {}, {"mrz": mrz}, "datos.numero_documento as id", "datos.nombre as nombre", "datos.nacionalidad as nation", "error"),
    duck(
        {
            "valido": f"not ({bad_id}) and not ({no_first}) and not ({no_last}) and not ({future}) and not ({other_zone})",
            "confianza_global": scored([no_id, wrong, odd, future, other_zone], [no_first, no_last, no_birth, expired], [noisy, minor], [bad_id, no_first, no_last, no_birth]),
            "errors": listed(
                (no_id, "DNI_MISSING_FIELD:critical:numero_documento"), (wrong, "DNI_CHECKLETTER_MISMATCH:critical:numero_documento"), (odd, "DNI_NUMBER_INVALID:critical:numero_documento"),
                (no_first, "DNI_MISSING_FIELD:error:nombre"), (no_last, "DNI_MISSING_FIELD:error:apellidos"), (no_birth, "DNI_MISSING_FIELD:error:fecha_nacimiento"),
                (future, "DNI_BIRTHDATE_INVALID:critical:fecha_nacimiento"), (expired, "DNI_EXPIRED:error:fecha_caducidad"), (other_zone, "DNI_MRZ_MISMATCH:critical:numero_documento"),
            ),
            "alerts": listed((noisy, "DNI_NAME_OCR_NOISE:warning:nombre"), (minor, "DNI_UNDERAGE:warning:fecha_nacimiento")),
            "id": f"case when not ({bad_id}) then '12345678Z' end",
            "nombre": f"case when not ({no_first}) then 'ANA' end",
            "nation": f"case when {K} % 8 = 2 then 'FR' when {K} % 8 > 2 then 'ESP' end",
            "error": f"case when {K} % 6 = 3 then 'impossible birth date' end",
        },
        "customer",
        K,
    ),
)

# Rules of the vehicle registration --------------------------------------------------------------------------------------
P = "p_partkey"
car = {
    "matricula": case(f"{P} % 6", {0: None, 1: "12BCD", 2: "1234AEI"}, "1234BCF"),
    "numero_bastidor": case(f"{P} % 7", {0: None, 1: "SHORT", 2: "1M8GDM9AXKP04278O", 3: "1M8GDM9A1KP042788"}, "1M8GDM9AXKP042788"),
    "titular_nif": case(f"{P} % 4", {0: "12345678A", 1: None, 2: "B12345678"}, "12345678Z"),
    "fecha_matriculacion": case(f"{P} % 5", {0: "1969-12-31", 1: "2030-01-01", 2: None}, "2010-01-01"),
    "fecha_primera_matriculacion": case(f"{P} % 3", {0: "2012-01-01"}, "1960-01-01"),
    "fecha_expedicion": case(f"{P} % 2", {0: "2009-06-01"}, "2031-01-01"),
    "marca": case(f"{P} % 8", {0: None, 1: "TESLA"}, "SEAT"),
    "modelo": case(f"{P} % 9", {0: None, 1: "NADA"}, "SEAT IBIZA"),
    "potencia_kw": "100D",
    "cilindrada_cc": f"cast(case when {P} % 10 = 0 then 400 when {P} % 10 <> 1 then 1500 end as int)",
    "masa_maxima": "2000",
    "masa_orden_marcha": f"cast(if({P} % 12 = 0, 2500, 1500) as int)",
    "titular_nombre": case(f"{P} % 13", {0: None}, "ANA"),
}
no_plate, bad_plate = f"{P} % 6 = 0", f"{P} % 6 in (1, 2)"
no_vin, short, letter_o, digit = (f"{P} % 7 = {i}" for i in range(4))
owner, out_of_range, heavy, no_brand = f"{P} % 4 = 0", f"{P} % 5 in (0, 1)", f"{P} % 12 = 0", f"{P} % 8 = 0"
first_later, issued_before = f"({P} % 3 = 0 and {P} % 5 in (0, 3, 4))", f"({P} % 2 = 0 and {P} % 5 in (1, 3, 4))"
strange, strong, nobody, no_model = f"({P} % 9 = 1 and {P} % 8 > 1)", f"{P} % 10 = 0", f"{P} % 13 = 0", f"{P} % 9 = 0"
add(
    "v_rules",
    judged(vehicle, "part", P, car, vehicle.TYPES, {}, "datos.potencia_fiscal as power"),
    duck(
        {
            "valido": f"not ({no_plate}) and not ({bad_plate}) and not ({short}) and not ({letter_o}) and not ({no_brand})",
            "confianza_global": scored([bad_plate, no_plate, short, letter_o, letter_o, no_brand], [owner, out_of_range, heavy, no_vin, nobody], [digit, first_later, issued_before, strange, strong], [no_plate, no_vin, no_brand, no_model, nobody]),
            "errors": listed(
                (bad_plate, "VEH_PLATE_INVALID:critical:matricula"), (no_plate, "VEH_MISSING_FIELD:critical:matricula"), (short, "VEH_VIN_INVALID_CHARS:critical:numero_bastidor"),
                (letter_o, "VEH_VIN_INVALID_CHARS:critical:numero_bastidor,VEH_VIN_INVALID_CHARS:critical:numero_bastidor"), (owner, "VEH_OWNER_ID_INVALID:error:titular_nif"),
                (out_of_range, "VEH_DATES_INCONSISTENT:error:fecha_matriculacion"), (heavy, "VEH_DATES_INCONSISTENT:error:masa_orden_marcha"), (no_brand, "VEH_MISSING_FIELD:critical:marca"),
            ),
            "alerts": listed(
                (digit, "VEH_VIN_CHECKDIGIT:warning:numero_bastidor"), (no_vin, "VEH_MISSING_FIELD:error:numero_bastidor"), (first_later, "VEH_DATES_INCONSISTENT:warning:fecha_primera_matriculacion"),
                (issued_before, "VEH_DATES_INCONSISTENT:warning:fecha_expedicion"), (strange, "VEH_OCR_SUSPECT:warning:modelo"), (strong, "VEH_OCR_SUSPECT:warning:potencia_kw"), (nobody, "VEH_MISSING_FIELD:error:titular_nombre"),
            ),
            "power": "136.0::double",
        },
        "part",
        P,
    ),
)

# Rules of the tax card ---------------------------------------------------------------------------------------------------
S = "s_suppkey"
card = {
    "numero_nif": case(f"{S} % 4", {0: None, 1: "A58818502"}, "A58818501"),
    "razon_social": case(f"{S} % 3", {0: None}, "EMPRESA"),
    "domicilio_fiscal": case(f"{S} % 5", {0: None}, "CALLE MAYOR 5"),
    "fecha_nif_definitivo": case(f"{S} % 6", {0: "2030-01-01", 1: None}, "2016-01-01"),
    "fecha_expedicion": case(f"{S} % 7", {0: "2030-01-01"}, "2016-01-01"),
}
no_number, control, no_name, no_home, late, issued_late = f"{S} % 4 = 0", f"{S} % 4 = 1", f"{S} % 3 = 0", f"{S} % 5 = 0", f"{S} % 6 = 0", f"{S} % 7 = 0"
add(
    "n_rules",
    judged(fiscal, "supplier", S, card, {}, {}),
    duck(
        {
            "valido": f"not ({no_number}) and not ({control}) and not ({no_name}) and not ({no_home})",
            "confianza_global": scored([no_number, no_number, control], [no_name, no_home, late, issued_late], [], [no_number, no_name, no_home]),
            "errors": listed(
                (no_number, "NIF_MISSING_FIELD:critical:numero_nif"), (control, "NIF_CHECKDIGIT_MISMATCH:critical:numero_nif"), (no_number, "NIF_MISSING_FIELD:critical:numero_nif"),
                (no_name, "NIF_MISSING_FIELD:error:razon_social"), (no_home, "NIF_MISSING_FIELD:error:domicilio_fiscal"), (late, "NIF_DATE_INVALID:error:fecha_nif_definitivo"), (issued_late, "NIF_DATE_INVALID:error:fecha_expedicion"),
            ),
            "alerts": "''",
        },
        "supplier",
        S,
    ),
)

# Fields of other layouts ---------------------------------------------------------------------------------------------------
add(
    "v_fields",
    parsed(
        vehicle, "part", P,
        lines("'PERMISO'", "'D.2'", f"if({P} % 3 = 0, 'PLAIN', 'A' || {P} || '/B')", "'V.7'", f"({P} % 300) || ' g/km'", "'C.1.3'", f"if({P} % 2 = 0, '1234567BZ', 'X1234567L')", "'C.1.1'", "'PRUEBA'", f"'PRÓXIMA ITV ' || lpad({P} % 28 + 1, 2, '0') || '-02-2027'", f"if({P} % 4 = 0, 'RIOJA (LA)', 'MADRID')", "'OBSERVACIONES'", f"'una ' || {P}", "'dos'"),
        "variante_version", "emissions_co2", "titular_nif", "titular_nombre", "proxima_itv", "provincia", "observaciones", "servicio", "fecha_matriculacion",
    ),
    duck(
        {
            "variante_version": f"case when {P} % 3 <> 0 then 'A' || {P} || '/B' end",
            "emissions_co2": f"({P} % 300)::double",
            "titular_nif": f"case when {P} % 2 = 0 then '12345678Z' else 'X1234567L' end",
            "titular_nombre": "'PRUEBA'",
            "proxima_itv": f"'2027-02-' || lpad(cast({P} % 28 + 1 as varchar), 2, '0')",
            "provincia": f"case when {P} % 4 = 0 then 'RIOJA (LA)' else 'MADRID' end",
            "observaciones": f"'una ' || {P} || ' dos'",
            "servicio": "'PARTICULAR'",
            "fecha_matriculacion": f"'2027-02-' || lpad(cast({P} % 28 + 1 as varchar), 2, '0')",
        },
        "part",
        P,
    ),
)
bare = "'Domicilio CALLE SOL, NUM. ' || ({0} % 99 + 1) || '\nSocial 35016 PALMAS DE PRUEBA (LAS) - (PALMAS, LAS)\nPLANTA 2\nFecha'".format(S)
labelled = "'Domicilio Social AVDA NORTE ' || ({0} % 99 + 1) || '\n08001 VILLAPRUEBA (BARCELONA)\n'".format(S)
either = lambda a, b: f"case when {S} % 2 = 0 then {a} else {b} end"
add(
    "n_fields",
    parsed(
        fiscal, "supplier", S,
        lines(f"if({S} % 2 = 0, {labelled}, {bare})", f"if({S} % 3 = 0, 'Anagrama Comercial: MARCA ' || {LETTERS.format(S)}, 'Anagrama Comercial\nMARCA ' || {LETTERS.format(S)})", "'Código Electrónico'", f"'abcdef' || lpad({S}, 8, '0')", "'Fecha de Expedición'", f"lpad({S} % 28 + 1, 2, '0') || '/02/2020'", f"'Razón Social: EMPRESA ' || {LETTERS.format(S)}"),
        "domicilio_social", "domicilio_social_calle", "domicilio_social_numero", "domicilio_social_piso_puerta", "domicilio_social_codigo_postal", "domicilio_social_municipio", "domicilio_social_provincia",
        "domicilio_fiscal", "anagrama_comercial", "codigo_electronico", "fecha_expedicion", "razon_social",
    ),
    duck(
        {
            "domicilio_social": either(f"'AVDA NORTE ' || ({S} % 99 + 1) || ' 08001 VILLAPRUEBA (BARCELONA)'", f"'CALLE SOL, NUM. ' || ({S} % 99 + 1) || ' 35016 PALMAS DE PRUEBA (LAS) - (PALMAS, LAS) PLANTA 2'"),
            "domicilio_social_calle": either("'AVDA NORTE'", "'CALLE SOL'"),
            "domicilio_social_numero": f"cast({S} % 99 + 1 as varchar)",
            "domicilio_social_piso_puerta": either("null", "'PLANTA 2'"),
            "domicilio_social_codigo_postal": either("'08001'", "'35016'"),
            "domicilio_social_municipio": either("'VILLAPRUEBA'", "'PALMAS DE PRUEBA'"),
            "domicilio_social_provincia": either("'BARCELONA'", "'LAS'"),
            "domicilio_fiscal": "cast(null as varchar)",
            "anagrama_comercial": f"'MARCA ' || {WORD(S)}",
            "codigo_electronico": f"'ABCDEF' || lpad(cast({S} as varchar), 8, '0')",
            "fecha_expedicion": f"'2020-02-' || lpad(cast({S} % 28 + 1 as varchar), 2, '0')",
            "razon_social": f"'EMPRESA ' || {WORD(S)}",
        },
        "supplier",
        S,
    ),
)
zone_lines = "rpad('IDESPAAA00000001' || '12345678Z', 30, '<'), rpad('8006155F3501017ESP', 30, '<'), rpad('PRUEBAEJEMPLO<<ANA', 30, '<')"
add(
    "d_merge",
    parsed(
        identity, "customer", K,
        lines(f"if({K} % 2 = 0, 'APELLIDOS\nDOBLE ' || {LETTERS.format(K)}, 'APELLIDOS\nUNO')", "'LUGAR DE NACIMIENTO'", f"'POBLE ' || {LETTERS.format(K)}", "'PADRE'", "'PEDRO'", "'MADRE'", "'EVA'", "'D0MICILI0'", "'LUGAR DE DOMICILIO / LLOC DE DOMICILI'", f"'C. LARGA ' || ({K} % 99 + 1) || ' P02 0001'", "'43001 POBLE'", "'TARRAGONA'", "'HIJO DE'", f"if({K} % 5 = 0, null, concat_ws('\n', {zone_lines}))"),
        "numero_documento", "tipo_numero", "apellidos", "nombre", "nombre_completo", "lugar_nacimiento", "nombre_padre", "nombre_madre", "calle", "numero", "piso_puerta", "municipio", "provincia", "codigo_postal", "fecha_nacimiento", "mrz.surname",
    ),
    duck(
        {
            "numero_documento": f"case when {K} % 5 <> 0 then '12345678Z' end",
            "tipo_numero": f"case when {K} % 5 <> 0 then 'DNI' end",
            "apellidos": f"case when {K} % 2 = 0 then 'DOBLE ' || {WORD(K)} when {K} % 5 = 0 then 'UNO' else 'PRUEBAEJEMPLO' end",
            "nombre": f"case when {K} % 5 <> 0 then 'ANA' end",
            "nombre_completo": f"case when {K} % 5 <> 0 then 'ANA ' || case when {K} % 2 = 0 then 'DOBLE ' || {WORD(K)} else 'PRUEBAEJEMPLO' end end",
            "lugar_nacimiento": f"'POBLE ' || {WORD(K)}",
            "nombre_padre": "'PEDRO'",
            "nombre_madre": "'EVA'",
            "calle": "'C. LARGA'",
            "numero": f"cast({K} % 99 + 1 as varchar)",
            "piso_puerta": "'P02 0001'",
            "municipio": "'POBLE'",
            "provincia": "'TARRAGONA'",
            "codigo_postal": f"case when {K} % 5 = 0 then '43001' end",
            "fecha_nacimiento": f"case when {K} % 5 <> 0 then '1980-06-15' end",
            "mrz_surname": f"case when {K} % 5 <> 0 then 'PRUEBAEJEMPLO' end",
        },
        "customer",
        K,
    ),
)

# Decisions: every reason -----------------------------------------------------------------------------------------------------
front = "'DNI', {}, 'FECHA DE NACIMIENTO', '15 06 1980', 'VALIDEZ', '01/01/2020 01/01/2035'"
good = "'APELLIDOS', 'PRUEBA EJEMPLO', 'NOMBRE', 'ANA', " + front.format("'12345678Z'")
reasons = {
    0: (lines(good), 90, "accepted"),
    1: (lines("'APELLIDOS', 'PRUEBA', 'NOMBRE', 'ANA'"), 90, "number missing or invalid"),
    2: (lines("'APELLIDOS', 'PRUEBA'", front.format("'12345678Z'")), 90, "name missing"),
    3: (lines("'NOMBRE', 'ANA'", front.format("'12345678Z'")), 90, "surname missing"),
    4: (lines(good, "'EQUIPO 1'"), 60, "back side without address"),
    5: (lines(good, "'EQUIPO 1'"), 70, "accepted"),
    6: (f"concat_ws('\n', {zone_lines})", 60, "machine-readable zone only"),
    7: (lines(good), 20, "low confidence"),
}


def reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda i: "case " + " ".join(f"when {K} % 8 = {k} then {v[i]}" for k, v in reasons.items()) + " end"
    df = read_table(spark, sf_dir, "customer").selectExpr(f"{K} as doc_id", f"{pick(0)} as text", f"cast({pick(1)} as double) as c")
    return identity.extract(df, date_expr(AS_OF)).selectExpr("doc_id", f"{decisions.identity_fallback('datos', 'c', 'text')} as reason")


add("r15_reasons", reason, duck({"reason": case(f"{K} % 8", {k: v[2] for k, v in reasons.items()}, None)}, "customer", K))
cars = {0: ("1234BCF\nSEAT", "accepted"), 1: ("SEAT", "plate missing"), 2: ("1234BCF", "brand missing"), 3: ("1234AEI\nSEAT", "plate invalid"), 4: ("1234BCF\nSEAT", "low confidence")}


def car_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "case " + " ".join(f"when {P} % 5 = {k} then {lit(v[0])}" for k, v in cars.items()) + " end"
    df = read_table(spark, sf_dir, "part").selectExpr(f"{P} as doc_id", f"replace({text}, '\\\\n', '\n') as text", f"if({P} % 5 = 4, 49.9D, 50D) as c")
    return vehicle.extract(df).selectExpr("doc_id", f"{decisions.vehicle_fallback('datos', 'c')} as reason")


add("r16_reasons", car_reason, duck({"reason": case(f"{P} % 5", {k: v[1] for k, v in cars.items()}, None)}, "part", P))

# Sources, runs and turns ---------------------------------------------------------------------------------------------------
heads = case(f"{P} % 5", {0: "FFD8FFE0", 1: "89504E470D", 2: "5249464630", 3: "68656C6C6F"}, "")
mimes = case(f"{P} % 7", {0: "text/plain", 1: None, 2: "image/webp"}, "image/png")
length = f"cast(case when {P} % 11 = 0 then 5242881 else 5242880 end as bigint)"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part").selectExpr(f"{P} as doc_id", f"unhex({heads}) as content", f"{mimes} as mime", f"{length} as length")
    return images.gated(df).select("doc_id", "status", images.image_type().alias("kind"))


add("s4_gates", gates, duck({"status": f"cast(case when {P} % 7 in (0, 1) then 400 when {P} % 11 = 0 then 413 when {P} % 5 > 2 then 400 else 200 end as int)", "kind": case(f"{P} % 5", {0: "jpeg", 1: "png", 2: "webp"}, None)}, "part", P))
owners = case(f"{K} % 6", {0: "12345678Z", 1: "12345678A", 2: "X1234567L", 3: "B12345678", 4: "b12345678"}, "NADA")
add("f9b_holder_id", lambda spark, sf_dir: read_table(spark, sf_dir, "customer").selectExpr(f"{K} as doc_id", f"{checks.owner_id_ok(owners)} as ok"), duck({"ok": f"{K} % 6 in (0, 2, 3, 4)"}, "customer", K))


def stub(engine: str, mode: str, content: bytes) -> dict:
    if engine == "google_vision" and mode == "document":
        raise ValueError("no credit")
    return {"text": f"{content.decode()} {engine} {mode}", "confidence": float(len(content))}


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = read_table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) as path", "cast(n_name as binary) as content")
    runs = compare.run_matrix(pictures, ["tesseract", "unknown", "google_vision"], ["none", "document"], stub)
    return runs.select("path", "engine", "preprocess_mode", "text", "confidence", "success", "error", "ordinal")


add(
    "r1_run_matrix",
    matrix,
    """select cast(n_nationkey as varchar) as path, engine, preprocess_mode, case when ok then n_name || ' ' || engine || ' ' || preprocess_mode else '' end as text,
    case when ok then length(n_name)::double else 0.0::double end as confidence, ok as success, case when not ok then 'ValueError: no credit' end as error, ordinal::int as ordinal
    from (select *, not (engine = 'google_vision' and preprocess_mode = 'document') as ok, i * 2 + j as ordinal
      from nation, (values ('tesseract', 0), ('google_vision', 1)) e(engine, i), (values ('none', 0), ('document', 1)) m(preprocess_mode, j))""",
)
HORIZONTAL, COUNT = "cast((p_partkey * 31 + angle * 7) % 101 as double)", "cast((p_partkey + angle) % 40 as int)"


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part").selectExpr("p_partkey", "explode(array(0, 90, 180, 270)) as angle")
    return images.best_rotation(df.selectExpr("cast(p_partkey as string) as path", "angle", f"{HORIZONTAL} as horizontal", f"{COUNT} as words"))


add(
    "r8_rotation",
    rotations,
    f"""with s as (select p_partkey, angle, 2 * {HORIZONTAL} + 0.1::double * {COUNT} as score from part, (values (0), (90), (180), (270)) a(angle)),
    b as (select p_partkey, max(score) as best, arg_min(angle, -score * 1000 + angle / 1000.0::double) as angle, max(score) filter (where angle = 0) as own from s group by all)
    select cast(p_partkey as varchar) as path, cast(case when best - own > 0.05::double * own then angle else 0 end as int) as angle from b""",
)
TILTS = "transform(sequence(0, cast(p_partkey % 13 as int)), i -> cast((p_partkey * 7 + i * 31) % 21 - 10 as double) / 4)"
add(
    "r9_skew",
    lambda spark, sf_dir: read_table(spark, sf_dir, "part").selectExpr("p_partkey", f"{images.skew_angle(TILTS)} as angle"),
    """select p_partkey, case when abs(m) > 0.5 then m else 0.0::double end as angle
    from (select p_partkey, list_aggregate(list_transform(range(0, least(p_partkey % 13, 9)::int + 1), lambda i: ((p_partkey * 7 + i * 31) % 21 - 10)::double / 4), 'median') as m from part)""",
)


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recommendations, with images of which no engine succeeds."""
    runs = read_table(spark, sf_dir, "events").selectExpr(
        "event_id % 50 as image", "if(event_id % 3 = 0, 'tesseract', 'google_vision') as engine", "element_at(array('none', 'standard', 'document'), cast(event_id % 7 % 3 as int) + 1) as preprocess_mode",
        "cast(event_id * 13 % 400 as double) / 4 as confidence", "cast(event_id % 97 + 1 as double) / 8 as processing_time", "event_id % 50 <> 7 and event_id % 5 <> 2 as success", "event_id as ordinal",
    )
    keys = ("best_accuracy", "best_speed", "best_balance", "recommended_engine", "error")
    return compare.recommendations(runs, ["image"]).selectExpr("image", *[f"recommendations['{k}'] as {k}" for k in keys])


add(
    "r7_advice",
    advice,
    """with r as (select event_id % 50 as image, case when event_id % 3 = 0 then 'tesseract' else 'google_vision' end as engine, ['none', 'standard', 'document'][cast(event_id % 7 % 3 as int) + 1] as mode,
      (event_id * 13 % 400)::double / 4 as c, (event_id % 97 + 1)::double / 8 as t, event_id % 50 <> 7 and event_id % 5 <> 2 as ok, event_id as o from events),
    f as (select image, count_if(ok) as n, first(engine || ' + ' || mode || ' (' || c || '%)' order by c desc, o) filter (where ok) as best_accuracy,
      first(engine || ' + ' || mode || ' (' || t || 's)' order by t, o) filter (where ok) as best_speed, first(engine || ' + ' || mode order by c / (t + 0.1::double) desc, o) filter (where ok) as best_balance,
      coalesce(avg(c) filter (where ok and engine = 'google_vision'), 0) as g, coalesce(avg(c) filter (where ok and engine = 'tesseract'), 0) as s from r group by image)
    select image, best_accuracy, best_speed, best_balance, case when n > 0 then case when g > s then 'google_vision' else 'tesseract' end end as recommended_engine, case when n = 0 then 'no engine succeeded' end as error from f""",
)
