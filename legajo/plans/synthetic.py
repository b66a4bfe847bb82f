"""Document texts derived from keys of the driver tables by plain expressions, so results can be told from the key alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legajo.functions import fixed
from legajo.functions.text import lit
from legajo.sources.tables import read_table

AS_OF, CONFIDENCE = "2025-06-30", 95.0
TOWNS = ("BARCELONA", "GIRONA", "CUENCA", "LUGO")
#: Brand, model; the last brand has no list of known models.
CARS = (("SEAT", "IBIZA"), ("FORD", "FOCUS"), ("BMW", "X5"), ("KIA", "RIO"), ("TESLA", "ROADSTER"))
LETTERS = "translate(cast({} as string), '0123456789', 'ABCDEFGHIJ')"


def _pick(values, index: str) -> str:
    return f"element_at(array({', '.join(map(lit, values))}), cast({index} as int) + 1)"


def _texts(df: DataFrame, key: str, family: str, exprs: dict[str, str], lines: list[str]) -> DataFrame:
    keyed = df.selectExpr(f"{key} as doc_id", *[f"{e} as {n}" for n, e in exprs.items()])
    text = "concat_ws('\n', " + ", ".join(lines) + ")"
    return keyed.selectExpr("doc_id", f"'{family}' as doc_type", f"{text} as text", "'google_vision' as ocr_engine", f"{CONFIDENCE}D as ocr_confidence")


def person_number(key: str, broken: str) -> str:
    """Number and letter of a person id from a key; the letter is wrong where ``broken`` holds."""
    n = f"(({key} * 7919 + 12345678) % 100000000)"
    return f"lpad(cast({n} as string), 8, '0') || substring({lit(fixed.PERSON_LETTERS)}, cast(({n} % 23 + if({broken}, 1, 0)) % 23 as int) + 1, 1)"


def identity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    exprs = {
        "number": person_number(k, f"{k} % 10 = 7"),
        "surname": f"'EJEMPLO ' || {LETTERS.format(k + ' % 100')}",
        "name": f"if({k} % 2 = 0, 'ANA', 'LUIS')",
        "birth": f"date_add(date'1950-01-01', cast({k} % 25000 as int))",
        "expiry": f"date_add(date'2020-01-01', cast({k} * 37 % 6000 as int))",
        "town": _pick(TOWNS, f"{k} % 4"),
        "code": f"lpad(cast({k} % 50000 as string), 5, '0')",
        "k": k,
    }
    lines = [
        "'APELLIDOS', surname", "if(k % 13 = 0, null, 'NOMBRE\n' || name)", "'DNI', number", "'SEXO', if(k % 2 = 0, 'MUJER', 'H')", "'NACIONALIDAD', 'ESP'",
        "if(k % 17 = 0, null, 'FECHA DE NACIMIENTO\n' || date_format(birth, 'dd MM yyyy'))", "'VALIDEZ', '01/01/2020 ' || date_format(expiry, 'dd/MM/yyyy')",
        "'DOMICILIO', 'CALLE MAYOR ' || (k % 99 + 1), code || ' POBLE', town",
    ]
    return _texts(read_table(spark, sf_dir, "customer"), k, "dni", exprs, lines)


def zone_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    exprs = {
        "one": f"rpad('IDESPAAA' || lpad(cast({k} % 1000000 as string), 6, '0') || {person_number(k, 'false')}, 30, '<')",
        "two": f"rpad(date_format(date_add(date'1950-01-01', cast({k} % 25000 as int)), 'yyMMdd') || '5' || if({k} % 2 = 0, 'F', 'M') || date_format(date_add(date'2020-01-01', cast({k} * 37 % 6000 as int)), 'yyMMdd') || '7ESP', 30, '<')",
        "three": f"rpad('EJEMPLO<' || {LETTERS.format(k + ' % 100')} || '<<ANA', 30, '<')",
        "k": k,
    }
    return _texts(read_table(spark, sf_dir, "customer"), k, "dni", exprs, ["'EQUIPO'", "one", "two", "if(k % 5 = 0, null, three)"])


def vehicle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = "p_partkey", lit(fixed.PLATE_LETTERS)
    letter = lambda n: f"substring({s}, cast({k} div {n} % 20 as int) + 1, 1)"
    weights, values = fixed.VIN_WEIGHTS, f"translate(raw, {lit(fixed.VIN_LETTERS)}, {lit(fixed.VIN_VALUES)})"
    total = " + ".join(f"cast(substring({values}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights) if w)
    df = read_table(spark, sf_dir, "part").selectExpr("*", f"'1M8GDM9A0KP' || lpad(cast({k} % 1000000 as string), 6, '0') as raw")
    df = df.selectExpr("*", f"if(({total}) % 11 = 10, 'X', cast(({total}) % 11 as string)) as right_digit")
    exprs = {
        "plate": f"lpad(cast({k} * 37 % 10000 as string), 4, '0') || {letter(1)} || {letter(20)} || if({k} % 11 = 0, 'A', {letter(400)})",
        "vin": f"left(raw, 8) || if({k} % 7 = 0, if(right_digit = '1', '2', '1'), right_digit) || substring(raw, 10)",
        "brand": _pick([b for b, _ in CARS], f"{k} % 5"),
        "model": f"if({k} % 9 = 0, 'NADA', {_pick([m for _, m in CARS], f'{k} % 5')})",
        "seats": "p_size % 17 + 1",
        "day": f"date_format(date_add(date'2000-01-01', cast({k} % 12000 as int)), 'dd/MM/yyyy')",
        "k": k,
    }
    lines = [
        "'A ' || plate, 'E ' || vin, 'D.1', brand, 'D.3', brand || ' ' || model", "'P.1', 1000 + k % 1500", "if(k % 19 = 0, 'POTENCIA CV\n100', 'P.2\n' || (50 + k % 100) || ' kW')",
        "'P.3', 'Diesel'", "'F.1', 'B', 1500 + k % 1000, 'G', 1000 + k % 800, 'S.1', seats", "if(k % 13 = 0, null, 'C.1.1\nPRUEBA\nC.1.2\nANA')", "'I', day",
    ]
    return _texts(df, k, "permiso_circulacion", exprs, lines)


def company_number(key: str, broken: str) -> str:
    """Head letter, seven digits and control of a company id from a key."""
    n = f"(({key} * 104729 + 1234567) % 10000000)"
    digit = [f"({n} div {10**i} % 10)" for i in range(6, -1, -1)]
    doubled = " + ".join(f"{d} * 2 - if({d} > 4, 9, 0)" for d in digit[::2])
    control = f"cast((((10 - ({doubled} + {' + '.join(digit[1::2])}) % 10) % 10) + if({broken}, 1, 0)) % 10 as int)"
    head = f"substring({lit(fixed.COMPANY_HEADS)}, cast({key} % 20 as int) + 1, 1)"
    return f"{head} || lpad(cast({n} as string), 7, '0') || if({head} in ('K', 'P', 'Q', 'S'), substring({lit(fixed.COMPANY_LETTERS)}, {control} + 1, 1), cast({control} as string))"


def fiscal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "s_suppkey"
    exprs = {"number": company_number(k, f"{k} % 9 = 0"), "name": f"'EMPRESA ' || {LETTERS.format(k)} || ', S.L.'", "day": f"date_format(date_add(date'1990-01-01', cast({k} * 53 % 14000 as int)), 'dd-MM-yyyy')", "k": k}
    lines = [
        "number", "if(k % 7 = 0, null, 'Denominación\n' || name)", "if(k % 11 = 0, null, 'Domicilio Fiscal\nCALLE MAYOR, NUM. ' || (k % 99 + 1) || ', PLANTA 0, PUERTA 3\n28001 POBLE\nGIRONA')",
        "'Fecha N.I.F. Definitivo', day", "'Administración AEAT', '28601 MADRID'",
    ]
    return _texts(read_table(spark, sf_dir, "supplier"), k, "nif", exprs, lines)


def ocr_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR runs from events: engine by type, mode by user, 100 images."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id % 100 as image",
        "if(event_type in ('click', 'view', 'error'), 'tesseract', 'google_vision') as engine",
        "element_at(array('none', 'standard', 'aggressive', 'document'), cast(user_id % 4 as int) + 1) as preprocess_mode",
        "least(value, 100D) as confidence",
        "(event_id % 97 + 1) / 50D as processing_time",
        "event_type <> 'error' as success",
        "event_id as ordinal",
    )
