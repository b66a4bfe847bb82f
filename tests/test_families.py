"""Extraction and validation of the three families on synthetic texts."""

import pytest

from legajo.operators import fiscal, identity, vehicle
from legajo.plans.pipeline import analyze, analyze_family
from tests.texts import CARD, FRONT, VEHICLE, ZONE

DAY = "date'2025-06-30'"


@pytest.fixture(scope="module")
def read(spark):
    """datos of texts, in order."""

    def run(family, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        got = [r.datos for r in family.extract(df, DAY).orderBy("i").collect()]
        return got[0] if len(got) == 1 else got

    return run


def fields(record, **want):
    assert {k: record[k] for k in want} == want


def test_identity_front(read):
    d = read(identity, FRONT)
    fields(d, apellidos="PRUEBA EJEMPLO", nombre="ANA", numero_documento="12345678Z", tipo_numero="DNI", sexo="F", nacionalidad="ESP")
    fields(d, fecha_nacimiento="1980-06-15", fecha_caducidad="2035-01-01", nombre_completo="ANA PRUEBA EJEMPLO", mrz=None, fecha_expedicion=None)


def test_identity_zone(read):
    d, spaced, two, bad = read(identity, ZONE, ZONE.replace("<", " < "), "\n".join(ZONE.split("\n")[:2]), ZONE.replace("8006155", "8x06155"))
    fields(d, numero_documento="12345678Z", fecha_nacimiento="1980-06-15", fecha_caducidad="2035-01-01", sexo="F", nacionalidad="ESP", nombre="ANA", apellidos="PRUEBA EJEMPLO")
    fields(d.mrz, document_number="12345678Z", birth_date="800615", expiry_date="350101", sex="F", nationality="ESP", surname="PRUEBA EJEMPLO", name="ANA")
    fields(spaced, numero_documento="12345678Z", apellidos="PRUEBA EJEMPLO", nombre="ANA")
    assert two.mrz is None
    yes = bad.numero_documento  # a year that is no number: the zone is not used, and the text has no number of its own
    assert bad.mrz is None and yes is None


def test_identity_century_and_merge(read):
    young, old, merged = read(identity, ZONE.replace("800615", "350615"), ZONE.replace("800615", "360615"), "APELLIDOS\nDOBLE NOMBRE\nDOMICILIO\nCALLE MAYOR 5\n08000 VILLAPRUEBA\nBARCELONA\n\n" + ZONE.replace("PRUEBA<EJEMPLO<<ANA<<", "PRUEBAEJEMPLO<<ANA<<<"))
    assert young.fecha_nacimiento == "2035-06-15" and old.fecha_nacimiento == "1936-06-15"
    fields(merged, apellidos="DOBLE NOMBRE", nombre_completo="ANA DOBLE NOMBRE", calle="CALLE MAYOR", numero="5", municipio="VILLAPRUEBA", provincia="BARCELONA", codigo_postal=None)


def test_identity_addresses(read):
    block, same, short, none, floor, two = read(
        identity,
        "DOMICILIO / DOMICILI\nCALLE MAYOR 5\n08000 VILLAPRUEBA\nBARCELONA\nEQUIPO",
        "DOMICILIO/DOMICILI C. MAYOR 9 ESC01 08000 VILLAPRUEBA BARCELONA",
        "DOMICILIO\nCARRER NOU 12\n080 VILLAPRUEBA\nGIRONA",
        "NOMBRE\nANA",
        "D0MICILI0\nLUGAR DE DOMICILIO / LLOC DE DOMICILI\nC. LARGA 45 P02 0001\n43001 POBLE\nTARRAGONA\nHIJO DE",
        "DOMICILIO\nCALLE A 1\n08001 UNO\nBARCELONA\n\nDOMICILIO\nCALLE B",
    )
    fields(block, domicilio="CALLE MAYOR 5", calle="CALLE MAYOR", numero="5", codigo_postal="08000", municipio="VILLAPRUEBA", provincia="BARCELONA", piso_puerta=None)
    fields(same, domicilio="C. MAYOR 9 ESC01", calle="C. MAYOR", numero="9", codigo_postal="08000", municipio="08000", provincia="VILLAPRUEBA BARCELONA")
    fields(short, codigo_postal=None, municipio="080 VILLAPRUEBA", provincia="GIRONA")
    fields(none, domicilio=None, municipio=None, provincia=None)
    fields(floor, calle="C. LARGA", numero="45", piso_puerta="P02 0001", municipio="POBLE", provincia="TARRAGONA")
    fields(two, domicilio="CALLE B", calle="CALLE B", numero="1", codigo_postal="08001", municipio="UNO", provincia="BARCELONA")


def test_identity_lines(read):
    tokens, letter, parent, long_sex, dates, last_line, empty = read(
        identity,
        "COGNOMS\nPRUEBA X1Y EJEMPLO",
        "NOM\nJ ANA  MAR\nSEGUNDA\nSEXO",
        "NOMBRE DEL PADRE\nJUAN\nPADRE\nPEDRO\nMADRE\nEVA",
        "SEXO\nTEXTO LARGO\nSEXE\nH",
        "FECHA DE NACIMIENTO\n32/01/1990\nNACIMIENTO\n05/01/1990\nVALIDESA\n01/01/2020",
        "APELLIDOS\nPRUEBA\nAPELLIDOS",
        "",
    )
    assert tokens.apellidos == "PRUEBA EJEMPLO" and letter.nombre == "ANA MAR SEGUNDA"
    fields(parent, nombre=None, nombre_padre="PEDRO", nombre_madre="EVA")
    assert long_sex.sexo == "M"
    fields(dates, fecha_nacimiento="1990-01-05", fecha_caducidad="2020-01-01")
    assert last_line.apellidos == "PRUEBA"
    assert all(v is None for v in empty)


def test_vehicle(read):
    d = read(vehicle, VEHICLE)
    fields(d, matricula="1234BCF", numero_bastidor="1M8GDM9AXKP042788", marca="SEAT", modelo="SEAT IBIZA", cilindrada_cc=1490, potencia_kw=92.0, combustible="GASOLINA", plazas=5)
    fields(d, categoria="M1", tipo_vehiculo="Turisme", titular_nombre="ANA PRUEBA EJEMPLO", fecha_matriculacion="2024-08-08", servicio="PARTICULAR", potencia_fiscal=None)


def test_vehicle_lines(read):
    horse, order, mass, old, owner, more, empty = read(
        vehicle,
        "POTENCIA CV\n300\nP.1\n(1.2)\n999",
        "D.1\nMERCEDES-BENZ\nD.3\nABC\nMERCEDES GLA",
        "F.1\nB\n1800\nG\nI\n1300\nV.7\n120.5 g/km\nS.1\n12",
        "B1238CD\nFIAT PANDA AZUL",
        "C.1.3\n1234567BZ\nC.1.1\nC.1.2\nC.1.2\nANA",
        "PRÓXIMA ITV 01-02-2027\nOBSERVACIONES\nuna\ndos\nRIOJA (LA)\n31.12.2019",
        "\n \n",
    )
    fields(horse, potencia_kw=220.7, cilindrada_cc=999)
    fields(order, marca="MERCEDES", modelo="MERCEDES GLA")
    fields(mass, masa_maxima=1800, masa_orden_marcha=1300, emissions_co2=120.5, plazas=12, categoria="M2")
    fields(old, matricula="8123BCD", marca="FIAT", modelo="FIAT PANDA AZUL")
    fields(owner, titular_nif="12345678Z", titular_nombre="ANA")
    fields(more, proxima_itv="2027-02-01", observaciones="una dos RIOJA (LA) 31.12.2019", provincia="RIOJA (LA)", fecha_matriculacion="2027-02-01")
    fields(empty, matricula=None, servicio="PARTICULAR", modelo=None)


def test_fiscal(read):
    d = read(fiscal, CARD)
    fields(d, numero_nif="A58818501", tipo_nif="CIF", razon_social="EMPRESA PRUEBA, S.L.", denominacion="EMPRESA PRUEBA, S.L.", fecha_nif_definitivo="2016-07-26")
    fields(d, administracion_aeat="28601 MADRID", codigo_administracion="28601", nombre_administracion="MADRID")
    fields(d, domicilio_fiscal="CALLE MAYOR, NUM. 5, PLANTA 0, PUERTA 3 28001 MADRID MADRID", domicilio_fiscal_calle="CALLE MAYOR", domicilio_fiscal_numero="5", domicilio_fiscal_piso_puerta="PLANTA 0, PUERTA 3")
    fields(d, domicilio_fiscal_codigo_postal="28001", domicilio_fiscal_provincia="MADRID", domicilio_fiscal_municipio="MADRID", domicilio_social=None)


def test_fiscal_lines(read):
    bare, inline, code, names, empty = read(
        fiscal,
        "Domicilio CALLE SOL, NUM. 7\nSocial 35016 PALMAS DE PRUEBA (LAS) - (PALMAS, LAS)\nPLANTA 2\nFecha",
        "Domicilio Social AVDA NORTE 12\n08001 VILLAPRUEBA (BARCELONA)\n\nDomicilio Fiscal:",
        "Código Electrónico\nabcdef0123456789\nFecha de Expedición\n01/02/2020\nAnagrama Comercial: MARCA",
        "Razón Social: PRIMERA SA\nDenominación SEGUNDA SA\nRazón Social TERCERA SA",
        "",
    )
    fields(bare, domicilio_social="CALLE SOL, NUM. 7 35016 PALMAS DE PRUEBA (LAS) - (PALMAS, LAS) PLANTA 2", domicilio_social_calle="CALLE SOL", domicilio_social_numero="7", domicilio_social_piso_puerta="PLANTA 2")
    fields(bare, domicilio_social_codigo_postal="35016", domicilio_social_municipio="PALMAS DE PRUEBA", domicilio_social_provincia="LAS")
    fields(inline, domicilio_social_calle="AVDA NORTE", domicilio_social_numero="12", domicilio_social_municipio="VILLAPRUEBA", domicilio_social_provincia="BARCELONA")
    fields(code, codigo_electronico="ABCDEF0123456789", fecha_expedicion="2020-02-01", anagrama_comercial="MARCA")
    fields(names, razon_social="SEGUNDA SA", denominacion="SEGUNDA SA")
    assert all(v is None for v in empty)


def run(spark, family, *texts, confidence=95.0):
    df = spark.createDataFrame([(i, t, "google_vision", confidence) for i, t in enumerate(texts)], "doc_id long, text string, ocr_engine string, ocr_confidence double")
    return analyze_family(df, family, "2025-06-30").orderBy("doc_id").collect()


def codes(result):
    return [(f.code, f.severity, f.field) for f in result.errores_detectados], [(f.code, f.severity, f.field) for f in result.alertas]


def test_identity_results(spark):
    good, letter, expired, minor, noisy, odd = run(spark, "dni", FRONT, FRONT.replace("78Z", "78A"), FRONT.replace("2035", "2024"), FRONT.replace("1980", "2010"), FRONT.replace("\nANA", "\nANA 4"), FRONT.replace("15 06", "31 02"))
    assert (good.valido, good.confianza_global, codes(good)) == (True, 99, ([], []))
    assert (letter.valido, letter.confianza_global, letter.datos.numero_documento) == (False, 52, None)
    assert codes(letter)[0] == [("DNI_CHECKLETTER_MISMATCH", "critical", "numero_documento")]
    assert (expired.valido, expired.confianza_global, codes(expired)[0]) == (True, 86, [("DNI_EXPIRED", "error", "fecha_caducidad")])
    assert codes(minor)[1] == [("DNI_UNDERAGE", "warning", "fecha_nacimiento")]
    assert codes(noisy)[1] == [("DNI_NAME_OCR_NOISE", "warning", "nombre"), ("DNI_NAME_OCR_NOISE", "warning", "nombre_completo")] and noisy.datos.nombre == "ANA"
    assert odd.error == "impossible birth date" and odd.datos.fecha_nacimiento == "1980-02-31"


def test_vehicle_results(spark):
    good, plate, vin, model, none = run(spark, "permiso_circulacion", VEHICLE, VEHICLE.replace("BCF", "AEI"), VEHICLE.replace("9AX", "9A1"), VEHICLE.replace("SEAT IBIZA", "SEAT NADA"), "x", confidence=95.0)
    assert (good.valido, good.confianza_global, codes(good), good.datos.potencia_fiscal) == (True, 99, ([], []), 125.1)
    assert codes(plate)[0] == [("VEH_PLATE_INVALID", "critical", "matricula")] and not plate.valido
    assert codes(vin)[1] == [("VEH_VIN_CHECKDIGIT", "warning", "numero_bastidor")] and vin.valido
    assert codes(model)[1] == [("VEH_OCR_SUSPECT", "warning", "modelo")]
    assert codes(none) == ([("VEH_MISSING_FIELD", "critical", "matricula"), ("VEH_MISSING_FIELD", "critical", "marca")], [("VEH_MISSING_FIELD", "error", "numero_bastidor"), ("VEH_MISSING_FIELD", "error", "titular_nombre")])


def test_fiscal_results(spark):
    good, control, none = run(spark, "nif", CARD, CARD.replace("18501", "18502"), CARD.replace("A58818501", ""), confidence=90.0)
    assert (good.valido, good.confianza_global) == (True, 98)
    assert (control.valido, control.confianza_global, codes(control)[0]) == (False, 69, [("NIF_CHECKDIGIT_MISMATCH", "critical", "numero_nif")])
    assert (none.valido, none.confianza_global, len(none.errores_detectados)) == (False, 22, 2)


def test_mixed_texts_and_plan(spark):
    rows = [(1, "dni", FRONT), (2, None, VEHICLE), (3, None, CARD), (4, "other", "x"), (5, None, None)]
    df = spark.createDataFrame([(*r, "tesseract", 90.0) for r in rows], "doc_id long, doc_type string, text string, ocr_engine string, ocr_confidence double")
    out = analyze(df, "2025-06-30")
    got = {r.doc_id: (r.tipo_documento, r.valido, r.error) for r in out.collect()}
    assert got == {1: ("dni", True, None), 2: ("permiso_circulacion", True, None), 3: ("nif", True, None), 4: (None, False, "unknown type"), 5: (None, False, "unknown type")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
