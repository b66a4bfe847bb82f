"""Registered queries over the driver tables and the DuckDB SQL that tells their results, mostly from the key alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions import checks, dates, fixed
from legajo.functions import text as T
from legajo.operators import decisions, fiscal, identity, vehicle
from legajo.plans import cases, compare, synthetic
from legajo.plans.pipeline import analyze, analyze_family, date_expr
from legajo.plans.synthetic import AS_OF
from legajo.sources.images import word_confidence
from legajo.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return _QUERIES | cases.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | cases.SQL


def add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, sql


def project(table: str, *exprs: str) -> Query:
    return lambda spark, sf_dir: read_table(spark, sf_dir, table).selectExpr(*exprs)


# DuckDB pieces ---------------------------------------------------------------------------------------------------
N = "((c_custkey * 7919 + 12345678) % 100000000)"
DOC_DIGITS = f"lpad(cast({N} as varchar), 8, '0')"
DOC_RIGHT = f"substr('{fixed.PERSON_LETTERS}', cast({N} % 23 as int) + 1, 1)"
DOC = f"{DOC_DIGITS} || substr('{fixed.PERSON_LETTERS}', cast(({N} % 23 + case when c_custkey % 10 = 7 then 1 else 0 end) % 23 as int) + 1, 1)"
WORDS = lambda x: f"translate(cast({x} as varchar), '0123456789', 'ABCDEFGHIJ')"
DAY = f"date '{AS_OF}'"
BIRTH, EXPIRY = "(date '1950-01-01' + cast(c_custkey % 25000 as int))", "(date '2020-01-01' + cast(c_custkey * 37 % 6000 as int))"
TOWN = f"[{', '.join(repr(t) for t in synthetic.TOWNS)}][cast(c_custkey % 4 as int) + 1]"
SCORE = lambda c, e, w, m, conf=95.0: f"cast(greatest(0, least(100, round_even((100 - 35 * ({c}) - 15 * ({e}) - 5 * ({w}) - 20 * ({m})) * 0.85::double + {conf} * 0.15::double, 0))) as int)"
ONE = lambda cond: f"(case when {cond} then 1 else 0 end)"
M = "((s_suppkey * 104729 + 1234567) % 10000000)"
HEAD = f"substr('{fixed.COMPANY_HEADS}', cast(s_suppkey % 20 as int) + 1, 1)"
_D = [f"({M} // {10**i} % 10)" for i in range(6, -1, -1)]
CONTROL = "((10 - (" + " + ".join([f"{d} * 2 // 10 + {d} * 2 % 10" for d in _D[::2]] + _D[1::2]) + ") % 10) % 10)"
SHOWN = f"cast(({CONTROL} + {ONE('s_suppkey % 9 = 0')}) % 10 as int)"
CIF = f"{HEAD} || lpad(cast({M} as varchar), 7, '0') || case when {HEAD} in ('K', 'P', 'Q', 'S') then substr('{fixed.COMPANY_LETTERS}', {SHOWN} + 1, 1) else cast({SHOWN} as varchar) end"
PLATE_DIGITS = "lpad(cast(p_partkey * 37 % 10000 as varchar), 4, '0')"
_L = lambda n: f"substr('{fixed.PLATE_LETTERS}', cast(p_partkey // {n} % 20 as int) + 1, 1)"
PLATE = f"{PLATE_DIGITS} || {_L(1)} || {_L(20)} || case when p_partkey % 11 = 0 then 'A' else {_L(400)} end"
RAW = "'1M8GDM9A0KP' || lpad(cast(p_partkey % 1000000 as varchar), 6, '0')"
_PLAIN = f"translate({RAW}, '{fixed.VIN_LETTERS}', '{fixed.VIN_VALUES}')"
VIN_SUM = "(" + " + ".join(f"cast(substr({_PLAIN}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(fixed.VIN_WEIGHTS)) + ")"
VIN_DIGIT = f"(case when {VIN_SUM} % 11 = 10 then 'X' else cast({VIN_SUM} % 11 as varchar) end)"
VIN = f"substr({RAW}, 1, 8) || case when p_partkey % 7 = 0 then (case when {VIN_DIGIT} = '1' then '2' else '1' end) else {VIN_DIGIT} end || substr({RAW}, 10)"
CAR = lambda i: f"[{', '.join(repr(c[i]) for c in synthetic.CARS)}][cast(p_partkey % 5 as int) + 1]"
MODEL = f"case when p_partkey % 9 = 0 then 'NADA' else {CAR(1)} end"
REGISTERED = "(date '2000-01-01' + cast(p_partkey % 12000 as int))"
KW = "(case when p_partkey % 19 = 0 then 73.6::double else cast(50 + p_partkey % 100 as double) end)"
SEATS = "(p_size % 17 + 1)"
ISO = lambda d: f"strftime({d}, '%Y-%m-%d')"

# Scalar functions ------------------------------------------------------------------------------------------------
doc = synthetic.person_number("c_custkey", "c_custkey % 10 = 7")
add("f1_doc_check", project("customer", "c_custkey", f"{checks.person_id_ok('lower(' + doc + ')')} as ok"), "select c_custkey, c_custkey % 10 <> 7 as ok from customer")
add("f2_expected_letter", project("customer", "c_custkey", f"{checks.expected_letter(doc)} as letter"), f"select c_custkey, {DOC_RIGHT} as letter from customer")
kinds = "case c_custkey % 3 when 0 then substring('XYZ', cast(c_custkey % 3 as int) + 1, 1) || lpad(cast(c_custkey as string), 7, '0') || 'A' when 1 then lpad(cast(c_custkey as string), 8, '0') || 'Z' else cast(c_custkey as string) end"
add("f3_doc_type", project("customer", "c_custkey", f"{checks.person_id_type(kinds)} as kind"), "select c_custkey, case c_custkey % 3 when 0 then 'NIE' when 1 then 'DNI' end as kind from customer")
cif = synthetic.company_number("s_suppkey", "s_suppkey % 9 = 0")
add("f4_cif_check", project("supplier", "s_suppkey", f"{checks.company_id_ok(cif)} as ok"), "select s_suppkey, s_suppkey % 9 <> 0 as ok from supplier")
add("f5_cif_expected", project("supplier", "s_suppkey", f"{checks.company_expected(cif)} as expected"), f"select s_suppkey, case when {HEAD} in ('A', 'B', 'E', 'H') then cast({CONTROL} as varchar) when {HEAD} in ('K', 'P', 'Q', 'S') then substr('{fixed.COMPANY_LETTERS}', cast({CONTROL} as int) + 1, 1) else cast({CONTROL} as varchar) || '/' || substr('{fixed.COMPANY_LETTERS}', cast({CONTROL} as int) + 1, 1) end as expected from supplier")
digits = "lpad(cast(p_partkey * 37 % 10000 as string), 4, '0')"
three = "substring('BCDFGHJKLMNPRSTVWXYZ', cast(p_partkey % 20 as int) + 1, 1) || substring('BCDFGHJKLMNPRSTVWXYZ', cast(p_partkey div 20 % 20 as int) + 1, 1) || 'B'"
misread = f"translate({digits}, '015826', 'OISBZG') || ' - ' || lower({three.replace(chr(39) + 'B' + chr(39), chr(39) + '8' + chr(39))})"
add("f6_plate_fix", project("part", "p_partkey", f"{checks.plate_fixed(misread)} as plate"), f"select p_partkey, {PLATE_DIGITS} || {_L(1)} || {_L(20)} || 'B' as plate from part")
half = "substring('0123456789', cast(c_custkey % 10 as int) + 1, 1) || translate(lpad(cast(c_custkey as string), 7, '0'), '01582', 'OISBZ') || ' -a'"
add("f7_id_fix", project("customer", "c_custkey", f"{checks.id_fixed(half)} as id"), "select c_custkey, cast(c_custkey % 10 as varchar) || lpad(cast(c_custkey as varchar), 7, '0') || 'A' as id from customer")
plate = "if(p_partkey % 7 = 0, '123', '1234') || 'BC' || if(p_partkey % 11 = 0, 'Q', 'D')"
add("f8_plate_check", project("part", "p_partkey", f"{checks.plate_fault(plate)} as fault"), "select p_partkey, case when p_partkey % 7 = 0 then 'format' when p_partkey % 11 = 0 then 'letters' end as fault from part")
vin = "if(p_partkey % 5 = 0, 'I', '1') || 'M8GDM9A' || cast(p_partkey % 10 as string) || 'KP' || lpad(cast(p_partkey % 1000000 as string), if(p_partkey % 3 = 0, 5, 6), '0')"
add(
    "f9_vin_check",
    project("part", "p_partkey", f"array_join({checks.vin_faults(vin)}, ',') as faults", f"{checks.vin_check_differs(vin)} as differs"),
    f"select p_partkey, case when p_partkey % 3 = 0 then 'length' when p_partkey % 5 = 0 then 'forbidden,charset' else '' end as faults, p_partkey % 3 <> 0 and p_partkey % 5 <> 0 and cast(p_partkey % 10 as varchar) <> {VIN_DIGIT} as differs from part",
)
dmy = lambda sep: f"lpad(cast(p_partkey % 35 as string), 2, '0') || '{sep}' || lpad(cast(p_partkey % 14 as string), 2, '0') || '{sep}' || cast(1960 + p_partkey % 100 as string)"
duck_iso = lambda low, high: f"case when p_partkey % 35 between 1 and 31 and p_partkey % 14 between 1 and 12 and 1960 + p_partkey % 100 between {low} and {high} then cast(1960 + p_partkey % 100 as varchar) || '-' || lpad(cast(p_partkey % 14 as varchar), 2, '0') || '-' || lpad(cast(p_partkey % 35 as varchar), 2, '0') end"
add("f10_iso_date", project("part", "p_partkey", f"{dates.slash_iso(dmy('/'))} as iso"), f"select p_partkey, {duck_iso(0, 9999)} as iso from part")
add("f11_iso_dash", project("part", "p_partkey", f"{dates.dash_iso(dmy('-'), '1980', '2025')} as iso"), f"select p_partkey, {duck_iso(1980, 2025)} as iso from part")
add("f12_iso_search", project("part", "p_partkey", f"{dates.any_iso(chr(39) + 'on ' + chr(39) + ' || ' + dmy('.') + ' || ' + chr(39) + ' x' + chr(39))} as iso"), f"select p_partkey, {duck_iso(1970, 2050)} as iso from part")
noisy = "if(c_custkey % 3 = 0, 'dni  ', '') || 'José' || if(c_custkey % 4 = 0, '_#', '') || '   O''Neil-Nuñez' || cast(c_custkey % 10 as string)"
add("f13_clean_name", project("customer", "c_custkey", f"{checks.clean_name(noisy)} as name"), "select c_custkey, 'José O''Neil-Nuñez' as name from customer")
add("f14_noise", project("customer", "c_custkey", f"{checks.has_noise('if(c_custkey % 4 = 0, c_mktsegment || 0, c_mktsegment)')} as noise"), "select c_custkey, c_custkey % 4 = 0 as noise from customer")
codes = [*fixed.CATEGORIES, "ZZ"]
add(
    "f15_category",
    project("part", "p_partkey", f"{checks.vehicle_type('lower(' + synthetic._pick(codes, f'p_partkey % {len(codes)}') + ')')} as kind"),
    f"select p_partkey, [{', '.join(repr(x) for x in [*fixed.CATEGORIES.values(), 'ZZ'])}][cast(p_partkey % {len(codes)} as int) + 1] as kind from part",
)
add("f16_fiscal_power", project("part", "p_partkey", f"{checks.fiscal_power('cast(p_partkey % 1000 as double)')} as power"), "select p_partkey, round_even((p_partkey % 1000)::double * 1.36::double, 1) as power from part")
add("f17_score", project("part", "p_partkey", f"{checks.score('p_partkey % 3', 'p_partkey % 4', 'p_partkey % 5', 'p_partkey % 2', 'cast(p_partkey % 101 as double)')} as score"), f"select p_partkey, {SCORE('p_partkey % 3', 'p_partkey % 4', 'p_partkey % 5', 'p_partkey % 2', '(p_partkey % 101)::double')} as score from part")
add("f18_redact", project("customer", "c_custkey", f"{checks.redacted_id('if(c_custkey % 5 = 0, left(c_name, 2), c_name)')} as hidden"), "select c_custkey, case when c_custkey % 5 = 0 then '***' else substr(c_name, 1, 4) || '****' || right(c_name, 1) end as hidden from customer")
add("f19_redact_name", project("customer", "c_custkey", f"{checks.redacted_name('nullif(c_mktsegment, ' + T.lit('MACHINERY') + ')')} as hidden"), "select c_custkey, case when c_mktsegment = 'MACHINERY' then '***' else substr(c_mktsegment, 1, 1) || repeat('*', length(c_mktsegment) - 1) end as hidden from customer")
add("f20_log_info", project("customer", "c_custkey", f"{checks.log_info('c_name', 'cast(c_custkey % 100 as int)', 'c_mktsegment')}.dni_redacted as id", f"{checks.log_info('c_name', 'cast(c_custkey % 100 as int)', 'c_mktsegment')}.qualitat as quality"), "select c_custkey, substr(c_name, 1, 4) || '****' || right(c_name, 1) as id, cast(c_custkey % 100 as int) as quality from customer")
box = lambda w, h: f"array(named_struct('x', 0, 'y', 0), named_struct('x', {w}, 'y', 0), named_struct('x', {w}, 'y', {h}), named_struct('x', 0, 'y', {h}))"
boxes = f"array({box('cast(p_partkey % 7 as int)', '3')}, {box('cast(p_partkey % 5 as int)', '2')}, slice({box('9', '1')}, 1, 3))"
add("f21_horizontal", project("part", "p_partkey", f"{checks.horizontal_score(boxes)} as score"), f"select p_partkey, ({ONE('p_partkey % 7 > 3')} + {ONE('p_partkey % 5 > 2')}) / 2.0::double * 100.0::double as score from part")

# Line operators on real texts --------------------------------------------------------------------------------------
L = "string_split(text, chr(10))"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
KEPT = f"list_filter(list_transform({L}, lambda x: {STRIP('x')}), lambda x: x <> '')"
SPARK_L = T.lines("text")
add("l1_lines", project("documents", "doc_id", f"size({SPARK_L}) as n"), f"select doc_id, cast(len({L}) as int) as n from documents")
add("l2_kept_lines", project("documents", "doc_id", f"size({T.kept_lines('text')}) as n"), f"select doc_id, cast(len({KEPT}) as int) as n from documents")
add("l3_label_lines", project("documents", "doc_id", f"size(filter({SPARK_L}, l -> {T.any_of('l', ['The', 'Die', 'Les'])})) as n"), f"select doc_id, cast(len(list_filter({L}, lambda x: contains(x, 'The') or contains(x, 'Die') or contains(x, 'Les'))) as int) as n from documents")
add("l4_coded_label", project("documents", "doc_id", f"size(filter({SPARK_L}, l -> {T.matches('l', r'(?-u)[Ll]icensed\s+under')})) as n"), f"select doc_id, cast(len(list_filter({L}, lambda x: regexp_matches(x, '[Ll]icensed\\s+under'))) as int) as n from documents")
hits = lambda array, word: f"filter({T.indexes(array)}, i -> contains(get({array}, i), '{word}'))"
duck_hits = lambda array, word: f"list_filter(range(1, len({array}) + 1), lambda i: contains({array}[i], '{word}'))"
add(
    "l5_next_line",
    project("documents", "doc_id", f"array_join(transform(filter({hits(SPARK_L, 'th')}, i -> i + 1 < size({SPARK_L})), i -> get({SPARK_L}, i + 1)), '|') as next"),
    f"select doc_id, coalesce(array_to_string(list_transform(list_filter({duck_hits('l', 'th')}, lambda i: i < len(l)), lambda i: l[i + 1]), '|'), '') as next from (select doc_id, {L} as l from documents)",
)
kept = f"(select conv_id, turn, {KEPT} as k from conversations)"
add(
    "l6_next_value",
    lambda spark, sf_dir: read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{T.kept_lines('text')} as k").selectExpr("conv_id", "turn", f"array_join(transform(filter({hits('k', 'a')}, i -> i + 1 < size(k)), i -> get(k, i + 1)), '|') as next"),
    f"select conv_id, turn, coalesce(array_to_string(list_transform(list_filter({duck_hits('k', 'a')}, lambda i: i < len(k)), lambda i: k[i + 1]), '|'), '') as next from {kept}",
)
stops = "lambda x, j: x = '' or (j > 1 and (contains(upper(x), 'THE') or contains(upper(x), 'QUE')))"
cut = f"coalesce(nullif(list_position(list_transform(t[i + 1:], {stops}), true), 0), len(t) + 1)"
add(
    "l7_gather",
    lambda spark, sf_dir: read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"transform({SPARK_L}, l -> {T.strip('l')}) as t").selectExpr("conv_id", "turn", f"array_join(transform({hits('t', 'a')}, i -> {T.gather('t', '(i + 1)', ['THE', 'QUE'])}), '|') as block"),
    f"select conv_id, turn, coalesce(array_to_string(list_transform({duck_hits('t', 'a')}, lambda i: array_to_string(t[i + 1:i + {cut} - 1], ' ')), '|'), '') as block from (select conv_id, turn, list_transform({L}, lambda x: {STRIP('x')}) as t from conversations)",
)
add("l10_same_line", project("documents", "doc_id", f"{T.group('text', r'(?iud)licensed\s+(.+)')} as tail"), "select doc_id, nullif(regexp_extract(text, '(?i)licensed\\s+(.+)', 1), '') as tail from documents")
add("l11_first_match", project("documents", "doc_id", f"{T.group('text', '([0-9]{3,})')} as found"), "select doc_id, nullif(regexp_extract(text, '([0-9]{3,})', 1), '') as found from documents")
add("l12_all_matches", project("documents", "doc_id", f"size({T.all_matches('text', '[0-9]{2,}')}) as n", f"{T.last(T.all_matches('text', '[0-9]{2,}'))} as last"), "select doc_id, cast(len(regexp_extract_all(text, '[0-9]{2,}')) as int) as n, regexp_extract_all(text, '[0-9]{2,}')[-1] as last from documents")
add("l15_last_hit", project("documents", "doc_id", f"{T.last(f'filter({SPARK_L}, l -> contains(l, {T.lit("on")}))')} as line"), f"select doc_id, list_filter({L}, lambda x: contains(x, 'on'))[-1] as line from documents")
add("l16_first_hit", project("documents", "doc_id", f"{T.first(f'filter({SPARK_L}, l -> contains(l, {T.lit("on")}))')} as line"), f"select doc_id, list_filter({L}, lambda x: contains(x, 'on'))[1] as line from documents")
add("l17_range_parse", project("documents", "doc_id", f"{T.in_range(T.group('text', '([0-9]{3,5})'), 'int', 500, 50000)} as number"), "select doc_id, case when try_cast(regexp_extract(text, '([0-9]{3,5})', 1) as int) between 500 and 50000 then try_cast(regexp_extract(text, '([0-9]{3,5})', 1) as int) end as number from documents")
add("l18_range_date", project("orders", "o_orderkey", f"{dates.dash_iso('date_format(o_orderdate, ' + T.lit('dd-MM-yyyy') + ')', '1993', '1997')} as iso"), f"select o_orderkey, case when year(o_orderdate) between 1993 and 1997 then {ISO('o_orderdate')} end as iso from orders")
each_line = lambda e: f"array_join(transform({SPARK_L}, l -> {e}), '\n') as lines"
duck_lines = lambda e: f"select doc_id, array_to_string(list_transform({L}, lambda l: {e}), chr(10)) as lines from documents"
add("l19_token_filter", project("documents", "doc_id", each_line(T.without_mixed_tokens("l"))), duck_lines(f"array_to_string(list_filter(regexp_split_to_array({STRIP('l')}, '\\s+'), lambda x: not (regexp_matches(x, '[0-9]') and regexp_matches(x, '\\p{{L}}'))), ' ')"))
add("l20_leading_letter", project("documents", "doc_id", each_line(T.without_leading_letter("l"))), duck_lines(f"regexp_replace(regexp_replace({STRIP('l')}, '\\s+', ' ', 'g'), '^\\S( |$)', '')"))
add("l21_split_keep", project("documents", "doc_id", f"size({T.split_keeping('text', '[0-9]{3}')}) as n"), f"select doc_id, cast(len(list_filter(list_transform(string_split(regexp_replace(text, '([0-9]{{3}})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP('x')}), lambda x: x <> '')) as int) as n from documents")
places = f"array('CALLE', {synthetic._pick(synthetic.TOWNS, 'p_partkey % 4')}, if(p_partkey % 3 = 0, 'en ' || {synthetic._pick(synthetic.TOWNS, 'p_partkey % 2')}, 'nada'))"
add("l22_province", project("part", "p_partkey", f"cast({T.last_line_with(places, fixed.PROVINCES, 1)} as int) as at"), f"select p_partkey, case when p_partkey % 3 = 0 and upper([{', '.join(repr(t) for t in synthetic.TOWNS)}][cast(p_partkey % 2 as int) + 1]) <> '' then 2 else 1 end as at from part")
cars = "element_at(array('UN MERCEDES-BENZ', 'VW', 'NUEVO FORD Y SEAT', 'NINGUNO'), cast(p_partkey % 4 as int) + 1)"
add("l23_brand", project("part", "p_partkey", f"{T.first_word(fixed.BRANDS, cars)} as brand"), "select p_partkey, ['MERCEDES', 'VW', 'SEAT', null][cast(p_partkey % 4 as int) + 1] as brand from part")


# Families ----------------------------------------------------------------------------------------------------------
def results(texts: Callable[[SparkSession, str], DataFrame], family: str) -> Query:
    code = "array_join(transform({}, f -> f.code || ':' || f.severity || ':' || f.field), ',')"
    return lambda spark, sf_dir: analyze_family(texts(spark, sf_dir), family, AS_OF).selectExpr("doc_id", "valido", "confianza_global", f"{code.format('errores_detectados')} as errors", f"{code.format('alertas')} as alerts")


def extracted(ops, texts, *fields: str) -> Query:
    return lambda spark, sf_dir: ops.extract(texts(spark, sf_dir), date_expr(AS_OF)).selectExpr("doc_id", *[f"datos.{f} as {f.replace('.', '_')}" for f in fields])


def listed(*pairs: tuple[str, str]) -> str:
    """DuckDB: the codes whose conditions hold, joined by commas."""
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{code}' end" for c, code in pairs) + "], lambda x: x is not null), ',')"


century = lambda d: f"(case when year({d}) % 100 > 35 then '19' else '20' end) || strftime({d}, '%y-%m-%d')"
add(
    "d_mrz",
    extracted(identity, synthetic.zone_texts, "numero_documento", "apellidos", "nombre", "sexo", "fecha_nacimiento", "fecha_caducidad", "mrz.nationality"),
    f"select c_custkey as doc_id, case when c_custkey % 5 <> 0 then {DOC_DIGITS} || {DOC_RIGHT} end as numero_documento, case when c_custkey % 5 <> 0 then 'EJEMPLO ' || {WORDS('c_custkey % 100')} end as apellidos, case when c_custkey % 5 <> 0 then 'ANA' end as nombre, case when c_custkey % 5 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end as sexo, case when c_custkey % 5 <> 0 then {century(BIRTH)} end as fecha_nacimiento, case when c_custkey % 5 <> 0 then {century(EXPIRY)} end as fecha_caducidad, case when c_custkey % 5 <> 0 then 'ESP' end as mrz_nationality from customer",
)
add(
    "d_extract",
    extracted(identity, synthetic.identity_texts, "numero_documento", "tipo_numero", "apellidos", "nombre", "sexo", "nacionalidad", "fecha_nacimiento", "fecha_caducidad", "domicilio", "calle", "numero", "codigo_postal", "municipio", "provincia"),
    f"select c_custkey as doc_id, {DOC} as numero_documento, 'DNI' as tipo_numero, 'EJEMPLO ' || {WORDS('c_custkey % 100')} as apellidos, case when c_custkey % 13 <> 0 then (case when c_custkey % 2 = 0 then 'ANA' else 'LUIS' end) end as nombre, case when c_custkey % 2 = 0 then 'F' else 'M' end as sexo, 'ESP' as nacionalidad, case when c_custkey % 17 <> 0 then {ISO(BIRTH)} end as fecha_nacimiento, {ISO(EXPIRY)} as fecha_caducidad, 'CALLE MAYOR ' || (c_custkey % 99 + 1) as domicilio, 'CALLE MAYOR' as calle, cast(c_custkey % 99 + 1 as varchar) as numero, lpad(cast(c_custkey % 50000 as varchar), 5, '0') as codigo_postal, 'POBLE' as municipio, {TOWN} as provincia from customer",
)
wrong, unnamed, unborn, old = "c_custkey % 10 = 7", "c_custkey % 13 = 0", "c_custkey % 17 = 0", f"{EXPIRY} < {DAY}"
minor = f"(c_custkey % 17 <> 0 and ({DAY} - {BIRTH}) // 365 < 18)"
d_errors = listed((wrong, "DNI_CHECKLETTER_MISMATCH:critical:numero_documento"), (unnamed, "DNI_MISSING_FIELD:error:nombre"), (unborn, "DNI_MISSING_FIELD:error:fecha_nacimiento"), (old, "DNI_EXPIRED:error:fecha_caducidad"))
d_score = SCORE(ONE(wrong), f"{ONE(unnamed)} + {ONE(unborn)} + {ONE(old)}", ONE(minor), f"{ONE(wrong)} + {ONE(unnamed)} + {ONE(unborn)}")
D_ROWS = f"select c_custkey as doc_id, not ({wrong}) and not ({unnamed}) as valido, {d_score} as confianza_global, {d_errors} as errors, {listed((minor, 'DNI_UNDERAGE:warning:fecha_nacimiento'))} as alerts from customer"
add("d_validate", results(synthetic.identity_texts, "dni"), D_ROWS)

add(
    "v_extract",
    extracted(vehicle, synthetic.vehicle_texts, "matricula", "numero_bastidor", "marca", "modelo", "cilindrada_cc", "potencia_kw", "combustible", "masa_maxima", "masa_orden_marcha", "plazas", "categoria", "tipo_vehiculo", "titular_nombre", "fecha_matriculacion", "servicio"),
    f"select p_partkey as doc_id, {PLATE} as matricula, {VIN} as numero_bastidor, {CAR(0)} as marca, {CAR(0)} || ' ' || {MODEL} as modelo, cast(1000 + p_partkey % 1500 as int) as cilindrada_cc, {KW} as potencia_kw, 'DIESEL' as combustible, cast(1500 + p_partkey % 1000 as int) as masa_maxima, cast(1000 + p_partkey % 800 as int) as masa_orden_marcha, cast({SEATS} as int) as plazas, case when {SEATS} <= 9 then 'M1' when {SEATS} <= 16 then 'M2' end as categoria, case when {SEATS} <= 9 then 'Turisme' when {SEATS} <= 16 then 'Autobús lleuger' end as tipo_vehiculo, case when p_partkey % 13 <> 0 then 'ANA PRUEBA' end as titular_nombre, {ISO(REGISTERED)} as fecha_matriculacion, 'PARTICULAR' as servicio from part",
)
vowel, future, heavy = "p_partkey % 11 = 0", f"{REGISTERED} > {DAY}", "1000 + p_partkey % 800 > 1500 + p_partkey % 1000"
digit, unknown, nobody = "p_partkey % 7 = 0", "(p_partkey % 9 = 0 and p_partkey % 5 <> 4)", "p_partkey % 13 = 0"
odd_power = f"not ({KW} / (1000 + p_partkey % 1500) between 0.02::double and 0.20::double)"
v_errors = listed((vowel, "VEH_PLATE_INVALID:critical:matricula"), (future, "VEH_DATES_INCONSISTENT:error:fecha_matriculacion"), (heavy, "VEH_DATES_INCONSISTENT:error:masa_orden_marcha"))
v_alerts = listed((digit, "VEH_VIN_CHECKDIGIT:warning:numero_bastidor"), (unknown, "VEH_OCR_SUSPECT:warning:modelo"), (odd_power, "VEH_OCR_SUSPECT:warning:potencia_kw"), (nobody, "VEH_MISSING_FIELD:error:titular_nombre"))
v_score = SCORE(ONE(vowel), f"{ONE(future)} + {ONE(heavy)} + {ONE(nobody)}", f"{ONE(digit)} + {ONE(unknown)} + {ONE(odd_power)}", ONE(nobody))
V_ROWS = f"select p_partkey as doc_id, not ({vowel}) as valido, {v_score} as confianza_global, {v_errors} as errors, {v_alerts} as alerts from part"
add("v_validate", results(synthetic.vehicle_texts, "permiso_circulacion"), V_ROWS)

add(
    "n_extract",
    extracted(fiscal, synthetic.fiscal_texts, "numero_nif", "razon_social", "domicilio_fiscal_calle", "domicilio_fiscal_numero", "domicilio_fiscal_piso_puerta", "domicilio_fiscal_codigo_postal", "domicilio_fiscal_municipio", "domicilio_fiscal_provincia", "fecha_nif_definitivo", "codigo_administracion", "nombre_administracion"),
    f"select s_suppkey as doc_id, {CIF} as numero_nif, case when s_suppkey % 7 <> 0 then 'EMPRESA ' || {WORDS('s_suppkey')} || ', S.L.' end as razon_social, case when s_suppkey % 11 <> 0 then 'CALLE MAYOR' end as domicilio_fiscal_calle, case when s_suppkey % 11 <> 0 then cast(s_suppkey % 99 + 1 as varchar) end as domicilio_fiscal_numero, case when s_suppkey % 11 <> 0 then 'PLANTA 0, PUERTA 3' end as domicilio_fiscal_piso_puerta, case when s_suppkey % 11 <> 0 then '28001' end as domicilio_fiscal_codigo_postal, case when s_suppkey % 11 <> 0 then 'POBLE' end as domicilio_fiscal_municipio, case when s_suppkey % 11 <> 0 then 'GIRONA' end as domicilio_fiscal_provincia, case when year(date '1990-01-01' + cast(s_suppkey * 53 % 14000 as int)) <= 2025 then {ISO('(date ' + chr(39) + '1990-01-01' + chr(39) + ' + cast(s_suppkey * 53 % 14000 as int))')} end as fecha_nif_definitivo, '28601' as codigo_administracion, 'MADRID' as nombre_administracion from supplier",
)
bad, anonymous, homeless = "s_suppkey % 9 = 0", "s_suppkey % 7 = 0", "s_suppkey % 11 = 0"
late = f"((date '1990-01-01' + cast(s_suppkey * 53 % 14000 as int)) > {DAY} and year(date '1990-01-01' + cast(s_suppkey * 53 % 14000 as int)) <= 2025)"
n_errors = listed((bad, "NIF_CHECKDIGIT_MISMATCH:critical:numero_nif"), (anonymous, "NIF_MISSING_FIELD:error:razon_social"), (homeless, "NIF_MISSING_FIELD:error:domicilio_fiscal"), (late, "NIF_DATE_INVALID:error:fecha_nif_definitivo"))
n_score = SCORE(ONE(bad), f"{ONE(anonymous)} + {ONE(homeless)} + {ONE(late)}", "0", f"{ONE(anonymous)} + {ONE(homeless)}")
N_ROWS = f"select s_suppkey as doc_id, not ({bad}) and not ({anonymous}) and not ({homeless}) as valido, {n_score} as confianza_global, {n_errors} as errors, '' as alerts from supplier"
add("n_validate", results(synthetic.fiscal_texts, "nif"), N_ROWS)


# Decisions, comparisons and figures ---------------------------------------------------------------------------------
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all three families, routed by the labels of their texts."""
    texts = [t(spark, sf_dir) for t in (synthetic.identity_texts, synthetic.vehicle_texts, synthetic.fiscal_texts)]
    texts = texts[0].unionByName(texts[1]).unionByName(texts[2])
    return analyze(texts.withColumn("doc_type", F.lit(None).cast("string")), AS_OF)


ALL_ROWS = " union all ".join(f"select '{k}' as tipo_documento, * from ({q})" for k, q in (("dni", D_ROWS), ("permiso_circulacion", V_ROWS), ("nif", N_ROWS)))
add("r20_route", lambda spark, sf_dir: mixed(spark, sf_dir).groupBy("tipo_documento").agg(F.count("*").alias("n"), F.count_if("valido").alias("valid")), f"select tipo_documento, count(*) as n, count_if(valido) as valid from ({ALL_ROWS}) group by all")
add(
    "r11_findings_by_code",
    lambda spark, sf_dir: compare.findings_by_code(mixed(spark, sf_dir)),
    f"select tipo_documento, split_part(f, ':', 1) as code, split_part(f, ':', 2) as severity, count(*) as n from (select tipo_documento, unnest(list_filter(string_split(errors || ',' || alerts, ','), lambda x: x <> '')) as f from ({ALL_ROWS})) group by all",
)
add(
    "r17_tier",
    lambda spark, sf_dir: mixed(spark, sf_dir).selectExpr("doc_id", "tipo_documento", f"{decisions.tier('valido', 'confianza_global')} as tier"),
    f"select doc_id, tipo_documento, case when not valido then 'INVALIT' when confianza_global >= 90 then 'ACCEPTAT' when confianza_global >= 70 then 'ACCEPTAT_AMB_AVIS' else 'REVISAR_MANUALMENT' end as tier from ({ALL_ROWS})",
)
confidence = "cast(doc_id % 60 + 20 as double)"
add(
    "r15_fallback",
    lambda spark, sf_dir: identity.extract(synthetic.identity_texts(spark, sf_dir), date_expr(AS_OF)).selectExpr("doc_id", f"{decisions.identity_fallback('datos', confidence, 'text')} as reason"),
    f"select c_custkey as doc_id, case when {wrong} then 'number missing or invalid' when {unnamed} then 'name missing' when c_custkey % 60 + 20 < 35 then 'low confidence' else 'accepted' end as reason from customer",
)
add(
    "r16_fallback",
    lambda spark, sf_dir: vehicle.extract(synthetic.vehicle_texts(spark, sf_dir)).selectExpr("doc_id", f"{decisions.vehicle_fallback('datos', confidence)} as reason"),
    f"select p_partkey as doc_id, case when p_partkey % 60 + 20 < 50 then 'low confidence' when {vowel} then 'plate invalid' else 'accepted' end as reason from part",
)
RUNS = "(select event_id % 100 as image, case when event_type in ('click', 'view', 'error') then 'tesseract' else 'google_vision' end as engine, ['none', 'standard', 'aggressive', 'document'][cast(user_id % 4 as int) + 1] as preprocess_mode, least(value, 100.0::double) as confidence, (event_id % 97 + 1) / 50.0::double as processing_time, event_type <> 'error' as success, event_id as ordinal from events)"
BEST = lambda order: f"select image, engine, preprocess_mode, confidence, processing_time, ordinal from {RUNS} where success qualify row_number() over (partition by image order by {order}, ordinal) = 1"


def best_run(order) -> Query:
    return lambda spark, sf_dir: compare.best(synthetic.ocr_runs(spark, sf_dir), order(), ["image"]).select("image", "engine", "preprocess_mode", "confidence", "processing_time", "ordinal")


add("r2_successes", lambda spark, sf_dir: synthetic.ocr_runs(spark, sf_dir).where("success").groupBy("engine", "preprocess_mode").agg(F.count("*").alias("n")), f"select engine, preprocess_mode, count(*) as n from {RUNS} where success group by all")
add("r3_best_conf", best_run(compare.by_confidence), BEST("confidence desc"))
add("r4_best_speed", best_run(compare.by_speed), BEST("processing_time"))
add("r5_balance", best_run(compare.by_balance), BEST("confidence / (processing_time + 0.1::double) desc"))
means = lambda e: f"round(coalesce(avg(case when success and engine = '{e}' then confidence end), 0), 6)"
add(
    "r6_engine_avg",
    lambda spark, sf_dir: compare.engine_means(synthetic.ocr_runs(spark, sf_dir), ["image"]).selectExpr("image", "round(tesseract_avg, 6) as tesseract_avg", "round(google_vision_avg, 6) as google_vision_avg"),
    f"select image, {means('tesseract')} as tesseract_avg, {means('google_vision')} as google_vision_avg from {RUNS} group by image",
)
add(
    "r7_recommendations",
    lambda spark, sf_dir: compare.recommendations(synthetic.ocr_runs(spark, sf_dir), ["image"]).selectExpr("image", "recommendations['best_balance'] as best_balance", "recommendations['recommended_engine'] as recommended_engine"),
    f"select image, best_balance, recommended_engine from (select image, case when avg(case when success and engine = 'google_vision' then confidence end) > coalesce(avg(case when success and engine = 'tesseract' then confidence end), 0) then 'google_vision' else 'tesseract' end as recommended_engine from {RUNS} group by image) join (select image, engine || ' + ' || preprocess_mode as best_balance from ({BEST('confidence / (processing_time + 0.1::double) desc')})) using (image)",
)
words = "transform(sequence(0, 5), i -> cast((event_id * (i + 3)) % 11 - 3 as double))"
add("s6_word_confidence", project("events", "event_id", f"{word_confidence(words)} as mean"), "select event_id, round_even(coalesce(list_avg(list_filter([cast((event_id * (i + 3)) % 11 - 3 as double) for i in range(0, 6)], lambda x: x > 0)), 0), 2) as mean from events")
add(
    "r18_usage",
    lambda spark, sf_dir: compare.usage(read_table(spark, sf_dir, "events"), "ts", "event_type", "value > 10", "value").selectExpr("day", "kind", "n", "round(success_rate, 6) as success_rate", "round(mean_latency, 6) as mean_latency"),
    "select cast(ts as date) as day, event_type as kind, count(*) as n, round(avg(case when value > 10 then 1.0 else 0.0 end), 6) as success_rate, round(avg(value), 6) as mean_latency from events group by all",
)
add(
    "r19_first_result",
    lambda spark, sf_dir: compare.first_results(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id"),
    "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1",
)
add(
    "r21_cost",
    lambda spark, sf_dir: read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).selectExpr("event_type", f"round({compare.monthly_cost('n * 4000')}, 6) as cost"),
    "select event_type, round((greatest(0, least(n * 4000, 5000000) - 1000) * 1.5::double + greatest(0, n * 4000 - 5000000) * 0.6::double) / 1000, 6) as cost from (select event_type, count(*) as n from events group by event_type)",
)
