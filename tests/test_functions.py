"""Scalar functions on the fixture values and as properties."""

import random

import pytest

from legajo.functions import checks, dates, fixed
from legajo.functions import text as T
from legajo.operators import decisions
from legajo.operators.rules import FINDING, score
from legajo.sources.images import skew_angle


@pytest.fixture(scope="module")
def value(spark):
    """Values of an expression over the column x for each given x."""

    def run(expr, *xs, kind="string"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
        return [r.v for r in df.selectExpr("i", f"{expr} as v").orderBy("i").collect()]

    return run


def test_person_ids(value):
    assert value(checks.person_id_ok("x"), "12345678Z", "12345678A", "1234567Z", "", "ABC", "12345678z", "X1234567L", None) == [True, False, False, False, False, True, True, False]
    assert value(checks.person_id_type("x"), "12345678Z", "X1234567L", "ABC", None) == ["DNI", "NIE", None, None]


def test_one_letter_fits(value):
    r = random.Random(1)
    for n in (r.randrange(10**8) for _ in range(5)):
        fits = value(checks.person_id_ok("x"), *(f"{n:08d}{c}" for c in fixed.PERSON_LETTERS))
        assert sum(fits) == 1
        assert value(checks.expected_letter("x"), f"{n:08d}A") == [fixed.PERSON_LETTERS[n % 23]]


def test_company_ids(value):
    good = ["A58818501", "K1234567D", "C12345674", "C1234567D"]
    bad = ["A5881850A", "K12345674", "K1234567E", "E78476350", "Z1234567A", " B 7626", "", None]
    assert value(checks.company_id_ok("x"), *good, *bad) == [True] * 4 + [False] * 8
    assert value(checks.company_expected("x"), "A58818502", "K1234567X", "C12345670", "nothing", None) == ["1", "D", "4/D", "?", "?"]


def test_plates(value):
    assert value(checks.plate_fault("x"), "1234BCF", "9999BCF", "1234AEI", "1234BQC", "123BCF", "12345BCF", "1234BÑC") == [None, None, "letters", "letters", "format", "format", "format"]
    assert value(checks.plate_fixed("x"), "11O7BCF", "1107 bcf", "B1238CD", "M-1234-AB") == ["1107BCF", "1107BCF", "8123BCD", "M1234AB"]


def test_vins(value):
    assert value(checks.vin_faults("x"), "1M8GDM9AXKP042788", "1M8GDM9AXKP0", "IM8GDM9AXKP042788", "1M8GDM9AXKP04278*") == [[], ["length"], ["forbidden", "charset"], ["charset"]]
    assert value(checks.vin_check_differs("x"), "1M8GDM9AXKP042788", "1M8GDM9A1KP042788") == [False, True]


def test_owner_ids(value):
    assert value(checks.owner_id_ok("x"), "12345678Z", "12345678A", "A58818502", "nothing", None) == [True, False, True, False, False]
    assert value(checks.id_fixed("x"), "1234S678z", "X-O2E4567 L", "abc", "") == ["12345678Z", "X02E4567L", "ABC", ""]


def test_dates(value):
    assert value(dates.any_iso("x"), "08/08/2024", "28.02.2025", "01-01-2020", "01/13/2024", "01/01/1900", "", "31/02/2020") == ["2024-08-08", "2025-02-28", "2020-01-01", None, None, None, "2020-02-31"]
    assert value(dates.slash_iso("x"), "01/02/2020", "01-02-2020", " 01/02/2020") == ["2020-02-01", None, None]
    assert value(dates.dash_iso("x"), "01-02-2020", "01/02/2020") == ["2020-02-01"] * 2
    assert [str(v) for v in value(dates.twin("x"), "2020-02-31", "2020-02-28")] == ["None", "2020-02-28"]


def test_names(value):
    assert value(checks.clean_name("x"), "NIF  ANA#  MARÍA", "123", "", None, "L'Hô-pital") == ["ANA MARÍA", None, None, None, "L'Hô-pital"]
    assert value(checks.has_noise("x"), "ANA 4", "ANA", None) == [True, False, False]
    assert value(checks.redacted_id("x"), "12345678A", "12", None) == ["1234****A", "***", "***"]
    assert value(checks.redacted_name("x"), "JOAN", "A", "", None) == ["J***", "A", "***", "***"]


def test_python_rounding(value):
    cvs = [x / 10 for x in range(10, 15001, 7)]
    assert value(checks.kw_from_cv("x"), *cvs, kind="double") == [round(v * 0.7355, 1) for v in cvs]
    kws = [x / 10 for x in range(10, 10001, 7)]
    assert value(checks.fiscal_power("x"), *kws, kind="double") == [round(v * 1.36, 1) for v in kws]


def test_score(spark, value):
    def own(c, e, w, m, confidence):
        return max(0, min(100, round((100 - 35 * c - 15 * e - 5 * w - 20 * m) * 0.85 + confidence * 0.15)))

    cases = [(c, e, w, m, x) for c in range(3) for e in range(3) for w in range(3) for m in range(3) for x in (0.0, 50.0, 90.0, 95.0, 100.0)]
    df = spark.createDataFrame(cases, "c int, e int, w int, m int, x double").selectExpr("c", "e", "w", "m", "x", f"{checks.score('c', 'e', 'w', 'm', 'x')} as s")
    assert all(r.s == own(r.c, r.e, r.w, r.m, r.x) for r in df.collect())
    empty = f"cast(array() as array<{FINDING}>)"
    assert value(score(empty, empty, "0", "95D"), "x") == [99]


def test_lines(value):
    assert value(T.kept_lines("x"), " a \n\n b \n", "", None) == [["a", "b"], [], []]
    assert value(T.lines("x"), "a\n\nb\n", "") == [["a", "", "b", ""], [""]]
    assert value(T.gather(T.lines("x"), "1", ["STOP"]), "k\nstop one\ntwo\nx stop\nthree", "k\n\ntwo", "k") == ["stop one two", "", ""]
    assert value(T.split_keeping("x", r"\d{5}"), "C. A 9 08000 V B", "123456", "12345") == [["C. A 9", "08000", "V B"], ["12345", "6"], ["12345"]]
    assert value(T.without_leading_letter("x"), "J ANA", "J  A ANA", "ANA", "J") == ["ANA", "A ANA", "ANA", ""]


def test_boxes(spark):
    box = lambda w, h: [(0, 0), (w, 0), (w, h), (0, h)]
    df = spark.createDataFrame([([box(9, 1), box(1, 9), box(5, 1)[:3]],), ([],), (None,)], "b array<array<struct<x:int,y:int>>>")
    assert [r.s for r in df.selectExpr(f"{checks.horizontal_score('b')} as s").collect()] == [50.0, 0.0, 0.0]


def test_decisions(value):
    assert value(decisions.tier("true", "x"), 95, 90, 75, 10, kind="int") == ["ACCEPTAT", "ACCEPTAT", "ACCEPTAT_AMB_AVIS", "REVISAR_MANUALMENT"]
    assert value(skew_angle("x"), [3.0, 1.0, 2.0], [0.2, 0.4], [], kind="array<double>") == [2.0, 0.0, 0.0]
