"""Check digits, formats, OCR corrections, scores and redaction, as SQL expressions."""

from __future__ import annotations

from legajo.functions import fixed
from legajo.functions.text import lit, matches, nz, strip, sub

DNI, NIE = r"^\d{8}[A-Z]$", r"^[XYZ]\d{7}[A-Z]$"
COMPANY = rf"^[{fixed.COMPANY_HEADS}]\d{{7}}[A-J0-9]$"
NOT_A_NAME = r"[^A-Za-zÀ-ÖØ-öø-ÿ \-']"


def clean(x: str) -> str:
    return f"upper({strip(x)})"


def expected_letter(x: str) -> str:
    """Control letter of an id of either person format; NULL for another format."""
    number = f"cast(translate(left({x}, 1), 'XYZ', '012') || substring({x}, 2, 7) as int)"
    letter = f"substring({lit(fixed.PERSON_LETTERS)}, {number} % 23 + 1, 1)"
    return f"if({matches(x, DNI)} or {matches(x, NIE)}, {letter}, null)"


def person_id_ok(x: str) -> str:
    return f"coalesce(right({clean(x)}, 1) = {expected_letter(clean(x))}, false)"


def person_id_type(x: str) -> str:
    return f"case when {matches(x, DNI)} then 'DNI' when {matches(x, NIE)} then 'NIE' end"


def company_digit(x: str) -> str:
    """Control digit of the seven digits after the head letter; the 1st, 3rd, 5th and 7th are doubled."""
    d = [f"cast(substring({x}, {i + 2}, 1) as int)" for i in range(7)]
    doubled = " + ".join(f"({v} * 2 div 10 + {v} * 2 % 10)" for v in d[::2])
    return f"((10 - ({doubled} + {' + '.join(d[1::2])}) % 10) % 10)"


def company_id_ok(x: str) -> str:
    c, last = clean(x), f"right({clean(x)}, 1)"
    digit = company_digit(c)
    by_digit, by_letter = f"{last} = cast({digit} as string)", f"{last} = substring({lit(fixed.COMPANY_LETTERS)}, {digit} + 1, 1)"
    rule = f"case when left({c}, 1) in ({', '.join(map(lit, fixed.COMPANY_DIGIT_ONLY))}) then {by_digit} when left({c}, 1) in ({', '.join(map(lit, fixed.COMPANY_LETTER_ONLY))}) then {by_letter} else {by_digit} or {by_letter} end"
    return f"coalesce(if({matches(c, COMPANY)}, {rule}, false), false)"


def company_expected(x: str) -> str:
    """The control character, both as digit/letter where either may stand; '?' for another format."""
    c = clean(x)
    digit = company_digit(c)
    letter = f"substring({lit(fixed.COMPANY_LETTERS)}, {digit} + 1, 1)"
    rule = f"case when left({c}, 1) in ({', '.join(map(lit, fixed.COMPANY_DIGIT_ONLY))}) then cast({digit} as string) when left({c}, 1) in ({', '.join(map(lit, fixed.COMPANY_LETTER_ONLY))}) then {letter} else cast({digit} as string) || '/' || {letter} end"
    return f"if(coalesce({matches(c, rf'^[{fixed.COMPANY_HEADS}]\d{{7}}')}, false), {rule}, '?')"


def plate_fixed(x: str) -> str:
    """Seven characters: letters read for digits in front and digits read for letters behind are put right."""
    c = sub(f"upper({x})", r"(?U)[\s\-]")
    fixed_ = f"translate(left({c}, 4), {lit(fixed.PLATE_DIGITS[0])}, {lit(fixed.PLATE_DIGITS[1])}) || translate(substring({c}, 5, 3), {lit(fixed.PLATE_ENDINGS[0])}, {lit(fixed.PLATE_ENDINGS[1])})"
    return f"if(length({c}) = 7, {fixed_}, {c})"


def plate_fault(x: str) -> str:
    """'format', 'letters' or NULL for a plate in order."""
    return f"case when not {matches(x, r'^\d{4}[A-Z]{3}$')} then 'format' when not {matches(x, rf'^\d{{4}}[{fixed.PLATE_LETTERS}]{{3}}$')} then 'letters' end"


def id_fixed(x: str) -> str:
    """Letters read for digits in the number part of a person id are put right."""
    c = f"replace(replace({clean(x)}, ' ', ''), '-', '')"
    a, b = map(lit, fixed.ID_DIGITS)
    return f"case when {matches(c, '^[0-9]')} then translate(left({c}, 8), {a}, {b}) || substring({c}, 9) when {matches(c, '^[XYZ]')} then left({c}, 1) || translate(substring({c}, 2, 7), {a}, {b}) || substring({c}, 9) else {c} end"


def _vin(x: str) -> str:
    return f"replace(replace(upper({x}), ' ', ''), '-', '')"


def vin_expected(x: str) -> str:
    """Check character at position 9 from the weighted sum mod 11."""
    c = _vin(x)
    plain = f"translate({c}, {lit(fixed.VIN_LETTERS)}, {lit(fixed.VIN_VALUES)})"
    total = " + ".join(f"cast(substring({plain}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(fixed.VIN_WEIGHTS) if w)
    return f"if(({total}) % 11 = 10, 'X', cast(({total}) % 11 as string))"


def vin_faults(x: str) -> str:
    """Array of 'length', 'forbidden' (I, O, Q), 'charset'."""
    c = _vin(x)
    return f"if(length({c}) <> 17, array('length'), filter(array(if({matches(c, '[IOQ]')}, 'forbidden', null), if(not {matches(c, '^[A-HJ-NPR-Z0-9]{17}$')}, 'charset', null)), e_ -> e_ is not null))"


def vin_check_differs(x: str) -> str:
    c = _vin(x)
    return f"case when {matches(c, '^[A-HJ-NPR-Z0-9]{17}$')} then substring({c}, 9, 1) <> {vin_expected(x)} else false end"


def owner_id_ok(x: str) -> str:
    """Person ids by their letter, company ids by their shape only."""
    c = clean(x)
    return f"coalesce({person_id_ok(x)} or {matches(c, COMPANY)}, false)"


def has_noise(x: str) -> str:
    return f"coalesce({matches(x, NOT_A_NAME)}, false)"


def clean_name(x: str) -> str:
    """Without a misread leading label and characters that no name has; NULL if nothing is left."""
    letters = sub(sub(x, r"(?iU)^(bdr|nif|dni|nie|doc)\s+"), NOT_A_NAME)
    return nz(strip(sub(letters, r"(?U)\s+", " ")))


def vehicle_type(x: str) -> str:
    """Readable type of a category; the category itself if it is unknown."""
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in fixed.CATEGORIES.items())
    return f"coalesce(try_element_at(map({pairs}), {clean(x)}), {clean(x)})"


def kw_from_cv(x: str) -> str:
    """Kilowatts of a horsepower figure to one decimal; exact ties go to even."""
    v = f"({x} * 0.7355D)"
    return f"if({v} * 4 = floor({v} * 4), bround({v}, 1), round({v}, 1))"


def fiscal_power(x: str) -> str:
    return f"bround({x} * 1.36D, 1)"


def score(critical: str, error: str, warning: str, missing: str, confidence: str) -> str:
    """0 to 100: 100 less 35, 15 and 5 for each finding and 20 for each missing field, with 15 % from the OCR confidence."""
    base = f"(100 - 35 * ({critical}) - 15 * ({error}) - 5 * ({warning}) - 20 * ({missing}))"
    return f"cast(greatest(0, least(100, bround({base} * 0.85D + {confidence} * 0.15D))) as int)"


def redacted_id(x: str) -> str:
    return f"if({x} is null or length({x}) < 3, '***', left({x}, 4) || '****' || right({x}, 1))"


def redacted_name(x: str) -> str:
    return f"if({x} is null or {x} = '', '***', rpad(left({x}, 1), length({x}), '*'))"


def log_info(number: str, quality: str, engine: str) -> str:
    """What a log may hold of a document."""
    return f"named_struct('dni_redacted', {redacted_id(number)}, 'qualitat', {quality}, 'engine', {engine})"


def horizontal_score(boxes: str) -> str:
    """Percentage of the boxes with four or more vertices that are wider than high; 0 without any.

    boxes: array of arrays of struct<x, y>.
    """
    full = f"filter({boxes}, b_ -> size(b_) >= 4)"
    side = lambda c: f"array_max(transform(b_, v_ -> v_.{c})) - array_min(transform(b_, v_ -> v_.{c}))"
    wide = f"size(filter({full}, b_ -> {side('x')} > {side('y')}))"
    return f"if(coalesce(size({full}), 0) <= 0, 0D, {wide} / size({full}) * 100D)"
