"""SQL snippets over texts and arrays of lines; all are Catalyst expressions.

Each function returns a SQL expression as a string, so plans stay native and read like the rules they state. Patterns are
Java regexes written as raw literals; ``W`` stands before those that Python-style matching needs: case-insensitive, Unicode,
and only a newline ends a line.
"""

from __future__ import annotations

from collections.abc import Iterable

W = "(?iud)"


def lit(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Iterable[str]) -> str:
    return "array(" + ", ".join(map(lit, values)) + ")"


def nz(x: str) -> str:
    """NULL for an empty string."""
    return f"nullif({x}, '')"


def strip(x: str) -> str:
    """Without leading and trailing white space of any script."""
    return f"regexp_replace({x}, {lit(r'(?U)^\s+|\s+$')}, '')"


def group(x: str, pattern: str, k: int = 1) -> str:
    """Group of the leftmost match; NULL without a match or when the group is empty."""
    return nz(f"regexp_extract({x}, {lit(pattern)}, {k})")


def matches(x: str, pattern: str) -> str:
    return f"regexp_like({x}, {lit(pattern)})"


def any_of(x: str, words: Iterable[str]) -> str:
    """Whether one of the words is a substring."""
    return matches(x, "|".join(r"\Q" + w + r"\E" for w in words))


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)})"


def all_matches(x: str, pattern: str, k: int = 0) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {k})"


def lines(text: str) -> str:
    """All lines, blank ones included."""
    return f"split(coalesce({text}, ''), '\n')"


def kept_lines(text: str) -> str:
    """Stripped lines without the blank ones."""
    return f"filter(transform({lines(text)}, l -> {strip('l')}), l -> l <> '')"


def indexes(array_: str) -> str:
    """0 to size - 1; empty for an empty array."""
    return f"transform({array_}, (x_, i_) -> i_)"


def first(array_: str) -> str:
    return f"get({array_}, 0)"


def last(array_: str) -> str:
    return f"try_element_at({array_}, -1)"


def present(array_: str) -> str:
    return f"filter({array_}, p_ -> p_ is not null)"


def upto(array_: str, stop: str, var: str = "s_") -> str:
    """Elements before the first for which ``stop``, an expression of ``var`` and its index ``j_``, holds."""
    flags = f"transform({array_}, ({var}, j_) -> {stop})"
    return f"slice({array_}, 1, if(array_position({flags}, true) = 0, size({array_}), cast(array_position({flags}, true) as int) - 1))"


def gather(lines_: str, start: str, words: Iterable[str]) -> str:
    """Stripped lines from ``start`` (0-based) joined by a blank, up to a blank line or a later line with a stop word."""
    tail = f"slice({lines_}, {start} + 1, greatest(size({lines_}) - ({start}), 0))"
    return f"array_join({upto(tail, 's_ = \'\' or (j_ > 0 and ' + any_of('upper(s_)', words) + ')')}, ' ')"


def split_keeping(x: str, pattern: str) -> str:
    """Stripped pieces between and of the matches, without empty ones."""
    marked = sub(x, f"({pattern})", "\u0001$1\u0001")
    return f"filter(transform(split({marked}, '\u0001'), q_ -> {strip('q_')}), q_ -> q_ <> '')"


def without_mixed_tokens(x: str) -> str:
    """Tokens that hold both a digit and a letter are dropped; one blank between the others."""
    return f"array_join(filter(split({strip(x)}, {lit('(?U)\\s+')}), k_ -> not ({matches('k_', '[0-9]')} and {matches('k_', r'\p{L}')})), ' ')"


def without_leading_letter(x: str) -> str:
    """White space normalised and a first token of one character dropped."""
    return sub(sub(strip(x), r"(?U)\s+", " "), r"^\S(?: |$)")


def in_range(x: str, kind: str, low: float, high: float) -> str:
    """``x`` as a number if it is one within the range."""
    return f"if(try_cast({x} as {kind}) between {low} and {high}, try_cast({x} as {kind}), null)"


def first_word(words: Iterable[str], x: str) -> str:
    """The first of the words, in their order, that is a substring of ``x``."""
    return f"get(filter({array(words)}, b_ -> contains({x}, b_)), 0)"


def last_line_with(array_: str, words: Iterable[str], least: int) -> str:
    """Greatest index >= least of a line with one of the words; NULL if none."""
    return f"array_max(filter({indexes(array_)}, h_ -> h_ >= {least} and {any_of(f'upper(get({array_}, h_))', words)}))"
