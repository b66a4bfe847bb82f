"""Dates as ISO text, checked by parts only (31 February passes), with DATE twins."""

from __future__ import annotations

from legajo.functions.text import group


def iso(x: str, separators: str, anchored: bool, low: str = "0", high: str = "9999") -> str:
    """dd, mm, yyyy with one of ``separators`` to yyyy-mm-dd; NULL out of range. Anchored: the whole string, else the leftmost match."""
    body = rf"(\d{{2}})[{separators}](\d{{2}})[{separators}](\d{{4}})"
    pattern = f"^{body}$" if anchored else body
    d, m, y = (group(x, pattern, k) for k in (1, 2, 3))
    return f"if(cast({m} as int) between 1 and 12 and cast({d} as int) between 1 and 31 and cast({y} as int) between {low} and {high}, concat({y}, '-', {m}, '-', {d}), null)"


def slash_iso(x: str) -> str:
    return iso(x, "/", True)


def dash_iso(x: str, low: str = "0", high: str = "9999") -> str:
    return iso(x, "-/", True, low, high)


def any_iso(x: str) -> str:
    """First date with -, / or . anywhere, of 1970 to 2050."""
    return iso(x, "-/.", False, "1970", "2050")


def twin(x: str) -> str:
    """The DATE of an ISO text, NULL for impossible ones."""
    return f"try_to_date({x}, 'yyyy-MM-dd')"


def century(yy: str, as_of: str) -> str:
    """Four-digit year: 19yy if yy lies over ten years ahead of ``as_of``, else 20yy."""
    return f"if(cast({yy} as int) > year({as_of}) % 100 + 10, '19', '20') || lpad({yy}, 2, '0')"
