"""One pattern text, two regular-expression engines.

Rules are written once in a neutral form: ``\\b`` is a boundary of ASCII words, ``\\s`` any white space of the
browser's definition, ``.`` any character that doesn't end a line. ``java`` and ``re2`` spell that out for
Spark and for DuckDB.
"""

from __future__ import annotations

# White space, and ends of lines, as the browser's language defines them.
_SPACES = ["\\t", "\\n", "\\x0b", "\\f", "\\r", " ", "00a0", "1680", ("2000", "200a"), "2028", "2029", "202f", "205f", "3000", "feff"]
_ENDS = ["\\n", "\\r", "2028", "2029"]


def _spell(items: list) -> str:
    one = lambda x: f"\\x{{{x}}}" if len(x) == 4 and x[0] != "\\" else x
    return "".join(f"{one(x[0])}-{one(x[1])}" if isinstance(x, tuple) else one(x) for x in items)


SPACE, END = _spell(_SPACES), _spell(_ENDS)
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _translate(pattern: str, boundary: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not inside:
            out.append(boundary)
        elif two == "\\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        elif two[:1] == "." and not inside:
            out.append(f"[^{END}]")
            i -= 1
        else:
            inside = {"[": True, "]": False}.get(two[:1], inside)
            out.append(two[:1])
            i -= 1
        i += 2
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """For Spark. Its own ``\\b`` also counts letters beyond ASCII, so the boundary is spelt out."""
    return ("(?i)" if ignore_case else "") + _translate(pattern, BOUNDARY)


def loose(pattern: str, ignore_case: bool = False) -> str:
    """For Spark, without boundaries: matches wherever the pattern does, and is several times quicker."""
    return ("(?i)" if ignore_case else "") + _translate(pattern, "")


def re2(pattern: str, ignore_case: bool = False) -> str:
    """For DuckDB."""
    return ("(?i)" if ignore_case else "") + _translate(pattern, r"\b")


def quoted(s: str) -> str:
    """A SQL string literal of DuckDB."""
    return "'" + s.replace("'", "''") + "'"
