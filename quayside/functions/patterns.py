"""File-name patterns, turned into Column predicates while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.paths import ext


class MalformedPattern(ValueError):
    pass


def _literal(ch: str) -> str:
    return f"\\x{{{ord(ch):X}}}"


def glob_regex(pattern: str) -> str:
    """Regular expression for a shell glob: ``* ? [a-z] [^a-z] \\c``.

    Raises MalformedPattern for an unclosed or empty class and for a dangling escape.
    """
    out: list[str] = []
    pos = 0

    def take_escaped(i: int, in_class: bool) -> tuple[str, int]:
        if i >= len(pattern) or (in_class and pattern[i] in "-]"):
            raise MalformedPattern(pattern)
        if pattern[i] == "\\":
            i += 1
            if i >= len(pattern):
                raise MalformedPattern(pattern)
        return pattern[i], i + 1

    while pos < len(pattern):
        ch = pattern[pos]
        if ch == "*":
            out.append("[^/]*")
            pos += 1
        elif ch == "?":
            out.append("[^/]")
            pos += 1
        elif ch == "[":
            pos += 1
            negated = pos < len(pattern) and pattern[pos] == "^"
            pos += negated
            ranges: list[str] = []
            empty_ranges = 0
            while not ((ranges or empty_ranges) and pos < len(pattern) and pattern[pos] == "]"):
                low, pos = take_escaped(pos, in_class=True)
                high = low
                if pos < len(pattern) and pattern[pos] == "-":
                    high, pos = take_escaped(pos + 1, in_class=True)
                if pos >= len(pattern):
                    raise MalformedPattern(pattern)
                if low <= high:
                    ranges.append(f"{_literal(low)}-{_literal(high)}")
                else:
                    empty_ranges += 1
            pos += 1
            if ranges:
                out.append(f"[{'^' if negated else ''}{''.join(ranges)}]")
            else:
                out.append(r"[\s\S]" if negated else r"(?!)")
        else:
            lit, pos = take_escaped(pos, in_class=False)
            out.append(_literal(lit))
    return rf"\A{''.join(out)}\z"


def match(name: Column | str, pattern: str) -> Column:
    """One pattern against one base name.

    ``*`` takes everything; ``*.x`` compares only the *last* extension, case-folded and with no
    glob fallback (so ``*.tar.gz`` never matches); then equality; then a case-sensitive glob.
    """
    n = F.col(name) if isinstance(name, str) else name
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*."):
        return F.lower(ext(n)) == pattern[1:].lower()
    exact = n == pattern
    if not any(c in pattern for c in "*?[\\"):
        return exact
    try:
        return exact | n.rlike(glob_regex(pattern))
    except MalformedPattern:
        return exact


def accepts(name: Column | str, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Exclude wins over include; an empty include list takes everything."""
    any_of = lambda ps: reduce(lambda a, b: a | b, [match(name, p) for p in ps], F.lit(False))
    wanted = any_of(include) if include else F.lit(True)
    return wanted & ~any_of(exclude) if exclude else wanted
