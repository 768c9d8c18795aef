"""Column selection by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable


class Selector:
    def __init__(self, pick: Callable[[list[str]], list[str]]):
        self.pick = pick

    def __neg__(self) -> Selector:
        return Selector(lambda cols: [c for c in cols if c not in self.pick(cols)])

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda cols: [c for c in cols if c in self.pick(cols) or c in other.pick(cols)])

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda cols: [c for c in self.pick(cols) if c in other.pick(cols)])


def _by(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda cols: [c for c in cols if test(c)])


def starts_with(s: str) -> Selector:
    return _by(lambda c: c.startswith(s))


def ends_with(s: str) -> Selector:
    return _by(lambda c: c.endswith(s))


def contains(s: str) -> Selector:
    return _by(lambda c: s in c)


def matches(pattern: str) -> Selector:
    return _by(lambda c: re.search(pattern, c) is not None)


def everything() -> Selector:
    return _by(lambda c: True)


def any_of(names: Iterable[str]) -> Selector:
    wanted = list(names)
    return _by(lambda c: c in wanted)


def all_of(names: Iterable[str]) -> Selector:
    wanted = list(names)

    def pick(cols: list[str]) -> list[str]:
        if missing := [n for n in wanted if n not in cols]:
            raise ValueError(f"no such columns: {missing}")
        return wanted

    return Selector(pick)


def num_range(prefix: str, numbers: Iterable[int]) -> Selector:
    return any_of([f"{prefix}{n}" for n in numbers])


def last_col() -> Selector:
    return Selector(lambda cols: cols[-1:])


def resolve(cols: list[str], *wanted: str | Selector) -> list[str]:
    """Names selected, in the order asked for; ``-name`` drops a name (from all, if it comes first)."""
    if not wanted:
        return list(cols)
    drops = [w for w in wanted if isinstance(w, str) and w.startswith("-")]
    out = list(cols) if len(drops) == len(wanted) else []
    for w in wanted:
        if isinstance(w, Selector):
            out += [c for c in w.pick(cols) if c not in out]
        elif w.startswith("-"):
            out = [c for c in out if c != w[1:]]
        elif w not in cols:
            raise ValueError(f"no such column: {w}")
        elif w not in out:
            out.append(w)
    return out
