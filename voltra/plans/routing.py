"""Which table an expression belongs to, and how an aggregate inside it is evaluated per group."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_AGGREGATES = "avg|mean|sum|min|max|count|stddev|stddev_samp|variance|var_samp|median|bool_or|bool_and|any|every|corr|first_value|last_value|ntile|row_number|lag|lead|percent_rank|rank|dense_rank|percentile"
_CALL = re.compile(rf"\b({_AGGREGATES})\s*\(", re.I)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TEXT = re.compile(r"'(?:[^'\\]|\\.)*'")


def names(expression: Column | str) -> set[str]:
    """Columns an expression names; text literals are not looked into."""
    if isinstance(expression, Column):
        return set(_named(expression._jc.node()))
    if isinstance(expression, str):
        return set(_NAME.findall(_TEXT.sub("''", expression)))
    return set()


def _named(node):
    """Names of the attributes in a column's tree, and in SQL text that is part of it."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedAttribute":
        yield node.sql().split(".")[-1].strip("`")
    elif kind == "SqlExpression":
        yield from names(node.sql())
    children = node.children()
    for i in range(children.size()):
        yield from _named(children.apply(i))


def over(expression: str, partition: list[str], order: list[str]) -> str:
    """``expression`` with every aggregate made a window over ``partition`` (ranking ones ordered by ``order``)."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    text = _TEXT.sub(hide, expression)
    out, at = "", 0
    while m := _CALL.search(text, at):
        depth, end = 1, m.end()
        while depth and end < len(text):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        by = f"PARTITION BY {', '.join(f'`{p}`' for p in partition)}" if partition else ""
        ranked = m[1].lower() in ("ntile", "row_number", "lag", "lead", "percent_rank", "rank", "dense_rank", "first_value", "last_value")
        if re.match(r"\s*over\b", text[end:], re.I):
            out += text[at:end]
        else:
            out += f"{text[at:end]} OVER ({by}{' ORDER BY ' + ', '.join(order) if ranked and order else ''})"
        at = end
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], out + text[at:])


def column(expression: Column | str | float | bool, partition: list[str], order: list[str]) -> Column:
    if isinstance(expression, Column):
        return expression
    if isinstance(expression, str):
        return F.expr(over(expression, partition, order))
    return F.lit(expression)


def na_mean(c: Column | str, na_rm: bool = False) -> Column:
    """Mean that is null if any value is, unless ``na_rm``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(c) if na_rm else F.when(F.count("*") == F.count(c), F.avg(c))
