"""Predicates: a builder that records conditions in call order and turns them into one Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "contains": lambda a, b: a.contains(b),
    "starts_with": lambda a, b: a.startswith(b),
    "ends_with": lambda a, b: a.endswith(b),
}
NAMED = {"equals": "=", "not_equals": "!=", "greater_than": ">", "less_than": "<"}


def compare(column: str | Column, operator: str, value) -> Column:
    """column operator value. like is a substring test on the value without its outer %."""
    col = F.col(column) if isinstance(column, str) else column
    operator = NAMED.get(operator.lower(), operator.lower())
    if operator == "like":
        return col.contains(str(value).strip("%"))
    if operator == "in":
        return col.isin(*value)
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    return OPERATORS[operator](col, value if isinstance(value, Column) else F.lit(value))


class Where:
    """Conditions joined in the order of their calls; AND binds tighter than OR."""

    def __init__(self):
        self.calls: list[tuple[str, Column]] = []

    def _add(self, how: str, condition: Column | None) -> Where:
        if condition is not None:
            self.calls.append((how, condition))
        return self

    def _of(self, first, *rest) -> Column | None:
        if isinstance(first, Where):
            return first.column()
        if callable(first) and not isinstance(first, Column):
            inner = Where()
            first(inner)
            return inner.column()
        if isinstance(first, Column):
            return first
        return compare(first, "=", rest[0]) if len(rest) == 1 else compare(first, rest[0], rest[1])

    def where(self, first, *rest) -> Where:
        """column and value, column, operator and value, or a group (a Where or a function that fills one)."""
        return self._add("and", self._of(first, *rest))

    def or_where(self, first, *rest) -> Where:
        return self._add("or", self._of(first, *rest))

    def where_in(self, column: str, values: Sequence) -> Where:
        """An empty list sets no condition."""
        return self._add("and", F.col(column).isin(*values) if values else None)

    def where_not_in(self, column: str, values: Sequence) -> Where:
        return self._add("and", ~F.col(column).isin(*values) if values else None)

    def where_null(self, column: str) -> Where:
        return self._add("and", F.col(column).isNull())

    def where_not_null(self, column: str) -> Where:
        return self._add("and", F.col(column).isNotNull())

    def where_between(self, column: str, bounds: Sequence) -> Where:
        """Both bounds included; anything but two bounds sets no condition."""
        return self._add("and", F.col(column).between(*bounds) if len(bounds) == 2 else None)

    def where_not_between(self, column: str, bounds: Sequence) -> Where:
        return self._add("and", ~F.col(column).between(*bounds) if len(bounds) == 2 else None)

    def where_column(self, left: str, operator: str, right: str) -> Where:
        return self._add("and", compare(left, operator, F.col(right)))

    def where_date(self, column: str, operator: str, day: str) -> Where:
        return self._add("and", compare(F.to_date(column), operator, F.to_date(F.lit(day))))

    def where_time(self, column: str, operator: str, time: str) -> Where:
        return self._add("and", compare(F.date_format(column, "HH:mm:ss"), operator, F.lit(time)))

    def column(self) -> Column | None:
        groups: list[list[Column]] = []
        for how, condition in self.calls:
            if how == "or" or not groups:
                groups.append([])
            groups[-1].append(condition)
        ands = [reduce(lambda a, b: a & b, g) for g in groups]
        return reduce(lambda a, b: a | b, ands) if ands else None

    def apply(self, df):
        condition = self.column()
        return df if condition is None else df.where(condition)


def temporal(column: str, kind: str, *, anchor: str | None = None, amount: str | None = None, value: str | None = None, until: str | None = None) -> Column:
    """before, after, within_last, within_next (of an explicit anchor) and between."""
    col, ts = F.col(column), lambda x: F.to_timestamp(F.lit(x))
    if kind == "before":
        return col < ts(value)
    if kind == "after":
        return col > ts(value)
    if kind == "between":
        return col.between(ts(value), ts(until))
    step = F.expr(f"INTERVAL {amount}")
    if kind == "within_last":
        return (col >= ts(anchor) - step) & (col <= ts(anchor))
    if kind == "within_next":
        return (col >= ts(anchor)) & (col <= ts(anchor) + step)
    raise ValueError(f"unknown temporal operator {kind}")
