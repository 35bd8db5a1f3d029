"""Metadata predicates: a tree of conditions that becomes a Column, or SQL text.

A missing key makes every condition false except NOT_EQUALS, which it makes true.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("EQUALS", "NOT_EQUALS", "CONTAINS", "STARTS_WITH", "ENDS_WITH", "EXISTS", "IN", "GREATER_THAN", "LESS_THAN")


def _compare(left: Column, right: str, greater: bool) -> Column:
    """As numbers if both are numbers, else as strings."""
    order = (lambda a, b: a > b) if greater else (lambda a, b: a < b)
    a, b = left.try_cast("double"), F.lit(right).try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), order(a, b)).otherwise(order(left, F.lit(right)))


@dataclass
class Condition:
    key: str
    op: str
    value: str | None = None
    values: list[str] | None = None

    def to_column(self, of) -> Column:
        """``of``: a map column, or a function from a key to a column."""
        v = of(self.key) if callable(of) else of[self.key]
        found = {
            "EQUALS": lambda: v == self.value,
            "NOT_EQUALS": lambda: ~v.eqNullSafe(F.lit(self.value)),
            "CONTAINS": lambda: v.contains(self.value),
            "STARTS_WITH": lambda: v.startswith(self.value),
            "ENDS_WITH": lambda: v.endswith(self.value),
            "EXISTS": lambda: v.isNotNull(),
            "IN": lambda: v.isin(*self.values) if self.values else F.lit(False),
            "GREATER_THAN": lambda: _compare(v, self.value, True),
            "LESS_THAN": lambda: _compare(v, self.value, False),
        }[self.op]()
        return F.coalesce(found, F.lit(False))

    def to_sql(self) -> str | None:
        q = lambda s: "'" + str(s).replace("'", "''") + "'"
        k = "`" + self.key.replace("`", "``") + "`"
        like = lambda s: s.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        return {
            "EQUALS": lambda: f"{k} = {q(self.value)}",
            "NOT_EQUALS": lambda: f"NOT ({k} <=> {q(self.value)})",
            "CONTAINS": lambda: f"{k} LIKE {q('%' + like(self.value) + '%')}",
            "IN": lambda: f"{k} IN ({', '.join(map(q, self.values or []))})" if self.values else "false",
            "GREATER_THAN": lambda: f"{k} > {q(self.value)}",
            "LESS_THAN": lambda: f"{k} < {q(self.value)}",
        }.get(self.op, lambda: None)()


@dataclass
class MetadataFilter:
    """Conditions or further filters under AND or OR; none of them is true for all rows."""

    logic: str = "AND"
    parts: list[Condition | MetadataFilter] = field(default_factory=list)

    @classmethod
    def eq(cls, key: str, value: str) -> MetadataFilter:
        return cls(parts=[Condition(key, "EQUALS", value)])

    @classmethod
    def ne(cls, key: str, value: str) -> MetadataFilter:
        return cls(parts=[Condition(key, "NOT_EQUALS", value)])

    @classmethod
    def contains(cls, key: str, value: str) -> MetadataFilter:
        return cls(parts=[Condition(key, "CONTAINS", value)])

    @classmethod
    def isin(cls, key: str, values: list[str]) -> MetadataFilter:
        return cls(parts=[Condition(key, "IN", values=list(values))])

    def add(self, key: str, op: str, value: str | None = None, values: list[str] | None = None) -> MetadataFilter:
        if op not in OPS:
            raise ValueError(op)
        self.parts.append(Condition(key, op, value, values))
        return self

    def to_column(self, of) -> Column:
        if not self.parts:
            return F.lit(True)
        return reduce(operator.and_ if self.logic == "AND" else operator.or_, [p.to_column(of) for p in self.parts])

    def to_sql(self) -> str:
        some = [s for s in (p.to_sql() for p in self.parts) if s]
        return "(" + f" {self.logic} ".join(some) + ")" if some else "true"


def combine(logic: str, *filters: MetadataFilter, flat: bool = False) -> MetadataFilter:
    """Filters under AND or OR; ``flat`` puts all their conditions on one level, which loses inner grouping."""
    if flat:
        return MetadataFilter(logic, [c for f in filters for c in f.parts])
    return MetadataFilter(logic, list(filters))


def time_range(start: str | None, end: str | None, key: str = "year") -> MetadataFilter:
    """Strictly between."""
    f = MetadataFilter()
    if start:
        f.add(key, "GREATER_THAN", start)
    if end:
        f.add(key, "LESS_THAN", end)
    return f


def has_any_tag(tags: list[str], key: str = "tags") -> MetadataFilter:
    return MetadataFilter("OR", [Condition(key, "CONTAINS", t) for t in tags])


def has_all_tags(tags: list[str], key: str = "tags") -> MetadataFilter:
    return MetadataFilter("AND", [Condition(key, "CONTAINS", t) for t in tags])


def department_path(path: list[str]) -> MetadataFilter:
    """By the last element."""
    return MetadataFilter.eq("department", path[-1]) if path else MetadataFilter()


def document_types(types: list[str]) -> MetadataFilter:
    return MetadataFilter.eq("document_type", types[0]) if len(types) == 1 else MetadataFilter.isin("document_type", types)


def authors(names: list[str]) -> MetadataFilter:
    return MetadataFilter("OR", [Condition("author", "EQUALS", n) for n in names])


def business_query(**wanted: str | None) -> MetadataFilter:
    """Equality of every field that is given."""
    return MetadataFilter(parts=[Condition(k, "EQUALS", v) for k, v in wanted.items() if v])
