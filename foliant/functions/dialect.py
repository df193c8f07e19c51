"""Expressions that can be written for Spark and for an ANSI engine that checks them.

The library's functions are defined once as SQL expressions over a dialect. Spark runs them
as ordinary Catalyst expressions; the other dialect states the same query for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

_names = count()


class Dialect:
    """What the two engines write differently. Patterns keep to syntax that both regex engines share."""

    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, text: str) -> str:
        return "'" + (text.replace("\\", "\\\\").replace("'", "\\'") if self.spark else text.replace("'", "''")) + "'"

    def re(self, pattern: str) -> str:
        """A pattern whose classes are Unicode-aware and whose lines end in \\n only."""
        return self.lit("(?Ud)" + pattern if self.spark else pattern)

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def record(self, fields: dict[str, str]) -> str:
        """A struct of named fields."""
        if self.spark:
            return f"named_struct({', '.join(f'{self.lit(k)}, {v}' for k, v in fields.items())})"
        return "{" + ", ".join(f"{self.lit(k)}: {v}" for k, v in fields.items()) + "}"

    def words(self, items: tuple[str, ...] | list[str]) -> str:
        return self.array([self.lit(x) for x in items])

    def none(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)" if self.spark else "CAST([] AS VARCHAR[])"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        if self.spark:
            for i in range(1, 4):
                by = by.replace(f"\\{i}", f"${i}")
            return f"regexp_replace({x}, {self.re(pattern)}, {self.lit(by)})"
        return f"regexp_replace({x}, {self.re(pattern)}, {self.lit(by)}, 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.re(pattern)})" if self.spark else f"regexp_matches({x}, {self.re(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def split(self, x: str, mark: str) -> str:
        return f"split({x}, {self.lit(re.escape(mark))}, -1)" if self.spark else f"string_split({x}, {self.lit(mark)})"

    def strip(self, x: str, chars: str) -> str:
        return f"btrim({x}, {self.lit(chars)})" if self.spark else f"trim({x}, {self.lit(chars)})"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})" if self.spark else f"starts_with({x}, {y})"

    def name(self) -> str:
        return f"v{next(_names)}"

    def _apply(self, ours: str, theirs: str, a: str, body: Callable[..., str], index: bool) -> str:
        x, i = self.name(), self.name()
        at = f"({i} + 1)" if self.spark else i
        inner = body(x, at) if index else body(x)
        if self.spark:
            return f"{ours}({a}, {f'({x}, {i})' if index else x} -> {inner})"
        return f"{theirs}({a}, lambda {f'{x}, {i}' if index else x}: {inner})"

    def map(self, a: str, body: Callable[..., str], index: bool = False) -> str:
        """Each element (and its position from 1 with ``index``) through ``body``."""
        return self._apply("transform", "list_transform", a, body, index)

    def where(self, a: str, body: Callable[..., str], index: bool = False) -> str:
        return self._apply("filter", "list_filter", a, body, index)

    def let(self, x: str, body: Callable[[str], str]) -> str:
        """``body`` of x, computed once however often it is used."""
        return f"{self.map(self.array([x]), body)}[{0 if self.spark else 1}]"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def any(self, a: str, body: Callable[[str], str]) -> str:
        return f"({self.size(self.where(a, body))} > 0)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})" if self.spark else f"list_contains({a}, {x})"

    def get(self, a: str, i: str) -> str:
        """Element at a position from 1; null outside."""
        return f"try_element_at({a}, CAST({i} AS INT))" if self.spark else f"list_extract({a}, {i})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({n} AS INT))" if self.spark else f"list_slice({a}, {start}, {start} + {n} - 1)"

    def join(self, a: str, by: str = " ") -> str:
        return f"array_join({a}, {self.lit(by)})" if self.spark else f"array_to_string({a}, {self.lit(by)})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})" if self.spark else f"list_concat({', '.join(arrays)})"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def range(self, n: str) -> str:
        """1 to n; empty below 1."""
        if self.spark:
            x = self.name()
            return f"filter(sequence(1, greatest(CAST({n} AS INT), 1)), {x} -> {x} <= {n})"
        return f"generate_series(1, {n})"

    def distinct(self, a: str) -> str:
        """Without repeats, first ones stay in order."""
        if self.spark:
            return f"array_distinct({a})"
        return self.let(a, lambda v: self.where(v, lambda x, i: f"list_position({v}, {x}) = {i}", index=True))

    def shared(self, a: str, b: str) -> str:
        """Number of different values in both."""
        return self.size(f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})")

    def subset(self, a: str, b: str) -> str:
        """Whether all of a are in b; b is computed once, not for each of a."""
        if self.spark:
            return f"(size(array_except({a}, {b})) = 0)"
        return self.let(b, lambda v: f"(NOT {self.any(a, lambda x: f'NOT {self.has(v, x)}')})")

    def total(self, a: str) -> str:
        if self.spark:
            s, x = self.name(), self.name()
            return f"aggregate({a}, CAST(0 AS DOUBLE), ({s}, {x}) -> {s} + {x})"
        return f"coalesce(list_sum({a}), 0)"

    def largest(self, a: str, least: str = "0") -> str:
        """Largest number of a list, or ``least``."""
        return f"coalesce({'array_max' if self.spark else 'list_max'}({a}), {least})"

    def explode(self, a: str, value: str = "item", position: str = "pos") -> str:
        """FROM-clause part that adds a row for each element, with its position from 0 (BIGINT)."""
        if self.spark:
            return f"LATERAL (SELECT CAST(p AS BIGINT) AS {position}, c AS {value} FROM (SELECT posexplode({a}) AS (p, c)))"
        return f"LATERAL (SELECT CAST(unnest(generate_series(0, len({a}) - 1)) AS BIGINT) AS {position}, unnest({a}) AS {value})"

    def gather(self, x: str, order: str) -> str:
        """Aggregate: values as a list in the order of a unique key."""
        if self.spark:
            v = self.name()
            return f"transform(array_sort(collect_list(struct({order} AS k, {x} AS x))), {v} -> {v}.x)"
        return f"list({x} ORDER BY {order})"


SPARK = Dialect(True)
DUCK = Dialect(False)
