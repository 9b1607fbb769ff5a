"""Column formulas as SQL text.

A formula is built once and used as a Catalyst expression (``F.expr``), so that it stays in whole-stage code generation; the
same text, with the few spellings in which engines differ, lets another SQL engine check a plan.
A *layer* is a dict of columns computed at once from the columns before; an operator on pixels is a list of layers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layer = dict[str, str]


class Dialect:
    """Spark's spelling."""

    name = "spark"

    def int_(self, x: str) -> str:
        """Towards zero."""
        return f"CAST({x} AS BIGINT)"

    def floor(self, x: str) -> str:
        return f"CAST(floor({x}) AS BIGINT)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))"

    def shr(self, a: str, n: int) -> str:
        return f"shiftright({a}, {n})"

    def shl(self, a: str, n: int) -> str:
        return f"shiftleft({a}, {n})"

    def array(self, items: Iterable[str]) -> str:
        return f"array({', '.join(items)})"

    def at(self, a: str, i: str) -> str:
        """1-based."""
        return f"element_at({a}, CAST({i} AS INT))"

    def fold(self, a: str, start: str, acc: str, item: str, body: str) -> str:
        return f"aggregate({a}, {start}, ({acc}, {item}) -> {body})"

    def map(self, a: str, item: str, body: str) -> str:
        return f"transform({a}, {item} -> {body})"

    def keep(self, a: str, item: str, body: str) -> str:
        return f"filter({a}, {item} -> {body})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def collect(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def size(self, a: str) -> str:
        return f"size({a})"

    def total(self, a: str) -> str:
        return f"aggregate({a}, 0e0, (acc, v) -> acc + v)"


class Duck(Dialect):
    name = "duckdb"

    def int_(self, x: str) -> str:
        return f"CAST(trunc({x}) AS BIGINT)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def shr(self, a: str, n: int) -> str:
        return f"(({a}) >> {n})"

    def shl(self, a: str, n: int) -> str:
        return f"(({a}) << {n})"

    def array(self, items: Iterable[str]) -> str:
        return f"[{', '.join(items)}]"

    def at(self, a: str, i: str) -> str:
        return f"list_extract({a}, CAST({i} AS BIGINT))"

    def fold(self, a: str, start: str, acc: str, item: str, body: str) -> str:
        return f"list_reduce(list_prepend({start}, {a}), lambda {acc}, {item}: {body})"

    def map(self, a: str, item: str, body: str) -> str:
        return f"list_transform({a}, lambda {item}: {body})"

    def keep(self, a: str, item: str, body: str) -> str:
        return f"list_filter({a}, lambda {item}: {body})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def collect(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def size(self, a: str) -> str:
        return f"len({a})"

    def total(self, a: str) -> str:
        return f"list_sum({a})"


SPARK, DUCK = Dialect(), Duck()


def num(x: float) -> str:
    """A DOUBLE literal (a plain decimal literal would be DECIMAL)."""
    return f"{float(x)!r}" if "e" in f"{float(x)!r}" else f"{float(x)!r}e0" if x >= 0 else f"({float(x)!r}e0)"


def clamp(x: str, low: str | float, high: str | float) -> str:
    low, high = (v if isinstance(v, str) else num(v) for v in (low, high))
    return f"least(greatest({x}, {low}), {high})"


def smoothstep(edge0: str, edge1: str, x: str) -> str:
    """The ramp 3t^2 - 2t^3; 1e-7 keeps equal edges from dividing by zero."""
    t = clamp(f"((({x}) - ({edge0})) / (({edge1}) - ({edge0}) + 1e-7))", 0, 1)
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def per_channel(make, names: Iterable[str] = ("r", "g", "b")) -> Layer:
    return {c: make(c) for c in names}


def apply(df: DataFrame, layers: Iterable[Layer]) -> DataFrame:
    """df with the layers' columns; each layer is one projection."""
    for layer in layers:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df


def sql(source: str, columns: Iterable[str], layers: Iterable[Layer], out: str) -> str:
    """The same as a nested SELECT. source: a table expression with these columns; out: the final select list."""
    columns, text = list(columns), source
    for layer in layers:
        keep = [c for c in columns if c not in layer]
        text = f"(SELECT {', '.join([*keep, *(f'{v} AS {k}' for k, v in layer.items())])} FROM {text} AS t)"
        columns = [*keep, *layer]
    return f"SELECT {out} FROM {text} AS t"
