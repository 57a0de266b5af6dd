"""Condition trees over the facts of a row, as boolean columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARISONS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
                "==": operator.eq, "!=": operator.ne}


def _family(value: object) -> str:
    if isinstance(value, T.NumericType | T.BooleanType | bool | int | float):
        return "number"
    return "text"


class Conditions:
    """Compiles trees against the columns of one DataFrame.

    Every leaf is TRUE or FALSE: a fact that is missing (no column, or NULL in a row) and a
    comparison of a number with a text are FALSE, so ``not`` over them is TRUE.
    """

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def _fact(self, name: str) -> Column | None:
        if name not in self.types:
            return None
        column = F.col(name)
        return column.cast("int") if isinstance(self.types[name], T.BooleanType) else column

    def _alike(self, name: str, value: object) -> bool:
        return _family(self.types[name]) == _family(value)

    @staticmethod
    def _literal(value: object) -> Column:
        return F.lit(int(value)) if isinstance(value, bool) else F.lit(value)

    def leaf(self, node: dict) -> Column:
        fact = self._fact(node.get("fact"))
        kind = node["op"]
        if fact is None:
            return F.lit(False)
        if kind in _COMPARISONS:
            value = node["value"]
            if not self._alike(node["fact"], value):
                return F.lit(kind == "!=") & fact.isNotNull()
            result = _COMPARISONS[kind](fact, self._literal(value))
        elif kind == "in":
            fitting = [self._literal(v) for v in node["value"] if self._alike(node["fact"], v)]
            result = fact.isin(fitting) if fitting else F.lit(False)
        elif kind == "contains":
            result = fact.cast("string").contains(str(node["value"]))
        elif kind == "between":
            low, high = node["low"], node["high"]
            if not (self._alike(node["fact"], low) and self._alike(node["fact"], high)):
                return F.lit(False)
            result = (fact >= self._literal(low)) & (fact <= self._literal(high))
        else:
            return F.lit(False)
        return F.coalesce(result, F.lit(False))

    def trace(self, node: dict) -> list[tuple[str, Column]]:
        """(label, result) of every node, children first, all of them evaluated."""
        kind = node.get("op") if isinstance(node, dict) else None
        if kind == "not":
            inner = self.trace(node["arg"])
            return [*inner, ("NOT", ~inner[-1][1])]
        if kind in ("and", "or"):
            parts = [self.trace(child) for child in node["args"]]
            start, join = (True, operator.and_) if kind == "and" else (False, operator.or_)
            result = reduce(join, [p[-1][1] for p in parts], F.lit(start))
            return [*(step for part in parts for step in part), (kind.upper(), result)]
        if kind in _COMPARISONS or kind in ("in", "contains", "between"):
            label = f"{node.get('fact')} {kind}"
            return [(label, self.leaf(node))]
        return [(f"unknown op {kind!r}", F.lit(False))]

    def compile(self, node: dict) -> Column:
        return self.trace(node)[-1][1]


def evaluate(df: DataFrame, condition: dict, result: str = "passed", with_trace: bool = False) -> DataFrame:
    """``df`` plus the verdict and, where wanted, one boolean per node as an array."""
    steps = Conditions(df).trace(condition)
    df = df.withColumn(result, steps[-1][1])
    return df.withColumn("trace", F.array(*[c for _, c in steps])) if with_trace else df
