"""Which defined function a misspelt name most likely means."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomlint.functions.tree import Tree, function, keyed, local, statements


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two names."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    m = len(matched)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def score(undefined: Column, candidate: Column, similarity: Column | None = None) -> Column:
    """The ladder of likeness, as an integer; the last rung is 60 times the Jaro similarity, rounded."""
    mangled = undefined.contains("__")
    likeness = similarity if similarity is not None else jaro_similarity(undefined, candidate)
    other = candidate != undefined
    return (
        F.when(candidate == F.concat(undefined, F.lit("?")), 100)
        .when(candidate == F.concat(undefined, F.lit("!")), 95)
        .when(mangled & (candidate == F.replace(undefined, F.lit("__"), F.lit("?"))), 90)
        .when(mangled & (candidate == F.replace(undefined, F.lit("__"), F.lit("!"))), 85)
        .when(other & undefined.startswith(candidate), 80)
        .when(other & candidate.startswith(undefined), 75)
        .when(other & (candidate.contains(undefined) | undefined.contains(candidate)), 70)
        .otherwise(F.floor(likeness * 60 + 0.5).cast("int"))
    )


def plain_score(undefined: str, candidate: str) -> int:
    """``score`` of two strings."""
    if candidate == undefined + "?":
        return 100
    if candidate == undefined + "!":
        return 95
    if "__" in undefined and candidate == undefined.replace("__", "?"):
        return 90
    if "__" in undefined and candidate == undefined.replace("__", "!"):
        return 85
    if candidate != undefined:
        if undefined.startswith(candidate):
            return 80
        if candidate.startswith(undefined):
            return 75
        if undefined in candidate or candidate in undefined:
            return 70
    return int(jaro(undefined, candidate) * 60 + 0.5)


def defined(tree: Tree, module: str) -> list[tuple[str, int, str]]:
    """(name, arity, def or defp) of the functions at the top of a module, in order, each once."""
    body = None
    for n in tree.nodes:
        if local(n, "defmodule", 2) and n.args[0].kind == "alias" and n.args[0].name == module:
            body = keyed(n.args[1], "do")
    out = {}
    for s in statements(body):
        f = function(s)
        if f:
            out.setdefault((f.name, len(f.params or [])), f.kind)
        elif local(s) and s.name in ("def", "defp") and s.args and s.args[0].kind in ("call", "var"):
            out.setdefault((s.args[0].name, len(s.args[0].args)), s.name)
    return [(name, arity, kind) for (name, arity), kind in out.items()]


def suggest(tree: Tree, module: str, name: str, arity: int, public_only: bool = False) -> str | None:
    """The best candidate; of equal ones the first defined."""
    found = [(plain_score(name, n), -i, n) for i, (n, a, kind) in enumerate(defined(tree, module)) if a == arity and (kind == "def" or not public_only)]
    return max(found)[2] if found else None


def candidates(asked: DataFrame, functions: DataFrame) -> DataFrame:
    """Ranked candidates: ``asked`` (source_id, module, name, arity, public_only) against ``functions`` (source_id, module,
    ord, function, arity, visibility); adds score and rank."""
    first = functions.groupBy("source_id", "module", "function", "arity").agg(F.min("ord").alias("ord"), F.min_by("visibility", "ord").alias("visibility"))
    both = asked.join(first, ["source_id", "module", "arity"]).where((F.col("visibility") == "def") | ~F.col("public_only"))
    scored = both.withColumn("score", score(F.col("name"), F.col("function")))
    w = Window.partitionBy("source_id", "module", "name", "arity").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w))
