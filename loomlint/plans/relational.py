"""Node-table forms of rules whose shape is a join, a window or an aggregation, and the same in SQL.

The rules in ``patterns`` run where a source is parsed; these take a node table that was written once (a corpus of
nodes can be queried many times).  All of them group or join by source_id, so a table that is partitioned by it is not
shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlint.plans.nodes import nodes
from loomlint.sources.corpus import read_table

TRACKED = ("count", "max", "min", "sum", "member?", "any?", "all?", "find", "find_value")
NESTED = ("map", "filter", "reduce", "count", "any?", "all?", "find", "find_value", "member?")


def calls(node: DataFrame, mod: str, names: tuple[str, ...]) -> DataFrame:
    return node.where((F.col("kind") == "remote") & (F.col("mod") == mod) & F.col("name").isin(*names))


def subjects(node: DataFrame, call: DataFrame) -> DataFrame:
    """Calls with the variable that is their first argument (``ord`` 1: the module stands before it)."""
    first = node.where("kind = 'var' and ord = 1").select("source_id", F.col("parent").alias("id"), F.col("name").alias("var"))
    return call.join(first, ["source_id", "id"])


def repeated_traversals(node: DataFrame) -> DataFrame:
    """Every tracked call on a variable name that has more than one in its source."""
    w = Window.partitionBy("source_id", "var")
    return subjects(node, calls(node, "Enum", TRACKED)).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1").select("source_id", "var", "name", "line")


def later_traversals(node: DataFrame) -> DataFrame:
    """The second and later tracked calls on a variable name in pre-order."""
    w = Window.partitionBy("source_id", "var").orderBy("id")
    return subjects(node, calls(node, "Enum", NESTED)).withColumn("r", F.row_number().over(w)).where("r > 1").select("source_id", "var", "name", "line")


def folds(node: DataFrame) -> DataFrame:
    return calls(node, "List", ("foldl", "foldr")).select("source_id", "name", "line")


def many_at(node: DataFrame) -> DataFrame:
    """Variables with three or more literal ``Enum.at`` calls: their number and first line."""
    index = node.where("kind = 'int' and ord = 2").select("source_id", F.col("parent").alias("id"))
    at = subjects(node, calls(node, "Enum", ("at",)).where("arity = 2")).join(index, ["source_id", "id"], "left_semi")
    return at.groupBy("source_id", "var").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).where("n >= 3")


def adjacent_steps(node: DataFrame, before: str, after: tuple[str, ...]) -> DataFrame:
    """Pipeline steps ``Enum.before`` that a step ``Enum.after`` follows at once."""
    w = Window.partitionBy("source_id", "pipe_id").orderBy("pipe_step")
    step = node.where("pipe_step is not null").withColumn("next", F.lead("name").over(w)).withColumn("next_mod", F.lead("mod").over(w))
    return step.where((F.col("mod") == "Enum") & (F.col("name") == before) & (F.col("next_mod") == "Enum") & F.col("next").isin(*after)).select("source_id", "name", "next", "line")


#: A corpus of our own for these queries: (source_id, code).
CORPUS = [
    (1, "def a(xs) do\n  n = Enum.count(xs)\n  m = Enum.max(xs)\n  {n, m, Enum.map(ys, &f/1)}\nend"),
    (2, "def b(xs), do: xs |> Enum.map(&f/1) |> Enum.sum()\ndef c(xs), do: xs |> Enum.map(&f/1) |> Enum.filter(&g/1) |> Enum.max()"),
    (3, "a = Enum.at(l, 0)\nb = Enum.at(l, 1)\nc = Enum.at(l, 2)\nd = Enum.at(k, 0)"),
    (4, "List.foldl(xs, 0, fn x, acc -> x + acc end)\nEnum.any?(xs, fn x -> Enum.member?(xs, x + 1) end)"),
]


def corpus_nodes(spark: SparkSession) -> DataFrame:
    return nodes(read_table(spark.createDataFrame(CORPUS, "source_id long, code string"), "source_id", "code"))


def inline(spark: SparkSession) -> DataFrame:
    """The same nodes, as the few columns that the SQL forms spell out."""
    return spark.createDataFrame(VALUES, "source_id long, id int, parent int, ord int, kind string, name string, mod string, arity int, line int, pipe_id int, pipe_step int")


#: Nodes of calls, their arguments and pipeline steps, written out by hand: both engines query these rows.
VALUES = [
    (1, 10, 5, 1, "remote", "count", "Enum", 1, 2, None, None),
    (1, 12, 10, 1, "var", "xs", None, None, 2, None, None),
    (1, 20, 5, 1, "remote", "max", "Enum", 1, 3, None, None),
    (1, 22, 20, 1, "var", "xs", None, None, 3, None, None),
    (1, 30, 5, 1, "remote", "map", "Enum", 2, 4, None, None),
    (1, 32, 30, 1, "var", "ys", None, None, 4, None, None),
    (2, 11, 10, 0, "var", "xs", None, None, 1, 9, 0),
    (2, 12, 10, 1, "remote", "map", "Enum", 1, 1, 9, 1),
    (2, 20, 9, 1, "remote", "sum", "Enum", 0, 1, 9, 2),
    (2, 41, 40, 0, "var", "xs", None, None, 2, 39, 0),
    (2, 42, 40, 1, "remote", "map", "Enum", 1, 2, 39, 1),
    (2, 50, 39, 1, "remote", "filter", "Enum", 1, 2, 39, 2),
    (2, 60, 38, 1, "remote", "max", "Enum", 0, 2, 39, 3),
    *[
        row
        for i, (name, at) in enumerate([("l", 0), ("l", 1), ("l", 2), ("k", 0)])
        for row in (
            (3, 10 * i + 2, 10 * i + 1, 1, "remote", "at", "Enum", 2, i + 1, None, None),
            (3, 10 * i + 4, 10 * i + 2, 1, "var", name, None, None, i + 1, None, None),
            (3, 10 * i + 5, 10 * i + 2, 2, "int", str(at), None, None, i + 1, None, None),
        )
    ],
    (4, 1, 0, 1, "remote", "foldl", "List", 3, 1, None, None),
    (4, 20, 0, 1, "remote", "any?", "Enum", 2, 2, None, None),
    (4, 22, 20, 1, "var", "xs", None, None, 2, None, None),
    (4, 30, 24, 1, "remote", "member?", "Enum", 2, 2, None, None),
    (4, 32, 30, 1, "var", "xs", None, None, 2, None, None),
]


def _literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


_WITH = "WITH raw(source_id, id, parent, ord, kind, name, mod, arity, line, pipe_id, pipe_step) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in VALUES) + "), node AS (SELECT CAST(source_id AS BIGINT) AS source_id, * EXCLUDE (source_id) FROM raw)"
_SUBJECT = """, subject AS (SELECT c.source_id, v.name AS var, c.name, c.line, c.id, c.mod, c.arity FROM node c JOIN node v
ON v.source_id = c.source_id AND v.parent = c.id AND v.kind = 'var' AND v.ord = 1 WHERE c.kind = 'remote')"""


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_literal, names)) + ")"


QUERIES = {
    "nodes_repeated_traversals": lambda spark, sf: repeated_traversals(inline(spark)),
    "nodes_later_traversals": lambda spark, sf: later_traversals(inline(spark)),
    "nodes_list_folds": lambda spark, sf: folds(inline(spark)),
    "nodes_many_at": lambda spark, sf: many_at(inline(spark)),
    "nodes_map_then_aggregate": lambda spark, sf: adjacent_steps(inline(spark), "map", ("max", "min", "sum")),
    "nodes_table": lambda spark, sf: corpus_nodes(spark),
}
ORACLES = {
    "nodes_repeated_traversals": f"{_WITH}{_SUBJECT}, n AS (SELECT *, count(*) OVER (PARTITION BY source_id, var) AS n FROM subject WHERE mod = 'Enum' AND name IN {_in(TRACKED)}) SELECT source_id, var, name, line FROM n WHERE n > 1",
    "nodes_later_traversals": f"{_WITH}{_SUBJECT}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id, var ORDER BY id) AS r FROM subject WHERE mod = 'Enum' AND name IN {_in(NESTED)}) SELECT source_id, var, name, line FROM n WHERE r > 1",
    "nodes_list_folds": f"{_WITH} SELECT source_id, name, line FROM node WHERE kind = 'remote' AND mod = 'List' AND name IN ('foldl', 'foldr')",
    "nodes_many_at": f"{_WITH}{_SUBJECT} SELECT s.source_id, var, count(*) AS n, min(s.line) AS line FROM subject s WHERE mod = 'Enum' AND name = 'at' AND arity = 2 AND EXISTS (SELECT 1 FROM node i WHERE i.source_id = s.source_id AND i.parent = s.id AND i.kind = 'int' AND i.ord = 2) GROUP BY s.source_id, var HAVING count(*) >= 3",
    "nodes_map_then_aggregate": f"{_WITH}, step AS (SELECT *, lead(name) OVER w AS next, lead(mod) OVER w AS next_mod FROM node WHERE pipe_step IS NOT NULL WINDOW w AS (PARTITION BY source_id, pipe_id ORDER BY pipe_step)) SELECT source_id, name, next, line FROM step WHERE mod = 'Enum' AND name = 'map' AND next_mod = 'Enum' AND next IN ('max', 'min', 'sum')",
}
