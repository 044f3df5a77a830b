"""Every query of the engine itself by name, and its SQL where SQL expresses it.

Names say what a query stands for: ``syntax_`` line rules over documents, ``semantic_`` rules over diagnostics,
``matcher_`` name likeness, ``pattern_`` an idiom rule over the fixture sources, ``nodes_`` relational forms over node
rows, ``vocabulary_`` derived equivalences.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlint.functions import vocabulary
from loomlint.operators import analysis, fix, matcher, semantic, syntax
from loomlint.plans import expected, fixtures, patterns, relational, rule_sql
from loomlint.plans.rewrites import REWRITES
from loomlint.session import ship_package
from loomlint.sources.corpus import FIXTURES, diff, fixture_corpus, lines, read_table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the fixture sources, and line issues of the documents."""
    found = analysis.analyze(fixture_corpus(spark)).unionByName(syntax.analyze_lines(_documents(spark, sf), {"FixScientificNotation"}))
    return found.select("source_id", "phase", "rule", "module", "message", "line")


def _document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(_documents(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("long")).alias("chars"))


#: Lines of our own that the line rules take or leave, beside the documents: (source_id, code).
LINES = [
    (-1, "x = n * 3 div 2\ny = f(a) rem b\n# a div b\nx |> div(2)\nz = a div b rem c"),
    (-2, "@spec g(list(atom()) :: atom())\n  @spec k?(x :: y :: z)\n@spec h(a :: b) :: c\n@spec u(a\n@spec v(atom() :: {atom(), integer()})"),
    (-3, "n % 2 == 1\nn % 25.0\n  # n % 2\nn % a.b\nf(n%10, m %k)\n%{a: 1}"),
    (-4, "x = 1e-9 + 1.5e3\n1.55e3\n  # 1e5\n12E+4, 7e8"),
    (-5, "  private defp f(x), do: x\npprivate def g, do: 1\nasync defmacro h(x), do: x\ndef private, do: 1\npublic  def k, do: 2"),
]


def _with_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).unionByName(spark.createDataFrame([(i, None, code) for i, code in LINES], "source_id long, path string, code string"))


def _syntax(module: str, spark: SparkSession, sf: str) -> DataFrame:
    return syntax.analyze_lines(_with_lines(spark, sf), {module}).select("source_id", "rule", F.col("line").cast("long").alias("line"))


def _syntax_fix(module: str, spark: SparkSession, sf: str) -> DataFrame:
    """Lines that the rule's rewrite changes, before and after."""
    docs = _with_lines(spark, sf)
    return diff(docs, syntax.fix_lines(docs, {module})).select("source_id", "op", F.col("line_no").cast("long").alias("line_no"), "text")


def _text(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _rows_sql(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + ")"


_DOCUMENT_LINES = "line AS (SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_LINES = (
    _rows_sql("own", "doc_id, text", LINES)
    + ", line AS (SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM (SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM own))"
)
_NOT_COMMENT = r"NOT regexp_matches(text, '^\s*#')"


def _line_sql(rule: str, pattern: str, extra: str = "") -> str:
    return f"WITH {_LINES} SELECT source_id, '{rule}' AS rule, line FROM line WHERE regexp_matches(text, '{pattern}') {extra}"


def _changed_sql(where: str, new: str, more: str = "") -> str:
    """Lines before and after, of those with a condition (``where``) that the expression ``new`` changes."""
    changed = f"changed AS (SELECT source_id, line AS line_no, text, {new} AS new FROM line WHERE {where})"
    return f"WITH {_LINES}, {more}{changed} SELECT source_id, 'removed' AS op, line_no, text FROM changed WHERE text <> new UNION ALL SELECT source_id, 'added', line_no, new FROM changed WHERE text <> new"


def _fix_sql(pattern: str, replacement: str, extra: str = "") -> str:
    return _changed_sql(f"regexp_matches(text, '{pattern}') {extra}", f"regexp_replace(text, '{pattern}', '{replacement}', 'g')")


def _infix_fix_sql() -> str:
    # RE2 has no lookbehind: the character before the operand is matched instead
    text = "text"
    for op in ("div", "rem"):
        match = rf"regexp_matches({text}, '(^|[^|>.])\b\S+\)\s+{op}\s+\w|(^|[^|>.])\b\w+\s+{op}\s+\w')"
        text = rf"CASE WHEN {match} THEN regexp_replace({text}, '^(\s*(?:\w+\s*=\s*)?)(.+?)\s+{op}\s+(.+?)(\s*)$', '\1{op}(\2, \3)\4') ELSE {text} END"
    return _changed_sql(_NOT_COMMENT + r" AND regexp_matches(text, '\s(div|rem)\s')", text)


#: A spec line taken apart: where its first parenthesis closes, and the last `::` outside parentheses within.
_SPEC_SQL = r"""
spec AS (SELECT source_id, line, text, regexp_extract(text, '^(\s*@spec\s+\w+[?!]?)\(', 1) AS head FROM line WHERE regexp_matches(text, '^\s*@spec\s+\w+[?!]?\(')),
rest AS (SELECT *, substr(text, length(head) + 2) AS rest FROM spec),
closed AS (SELECT *, list_min([i for i in range(1, length(rest) + 1) if length(replace(rest[1:i], '(', '')) - length(replace(rest[1:i], ')', '')) = 1]) AS shut FROM rest),
inside AS (SELECT *, rest[1:shut - 1] AS inner_, rest[shut + 1:] AS after FROM closed WHERE shut IS NOT NULL),
parted AS (SELECT *, list_max([i for i in range(1, length(inner_)) if inner_[i:i + 1] = '::' AND length(replace(inner_[1:i], '(', '')) = length(replace(inner_[1:i], ')', ''))]) AS sep FROM inside),
bad AS (SELECT source_id, line AS line_no, text, concat(head, '(', rtrim(inner_[1:sep - 1]), ') :: ', ltrim(inner_[sep + 2:])) AS new FROM parted WHERE sep IS NOT NULL AND NOT contains(after, '::'))"""


def _infix_sql() -> str:
    # RE2 has no lookbehind: the character before the operand is matched instead
    parts = [
        rf"SELECT source_id, 'infix_{op}' AS rule, line FROM line WHERE {_NOT_COMMENT} AND regexp_matches(text, '(^|[^|>.])\b\S+\)\s+{op}\s+\w|(^|[^|>.])\b\w+\s+{op}\s+\w')" for op in ("div", "rem")
    ]
    return f"WITH {_LINES} " + " UNION ALL ".join(parts)


#: Diagnostics of our own: (source_id, ord, severity, message, line, col).
DIAGNOSTICS = [
    (1, 0, "warning", 'variable "x" is unused (if the variable is not meant to be used, prefix it with an underscore)', 2, 3),
    (1, 1, "warning", 'the underscored variable "_y" is used after being set', 3, None),
    (1, 2, "warning", "Enum.last/1 is undefined or private", 4, 5),
    (2, 0, "error", "undefined function sorted/1 (expected B to define such a function or for it to be imported)", 2, 7),
    (2, 1, "warning", 'variable "z" is unused', 3, 1),
    (3, 0, "error", "undefined function describe/2 (there is no such import)", 2, 3),
    (4, 0, "warning", "outdented heredoc line", 3, None),
    (4, 1, "warning", "String.alphanumeric?/1 is undefined or private", 4, 2),
    (4, 2, "warning", "something else entirely", 5, 2),
    (5, 0, "warning", "Enum.partition/2 is deprecated. Use Enum.split_with/2 instead", 6, 2),
]
PAIRS = [("sorted", "sorted?"), ("store", "store!"), ("blank__", "blank?"), ("wipe__", "wipe!"), ("factorial", "fact"), ("scan", "scan_rows"), ("walk", "do_walk"), ("colour", "color"), ("abc", "xyz"), ("martha", "marhta")]


def _diagnostics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIAGNOSTICS, "source_id long, ord int, severity string, message string, line int, col int")


def _dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.dispatched(_diagnostics(spark)).select("source_id", "ord", "rule", "line")


_DISPATCH_SQL = (
    "WITH "
    + _rows_sql("d", "source_id, ord, severity, message, line, col", DIAGNOSTICS)
    + r""", judged AS (SELECT d.* FROM d JOIN (SELECT source_id, bool_or(severity = 'error') AS failed FROM d GROUP BY source_id) USING (source_id)
WHERE severity = CASE WHEN failed THEN 'error' ELSE 'warning' END), named AS (SELECT CAST(source_id AS BIGINT) AS source_id, ord, line, CASE
WHEN severity = 'error' AND (message LIKE '%undefined function test/%' OR message LIKE '%undefined function describe/%' OR message LIKE '%undefined function setup/%') THEN 'missing_use_exunit_case'
WHEN severity = 'warning' AND message LIKE '%outdented heredoc line%' THEN 'outdented_heredoc'
WHEN severity = 'warning' AND regexp_matches(message, '(\w+)\.(\w+)/(\d+) is (undefined or private|deprecated)') OR severity = 'error' AND regexp_matches(message, 'undefined function (\w+)/(\d+)') THEN 'undefined_function'
WHEN severity = 'warning' AND message LIKE '%String.alphanumeric?%' AND message LIKE '%is undefined or private%' THEN 'undefined_string_alphanumeric'
WHEN severity = 'warning' AND regexp_matches(message, 'variable ".*" is unused') THEN 'unused_variable'
WHEN severity = 'warning' AND message LIKE '%is used after being set%' THEN 'used_underscore_variable' END AS rule FROM judged)
SELECT source_id, ord, rule, line FROM named WHERE rule IS NOT NULL"""
)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    pairs = spark.createDataFrame(PAIRS, "name string, candidate string")
    return pairs.withColumn("score", matcher.score(F.col("name"), F.col("candidate")))


_LADDER = """CAST(CASE WHEN candidate = name || '?' THEN 100 WHEN candidate = name || '!' THEN 95
WHEN contains(name, '__') AND candidate = replace(name, '__', '?') THEN 90 WHEN contains(name, '__') AND candidate = replace(name, '__', '!') THEN 85
WHEN candidate <> name AND starts_with(name, candidate) THEN 80 WHEN candidate <> name AND starts_with(candidate, name) THEN 75
WHEN candidate <> name AND (contains(candidate, name) OR contains(name, candidate)) THEN 70 ELSE floor(jaro_similarity(name, candidate) * 60 + 0.5) END AS INTEGER)"""
_SCORE_SQL = (
    "WITH "
    + _rows_sql("p", "name, candidate", PAIRS)
    + f" SELECT name, candidate, {_LADDER} AS score FROM p"
)


#: Functions of modules, in order, and names asked for: (source_id, module, ord, function, arity, visibility).
FUNCTIONS = [
    (1, "A", 0, "scan_rows", 1, "def"), (1, "A", 1, "scan", 1, "defp"), (1, "A", 2, "scan_all", 2, "def"), (1, "A", 3, "scan_rows", 1, "def"), (1, "B", 0, "walk?", 0, "def"), (1, "B", 1, "do_walk", 0, "defp"),
]
ASKED = [(1, "A", "scans", 1, False), (1, "A", "scan_row", 1, True), (1, "B", "walk", 0, False), (1, "B", "walk", 3, False)]


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    functions = spark.createDataFrame(FUNCTIONS, "source_id long, module string, ord int, function string, arity int, visibility string")
    asked = spark.createDataFrame(ASKED, "source_id long, module string, name string, arity int, public_only boolean")
    return matcher.candidates(asked, functions).select("module", "name", "function", "score", "rank")


_CANDIDATES_SQL = (
    "WITH "
    + _rows_sql("f", "source_id, module, ord, candidate, arity, visibility", FUNCTIONS)
    + ", "
    + _rows_sql("a", "source_id, module, name, arity, public_only", ASKED)
    + f""", u AS (SELECT source_id, module, candidate, arity, min(ord) AS ord, arg_min(visibility, ord) AS visibility FROM f GROUP BY ALL),
s AS (SELECT module, name, candidate, ord, {_LADDER} AS score FROM a JOIN u USING (source_id, module, arity) WHERE visibility = 'def' OR NOT public_only)
SELECT module, name, candidate AS function, score, CAST(row_number() OVER (PARTITION BY module, name ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s"""
)
#: A line before and after the rewrite of a diagnostic: (module, message, line).
DIAGNOSED = [
    ("UndefinedFunction", "Enum.last/1 is undefined or private", "Enum.last(xs)"),
    ("UndefinedFunction", "Float.inf/0 is undefined or private", "-Float.inf()"),
    ("UndefinedFunction", "List.second/1 is undefined or private", "List.second(xs)"),
    ("UndefinedFunction", "Enum.take_last/2 is undefined or private", "Enum.take_last(xs, n)"),
    ("UndefinedFunction", "undefined function sorted/1", "sorted(xs)"),
    ("UndefinedFunction", "undefined function max/3", "max(a, b, c)"),
    ("UndefinedFunction", "undefined function range/2", "range(1, n)"),
    ("UndefinedStringAlphanumeric", "String.alphanumeric?/1 is undefined or private", "String.alphanumeric?(c)"),
    ("UnusedVariable", 'variable "n" is unused', "n = count"),
    ("UsedUnderscoreVariable", 'variable "_x" is used after being set', "_x + 1"),
    ("OutdentedHeredoc", "outdented heredoc line", "plain"),
    ("MissingUseExunitCase", "undefined function test/2", 'defmodule T do\n  test "x" do\n    1\n  end\nend'),
]


def _semantic_fixes(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    rows = spark.createDataFrame(DIAGNOSED, "module string, message string, before string")

    @F.pandas_udf("string")
    def after(module: pd.Series, message: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([semantic.rewrite(c, m, text, 1) for m, text, c in zip(module, message, before, strict=True)])

    return rows.withColumn("after", after("module", "message", "before"))


def _analyzed(spark: SparkSession, sf: str) -> DataFrame:
    """All issues of all fixture sources, clean ones included."""
    rows = [(1000 * k + i, path, code) for k, module in enumerate(sorted(fixtures.CASES), 1) for i, path, code in fixtures.sources(module)]
    source = spark.createDataFrame(rows, "source_id long, path string, code string")
    return analysis.analyze(source).select("source_id", "phase", "rule", F.col("line").cast("long").alias("line"))


def _pattern(module: str, spark: SparkSession, sf: str) -> DataFrame:
    """An idiom rule over its fixture sources."""
    source = spark.createDataFrame(fixtures.sources(module), "source_id long, path string, code string")
    return analysis.analyze(source, rules=[module], derive=False).select("source_id", "rule", F.col("line").cast("long").alias("line"))


def _pattern_fix(module: str, spark: SparkSession, sf: str) -> DataFrame:
    """The fixture sources of an idiom rule after its rewrite."""
    source = spark.createDataFrame(fixtures.sources(module), "source_id long, path string, code string")
    return fix.fix(source, rules=[module], derive=False).select("source_id", "code", F.size("applied").cast("long").alias("n_applied"))


def _analyzed_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.analyze(fixture_corpus(spark)).select("source_id", "phase", "rule", F.col("line").cast("long").alias("line"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.catalog(spark)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    source = fixture_corpus(spark)
    return analysis.verdicts(source, analysis.analyze(source))


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = fix.fix(fixture_corpus(spark))
    return out.select("source_id", "code", F.size("applied").cast("long").alias("n_applied"))


def _values(columns: dict[str, str], rows: list[tuple]) -> str:
    """Rows as values, each column cast to its type."""
    cast = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
    return f"WITH {_rows_sql('v', ', '.join(columns), rows or [tuple([None] * len(columns))])} SELECT {cast} FROM v" + ("" if rows else " WHERE false")


def _issue_name(module: str) -> str:
    return expected.NAMES.get(module, re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", module).lower())


def _pattern_sql(module: str) -> str:
    """A row for each report that the fixtures declare, in the lines written out for them or else the first."""
    rows = [(i, _issue_name(module), line) for i, (_, n) in enumerate(fixtures.CASES[module][0], 1) for line in expected.LINES.get((module, i), [1] * n)]
    return _values({"source_id": "BIGINT", "rule": "VARCHAR", "line": "BIGINT"}, rows)


def _pattern_fix_sql(module: str) -> str:
    bad, clean = fixtures.CASES[module]
    rows = [(i, code, 1) for i, code in enumerate(expected.REWRITTEN[module], 1)] + [(i, code, 0) for i, code in enumerate(clean, 1001)]
    return _values({"source_id": "BIGINT", "code": "VARCHAR", "n_applied": "BIGINT"}, rows)


def _catalog_sql() -> str:
    rows = [("syntax", None, m, 500, True) for m in expected.SYNTAX]
    rows += [("semantic", _issue_name(m), m, expected.PLACES.get(m, 500), True) for m in expected.SEMANTIC]
    rows += [("pattern", _issue_name(m), m, expected.PLACES.get(m, 500), m not in expected.REPORT_ONLY) for m in fixtures.CASES]
    return _values({"phase": "VARCHAR", "rule": "VARCHAR", "module": "VARCHAR", "priority": "INTEGER", "fixable": "BOOLEAN"}, rows)


def _fixed_sql() -> str:
    codes = dict(FIXTURES)
    for i, _, before, after in expected.CHANGES:
        codes[i] = codes[i].replace(before, after)
    return _values({"source_id": "BIGINT", "code": "VARCHAR", "n_applied": "BIGINT"}, [(i, code, int(code != dict(FIXTURES)[i])) for i, code in codes.items()])


def _traced_sql() -> str:
    rows = [(i, 0, rule, op, 2, text) for i, rule, before, after in expected.CHANGES for op, text in (("removed", before), ("added", after))]
    return _values({"source_id": "BIGINT", "step": "INTEGER", "rule": "VARCHAR", "op": "VARCHAR", "line_no": "INTEGER", "text": "VARCHAR"}, rows)


def _verdicts_sql() -> str:
    counts = [(i, sum(x[0] == i for x in expected.ISSUES)) for i, _ in FIXTURES]
    return _values({"source_id": "BIGINT", "valid": "BOOLEAN", "n_issues": "BIGINT"}, [(i, not n, n) for i, n in counts])


_S = r"(\d+)[eE]([+-]?\d+)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lines": _document_lines,
    **{f"syntax_{r.module}": partial(_syntax, r.module) for r in syntax.RULES},
    **{f"syntax_fix_{r.module}": partial(_syntax_fix, r.module) for r in syntax.RULES},
    "semantic_dispatch": _dispatch,
    "matcher_scores": _scores,
    "matcher_candidates": _candidates,
    "semantic_fixes": _semantic_fixes,
    "analyze_corpus": _analyzed,
    "analyze_fixtures": _analyzed_fixtures,
    "catalog": _catalog,
    "verdicts": _verdicts,
    "fix_corpus": _fixed,
    "fix_trace": lambda spark, sf: fix.traced(fixture_corpus(spark)),
    **{f"pattern_{r.module}": partial(_pattern, r.module) for r in patterns.RULES if r.module in fixtures.CASES},
    **{f"pattern_fix_{m}": partial(_pattern_fix, m) for m in fixtures.CASES if m in REWRITES},
    **relational.QUERIES,
    **vocabulary.QUERIES,
}
_STALE = r"^(\s*)(" + "|".join(sorted(syntax.MODIFIERS, key=lambda m: -len(m))) + r")\s+(defp?|defmacrop?)\b"
_MODULO = r"(\w+)\s*%\s*(\w+)"
ORACLES: dict[str, str] = {
    "lines": f"WITH {_DOCUMENT_LINES} SELECT source_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM line GROUP BY source_id",
    "syntax_FixDivRem": _infix_sql(),
    "syntax_FixPythonModulo": _line_sql("python_modulo", _MODULO + r"($|[^.\w]|\w)", "AND " + _NOT_COMMENT),
    "syntax_FixScientificNotation": _line_sql("python_scientific_notation", r"(^|[^.])" + _S, "AND " + _NOT_COMMENT),
    "syntax_FixStaleAccessModifier": _line_sql("stale_access_modifier", _STALE),
    "syntax_fix_FixStaleAccessModifier": _fix_sql(_STALE, r"\1\3"),
    "syntax_FixMalformedSpec": f"WITH {_LINES}, {_SPEC_SQL} SELECT source_id, 'malformed_spec' AS rule, line_no AS line FROM bad",
    "syntax_fix_FixMalformedSpec": f"WITH {_LINES}, {_SPEC_SQL} SELECT source_id, 'removed' AS op, line_no, text FROM bad UNION ALL SELECT source_id, 'added', line_no, new FROM bad",
    "syntax_fix_FixDivRem": _infix_fix_sql(),
    # RE2 has no lookahead: what follows the second operand is matched too, and of one before a dot a character less
    "syntax_fix_FixPythonModulo": _fix_sql(r"(\w+)\s*%\s*(?:(\w+)(\w\.)|(\w+)($|[^.\w]))", r"rem(\1, \2\4)\3\5", "AND " + _NOT_COMMENT),
    "syntax_fix_FixScientificNotation": _fix_sql(r"(^|[^.])" + _S, r"\1\2.0e\3", "AND " + _NOT_COMMENT),
    "analyze_fixtures": _values({"source_id": "BIGINT", "phase": "VARCHAR", "rule": "VARCHAR", "line": "BIGINT"}, expected.ISSUES),
    "verdicts": _verdicts_sql(),
    "catalog": _catalog_sql(),
    "fix_corpus": _fixed_sql(),
    "fix_trace": _traced_sql(),
    "semantic_fixes": _values({"module": "VARCHAR", "message": "VARCHAR", "before": "VARCHAR", "after": "VARCHAR"}, [(*d, after) for d, after in zip(DIAGNOSED, expected.DIAGNOSED, strict=True)]),
    **{f"pattern_{m}": _pattern_sql(m) for m in fixtures.CASES},
    **{f"pattern_fix_{m}": _pattern_fix_sql(m) for m in expected.REWRITTEN},
    "semantic_dispatch": _DISPATCH_SQL,
    "matcher_scores": _SCORE_SQL,
    "matcher_candidates": _CANDIDATES_SQL,
    **rule_sql.ORACLES,
    **relational.ORACLES,
    **vocabulary.ORACLES,
}
