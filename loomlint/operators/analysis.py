"""Analyse a corpus: issues of every source.

One Arrow pass parses each source once and asks all idiom rules of it; the syntax rules are SQL over the lines of the
sources that did not parse; diagnostics, where there are any, join by source.  Files are independent, so apart from
that join nothing is shuffled, and nothing is parsed twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlint.functions.elixir import ParseError
from loomlint.functions.tree import Tree
from loomlint.operators import semantic, syntax
from loomlint.operators.diagnose import diagnose, taken
from loomlint.plans import patterns
from loomlint.session import ship_package

PARSED = "source_id long, path string, code string, parses boolean, issues array<struct<phase:string,rule:string,module:string,message:string,line:int,rule_ord:int,issue_ord:int>>"
_ISSUES = pa.list_(pa.struct([("phase", pa.string()), ("rule", pa.string()), ("module", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("rule_ord", pa.int32()), ("issue_ord", pa.int32())]))


def found_in(code: str, rules: Iterable[str] | None = None, derive: bool = False) -> tuple[bool, list[dict]]:
    """Whether a source parses, and its issues (those of derived diagnostics first) or its parse error."""
    try:
        tree = Tree(code)
    except ParseError as e:
        return False, [{"phase": "pattern", "rule": "parse_error", "module": "Pattern", "message": str(e), "line": e.line, "rule_ord": 0, "issue_ord": 0}]
    except RecursionError:
        return False, [{"phase": "pattern", "rule": "parse_error", "module": "Pattern", "message": "nested too deeply", "line": None, "rule_ord": 0, "issue_ord": 0}]
    wanted = None if rules is None else set(rules)
    out = []
    for k, (ord_, module, name, message, line) in enumerate(taken(diagnose(tree)) if derive else ()):
        out.append({"phase": "semantic", "rule": name, "module": module, "message": message, "line": line, "rule_ord": ord_, "issue_ord": k})
    for ord_, r in enumerate(patterns.RULES):
        if wanted is None or r.module in wanted:
            for k, (line, detail) in enumerate(r.check(tree)):
                out.append({"phase": "pattern", "rule": r.rule, "module": r.module, "message": r.message.replace("{detail}", detail), "line": line, "rule_ord": ord_, "issue_ord": k})
    return True, out


def parsed(source: DataFrame, rules: Iterable[str] | None = None, derive: bool = False) -> DataFrame:
    """``source`` with parse status and issues; a null text is an empty source."""
    ship_package(source.sparkSession)
    wanted = None if rules is None else tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [found_in(c or "", wanted, derive) for c in b.column("code").to_pylist()]
            cols = [b.column("source_id"), b.column("path"), b.column("code"), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], _ISSUES)]
            yield pa.RecordBatch.from_arrays(cols, names=["source_id", "path", "code", "parses", "issues"])

    return source.select(F.col("source_id").cast("long").alias("source_id"), F.col("path").cast("string").alias("path"), "code").mapInArrow(run, PARSED)


def _syntax_issues() -> Column:
    """Issues of the syntax rules over the lines of ``code``, as an array."""

    def of(line: Column, at: Column) -> Column:
        found = []
        for ord_, r in enumerate(syntax.RULES):
            for k, (when, atom, message) in enumerate(r.issues(line)):
                issue = F.struct(F.lit("syntax").alias("phase"), atom.alias("rule"), F.lit(r.module).alias("module"), message.alias("message"), (at + 1).alias("line"), F.lit(ord_).alias("rule_ord"), (at * 2 + k).alias("issue_ord"))
                found.append(F.when(when, issue))
        return F.array_compact(F.array(*found))

    return F.array_sort(
        F.flatten(F.transform(F.split("code", "\n", -1), of)),
        lambda a, b: F.when(a["rule_ord"] != b["rule_ord"], a["rule_ord"] - b["rule_ord"]).otherwise(a["issue_ord"] - b["issue_ord"]),
    )


def analyze(source: DataFrame, diagnostics: DataFrame | None = None, rules: Iterable[str] | None = None, derive: bool = True) -> DataFrame:
    """Issues of a corpus: the syntax issues of a source that has any, else its semantic and idiom issues.

    ``diagnostics`` (what a compiler said) take the place of derived ones; ``rules`` picks idiom rules.
    """
    rows = parsed(source, rules, derive and diagnostics is None).withColumn("syntax", F.when(~F.col("parses"), _syntax_issues()))
    found = F.col("issues")
    if diagnostics is not None:
        told = semantic.issues(diagnostics).groupBy("source_id").agg(F.collect_list(F.struct("phase", "rule", "module", "message", "line", "rule_ord", "issue_ord")).alias("_told"))
        rows = rows.join(told, "source_id", "left")
        found = F.concat(F.coalesce("_told", F.array().cast(told.schema["_told"].dataType)), found)
    stopped = F.coalesce(F.size("syntax") > 0, F.lit(False))
    return rows.select("source_id", F.explode(F.when(stopped, F.col("syntax")).otherwise(found)).alias("i")).select("source_id", "i.*")


def verdicts(source: DataFrame, issues: DataFrame) -> DataFrame:
    """source_id, valid, n_issues of every source."""
    counts = issues.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_issues"))
    both = source.select("source_id").join(counts, "source_id", "left")
    return both.select("source_id", F.col("n_issues").isNull().alias("valid"), F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


def catalog(spark: SparkSession) -> DataFrame:
    """Every rule: phase, rule, module, priority, fixable."""
    rows = [("syntax", None, r.module, 500, True) for r in syntax.RULES]
    rows += [("semantic", r.rule, r.module, r.priority, True) for r in semantic.RULES]
    rows += [("pattern", r.rule, r.module, r.priority, r.fixable) for r in patterns.RULES]
    return spark.createDataFrame(rows, "phase string, rule string, module string, priority int, fixable boolean")
