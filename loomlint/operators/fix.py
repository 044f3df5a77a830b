"""Fix a corpus: syntax, then diagnostics, then idioms, each source on its own.

The idiom rules run in the order of their priority; each sees what the one before left.  A rewrite that would not parse
is not taken.  Sources are independent: the line rules are SQL over the lines of a row, the rest is one Arrow pass, so
nothing is shuffled; supplied diagnostics join by source first.  Rows that share a source_id are sources of their own.

A rule takes one turn, in which it rewrites all that it reports.  Rewrites are edits of spans, and what lies within the
span of another edit follows in a round of the same turn, ``ROUNDS`` at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlint import schema
from loomlint.functions.elixir import ParseError, parse
from loomlint.functions.tree import Tree
from loomlint.operators import semantic, syntax
from loomlint.operators.analysis import analyze
from loomlint.operators.diagnose import diagnose, taken
from loomlint.plans import patterns
from loomlint.plans.rewrites import REWRITES, apply
from loomlint.session import ship_package

PASSES, ROUNDS = 3, 10


def parses(code: str) -> bool:
    try:
        parse(code)
    except (ParseError, RecursionError):
        return False
    return True


def tree_of(code: str) -> Tree | None:
    try:
        return Tree(code)
    except (ParseError, RecursionError):
        return None


Step = tuple[str, int, str, str]  # rule, number of its issues, text before, text after


def idiom_steps(code: str, rules: Iterable[str] | None = None) -> list[Step]:
    """A step for each idiom rule that reports something; a text is parsed once and serves all rules until one changes it."""
    wanted, out = None if rules is None else set(rules), []
    tree = tree_of(code)
    if tree is None:
        return out
    for r in patterns.RULES:
        if r.module not in REWRITES or wanted is not None and r.module not in wanted:
            continue
        before, first = tree.code, 0
        for _ in range(ROUNDS):
            n = sum(1 for _ in r.check(tree))
            first = first or n
            new = apply(tree.code, REWRITES[r.module](tree)) if n else tree.code
            after = tree_of(new) if new != tree.code else None
            if after is None:
                break
            tree = after
        if first:
            out.append((r.module, first, before, tree.code))
    return out


def told_steps(code: str, diagnostics: Iterable[tuple]) -> list[Step]:
    """A step for each dispatched diagnostic (module, message, line), in order."""
    out = []
    for module, message, line in diagnostics:
        before, code = code, semantic.rewrite(code, module, message, line)
        out.append((module, 1, before, code))
    return out


def derived_steps(code: str) -> list[Step]:
    """Steps for derived diagnostics, in up to ``PASSES`` passes.

    While there are errors, they are fixed and the source is looked at again; a pass over warnings is the last.
    """
    out: list[Step] = []
    for _ in range(PASSES):
        if not parses(code):
            break
        found = diagnose(Tree(code))
        some = told_steps(code, [(module, message, line) for _, module, _, message, line in taken(found)])
        out += some
        changed, code = bool(some) and some[-1][3] != code, some[-1][3] if some else code
        if not changed or not any(s == "error" for s, _, _ in found):
            break
    return out


def compiles(code: str) -> bool:
    """Whether a source parses and no error can be told from it."""
    return parses(code) and not any(s == "error" for s, _, _ in diagnose(Tree(code)))


def _after(code: str, steps: list[Step]) -> str:
    return steps[-1][3] if steps else code


def _applied(steps: list[Step]) -> list[tuple[str, int]]:
    return [(module, n) for module, n, _, _ in steps]


def fix_idioms(code: str, rules: Iterable[str] | None = None) -> tuple[str, list[tuple[str, int]]]:
    """A source after the idiom rewrites, and (rule, number of its issues) for each rule that took a turn."""
    steps = idiom_steps(code, rules)
    return _after(code, steps), _applied(steps)


def fix_diagnosed(code: str, diagnostics: Iterable[tuple]) -> tuple[str, list[tuple[str, int]]]:
    """A source after the fixes of its dispatched diagnostics (module, message, line), and an entry for each."""
    steps = told_steps(code, diagnostics)
    return _after(code, steps), _applied(steps)


def fix_derived(code: str) -> tuple[str, list[tuple[str, int]], bool]:
    """A source after the fixes of its derived diagnostics, an entry for each, and whether no error is left."""
    steps = derived_steps(code)
    return _after(code, steps), _applied(steps), compiles(_after(code, steps))


def fix_steps(code: str, lines: list[tuple[str, str]], told: list[tuple] | None, errors: int, rules: Iterable[str] | None) -> list[Step]:
    """Every step of a fix, in order.

    ``lines`` are the texts after each line rule, taken if the code does not parse.  ``told`` are dispatched diagnostics,
    of ``errors`` errors in all; None derives them.  Idioms are left alone while an error is left: one that no rule took,
    whose rule changed nothing, or that can be told from the text after it.
    """
    out: list[Step] = []
    if not parses(code):
        for module, after in lines:
            out.append((module, 1, _after(code, out), after))
    now = _after(code, out)
    more = derived_steps(now) if told is None else told_steps(now, told)
    out += more
    solved = told is None or errors <= sum(a != b for _, _, a, b in more)
    if solved and compiles(_after(now, more)):
        out += idiom_steps(_after(now, more), rules)
    return out


def _stepped(source: DataFrame, diagnostics: DataFrame | None, rules: Iterable[str] | None, derive: bool, schema_: pa.Schema, ddl: str, rows_of) -> DataFrame:
    """``rows_of`` (source_id, code, steps) for each source, in one Arrow pass."""
    ship_package(source.sparkSession)
    wanted = None if rules is None else tuple(rules)
    rows = syntax.fix_lines(source.select(F.col("source_id").cast("long").alias("source_id"), "code", F.col("code").alias("_code")), steps=True)
    rows = rows.select("source_id", F.col("_code").alias("code"), "steps")
    if diagnostics is not None:
        told = semantic.dispatched(diagnostics).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ord", "module", "message", "line"))).alias("told"))
        failed = diagnostics.groupBy("source_id").agg(F.count_if(F.col("severity") == "error").cast("int").alias("errors"))
        rows = rows.join(told, "source_id", "left").join(failed, "source_id", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("array<struct<ord:int,module:string,message:string,line:int>>").alias("told"), F.lit(0).alias("errors"))
    derived = derive and diagnostics is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                lines = [(x["rule"], x["code"]) for x in row["steps"] or []]
                told = None if derived else [(x["module"], x["message"], x["line"]) for x in row["told"] or []]
                steps = [] if row["code"] is None else fix_steps(row["code"], lines, told, row["errors"] or 0, wanted)
                out += rows_of(row["source_id"], row["code"], steps)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema_)], schema=schema_)

    return rows.select("source_id", "code", "steps", "told", "errors").mapInArrow(run, ddl)


def fix(source: DataFrame, diagnostics: DataFrame | None = None, rules: Iterable[str] | None = None, derive: bool = True) -> DataFrame:
    """source_id, code, applied (rule and count, an entry for each application, in order) of every source.

    Without ``diagnostics`` they are derived; idioms are left alone in a source that has errors left.
    """
    out = pa.schema([("source_id", pa.int64()), ("code", pa.string()), ("applied", pa.list_(pa.struct([("rule", pa.string()), ("count", pa.int32())])))])

    def rows_of(source_id, code, steps):
        return [(source_id, _after(code, steps), [{"rule": r, "count": n} for r, n in _applied(steps)])]

    return _stepped(source, diagnostics, rules, derive, out, schema.FIX, rows_of)


def fix_and_analyze(source: DataFrame, diagnostics: DataFrame | None = None, rules: Iterable[str] | None = None, derive: bool = True) -> tuple[DataFrame, DataFrame]:
    """The fixed corpus, and what is left to say about it."""
    fixed = fix(source, diagnostics, rules, derive)
    return fixed, analyze(fixed.select("source_id", F.lit(None).cast("string").alias("path"), "code"), rules=rules, derive=derive)


def traced(source: DataFrame, diagnostics: DataFrame | None = None, rules: Iterable[str] | None = None, derive: bool = True) -> DataFrame:
    """source_id, step, rule, op, line_no, text: the lines that each step of a fix changes.

    Steps are numbered as the entries of ``applied``; one that changes nothing has a row without op, line and text.
    """
    out = pa.schema([("source_id", pa.int64()), ("step", pa.int32()), ("rule", pa.string()), ("op", pa.string()), ("line_no", pa.int32()), ("text", pa.string())])

    def rows_of(source_id, code, steps):
        return [(source_id, k, rule, *change) for k, (rule, _, before, after) in enumerate(steps) for change in trace(before, after) or [(None, None, None)]]

    return _stepped(source, diagnostics, rules, derive, out, "source_id long, step int, rule string, op string, line_no int, text string", rows_of)


def trace(before: str, after: str) -> list[tuple[str, int, str]]:
    """(removed or added, line, text) of lines that differ at the same place."""
    a, b = before.split("\n"), after.split("\n")
    out = []
    for i in range(max(len(a), len(b))):
        x, y = a[i] if i < len(a) else None, b[i] if i < len(b) else None
        if x != y:
            out += [("removed", i + 1, x)] * (x is not None) + [("added", i + 1, y)] * (y is not None)
    return out


__all__ = ["fix", "fix_and_analyze", "fix_derived", "fix_diagnosed", "fix_idioms", "fix_steps", "trace", "traced"]
