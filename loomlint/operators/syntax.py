"""Rules over lines of text that does not parse.  All are Spark SQL expressions of one line.

A rule is a name, a condition, an issue and a rewrite; conditions and rewrites are applied to all lines in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlint.sources.corpus import lines

#: Words that other languages put before a definition, and the patterns of the lines that match.
MODIFIERS = ["pprivate", "private", "public", "protected", "static", "abstract", "final", "async", "pub", "export"]
_SCIENTIFIC = r"(?<!\.)(\d+)[eE]([+-]?\d+)"
_MODULO = r"(\w+)\s*%\s*(\w+)(?!\.)"
_STALE = r"^(\s*)(" + "|".join(sorted(MODIFIERS, key=lambda m: -len(m))) + r")\s+(defp?|defmacrop?)\b"
_SPEC = r"^(\s*@spec\s+\w+[?!]?)\("


@dataclass(frozen=True)
class SyntaxRule:
    module: str
    issues: Callable[[Column], list[tuple[Column, Column, Column]]]  # (condition, atom, message)
    rewrite: Callable[[Column], Column]


def _comment(text: Column) -> Column:
    return F.coalesce(F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("#"), F.lit(False))


def _infix(text: Column, op: str) -> Column:
    """Both forms have the operator between spaces, which most lines do not: that is asked first."""
    pattern = rf"(?<![|>.])\b\S+\)\s+{op}\s+\w|(?<![|>.])\b\w+\s+{op}\s+\w"
    return F.when(text.contains(op), text.rlike(rf"\s{op}\s") & ~_comment(text) & text.rlike(pattern)).otherwise(F.lit(False))


def _infix_issues(text: Column) -> list[tuple[Column, Column, Column]]:
    return [(_infix(text, op), F.lit(f"infix_{op}"), F.lit(f"`{op}` is a function, not an operator: write `{op}(a, b)`.")) for op in ("div", "rem")]


def _infix_rewrite(text: Column) -> Column:
    for op in ("div", "rem"):
        pattern = rf"^(\s*(?:\w+\s*=\s*)?)(.+?)\s+{op}\s+(.+?)(\s*)$"
        text = F.when(_infix(text, op) & text.rlike(pattern), F.regexp_replace(text, pattern, rf"$1{op}($2, $3)$4")).otherwise(text)
    return text


def _spec_parts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Of a spec line: its head, what stands in its parentheses, what follows them, and whether they close.

    The closing parenthesis is the first character at which a fold over the text reaches depth 0.
    """
    head = F.regexp_extract(text, _SPEC, 1)
    rest = F.substr(text, F.length(head) + F.lit(2))
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("close"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["close"] == 0) & (depth == 0), at).otherwise(s["close"]).alias("close"))

    close = F.aggregate(F.split(rest, ""), zero, step)["close"]
    inner = F.substr(rest, F.lit(1), close - 1)
    return head, inner, F.substr(rest, close + 1), text.rlike(_SPEC) & (close > 0)


def _separator(inner: Column) -> Column:
    """Place (from 1) of the last `::` outside parentheses, or 0."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("last"), F.lit(False).alias("colon"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        at = s["at"] + 1
        pair = s["colon"] & (c == ":")
        return F.struct(
            depth.alias("depth"), at.alias("at"), F.when(pair & (s["depth"] == 0), s["at"]).otherwise(s["last"]).alias("last"), ((c == ":") & ~pair).alias("colon")
        )

    return F.aggregate(F.split(inner, ""), zero, step)["last"]


def _spec(text: Column) -> tuple[Column, Column]:
    head, inner, after, closed = _spec_parts(text)
    at = _separator(inner)
    bad = F.coalesce(text.rlike(_SPEC) & closed & ~after.contains("::") & (at > 0), F.lit(False))
    params = F.regexp_replace(F.substr(inner, F.lit(1), at - 1), r"\s+$", "")
    returns = F.regexp_replace(F.substr(inner, at + 2), r"^\s+", "")
    return bad, F.concat(head, F.lit("("), params, F.lit(") :: "), returns)


RULES = [
    SyntaxRule("FixDivRem", _infix_issues, _infix_rewrite),
    SyntaxRule(
        "FixMalformedSpec",
        lambda t: [(F.when(t.rlike(_SPEC), _spec(t)[0]).otherwise(False), F.lit("malformed_spec"), F.lit("The return type's `::` is inside the parentheses: close them before it."))],
        lambda t: F.when(t.rlike(_SPEC) & _spec(t)[0], _spec(t)[1]).otherwise(t),
    ),
    SyntaxRule(
        "FixPythonModulo",
        lambda t: [(~t.rlike(r"^\s*#") & t.rlike(_MODULO), F.lit("python_modulo"), F.lit("`%` is no operator: use `rem(a, b)`."))],
        lambda t: F.when(~t.rlike(r"^\s*#") & t.rlike(_MODULO), F.regexp_replace(t, _MODULO, "rem($1, $2)")).otherwise(t),
    ),
    SyntaxRule(
        "FixScientificNotation",
        lambda t: [(~_comment(t) & t.rlike(_SCIENTIFIC), F.lit("python_scientific_notation"), F.lit("A float needs a decimal point: write `1.0e-10` for `1e-10`."))],
        lambda t: F.when(_comment(t), t).otherwise(F.regexp_replace(t, _SCIENTIFIC, "$1.0e$2")),
    ),
    SyntaxRule(
        "FixStaleAccessModifier",
        lambda t: [(t.rlike(_STALE), F.lit("stale_access_modifier"), F.concat(F.lit("`"), F.regexp_extract(t, _STALE, 2), F.lit("` is no keyword: `def` and `defp` decide visibility.")))],
        lambda t: F.regexp_replace(t, _STALE, "$1$3"),
    ),
]


def analyze_lines(source: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Issues of the syntax rules on every line, whether or not the text parses."""
    found = []
    for ord_, rule in enumerate(RULES):
        if only is None or rule.module in only:
            for k, (when, atom, message) in enumerate(rule.issues(F.col("text"))):
                issue = F.struct(F.lit(ord_).alias("rule_ord"), F.lit(k).alias("k"), F.lit(rule.module).alias("module"), atom.alias("rule"), message.alias("message"))
                found.append(F.when(when, issue))
    issues = lines(source).where("text is not null").select("source_id", "line_no", F.explode(F.array_compact(F.array(*found))).alias("i"))
    return issues.select(
        "source_id", F.lit("syntax").alias("phase"), "i.rule", "i.module", "i.message", F.col("line_no").alias("line"), "i.rule_ord", (F.col("line_no") * 2 + F.col("i.k")).alias("issue_ord")
    )


def fix_lines(source: DataFrame, only: set[str] | None = None, steps: bool = False) -> DataFrame:
    """source_id, code, applied: every text with all rewrites, in the rules' order, and the rules that changed it.

    A text stays in its row: the rules go over its lines as an array.  With ``steps`` a last column holds the text after
    each rule that changed it, as (rule, code).
    """
    row = source.select("*", F.split("code", "\n", -1).alias("_0"))
    rules = [r for r in RULES if only is None or r.module in only]
    for k, r in enumerate(rules):
        row = row.withColumn(f"_{k + 1}", F.transform(f"_{k}", r.rewrite))
    text = lambda k: F.array_join(f"_{k}", "\n")
    changed = [F.when(F.col(f"_{k}") != F.col(f"_{k + 1}"), F.struct(F.lit(r.module).alias("rule"), F.lit(1).alias("count"))) for k, r in enumerate(rules)]
    out = [text(len(rules)).alias("code"), F.array_compact(F.array(*changed)).alias("applied")]
    if steps:
        each = [F.when(F.col(f"_{k}") != F.col(f"_{k + 1}"), F.struct(F.lit(r.module).alias("rule"), text(k + 1).alias("code"))) for k, r in enumerate(rules)]
        out.append(F.array_compact(F.array(*each)).alias("steps"))
    return row.select("source_id", *out, *[c for c in source.columns if c not in ("source_id", "code")])


__all__ = ["RULES", "SyntaxRule", "analyze_lines", "fix_lines"]
