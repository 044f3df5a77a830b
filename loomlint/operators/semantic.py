"""Rules over compiler diagnostics: which rule takes a diagnostic, and what it does to the line it names.

The compiler itself is outside: diagnostics come as a table (source_id, ord, severity, message, line, col).  Dispatch is
SQL; rewrites work on one source at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlint.functions.elixir import ParseError
from loomlint.functions.tree import Tree, keyed, local, statements
from loomlint.operators.matcher import suggest

QUALIFIED = r"(\w+)\.(\w+)/(\d+) is (undefined or private|deprecated)"
LOCAL = r"undefined function (\w+)/(\d+)"


@dataclass(frozen=True)
class SemanticRule:
    module: str
    rule: str
    priority: int
    matches: Callable[[Column, Column], Column]  # of severity and message


RULES = [
    SemanticRule(
        "MissingUseExunitCase",
        "missing_use_exunit_case",
        100,
        lambda s, m: (s == "error") & (m.contains("undefined function test/") | m.contains("undefined function describe/") | m.contains("undefined function setup/")),
    ),
    SemanticRule("OutdentedHeredoc", "outdented_heredoc", 500, lambda s, m: (s == "warning") & m.contains("outdented heredoc line")),
    SemanticRule(
        "UndefinedFunction",
        "undefined_function",
        500,
        lambda s, m: (s == "warning") & (m.contains("is undefined or private") | m.contains("is deprecated")) & m.rlike(QUALIFIED) | (s == "error") & m.contains("undefined function") & m.rlike(LOCAL),
    ),
    SemanticRule("UndefinedStringAlphanumeric", "undefined_string_alphanumeric", 500, lambda s, m: (s == "warning") & m.contains("String.alphanumeric?") & m.contains("is undefined or private")),
    SemanticRule("UnusedVariable", "unused_variable", 500, lambda s, m: (s == "warning") & m.rlike('variable ".*" is unused')),
    SemanticRule("UsedUnderscoreVariable", "used_underscore_variable", 500, lambda s, m: (s == "warning") & m.contains("is used after being set")),
]
RULES.sort(key=lambda r: (r.priority, r.module))


def dispatched(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics with the rule that takes them: the first that matches by priority and module; others are dropped.

    A source with errors is judged by its errors, one without by its warnings.
    """
    s, m = F.col("severity"), F.col("message")
    picked = F.coalesce(*[F.when(r.matches(s, m), F.struct(F.lit(i).alias("rule_ord"), F.lit(r.module).alias("module"), F.lit(r.rule).alias("rule"))) for i, r in enumerate(RULES)])
    failed = diagnostics.groupBy("source_id").agg(F.bool_or(s == "error").alias("failed"))
    judged = diagnostics.join(failed, "source_id").where(s == F.when(F.col("failed"), "error").otherwise("warning")).drop("failed")
    return judged.withColumn("r", picked).where("r is not null").select("*", "r.*").drop("r")


def issues(diagnostics: DataFrame) -> DataFrame:
    text = F.when(F.col("rule") == "missing_use_exunit_case", F.lit("A test module needs `use ExUnit.Case`.")).otherwise(F.col("message"))
    return dispatched(diagnostics).select("source_id", F.lit("semantic").alias("phase"), "rule", "module", text.alias("message"), "line", "rule_ord", F.col("ord").alias("issue_ord"))


# -- rewrites of one source

#: What stands for functions that do not exist, by module, name and arity.
QUALIFIED_FIXES = {
    ("Enum", "last", 1): ("rename", "List.last"),
    ("Enum", "last", 0): ("rename", "List.last"),
    ("List", "reverse", 1): ("rename", "Enum.reverse"),
    ("Enum", "partition", 2): ("rename", "Enum.split_with"),
    ("Float", "NegInfinity", 0): ("literal", ":neg_infinity"),
    ("Float", "PositiveInfinity", 0): ("literal", ":infinity"),
    ("Float", "NegInf", 0): ("literal", ":neg_infinity"),
    ("Float", "Infinity", 0): ("literal", ":infinity"),
    ("Float", "inf", 0): ("signed", ":infinity", ":neg_infinity"),
    ("Integer", "min_value", 0): ("literal", ":neg_infinity"),
    ("Integer", "max_value", 0): ("literal", ":infinity"),
    ("List", "pop", 1): ("rename", "List.last"),
    ("List", "drop", 2): ("rename", "Enum.drop"),
    ("Enum", "cycle", 1): ("rename", "Stream.cycle"),
    ("List", "second", 1): ("add", "Enum.at", "1"),
    ("Enum", "take_last", 2): ("negate", "Enum.take", 1),
}
LOCAL_FIXES = {
    ("infinity", 0): ("literal", ":math.inf()"),
    ("max", 1): ("rename", "Enum.max"),
    ("max", 3): ("wrap", "Enum.max"),
    ("max", 4): ("wrap", "Enum.max"),
    ("max", 5): ("wrap", "Enum.max"),
    ("min", 1): ("rename", "Enum.min"),
    ("min", 3): ("wrap", "Enum.min"),
    ("min", 4): ("wrap", "Enum.min"),
    ("min", 5): ("wrap", "Enum.min"),
    ("sum", 1): ("rename", "Enum.sum"),
    ("sorted", 1): ("rename", "Enum.sort"),
    ("len", 1): ("rename", "length"),
    ("reversed", 1): ("rename", "Enum.reverse"),
    ("range", 1): ("range",),
    ("range", 2): ("range",),
    ("range", 3): ("range",),
}


def split_call(text: str, at: int) -> tuple[list[str], str, int] | None:
    """Arguments of the call whose opening parenthesis is at ``at``, their text, and the place after the closing one."""
    depth, start, args = 0, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                args.append(text[start:i].strip())
                return args, text[at + 1 : i], i + 1
        elif c == "," and depth == 1:
            args.append(text[start:i].strip())
            start = i + 1
    return None


def _each_call(line: str, name: str, make: Callable[[list[str], str], str | None], again: bool) -> str:
    """Replace calls of a name that no dot or word precedes."""
    out, rest = "", line
    while m := re.search(rf"(?<![.a-zA-Z0-9_]){re.escape(name)}\(", rest):
        call = split_call(rest, m.end() - 1)
        new = make(call[0], call[1]) if call else None
        if new is None:
            break
        out, rest = out + rest[: m.start()] + new, rest[call[2] :]
        if not again:
            break
    return out + rest


def _range(args: list[str], arity: int) -> str | None:
    if len(args) != arity:
        return None
    return {1: lambda n: f"0..{n} - 1", 2: lambda a, b: f"{a}..{b} - 1", 3: lambda a, b, c: f"{a}..{b}//{c}"}[arity](*args)


def _qualified(line: str, mod: str, fun: str, arity: int, tree: Callable[[], Tree | None]) -> str:
    old = f"{mod}.{fun}"
    fix = QUALIFIED_FIXES.get((mod, fun, arity))
    if fix is None:
        t = tree()
        new = suggest(t, mod, fun, arity, public_only=True) if t else None
        return line.replace(old, f"{mod}.{new}", 1) if new else line
    if fix[0] == "rename":
        return line.replace(old, fix[1], 1)
    if fix[0] in ("literal", "signed"):
        forms = [(f"-{old}()", fix[2]), (f"-{old}", fix[2])] if fix[0] == "signed" else []
        for form, text in [*forms, (f"{old}()", fix[1]), (old, fix[1])]:
            if form in line:
                return line.replace(form, text, 1)
        return line
    at = line.find(f"{old}(")
    call = split_call(line, at + len(old)) if at >= 0 else None
    if not call:
        return line
    args, inner, end = call
    if fix[0] == "add":
        text = f"{inner}, {fix[2]}" if inner.strip() else fix[2]
    else:
        k = min(fix[2], len(args) - 1)
        args[k] = f"-{args[k]}" if re.fullmatch(r"\w+", args[k], re.ASCII) else f"-({args[k]})"
        text = ", ".join(args)
    return f"{line[:at]}{fix[1]}({text}){line[end:]}"


def _local(line: str, name: str, arity: int, message: str, tree: Callable[[], Tree | None]) -> str:
    fix = LOCAL_FIXES.get((name, arity))
    rename = lambda new: re.sub(rf"(?<![.a-zA-Z0-9_]){re.escape(name)}\(", lambda _: f"{new}(", line)
    if fix is None:
        m = re.search(r"expected ([\w.]+) to define", message, re.ASCII)
        t = tree() if m else None
        new = suggest(t, m[1], name, arity) if t else None
        return rename(new) if new else line
    if fix[0] == "literal":
        return line.replace(f"{name}()", fix[1])
    if fix[0] == "rename":
        return rename(fix[1])
    if fix[0] == "wrap":
        return _each_call(line, name, lambda _args, inner: f"{fix[1]}([{inner}])", True)
    return _each_call(line, name, lambda args, _inner: _range(args, arity), True)


def _indent(line: str) -> int:
    return len(line.encode()) - len(line.lstrip().encode())


def _clause_bounds(lines: list[str], at: int) -> tuple[int, int]:
    start = next((i for i in range(at, -1, -1) if re.match(r"\s*(def|defp)\s", lines[i])), at)
    if ", do:" in lines[start]:
        return start, start
    end = next((i for i in range(start + 1, len(lines)) if lines[i].strip() == "end" and _indent(lines[i]) == _indent(lines[start])), start)
    return start, end


def _reindent(lines: list[str], at: int) -> list[str]:
    quotes = ('"""', "'''")
    top = next((i for i in range(at - 1, -1, -1) if any(q in lines[i] for q in quotes)), None)
    low = next((i for i in range(at + 1, len(lines)) if lines[i].strip() in quotes), None)
    if top is None or low is None:
        return lines
    need = _indent(lines[low])
    body = [" " * max(0, need - _indent(x)) + x if x.strip() else x for x in lines[top + 1 : low]]
    return [*lines[: top + 1], *body, *lines[low:]]


def _use_case(code: str) -> str:
    """``use ExUnit.Case`` after the directives of each module that calls test macros at its top without it."""
    try:
        tree = Tree(code)
    except ParseError:
        return code
    edits = []
    for n in tree.nodes:
        if not local(n, "defmodule", 2):
            continue
        top = statements(keyed(n.args[1], "do"))
        asks = any(local(s) and s.name in ("test", "describe", "setup", "setup_all") for s in top)
        has = any(local(s, "use") and s.args and s.args[0].kind == "alias" and s.args[0].name == "ExUnit.Case" for s in top)
        if asks and not has:
            directives = [s for s in top if local(s) and s.name in ("use", "import", "require", "alias") or local(s, "@", 1) and s.args[0].name == "moduledoc"]
            line_start = code.rfind("\n", 0, top[0].start) + 1
            pad = " " * (top[0].start - line_start) if not code[line_start : top[0].start].strip() else "  "
            edits.append((directives[-1].end, f"\n{pad}use ExUnit.Case") if directives else (top[0].start, f"use ExUnit.Case\n{pad}"))
    for at, text in sorted(edits, reverse=True):
        code = code[:at] + text + code[at:]
    return code


def rewrite(code: str, module: str, message: str, line: int | None) -> str:
    """A source after the fix of one diagnostic; unchanged if there is none."""
    if module == "MissingUseExunitCase":
        return _use_case(code)
    lines = code.split("\n")
    if line is None or not 1 <= line <= len(lines):
        return code
    i = line - 1

    def tree() -> Tree | None:
        try:
            return Tree(code)
        except ParseError:
            return None

    if module == "OutdentedHeredoc":
        return "\n".join(_reindent(lines, i))
    if module == "UndefinedFunction":
        if m := re.search(QUALIFIED, message, re.ASCII):
            lines[i] = _qualified(lines[i], m[1], m[2], int(m[3]), tree)
        elif m := re.search(LOCAL, message, re.ASCII):
            lines[i] = _local(lines[i], m[1], int(m[2]), message, tree)
    elif module == "UndefinedStringAlphanumeric":
        text = lines[i].replace("&String.alphanumeric?/1", "fn char -> String.match?(char, ~r/^[a-zA-Z0-9]$/) end")
        lines[i] = re.sub(r"String\.alphanumeric\?\(([^)]+)\)", lambda m: f"String.match?({m[1].strip()}, ~r/^[a-zA-Z0-9]$/)", text)
    elif module == "UnusedVariable":
        if (m := re.search(r'variable "([^"]+)" is unused', message)) and not m[1].startswith("_"):
            # a whole word: the name can be part of a longer one on the line
            lines[i] = re.sub(rf"(?<![\w?!]){re.escape(m[1])}(?![\w?!])", f"_{m[1]}", lines[i], count=1)
    elif module == "UsedUnderscoreVariable":
        if (m := re.search(r'variable "([^"]+)" is used after being set', message)) and m[1].startswith("_"):
            lo, hi = _clause_bounds(lines, i)
            for k in range(lo, hi + 1):
                lines[k] = re.sub(rf"(?<![a-zA-Z0-9_?!]){re.escape(m[1])}(?![a-zA-Z0-9_?!])", m[1][1:], lines[k])
    return "\n".join(lines)
