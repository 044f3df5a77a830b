"""Diagnostics that can be told from a source alone.

There is no compiler here.  What it would say is taken from a diagnostics table where there is one; otherwise these are
derived: variables that are bound and never used, underscored variables that are used, heredoc lines left of their
closer, and calls of functions that are known not to exist.  A source counts as compiling if it parses and none of the
derived diagnostics is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from loomlint.functions.elixir import Node
from loomlint.functions.tree import Function, Tree, function, keyed, local, pipe, statements
from loomlint.operators.semantic import LOCAL_FIXES, QUALIFIED_FIXES, RULES

#: (severity, message, line)
Diagnostic = tuple[str, str, int | None]
#: Macros of test modules.
TEST_MACROS = ("test", "describe", "setup")


def _bound(f: Function) -> set[int]:
    """Ids of the variable nodes of a function that stand where names are bound."""
    out: set[int] = set()

    def pattern(n: Node) -> None:
        skip: set[int] = set()
        for x in n.walk():
            if local(x, "^", 1):
                skip.add(id(x.args[0]))
            elif local(x, "\\\\", 2) or local(x, "::", 2):  # defaults and sizes are expressions
                skip.update(id(y) for y in x.args[1].walk())
            if x.kind == "var" and id(x) not in skip:
                out.add(id(x))

    for p in f.params or []:
        pattern(p)
    for n in f.node.walk():
        if local(n, "=", 2) or local(n, "<-", 2):
            pattern(n.args[0])
        elif n.kind == "clause":
            for a in n.args:
                if local(a, "when"):
                    for x in a.args[:-1]:
                        pattern(x)
                else:
                    pattern(a)
    return out


def _variables(t: Tree) -> Iterator[Diagnostic]:
    for f in t.functions:
        at: dict[str, list[Node]] = {}
        for n in f.node.walk():
            if n.kind == "var" and n is not f.head:
                at.setdefault(n.name, []).append(n)
        if any(local(n) and n.name in ("binding", "var!", "quote", "unquote") for n in f.node.walk()):
            continue
        bound = _bound(f)
        for name, found in at.items():
            if name == "_" or name.startswith("__") or not re.match(r"\w", name):
                continue
            used = [n for n in found if id(n) not in bound]
            if name.startswith("_"):
                if used and len(used) < len(found):
                    yield "warning", f'the underscored variable "{name}" is used after being set', used[0].line
            elif len(found) == 1 and not used:
                yield "warning", f'variable "{name}" is unused', found[0].line


def _calls(t: Tree) -> Iterator[Diagnostic]:
    piped = {id(n.args[1]) for n in t.nodes if pipe(n)}
    captured = {}
    for n in t.nodes:
        if local(n, "&", 1) and local(n.args[0], "/", 2) and n.args[0].args[1].kind == "int":
            captured[id(n.args[0].args[0])] = n.args[0].args[1].value
    for n in t.nodes:
        if n.kind != "call" or n.target is None or n.target.kind != "alias" or n.flags in ("anon", "access"):
            continue
        arity = captured.get(id(n), len(n.args) + (id(n) in piped))
        key = (n.target.name, n.name, arity)
        if key in QUALIFIED_FIXES:
            what = "is deprecated" if key == ("Enum", "partition", 2) else "is undefined or private"
            yield "warning", f"{n.target.name}.{n.name}/{arity} {what}", n.line
        elif n.target.name == "String" and n.name == "alphanumeric?":
            yield "warning", f"String.alphanumeric?/{arity} is undefined or private", n.line
    inner: set[int] = set()
    for module in t.nodes:  # outer modules come first
        if local(module, "defmodule", 2) and module.args[0].kind == "alias" and id(module) not in inner:
            inner.update(id(n) for n in module.walk())
            yield from _local_calls(t, module, set(), piped)


def _own(module: Node) -> Iterator[Node]:
    """Nodes of a module but those of modules inside it, which are only named."""
    stack = [module.args[1]]
    while stack:
        n = stack.pop()
        yield n
        if not local(n, "defmodule", 2):
            stack.extend(reversed(n.children()))


def _local_calls(t: Tree, module: Node, outer: set[tuple[str, int]], piped: set[int]) -> Iterator[Diagnostic]:
    """Calls in a module of functions that neither it nor a module around it defines; then the modules inside it."""
    top, nodes = statements(keyed(module.args[1], "do")), list(_own(module))
    if any(local(s) and s.name in ("import", "use") for s in top):
        return  # what they bring in is not known, here and inside
    own = outer | _functions(top)
    for s in top:
        if local(s) and s.name in TEST_MACROS and len(s.args) >= 1 and (s.name, len(s.args)) not in own:
            yield "error", f"undefined function {s.name}/{len(s.args)} (there is no such import)", s.line
    for n in nodes:
        arity = len(n.args) + (id(n) in piped) if n.kind == "call" else 0
        if local(n) and (n.name, arity) in LOCAL_FIXES and (n.name, arity) not in own and not _is_head(t, n):
            yield "error", f"undefined function {n.name}/{arity} (expected {module.args[0].name} to define such a function or for it to be imported)", n.line
    for n in nodes:
        if local(n, "defmodule", 2) and n.args[0].kind == "alias":
            yield from _local_calls(t, n, own, piped)


def _functions(top: list[Node]) -> set[tuple[str, int]]:
    """(name, arity) of what statements define."""
    out = set()
    for s in top:
        if f := function(s):
            out.add((f.name, len(f.params or [])))
        elif local(s) and s.name in ("def", "defp", "defmacro", "defmacrop") and s.args and s.args[0].kind in ("call", "var"):
            out.add((s.args[0].name, len(s.args[0].args)))
    return out


def _is_head(t: Tree, n: Node) -> bool:
    return any(f.head is n for f in t.functions)


def _heredocs(t: Tree) -> Iterator[Diagnostic]:
    for n in t.nodes:
        if n.flags == "heredoc":
            lines = t.text(n).split("\n")
            need = len(lines[-1]) - len(lines[-1].lstrip())
            for i, line in enumerate(lines[1:-1], 1):
                if line.strip() and len(line) - len(line.lstrip()) < need:
                    yield "warning", "outdented heredoc line", n.line + i
                    break


def diagnose(t: Tree) -> list[Diagnostic]:
    return [*_calls(t), *_variables(t), *_heredocs(t)]


#: As ``semantic.RULES`` match, on plain strings: (module, issue, test of severity and message).
_QUALIFIED, _LOCAL = r"(\w+)\.(\w+)/(\d+) is (undefined or private|deprecated)", r"undefined function (\w+)/(\d+)"
_TESTS = {
    "MissingUseExunitCase": lambda s, m: s == "error" and any(f"undefined function {x}/" in m for x in TEST_MACROS),
    "OutdentedHeredoc": lambda s, m: s == "warning" and "outdented heredoc line" in m,
    "UndefinedFunction": lambda s, m: s == "warning" and bool(re.search(_QUALIFIED, m, re.ASCII)) or s == "error" and bool(re.search(_LOCAL, m, re.ASCII)),
    "UndefinedStringAlphanumeric": lambda s, m: s == "warning" and "String.alphanumeric?" in m and "is undefined or private" in m,
    "UnusedVariable": lambda s, m: s == "warning" and bool(re.search(r'variable ".*" is unused', m)),
    "UsedUnderscoreVariable": lambda s, m: s == "warning" and "is used after being set" in m,
}


def taken(diagnostics: list[Diagnostic]) -> list[tuple[int, str, str, str, int | None]]:
    """(order, module, issue, message, line) of the diagnostics that a rule takes, of one severity as in ``dispatched``."""
    severity = "error" if any(s == "error" for s, _, _ in diagnostics) else "warning"
    out = []
    for s, m, line in diagnostics:
        if s == severity:
            hit = next(((i, r) for i, r in enumerate(RULES) if _TESTS[r.module](s, m)), None)
            if hit:
                out.append((hit[0], hit[1].module, hit[1].rule, m, line))
    return out
