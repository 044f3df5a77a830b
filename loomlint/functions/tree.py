"""Questions that rules ask of a parsed source."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from loomlint.functions.elixir import Node, parse


class Tree:
    """A source with its nodes in pre-order and views that several rules share."""

    def __init__(self, code: str):
        self.code = code
        self.root = parse(code)

    @cached_property
    def nodes(self) -> list[Node]:
        return list(self.root.walk())

    @cached_property
    def lines(self) -> list[str]:
        return self.code.split("\n")

    def text(self, node: Node) -> str:
        return self.code[node.start : node.end]

    def calls(self, name: str | None = None, arity: int | None = None) -> Iterator[Node]:
        for n in self.nodes:
            if local(n, name, arity):
                yield n

    def remotes(self, mod: str, names, *arities: int) -> Iterator[Node]:
        for n in self.nodes:
            if remote(n, mod, names, *arities):
                yield n

    @cached_property
    def pipes(self) -> list[Node]:
        return [n for n in self.nodes if pipe(n)]

    @cached_property
    def blocks(self) -> list[list[Node]]:
        return [n.args for n in self.nodes if n.kind == "block" and n.flags != "clauses"]

    @cached_property
    def functions(self) -> list[Function]:
        return [f for n in self.nodes if (f := function(n))]

    @cached_property
    def clauses(self) -> dict[tuple[str, int], list[Function]]:
        """Clauses with a parameter list by name and arity, in source order."""
        out: dict[tuple[str, int], list[Function]] = {}
        for f in self.functions:
            if f.params is not None:
                out.setdefault((f.name, len(f.params)), []).append(f)
        return out


class Function:
    """A def or defp with a body."""

    def __init__(self, node: Node, kind: str, name: str, params: list[Node] | None, guard: Node | None, when: Node | None, body: Node | None, head: Node):
        self.node, self.kind, self.name, self.params, self.guard, self.when, self.body, self.head = node, kind, name, params, guard, when, body, head
        self.line = node.line

    @cached_property
    def recursive(self) -> bool:
        return self.body is not None and any(n.kind == "call" and n.target is None and n.name == self.name for n in self.body.walk())


def function(n: Node) -> Function | None:
    if not (n.kind == "call" and n.target is None and n.name in ("def", "defp") and len(n.args) == 2 and n.args[1].kind == "list"):
        return None
    head, guard, when = n.args[0], None, None
    if local(head, "when", 2):
        when, (head, guard) = head, head.args
    if head.kind not in ("call", "var") or head.target is not None or head.name is None:
        return None
    return Function(n, n.name, head.name, head.args if head.kind == "call" else None, guard, when, keyed(n.args[1], "do"), head)


def local(n: Node | None, name: str | None = None, arity: int | None = None) -> bool:
    return n is not None and n.kind == "call" and n.target is None and (name is None or n.name == name) and (arity is None or len(n.args) == arity)


def remote(n: Node | None, mod: str, names, *arities: int) -> bool:
    if n is None or n.kind != "call" or n.target is None or n.target.kind != "alias" or n.target.name != mod or n.flags in ("anon", "access"):
        return False
    return (n.name == names if isinstance(names, str) else n.name in names) and (not arities or len(n.args) in arities)


def pipe(n: Node | None) -> bool:
    return local(n, "|>", 2)


def steps(n: Node) -> list[Node]:
    """The first expression of a pipeline and its steps."""
    out = []
    while pipe(n):
        out.append(n.args[1])
        n = n.args[0]
    return [n, *reversed(out)]


def last_step(n: Node) -> Node:
    return n.args[1] if pipe(n) else n


def pairs_next(items: list) -> Iterator[tuple]:
    return zip(items, items[1:], strict=False)


def keyed(n: Node | None, key: str) -> Node | None:
    """Value of a key of a keyword list or do block."""
    if n is None or n.kind != "list":
        return None
    for p in n.args:
        if p.kind == "tuple" and len(p.args) == 2 and p.args[0].kind == "atom" and p.args[0].value == key:
            return p.args[1]
    return None


def keys(n: Node) -> list:
    return [p.args[0].value for p in n.args if p.kind == "tuple" and len(p.args) == 2]


def var(n: Node | None) -> str | None:
    return n.name if n is not None and n.kind == "var" else None


def same_var(a: Node, b: Node) -> bool:
    return var(a) is not None and var(a) == var(b)


def same(a: Node, b: Node) -> bool:
    return a.shape() == b.shape()


def integer(n: Node | None) -> int | None:
    """An integer literal, with a minus sign before it or not."""
    if n is None:
        return None
    if n.kind == "int":
        return n.value
    if local(n, "-", 1) and n.args[0].kind == "int":
        return -n.args[0].value
    return None


def atom(n: Node | None, *values: str) -> bool:
    return n is not None and n.kind == "atom" and n.value in values


def string(n: Node | None, value: str | None = None) -> bool:
    return n is not None and n.kind == "str" and (value is None or n.value == value)


def empty_list(n: Node | None) -> bool:
    return n is not None and n.kind == "list" and not n.args and n.flags == ""


def lambda_(n: Node | None) -> tuple[list[Node], Node] | None:
    """Parameters and body of a function literal with one clause."""
    if n is None or n.kind != "fn" or len(n.args) != 1:
        return None
    return n.args[0].args, n.args[0].body


def statements(n: Node | None) -> list[Node]:
    if n is None:
        return []
    return n.args if n.kind == "block" and n.flags != "clauses" else [n]


def last(n: Node | None) -> Node | None:
    s = statements(n)
    return s[-1] if s else None


def names_in(n: Node) -> set[str]:
    return {x.name for x in n.walk() if x.kind == "var"}


def mentions(n: Node, name: str) -> bool:
    return any(x.name == name and x.target is None and x.kind in ("var", "call") for x in n.walk())


def direction(n: Node | None) -> str | None:
    """asc or desc of a sort argument: an atom, a capture such as &>=/2, or a comparator of two parameters."""
    if n is None:
        return "asc"
    if atom(n, "asc", "desc"):
        return n.value
    if local(n, "&", 1) and local(n.args[0], "/", 2) and n.args[0].args[1].kind == "int" and n.args[0].args[1].value == 2:
        op = n.args[0].args[0].name
        return {">": "desc", ">=": "desc", "<": "asc", "<=": "asc"}.get(op)
    f = lambda_(n)
    if f and len(f[0]) == 2 and f[1].kind == "call" and f[1].name in (">", ">=", "<", "<=") and len(f[1].args) == 2:
        (p, q), (a, b) = f[0], f[1].args
        forward = same_var(p, a) and same_var(q, b)
        if forward or same_var(q, a) and same_var(p, b):
            return "desc" if (f[1].name in (">", ">=")) == forward else "asc"
    return None
