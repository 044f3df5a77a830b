"""Idiom rules over parsed sources: what each reports.

A rule is a function from a ``Tree`` to (line, detail) findings, registered with its module name, the issue's atom, a
message that may hold {detail}, whether it can be fixed, and its priority.  Rules see one source at a time, so a corpus
is checked in one pass without a shuffle (see ``operators.analysis``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from loomlint.functions.elixir import Node
from loomlint.functions.tree import (
    Function,
    Tree,
    atom,
    direction,
    empty_list,
    function,
    integer,
    keyed,
    keys,
    lambda_,
    last,
    last_step,
    local,
    mentions,
    names_in,
    pairs_next,
    pipe,
    remote,
    same,
    same_var,
    statements,
    steps,
    string,
    var,
)

Found = Iterator[tuple[int | None, str]]


@dataclass(frozen=True)
class PatternRule:
    module: str
    rule: str
    message: str
    fixable: bool
    priority: int
    check: Callable[[Tree], Found]


RULES: list[PatternRule] = []


def rule(module: str, message: str, fixable: bool = True, priority: int = 500, atom: str | None = None):
    name = atom or re.sub(r"(?<!^)(?=[A-Z])", "_", module).lower()

    def add(check: Callable[[Tree], Found]) -> Callable[[Tree], Found]:
        RULES.append(PatternRule(module, name, message, fixable, priority, check))
        return check

    return add


def fed(t: Tree) -> Iterator[tuple[Node, Node | None, list[Node], int, Node | None]]:
    """Calls with what feeds them: (call, feeding call, other arguments, line, pipe); the feeder is the step before in a
    pipeline, or else the first argument."""
    for n in t.nodes:
        if pipe(n):
            yield n.args[1], last_step(n.args[0]), n.args[1].args, n.line, n
        elif n.kind == "call" and n.args:
            yield n, n.args[0], n.args[1:], n.line, None


def piped_or_direct(t: Tree, mod: str, names) -> Iterator[tuple[Node, list[Node], int]]:
    """Calls of mod.names with their arguments after the subject: direct ones, and those that a pipe feeds."""
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], mod, names):
            yield n.args[1], n.args[1].args, n.line
        elif remote(n, mod, names) and n.args:
            yield n, n.args[1:], n.line


# -- aggregation and reduce


def _reduce_body(n: Node) -> Node | None:
    f = lambda_(n.args[2])
    return f[1] if f else None


def _picks(body: Node | None, fun: str, ops: tuple[str, str]) -> bool:
    if local(body, fun, 2):
        return True
    return local(body, "if") and len(body.args) == 2 and body.args[0].kind == "call" and body.args[0].name in ops and len(body.args[0].args) == 2


@rule("NoExplicitMaxReduce", "This reduce computes a maximum: use `Enum.max/1` or `Enum.max_by/2`.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.remotes("Enum", "reduce", 3) if _picks(_reduce_body(n), "max", (">", ">=")))


@rule("NoExplicitMinReduce", "This reduce computes a minimum: use `Enum.min/1` or `Enum.min_by/2`.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.remotes("Enum", "reduce", 3) if _picks(_reduce_body(n), "min", ("<", "<=")))


@rule("NoExplicitSumReduce", "This reduce computes a sum: use `Enum.sum/1`.", priority=501)
def _(t: Tree) -> Found:
    for n in t.remotes("Enum", "reduce", 3):
        f = lambda_(n.args[2])
        if f and len(f[0]) == 2 and local(f[1], "+", 2):
            a, b = map(var, f[0])
            if a and b and sorted([a, b]) == sorted([var(f[1].args[0]) or "", var(f[1].args[1]) or ""]):
                yield n.line, ""


def _seeded(t: Tree, seed: Callable[[Node], bool]) -> Iterator[tuple[Node, Node, int]]:
    """Reduces whose seed passes: (call, function, line)."""
    for call, rest, line in piped_or_direct(t, "Enum", "reduce"):
        if len(rest) == 2 and seed(rest[0]):
            yield call, rest[1], line


@rule("NoManualFrequencies", "This reduce counts occurrences: use `Enum.frequencies/1`.")
def _(t: Tree) -> Found:
    for _call, fun, line in _seeded(t, lambda s: s.kind == "map" and not s.args):
        updates = [n for n in fun.walk() if remote(n, "Map", "update", 4) and integer(n.args[2]) == 1 or remote(n, "Map", "update!", 3)]
        if updates:
            yield line, ""


@rule("NoManualEnumUniq", "This reduce removes repeats with a MapSet: use `Enum.uniq/1`.")
def _(t: Tree) -> Found:
    def tests(cond: Node, seen: str, item: str) -> bool:
        while cond.kind == "call" and cond.name in ("!", "not") and len(cond.args) == 1:
            cond = cond.args[0]
        return remote(cond, "MapSet", "member?", 2) and var(cond.args[0]) == seen and var(cond.args[1]) == item

    for call, rest, line in piped_or_direct(t, "Enum", "reduce"):
        if len(rest) != 2 or rest[0].kind != "tuple" or len(rest[0].args) != 2 or rest[1].kind != "fn":
            continue
        at = next((i for i, x in enumerate(rest[0].args) if remote(x, "MapSet", "new")), None)
        for clause in rest[1].args if at is not None else []:
            if len(clause.args) == 2 and clause.args[1].kind == "tuple" and len(clause.args[1].args) == 2:
                item, seen = var(clause.args[0]), var(clause.args[1].args[at])
                if item and seen and any(local(n) and n.name in ("if", "unless", "case") and n.args and tests(n.args[0], seen, item) for n in clause.body.walk()):
                    yield line, ""
                    break


def _branches(n: Node) -> tuple[Node, Node] | None:
    if local(n, "if", 2):
        yes, no = keyed(n.args[1], "do"), keyed(n.args[1], "else")
        if yes is not None and no is not None:
            return yes, no
    return None


def _chosen(t: Tree, larger: bool) -> Found:
    for n in t.calls("if", 2):
        b, cond = _branches(n), n.args[0]
        if b and cond.kind == "call" and cond.target is None and cond.name in (">", ">=", "<", "<=") and len(cond.args) == 2:
            left, right = cond.args
            first = (cond.name in (">", ">=")) == larger
            if (same(b[0], left) and same(b[1], right)) if first else (same(b[0], right) and same(b[1], left)):
                yield n.line, ""


@rule("NoManualMax", "This conditional picks the larger value: use `max/2`.")
def _(t: Tree) -> Found:
    return _chosen(t, True)


@rule("NoManualMin", "This conditional picks the smaller value: use `min/2`.")
def _(t: Tree) -> Found:
    return _chosen(t, False)


@rule("NoMapThenAggregate", "`Enum.map` builds a list only for `Enum.{detail}`: fold in one pass.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if pipe(n):
            for a, b in pairs_next(steps(n)):
                if remote(a, "Enum", "map", 1, 2) and remote(b, "Enum", ("max", "min", "sum"), 0, 1):
                    yield n.line, b.name
                    break
        elif remote(n, "Enum", ("max", "min", "sum"), 1) and remote(n.args[0], "Enum", "map", 2):
            yield n.line, n.name


def _traversal(n: Node | None) -> tuple[str, str] | None:
    if local(n, "length", 1) and var(n.args[0]):
        return n.args[0].name, "count"
    if remote(n, "Enum", ("count", "sum", "min", "max"), 1) and var(n.args[0]):
        return n.args[0].name, n.name
    return None


def _binds(stmt: Node, name: str) -> bool:
    return local(stmt, "=", 2) and name in names_in(stmt.args[0])


@rule("NoRedundantListTraversal", "`{detail}` is traversed more than once in this block.")
def _(t: Tree) -> Found:
    def inline(n: Node) -> Iterator[tuple[str, str, int]]:
        if n.kind == "list" and n.args and n.args[0].kind == "tuple" and n.args[0].args[0:1] and atom(n.args[0].args[0], "do", "else", "catch", "rescue", "after"):
            return
        if (c := _traversal(n)) is not None:
            yield (*c, n.line)
        for x in [*n.args, *([n.body] if n.body is not None else [])]:
            yield from inline(x)

    for block in t.blocks:
        calls: dict[str, list[tuple[int, str, int]]] = {}
        for i, s in enumerate(block):
            bare = local(s, "=", 2) and var(s.args[0]) and _traversal(s.args[1])
            if bare:
                calls.setdefault(bare[0], []).append((i, bare[1], s.line))
            elif not (local(s, "=", 2) and var(s.args[0]) == "_"):
                for name, kind, line in inline(s):
                    calls.setdefault(name, []).append((i, kind, line))
        for name, found in calls.items():
            if len({k for _, k, _ in found}) >= 2:
                lo, hi = found[0][0], max(i for i, _, _ in found)
                if not any(_binds(s, name) for s in block[lo + 1 : hi + 1]):
                    yield min(found)[2], name


@rule("NoRepeatedEnumTraversal", "`{detail}` is traversed repeatedly: combine the traversals.", fixable=False)
def _(t: Tree) -> Found:
    seen: dict[str, list[Node]] = {}
    for n in t.remotes("Enum", ("count", "max", "min", "sum", "member?", "any?", "all?", "find", "find_value")):
        if n.args and var(n.args[0]):
            seen.setdefault(n.args[0].name, []).append(n)
    for name, calls in seen.items():
        if len(calls) > 1:
            for n in calls:
                yield n.line, name


@rule("NoEnumCountForLength", "`Enum.count/1` on a list: use `length/1`.")
def _(t: Tree) -> Found:
    for n in t.remotes("Enum", "count", 0, 1):
        if not n.args or not (n.args[0].kind == "fn" or local(n.args[0], "&")):
            yield n.line, ""


# -- sorting


def _top(n: Node) -> tuple[str, int] | None:
    """The name of what a pipeline sorts and how many of it the end takes."""
    s = steps(n)
    subject = s[0].args[0] if remote(s[0], "Enum", "sort", 1, 2) else None
    named = subject is not None and (var(subject) or local(subject, "&", 1) and subject.args[0].kind == "int" and f"&{subject.args[0].value}")
    if not named:
        return None
    for x in s[1:-1]:
        if not remote(x, "Enum", "reverse", 0):
            return None
    end = s[-1]
    if remote(end, "Enum", "take", 1) and end.args[0].kind == "int":
        return named, end.args[0].value
    if local(end, "hd", 0) or remote(end, "Enum", "at", 1) and end.args[0].kind == "int" and end.args[0].value == 0:
        return named, 1
    if remote(end, "Enum", "at", 1) and end.args[0].kind == "int" and end.args[0].value == 1:
        return named, 2
    return None


def _whole_pipelines(t: Tree) -> Iterator[Node]:
    inner = {id(n.args[0]) for n in t.pipes if pipe(n.args[0])}
    return (n for n in t.pipes if id(n) not in inner)


@rule("NoSortForTopK", "`{detail}` is sorted only for its first element: use `Enum.min/1` or `Enum.max/1`.")
def _(t: Tree) -> Found:
    for n in _whole_pipelines(t):
        top = _top(n)
        if top and top[1] == 1:
            yield n.line, top[0]


@rule("NoSortForTopKReduce", "`{detail}` is sorted only for a few elements: track them in one pass.", fixable=False)
def _(t: Tree) -> Found:
    for n in _whole_pipelines(t):
        top = _top(n)
        if top and top[1] > 1 and not top[0].startswith("&"):
            yield n.line, top[0]


@rule("NoSortThenAt", "A sort for one end of a list: use `Enum.min/1` or `Enum.max/1`.")
def _(t: Tree) -> Found:
    for call, feeder, rest, line, p in fed(t):
        if remote(call, "Enum", "at") and len(rest) == 1 and integer(rest[0]) in (0, -1) and remote(feeder, "Enum", "sort"):
            args = feeder.args
            if p is not None and pipe(p.args[0]) and len(args) < 1:
                known = None
            else:
                known = direction(args[1] if len(args) > 1 else None) if 1 <= len(args) <= 2 else None
            if known:
                yield line, ""


@rule("NoSortThenReverse", "A sort that is reversed: sort in the other direction.")
def _(t: Tree) -> Found:
    for call, feeder, rest, line, p in fed(t):
        if remote(call, "Enum", "reverse") and remote(feeder, "Enum", "sort") and (p is not None or not rest):
            args = feeder.args if p is not None and pipe(p.args[0]) else feeder.args[1:] if feeder.args else None
            if args is not None and len(args) < 2 and direction(args[0] if args else None):
                yield line, ""


@rule("NoDoubleSortSameList", "`{detail}` is sorted both ways: reverse the first result.")
def _(t: Tree) -> Found:
    sorts: dict[str, list[tuple[str, int]]] = {}
    for n in t.calls("=", 2):
        if not var(n.args[0]):
            continue
        right, source, given = n.args[1], None, None
        if remote(right, "Enum", "sort", 1, 2):
            source, given = var(right.args[0]), right.args[1:]
        elif pipe(right) and remote(right.args[1], "Enum", "sort", 0, 1):
            source, given = var(steps(right)[0]), right.args[1].args
        if source and (not given or atom(given[0], "asc", "desc")):
            sorts.setdefault(source, []).append((given[0].value if given else "asc", n.line))
    for source, found in sorts.items():
        if {d for d, _ in found} == {"asc", "desc"}:
            yield [line for d, line in found if d == "desc"][-1], source


@rule("PreferDescSortOverNegativeTake", "Taking from the end of a sort: sort descending and take from the front.")
def _(t: Tree) -> Found:
    for n in t.pipes:
        s = steps(n)
        plain = any(remote(x, "Enum", "sort", 0) or remote(x, "Enum", "sort", 1) and not (atom(x.args[0], "asc", "desc") or x.args[0].kind == "fn" or local(x.args[0], "&")) for x in s)
        if plain and any(remote(x, "Enum", "take", 1) and local(x.args[0], "-", 1) and x.args[0].args[0].kind == "int" for x in s):
            yield n.line, ""


@rule("NoIdentityFunctionInEnum", "`Enum.{detail}` with the identity: drop the `_by`.", priority=499)
def _(t: Tree) -> Found:
    def identity(n: Node) -> bool:
        f = lambda_(n)
        if f:
            return len(f[0]) == 1 and same_var(f[0][0], f[1])
        if local(n, "&", 1):
            x = n.args[0]
            if local(x, "&", 1):
                return integer(x.args[0]) == 1
            return local(x, "/", 2) and remote(x.args[0], "Function", "identity") and integer(x.args[1]) == 1
        return False

    names = ("uniq_by", "sort_by", "min_by", "max_by", "dedup_by")
    fed_by_pipe = {id(n.args[1]) for n in t.pipes}
    for n in t.remotes("Enum", names, 1, 2):
        if (len(n.args) == 2 or id(n) in fed_by_pipe) and identity(n.args[-1]):
            yield n.line, n.name


# -- slices


@rule("PreferEnumSlice", "`Enum.drop` then `Enum.take`: use `Enum.slice/3`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "take", 1):
            before = last_step(n.args[0])
            if remote(before, "Enum", "drop", 1 if pipe(n.args[0]) else 2):
                yield n.args[1].line, ""
        elif remote(n, "Enum", "take", 2) and remote(n.args[0], "Enum", "drop", 2):
            yield n.line, ""


def _negative(t: Tree, name: str) -> Found:
    for n in t.remotes("Enum", name, 1, 2):
        x = n.args[-1]
        if local(x, "-", 1) and x.args[0].kind == "int" and x.args[0].value > 0:
            yield n.line, str(x.args[0].value)


@rule("NoEnumTakeNegative", "`Enum.take` of -{detail} walks the list twice: use `Enum.slice/2`.")
def _(t: Tree) -> Found:
    return _negative(t, "take")


@rule("NoEnumDropNegative", "`Enum.drop` of -{detail} walks the list twice: use `Enum.slice/2`.")
def _(t: Tree) -> Found:
    return _negative(t, "drop")


@rule("NoTakeWhileLengthCheck", "`Enum.take_while` only to count: count with `Enum.reduce_while/3`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if pipe(n):
            if any(remote(a, "Enum", "take_while") and (local(b, "length", 0) or remote(b, "Enum", "count", 0)) for a, b in pairs_next(steps(n))):
                yield n.line, ""
        elif (local(n, "length", 1) or remote(n, "Enum", "count", 1)) and remote(n.args[0], "Enum", "take_while", 2):
            yield n.line, ""


# -- sets


@rule("NoMapAsSet", "A map with `{detail}` values: use a MapSet.", fixable=False)
def _(t: Tree) -> Found:
    return ((n.line, n.args[-1].value) for n in t.remotes("Map", "put", 2, 3) if atom(n.args[-1], "true", "false"))


#: Functions whose repetition over one list is reported.
NESTED_FUNCTIONS = ("map", "filter", "reduce", "count", "any?", "all?", "find", "find_value", "member?")


def _again(calls: Iterator[tuple[Node, Node]]) -> Found:
    seen: set[str] = set()
    for n, subject in calls:
        name = var(subject)
        if name:
            if name in seen:
                yield None, f"{n.name} on {name}"
            seen.add(name)


@rule("NoNestedEnumOnSameEnumerable", "Another traversal of the same list: Enum.{detail}.")
def _(t: Tree) -> Found:
    return _again((n, n.args[0]) for n in t.remotes("Enum", NESTED_FUNCTIONS) if n.args)


@rule("NoNestedEnumOnSameEnumerableUnfixable", "Another traversal of the same list, pipes included: Enum.{detail}.", fixable=False)
def _(t: Tree) -> Found:
    def desugared(n: Node, given: Node | None = None) -> Iterator[tuple[Node, Node]]:
        if pipe(n) and n.args[1].kind == "call":
            yield from desugared(n.args[1], n.args[0])
            return
        subject = given if given is not None else (n.args[0] if n.args else None)
        if remote(n, "Enum", NESTED_FUNCTIONS) and subject is not None:
            yield n, subject
        if n.target is not None:
            yield from desugared(n.target)
        if given is not None:
            yield from desugared(given)
        for x in n.args:
            yield from desugared(x)
        if n.body is not None:
            yield from desugared(n.body)

    return _again(desugared(t.root))


# -- maps


def _after_until(block: list[Node], i: int, *names: str) -> list[Node]:
    """Statements after the i-th up to the first that binds one of the names."""
    out = []
    for s in block[i + 1 :]:
        if any(_binds(s, n) for n in names):
            break
        out.append(s)
    return out


@rule("NoMapGetSentinel", "`{detail}` defaults to a negative number that is tested later: let it be nil.")
def _(t: Tree) -> Found:
    for block in t.blocks:
        for i, s in enumerate(block):
            if not (local(s, "=", 2) and var(s.args[0]) and remote(s.args[1], "Map", "get", 3)):
                continue
            name, sentinel = s.args[0].name, integer(s.args[1].args[2])
            if sentinel is None or sentinel >= 0:
                continue
            near = [x for y in _after_until(block, i, name) for x in y.walk() if x.kind == "call" and x.target is None and len(x.args) == 2]
            sides = lambda x: {var(x.args[0]), var(x.args[1])}
            equal = any(x.name in ("==", "!=", "===", "!==") and name in sides(x) and sentinel in (integer(x.args[0]), integer(x.args[1])) for x in near)
            if equal or any(x.name in ("<", ">", "<=", ">=") and name in sides(x) and sentinel not in (integer(x.args[0]), integer(x.args[1])) for x in near):
                yield s.line, name


@rule("NoMapKeysEnumLookup", "The keys of `{detail}` are looked up again: iterate its pairs.")
def _(t: Tree) -> Found:
    names = ("all?", "any?", "each", "map", "filter", "reject", "flat_map")

    def reads(fun: Node, name: str) -> bool:
        for x in fun.walk():
            if x.kind == "call" and x.flags == "access" and var(x.args[0]) == name:
                return True
            if remote(x, "Map", ("get", "fetch", "fetch!")) and x.args and var(x.args[0]) == name:
                return True
        return False

    def of(call: Node | None) -> str | None:
        return var(call.args[0]) if remote(call, "Map", "keys", 1) else None

    for n in t.nodes:
        if pipe(n):
            s = steps(n)
            name, step = of(s[0]), s[1]
            if not name and len(s) > 2 and var(s[0]) and remote(s[1], "Map", "keys", 0):
                name, step = s[0].name, s[2]
            if name and remote(step, "Enum", names, 1) and reads(step.args[0], name):
                yield n.line, name
        elif remote(n, "Enum", names) and len(n.args) >= 2 and (name := of(n.args[0])) and reads(n.args[1], name):
            yield n.line, name


#: Functions that can take a map's pairs in place of its keys or values, and functions that cannot.
OVER_PAIRS = (
    "all? any? count each map flat_map frequencies_by find_value reduce reduce_while max min max_by min_by sum product at find random empty? join filter reject "
    "sort sort_by uniq uniq_by dedup dedup_by take drop take_while drop_while reverse sample shuffle slice frequencies group_by take_every drop_every"
).split()
NOT_OVER_PAIRS = (
    "chunk_every chunk chunk_by chunk_while zip unzip zip_reduce zip_with split split_while split_with with_index min_max min_max_by scan flat_map_reduce map_reduce "
    "map_every intersperse tally member? find_index fetch fetch! reverse_slice slide into"
).split()


def _over_keys(t: Tree, good: Callable[[str, int], bool]) -> Found:
    for n in t.nodes:
        if pipe(n):
            call, feeder, rest = n.args[1], last_step(n.args[0]), n.args[1].args
        elif n.kind == "call" and n.args:
            call, feeder, rest = n, n.args[0], n.args[1:]
        else:
            continue
        if remote(call, "Enum", (call.name,)) and remote(feeder, "Map", ("keys", "values")) and good(call.name, len(rest)):
            yield n.line, f"Map.{feeder.name} to Enum.{call.name}"


@rule("NoMapKeysOrValuesForIteration", "An intermediate list from {detail}: iterate the map's pairs.")
def _(t: Tree) -> Found:
    return _over_keys(t, lambda f, n: f in OVER_PAIRS and not (f == "group_by" and n < 2))


@rule("NoMapKeysOrValuesForRawIteration", "An intermediate list from {detail}: iterate the map's pairs.", fixable=False)
def _(t: Tree) -> Found:
    return _over_keys(t, lambda f, n: f in NOT_OVER_PAIRS or f == "group_by" and n < 2)


@rule("NoMapUpdateThenFetch", "`{detail}` is updated and then read: compute the value once.")
def _(t: Tree) -> Found:
    updated = {n.args[0].name for n in t.calls("=", 2) if var(n.args[0]) and remote(n.args[1], "Map", ("update", "update!"))}
    for n in t.remotes("Map", ("fetch!", "get")):
        if n.args and var(n.args[0]) in updated:
            yield n.line, n.args[0].name


@rule("PreferMapFetchOverHasKey", "`Map.has_key?` before a lookup: match on `Map.fetch/2`.", fixable=False)
def _(t: Tree) -> Found:
    def asks(n: Node) -> bool:
        if local(n) and n.name in ("and", "or", "not"):
            return any(asks(x) for x in n.args)
        return remote(n, "Map", "has_key?")

    for n in t.nodes:
        if local(n, "if") and n.args and asks(n.args[0]):
            yield n.line, ""
        elif local(n, "cond", 1) and (body := keyed(n.args[0], "do")) is not None and any(c.kind == "clause" and len(c.args) == 1 and asks(c.args[0]) for c in body.args):
            yield n.line, ""


@rule("NoKeywordGetIntegerKey", "`Keyword.get` with an integer key: keyword keys are atoms.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.remotes("Keyword", "get", 1, 2) if integer(n.args[-1]) is not None)


# -- indexed access


def _midpoint(n: Node) -> bool:
    def half(x: Node, op: str) -> bool:
        return local(x, "div", 2) and local(x.args[0], op, 2) and integer(x.args[1]) == 2

    return half(n, "+") or local(n, "+", 2) and (half(n.args[1], "-") or half(n.args[0], "-"))


def _midpoints(t: Tree, recursive: bool) -> Found:
    for f in reversed(t.functions):
        if f.body is None or f.recursive != recursive:
            continue
        mids: set[str] = set()
        for n in f.body.walk():
            if local(n, "=", 2) and var(n.args[0]) and _midpoint(n.args[1]):
                mids.add(n.args[0].name)
            elif remote(n, "Enum", "at", 2) or pipe(n) and remote(n.args[1], "Enum", "at", 1):
                index = n.args[1] if not pipe(n) else n.args[1].args[0]
                if var(index) in mids or _midpoint(index):
                    yield n.line, ""


@rule("NoEnumAtBinarySearch", "Binary search over a list: each `Enum.at` walks it; use a tuple.", fixable=False)
def _(t: Tree) -> Found:
    return _midpoints(t, True)


@rule("NoEnumAtMidpointAccess", "`Enum.at` at a midpoint walks the list: use a tuple.")
def _(t: Tree) -> Found:
    return _midpoints(t, False)


def _once_a_line(found: Iterator[int]) -> Found:
    seen: set[int] = set()
    for line in found:
        if line not in seen:
            seen.add(line)
            yield line, ""


def _in_loops(t: Tree, funs: tuple[str, ...], wanted: Callable[[Node], bool]) -> Iterator[int]:
    for n in t.nodes:
        if local(n, "for") or remote(n, "Enum", funs):
            yield from (x.line for x in n.walk() if wanted(x))
    for f in t.functions:
        if f.recursive:
            yield from (x.line for x in f.body.walk() if wanted(x))


@rule("NoEnumAtInLoop", "`Enum.at` inside a loop walks the list each time.", fixable=False)
def _(t: Tree) -> Found:
    return _once_a_line(_in_loops(t, ("reduce", "reduce_while", "map", "flat_map", "each", "filter"), lambda x: remote(x, "Enum", "at")))


@rule("NoListDeleteAtInLoop", "`List.delete_at` inside a loop walks the list each time.", fixable=False)
def _(t: Tree) -> Found:
    return _once_a_line(_in_loops(t, ("reduce", "map", "flat_map", "each", "filter"), lambda x: remote(x, "List", "delete_at")))


@rule("NoEnumAtLoopAccess", "`Enum.at` with a computed index inside a loop.", fixable=False)
def _(t: Tree) -> Found:
    loops = ("map", "reduce", "each", "any?", "all?", "filter", "find", "flat_map")

    def visit(n: Node, depth: int) -> Found:
        if n.kind in ("call", "var") and n.target is None and n.name in ("for", "while") or remote(n, "Enum", loops):
            depth += 1
        elif depth and remote(n, "Enum", "at", 2) and n.args[1].kind != "int":
            yield n.line, ""
        for c in n.children():
            yield from visit(c, depth)

    return visit(t.root, 0)


@rule("NoEnumAtNegativeIndex", "`Enum.at` from the end ({detail}) walks the list: use `List.last/1` or reverse once.")
def _(t: Tree) -> Found:
    fed_by_pipe = {id(n.args[1]) for n in t.pipes}
    for n in t.remotes("Enum", "at", 1, 2):
        if (len(n.args) == 2 or id(n) in fed_by_pipe) and (i := integer(n.args[-1])) is not None and i < 0:
            yield n.line, str(i)


@rule("NoMultipleEnumAt", "Several `Enum.at` calls on `{detail}`: match its elements.")
def _(t: Tree) -> Found:
    seen: dict[str, list[int]] = {}
    for n in t.remotes("Enum", "at", 2):
        if var(n.args[0]) and integer(n.args[1]) is not None:
            seen.setdefault(n.args[0].name, []).append(n.line)
    for name in sorted(seen):
        if len(seen[name]) >= 3:
            yield min(seen[name]), name


@rule("NoLengthBasedIndexing", "`Enum.at` at a length minus a number: use a negative index.")
def _(t: Tree) -> Found:
    for block in t.blocks:
        for i, s in enumerate(block):
            if not (local(s, "=", 2) and var(s.args[0])):
                continue
            right = s.args[1]
            xs = var(right.args[0]) if local(right, "length", 1) or remote(right, "Enum", "count", 1) else None
            n = s.args[0].name
            if xs and any(
                remote(x, "Enum", "at", 2) and var(x.args[0]) == xs and local(x.args[1], "-", 2) and var(x.args[1].args[0]) == n and (integer(x.args[1].args[1]) or 0) > 0
                for y in _after_until(block, i, n, xs)
                for x in y.walk()
            ):
                yield s.line, ""


@rule("NoListToTupleForAccess", "`{detail}` is a tuple made of a list for `elem/2`: use `Enum.at/2`.")
def _(t: Tree) -> Found:
    def made(x: Node) -> bool:
        return remote(last_step(x), "List", "to_tuple")

    tuples = {n.args[0].name for n in t.calls("=", 2) if var(n.args[0]) and made(n.args[1])}
    seen: set[str] = set()
    for n in t.calls("elem", 2):
        name = var(n.args[0])
        if name in tuples and name not in seen:
            seen.add(name)
            yield n.line, name


# -- building lists


def _appends_one(n: Node | None) -> bool:
    return local(n, "++", 2) and n.args[1].kind == "list" and n.args[1].flags == "" and len(n.args[1].args) == 1 and not local(n.args[1].args[0], "|", 2)


def _appending_reduce(fun: Node) -> Node | None:
    f = lambda_(fun)
    end = last(f[1]) if f and len(f[0]) == 2 and var(f[0][1]) else None
    return end if _appends_one(end) and same_var(end.args[0], f[0][1]) else None


def _appending_recursion(f: Function) -> Node | None:
    end = last(f.body)
    if local(end, f.name):
        for a in end.args:
            if _appends_one(a) and any(same_var(a.args[0], p) for p in f.params or []):
                return a
    return None


@rule("NoListAppendInLoop", "`++` inside a loop copies the list each time: prepend and reverse.", fixable=False)
def _(t: Tree) -> Found:
    def inside(n: Node | None) -> Found:
        return ((x.line, "") for x in (n.walk() if n is not None else ()) if local(x, "++"))

    for n in t.nodes:
        if remote(n, "Enum", "reduce", 3):
            if not (empty_list(n.args[1]) and _appending_reduce(n.args[2]) is not None):
                yield from inside(n.args[2])
        elif local(n, "for") and n.args:
            yield from inside(keyed(n.args[-1], "do"))
        elif (f := function(n)) and f.params is not None and f.recursive and _appending_recursion(f) is None:
            yield from inside(f.body)


@rule("NoListAppendInRecursion", "An accumulator is appended to in recursion: prepend, and reverse at the end.")
def _(t: Tree) -> Found:
    for f in t.functions:
        if f.params is not None and f.recursive and (a := _appending_recursion(f)) is not None:
            yield a.line, ""


@rule("NoListAppendInReduce", "A reduce appends to its accumulator: prepend, and reverse at the end.")
def _(t: Tree) -> Found:
    for n in t.remotes("Enum", "reduce", 2, 3):
        if empty_list(n.args[-2]) and (a := _appending_reduce(n.args[-1])) is not None:
            yield a.line, ""


@rule("NoListFold", "`List.{detail}`: use `Enum.reduce/3`.")
def _(t: Tree) -> Found:
    return ((n.line, n.name) for n in t.remotes("List", ("foldl", "foldr")))


@rule("PreferEnumReverseTwo", "`Enum.reverse(a) ++ b`: use `Enum.reverse(a, b)`.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.calls("++", 2) if remote(n.args[0], "Enum", "reverse", 1))


@rule("NoDestructureReconstruct", "A list is taken apart and built again from {detail}: bind it whole.")
def _(t: Tree) -> Found:
    def names(p: Node) -> list[str] | None:
        if p.kind != "list" or p.flags or len(p.args) < 2:
            return None
        found = [var(x) for x in p.args]
        return found if all(x and not x.startswith("_") for x in found) else None

    def built(p: Node, body: Node | None) -> list[str] | None:
        want = names(p)
        return want if want and body is not None and any(names(x) == want for x in body.walk()) else None

    for n in t.nodes:
        if local(n, "case", 2) and (body := keyed(n.args[1], "do")) is not None and keys(n.args[1]) == ["do"]:
            for c in body.args:
                if c.kind == "clause" and len(c.args) == 1 and (found := built(c.args[0], c.body)):
                    yield c.line, ", ".join(found)
        elif f := function(n):
            for p in f.params or []:
                if found := built(p, n.args[1]):
                    yield None, ", ".join(found)


@rule("NoManualListLast", "`{detail}` finds a list's last element: use `List.last/1`.")
def _(t: Tree) -> Found:
    def single(f: Function) -> bool:
        p = f.params[0]
        return p.kind == "list" and len(p.args) == 1 and var(p.args[0]) is not None and f.body is not None and same_var(f.body, p.args[0])

    def walks(f: Function) -> bool:
        p = f.params[0]
        if not (p.kind == "list" and len(p.args) == 1 and local(p.args[0], "|", 2)):
            return False
        head, tail = p.args[0].args
        return (var(head) or "").startswith("_") and var(tail) is not None and local(f.body, f.name, 1) and same_var(f.body.args[0], tail)

    found = []
    for (name, arity), group in t.clauses.items():
        group = [f for f in group if f.guard is None]
        if arity == 1 and len(group) == 2:
            for a, b in (group, group[::-1]):
                if single(a) and walks(b):
                    found.append((a.line, name))
    yield from sorted(found)


@rule("NoEagerWithIndexInReduce", "`Enum.with_index` builds a list for a reduce: use `Stream.with_index/1`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if remote(n, "Enum", "reduce") and n.args and remote(n.args[0], "Enum", "with_index") or pipe(n) and remote(n.args[1], "Enum", "reduce") and remote(last_step(n.args[0]), "Enum", "with_index"):
            yield n.line, ""


# -- strings


@rule("AvoidGraphemesEnumCount", "Counting graphemes: use `String.length/1`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "count", 0) and remote(last_step(n.args[0]), "String", "graphemes") or remote(n, "Enum", "count", 1) and remote(n.args[0], "String", "graphemes"):
            yield n.line, ""


@rule("AvoidGraphemesLength", "The length of graphemes: use `String.length/1`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        step = n.args[1] if pipe(n) else None
        if step is not None and step.name == "length" and step.target is None and remote(last_step(n.args[0]), "String", "graphemes") or local(n, "length", 1) and remote(n.args[0], "String", "graphemes"):
            yield n.line, ""


@rule("NoGraphemePalindromeCheck", "Comparing graphemes with their reverse: compare the strings.")
def _(t: Tree) -> Found:
    split = {n.args[0].name for n in t.calls("=", 2) if var(n.args[0]) and remote(last_step(n.args[1]), "String", ("graphemes", "to_charlist"))}
    for n in t.calls("==", 2):
        for a, b in (n.args, n.args[::-1]):
            if var(a) in split and remote(b, "Enum", "reverse", 1) and same_var(a, b.args[0]):
                yield n.line, ""
                break


@rule("NoManualStringReverse", "Reversing graphemes: use `String.reverse/1`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "join") and pipe(n.args[0]) and remote(n.args[0].args[1], "Enum", "reverse") and remote(last_step(n.args[0].args[0]), "String", "graphemes"):
            yield n.line, ""
        elif remote(n, "Enum", "join", 1) and remote(n.args[0], "Enum", "reverse", 1) and remote(n.args[0].args[0], "String", "graphemes"):
            yield n.line, ""


@rule("NoIntegerToStringDigits", "Digits through a string: use `Integer.digits/1`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if remote(n, "String", "to_charlist", 1) and remote(n.args[0], "Integer", "to_string") or pipe(n) and remote(n.args[1], "String", "to_charlist") and remote(last_step(n.args[0]), "Integer", "to_string"):
            yield n.line, ""


@rule("NoSplitToCount", "Splitting a string only to count: count matches.", fixable=False)
def _(t: Tree) -> Found:
    for n in t.calls("-", 2):
        if integer(n.args[1]) == 1 and local(n.args[0], "length", 1) and remote(n.args[0].args[0], "String", "split", 2):
            yield n.line, ""


def _joins(fun: Node) -> bool:
    f = lambda_(fun)
    if not (f and len(f[0]) == 2 and local(f[1], "<>", 2)):
        return False
    acc = f[0][1].name
    left, right = f[1].args
    return f[0][0].kind in ("var", "call", "map", "struct", "bits") and acc is not None and left.name == acc and left.target is None and not mentions(right, acc)


@rule("NoStringConcatInLoop", "A reduce concatenates strings: use `Enum.join/1` or `Enum.map_join/3`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if remote(n, "Enum", "reduce", 3) and string(n.args[1], "") and _joins(n.args[2]):
            yield n.line, ""
        elif pipe(n) and remote(n.args[1], "Enum", "reduce", 2) and string(n.args[1].args[0], "") and _joins(n.args[1].args[1]):
            yield n.args[1].line, ""


@rule("NoStringConcatInLoopUnfixable", "`<>` inside a loop copies the string each time.", fixable=False, atom="no_string_concat_in_loop_complex")
def _(t: Tree) -> Found:
    def inside(n: Node) -> Iterator[int]:
        return (x.line for x in n.walk() if local(x, "<>"))

    def loops() -> Iterator[int]:
        for n in t.nodes:
            if remote(n, "Enum", "reduce_while", 3) or local(n, "for"):
                yield from inside(n)
            elif remote(n, "Enum", "reduce", 3):
                if not (string(n.args[1], "") and _joins(n.args[2])):
                    yield from inside(n)
            elif pipe(n) and remote(n.args[1], "Enum", "reduce_while"):
                yield from inside(n.args[1])
            elif pipe(n) and remote(n.args[1], "Enum", "reduce"):
                call = n.args[1]
                if not (len(call.args) == 2 and string(call.args[0], "") and _joins(call.args[1])):
                    yield from inside(call)
        for f in t.functions:
            if f.params is not None and f.recursive:
                yield from inside(f.body)

    return _once_a_line(loops())


@rule("NoStringLengthForCharCheck", "A string's length against 1: match one grapheme.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if local(n) and n.name in ("==", "!=", "===", "!==") and len(n.args) == 2:
            for a, b in (n.args, n.args[::-1]):
                if remote(a, "String", "length", 1) and integer(b) == 1:
                    yield n.line, ""
                    break


@rule("NoRedundantEnumJoinSeparator", "An empty separator is the default.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if remote(n, "Enum", "join", 1, 2) and string(n.args[-1], "") or remote(n, "Enum", "map_join", 2, 3) and string(n.args[-2], ""):
            yield n.line, ""


@rule("UseMapJoin", "`Enum.map` then `Enum.join`: use `Enum.map_join/3`.")
def _(t: Tree) -> Found:
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "join") and remote(last_step(n.args[0]), "Enum", "map") or remote(n, "Enum", "join") and n.args and remote(n.args[0], "Enum", "map"):
            yield n.line, ""


def _sliding(n: Node) -> bool:
    return remote(n, "Enum", "chunk_every", 2, 3) and integer(n.args[1]) == 1 and (len(n.args) == 2 or atom(n.args[2], "discard"))


def _maps_join(n: Node) -> bool:
    return remote(n, "Enum", "map", 1) and any(remote(x, "Enum", "join") for x in n.args[0].walk())


@rule("UnnecessaryGraphemeChunking", "Sliding over graphemes: slice the string.")
def _(t: Tree) -> Found:
    for n in t.pipes:
        s = steps(n)
        if len(s) >= 4 and remote(s[-3], "String", "graphemes") and _sliding(s[-2]) and _maps_join(s[-1]):
            yield n.line, ""


@rule("UnnecessaryGraphemeChunkingUnfixable", "Chunking graphemes to map over them: slice the string.", fixable=False, atom="unnecessary_grapheme_chunking")
def _(t: Tree) -> Found:
    for n in t.pipes:
        s = steps(n)
        broad = any(remote(x, "String", ("graphemes", "codepoints")) for x in s) and any(remote(x, "Enum", ("chunk_every", "chunk_by", "split")) for x in s) and any(remote(x, "Enum", "map") for x in s)
        if broad:
            at = [next((i for i, x in enumerate(s) if test(x)), None) for test in (lambda x: remote(x, "String", "graphemes"), _sliding, _maps_join)]
            if None in at or not at[0] < at[1] < at[2]:
                yield n.line, ""


@rule("NoPipedRegexReplace", "`Regex.replace` takes the regex first: pipe into `String.replace/3`.", priority=50)
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.pipes if remote(n.args[1], "Regex", "replace"))


@rule("NoRedundantBinarySyntax", "A string inside `<<>>` is already a binary.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.nodes if n.kind == "bits" and len(n.args) == 1 and string(n.args[0]))


# -- lengths and guards

_MIRROR = {"==": "==", "!=": "!=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


@rule("NoLengthComparisonForEmpty", "A list's length against a small number: match its shape.")
def _(t: Tree) -> Found:
    most = 5
    for n in t.nodes:
        if not (local(n) and n.name in _MIRROR and len(n.args) == 2):
            continue
        a, b = n.args
        op, size, k = (n.name, a, b) if local(a, "length", 1) and b.kind == "int" else (_MIRROR[n.name], b, a)
        if local(size, "length", 1) and k.kind == "int" and var(size.args[0]):
            lo = 1 if op in (">=", "<") else 0
            hi = most - 1 if op in (">", "<=") else most
            if lo <= k.value <= hi:
                yield n.line, ""


def _owned_length(n: Node) -> bool:
    """Comparisons of a length in a guard that a pattern in the head can express."""
    if local(n, ">", 2) and local(n.args[0], "length", 1) and integer(n.args[1]) == 0:
        return True
    return local(n, "==", 2) and local(n.args[0], "length", 1) and n.args[1].kind == "int" and 1 <= n.args[1].value <= 5


def _guarded(t: Tree) -> Iterator[tuple[Node, Node, Node]]:
    """(definition, when, guard) of every def and defp with a guard."""
    for n in t.nodes:
        if local(n) and n.name in ("def", "defp") and n.args and local(n.args[0], "when", 2):
            yield n, n.args[0], n.args[0].args[1]


@rule("NoLengthGuardToPattern", "A guard on a list's length: match the list in the head.")
def _(t: Tree) -> Found:
    for n, _when, guard in _guarded(t):
        for x in guard.walk():
            if _owned_length(x):
                yield x.line or n.line, ""


@rule("NoLengthInGuard", "`length/1` in a guard walks the list on every call.", fixable=False)
def _(t: Tree) -> Found:
    def visit(n: Node) -> Found:
        if _owned_length(n):
            return
        if local(n, "length", 1):
            yield n.line, ""
        for c in n.children():
            yield from visit(c)

    for _n, _when, guard in _guarded(t):
        yield from visit(guard)


@rule("HallucinatedGuard", "There is no guard `{detail}`.")
def _(t: Tree) -> Found:
    names = ("is_pos_integer", "is_non_neg_integer", "is_neg_integer", "is_non_pos_integer")
    return ((n.line, n.name) for n in t.nodes if local(n, None, 1) and n.name in names)


@rule("NoGuardEqualityForPatternMatch", "A guard compares {detail} with a literal: match it in the head.")
def _(t: Tree) -> Found:
    def parts(g: Node) -> Iterator[Node]:
        if local(g) and g.name in ("and", "or") and len(g.args) == 2:
            for x in g.args:
                yield from parts(x)
        else:
            yield g

    for _n, when, guard in _guarded(t):
        params = {var(p) for p in when.args[0].args} - {None}
        for g in parts(guard):
            if local(g, "==", 2):
                for a, b in (g.args, g.args[::-1]):
                    if var(a) in params and b.kind in ("int", "atom", "str"):
                        yield g.line, a.name
                        break


@rule("NoIsNilGuard", "An `is_nil` guard on a parameter: match `nil` in the head.")
def _(t: Tree) -> Found:
    def asks(g: Node, params: set) -> bool:
        if local(g, "and", 2):
            return any(asks(x, params) for x in g.args)
        return local(g, "is_nil", 1) and var(g.args[0]) in params

    for n, when, guard in _guarded(t):
        params = {var(p) for p in when.args[0].args} - {None}
        if params and asks(guard, params):
            yield n.line, ""


@rule("RedundantListGuard", "`{detail}` is a list by its pattern: drop the guard.")
def _(t: Tree) -> Found:
    for f in t.functions:
        if f.guard is None:
            continue
        tails = {x.args[1].name for p in f.params or [] for x in p.walk() if local(x, "|", 2) and var(x.args[1])}
        asked = dict.fromkeys(x.args[0].name for x in f.guard.walk() if local(x, "is_list", 1) and var(x.args[0]) in tails)
        for name in reversed(asked):
            yield f.when.line, name


@rule("NoRedundantNegatedGuard", "The clause before already takes the equal case: drop the guard.")
def _(t: Tree) -> Found:
    def compare(g: Node | None, ops: tuple[str, str]) -> list[Node] | None:
        return g.args if local(g) and g.name in ops and len(g.args) == 2 else None

    found = []
    for group in t.clauses.values():
        for a, b in pairs_next(group):
            p, q = compare(a.guard, ("==", "===")), compare(b.guard, ("!=", "!=="))
            if p and q and same_var(p[0], q[0]) and same_var(p[1], q[1]):
                found.append((b.line, ""))
    yield from sorted(found)


# -- control flow


@rule("NoCaseTrueFalse", "A case on a boolean: use `if`.")
def _(t: Tree) -> Found:
    for n in t.calls("case", 2):
        body = keyed(n.args[1], "do")
        if n.args[0].kind == "var" or body is None or keys(n.args[1]) != ["do"] or len(body.args) != 2 or body.flags != "clauses":
            continue
        kinds = [("_" if var(c.args[0]) == "_" else c.args[0].value if atom(c.args[0], "true", "false") else "") if len(c.args) == 1 else "" for c in body.args]
        if "" not in kinds and kinds[0] != kinds[1]:
            yield n.line, ""


@rule("NoCondTwoClauses", "A cond of two clauses: use `if`.")
def _(t: Tree) -> Found:
    for n in t.calls("cond", 1):
        body = keyed(n.args[0], "do")
        if body is not None and body.flags == "clauses" and len(body.args) == 2 and len(body.args[1].args) == 1 and atom(body.args[1].args[0], "true"):
            yield n.line, ""


@rule("NoUnlessElse", "`unless` with `else`: use `if`.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.calls("unless", 2) if keyed(n.args[1], "else") is not None)


@rule("NoAnonFnApplicationInPipe", "A function literal is called in a pipe: use `then/2`.")
def _(t: Tree) -> Found:
    return ((n.line, "") for n in t.pipes if n.args[1].kind == "call" and n.args[1].flags == "anon" and n.args[1].target.kind == "fn" and not n.args[1].args)


@rule("NoKernelOpInPipeline", "`Kernel.{detail}` in a pipe: write the operator.")
def _(t: Tree) -> Found:
    ops = ("==", "!=", "===", "!==", "<", ">", "<=", ">=", "and", "or")
    return ((n.args[1].line, n.args[1].name) for n in t.pipes if remote(n.args[1], "Kernel", ops, 1))


@rule("NoRedundantAssignment", "A value is bound only to be returned.")
def _(t: Tree) -> Found:
    def plain(p: Node) -> bool:
        if p.kind == "var":
            return p.name != "_"
        if p.kind == "tuple" or p.kind == "list" and p.args:
            return all(plain(x) for x in p.args)
        return local(p, "|", 2) and all(plain(x) for x in p.args)

    for block in t.blocks:
        if len(block) >= 2 and local(block[-2], "=", 2) and plain(block[-2].args[0]) and same(block[-2].args[0], block[-1]):
            yield block[-2].line, ""


@rule("NoParamRebinding", "The parameter `{detail}` is bound again.")
def _(t: Tree) -> Found:
    def bound(ns: list[Node]) -> set[str]:
        return {x for n in ns for x in names_in(n) if not x.startswith("_")}

    for n in t.nodes:
        if n.kind != "fn":
            continue
        for c in n.args:
            params = bound(c.args)
            for x in c.body.walk() if params else ():
                if local(x, "=", 2) and (again := bound([x.args[0]]) & params):
                    yield x.line, sorted(again)[0]


# -- functions and names


@rule("InconsistentParamNames", "A parameter has several names over the clauses: {detail}.")
def _(t: Tree) -> Found:
    found = []
    for (name, arity), group in t.clauses.items():
        if len(group) < 2:
            continue
        for i in range(arity):
            bases = [(var(f.params[i]) or "").lstrip("_") for f in group]
            if all(bases) and len(set(bases)) > 1:
                found.append((group[0].line, f"{name}/{arity} at {i + 1}: {', '.join(dict.fromkeys(bases))}"))
    yield from sorted(found, key=lambda x: x[0])


#: Guards whose names begin with is_.
TYPE_GUARDS = (
    "is_atom is_binary is_bitstring is_boolean is_exception is_float is_function is_integer is_list is_map is_map_key is_nil is_number is_pid is_port is_reference is_struct is_tuple"
).split()


@rule("NoIsPrefixForNonGuard", "`{detail}`: the `is_` prefix is for guards; end the name with `?`.")
def _(t: Tree) -> Found:
    seen: set = set()
    for f in t.functions:
        if f.params is not None and f.name.startswith("is_") and not f.name.endswith("?") and f.name not in TYPE_GUARDS:
            key = (f.line, f.kind, f.name, len(f.params))
            if key not in seen:
                seen.add(key)
                yield f.line, f"{f.kind} {f.name}/{len(f.params)}"


@rule("NoUnderscoreFunctionName", "`{detail}`: a name that begins with `_` reads as unused.")
def _(t: Tree) -> Found:
    seen: set[str] = set()
    for f in t.functions:
        if f.params is not None and f.name.startswith("_") and not f.name.startswith("__") and f.name not in seen:
            seen.add(f.name)
            yield f.line, f"{f.kind} {f.name}/{len(f.params)}"


#: Functions that need no import, whose names are poor variables.
KERNEL_NAMES = "max min elem hd tl length abs round trunc div rem tuple_size map_size byte_size bit_size".split()


@rule("NoKernelShadowing", "The variable `{detail}` hides a built-in function.")
def _(t: Tree) -> Found:
    def hidden(ns: list[Node]) -> Found:
        for n in ns:
            for x in n.walk():
                if x.kind == "var" and x.name in KERNEL_NAMES:
                    yield x.line, x.name

    for n in t.nodes:
        if local(n, "=", 2):
            yield from hidden([n.args[0]])
        elif n.kind == "fn":
            for c in n.args:
                yield from hidden(c.args)
        elif local(n) and n.name in ("def", "defp") and len(n.args) == 2 and n.args[0].kind == "call":
            yield from hidden(n.args[0].args)


@rule("NonGroupedClauses", "Clauses of `{detail}` stand apart.")
def _(t: Tree) -> Found:
    for n in t.calls("defmodule", 2):
        before, seen, told = None, set(), set()
        for s in statements(keyed(n.args[1], "do")):
            f = function(s)
            key = (f.name, len(f.params)) if f and f.params is not None else None
            if key and key != before:
                if key in seen and key not in told:
                    told.add(key)
                    yield s.line, f"{key[0]}/{key[1]}"
                seen.add(key)
            before = key


@rule("NoUnnecessaryCatchAllRaise", "`{detail}` only raises for what matches no clause.")
def _(t: Tree) -> Found:
    for f in t.functions:
        if f.guard is None and f.params and all((var(p) or "").startswith("_") for p in f.params) and local(f.body, "raise"):
            yield f.line, f"{f.name}/{len(f.params)}"


@rule("NoDocFalseOnPrivate", "`@doc false` before a private function.")
def _(t: Tree) -> Found:
    for block in t.blocks:
        for a, b in pairs_next(block):
            if local(a, "@", 1) and local(a.args[0], "doc", 1) and atom(a.args[0].args[0], "false") and local(b, "defp"):
                yield a.line, ""


# -- documentation and directives


def _docs(t: Tree) -> Iterator[tuple[Node, str, str]]:
    """Documentation attributes with a plain string that is not a heredoc on its line."""
    for n in t.calls("@", 1):
        a = n.args[0]
        if local(a, None, 1) and a.name in ("doc", "moduledoc", "typedoc") and string(a.args[0]):
            line = t.lines[n.line - 1] if n.line <= len(t.lines) else ""
            if '"""' not in line:
                yield n, a.name, a.args[0].value


@rule("NoTrailingNewlineInDoc", "The text of @{detail} ends in a newline.")
def _(t: Tree) -> Found:
    return ((n.line, name) for n, name, text in _docs(t) if text.endswith("\n") and "\n" not in text.rstrip("\n"))


@rule("PreferHeredocForMultiLineDoc", "@{detail} has several lines: use a heredoc.", priority=501)
def _(t: Tree) -> Found:
    return ((n.line, name) for n, name, text in _docs(t) if "\n" in text.rstrip("\n"))


#: Macros of the logger.
LOGGER_MACROS = "emergency alert critical error warning warn notice info debug log".split()


@rule("NoMissingRequireLogger", "Logger macros need `require Logger`.")
def _(t: Tree) -> Found:
    def logs(n: Node) -> bool:
        if local(n, "defmodule"):
            return False
        return remote(n, "Logger", LOGGER_MACROS) or any(logs(c) for c in n.children())

    for n in t.calls("defmodule", 2):
        body = keyed(n.args[1], "do")
        top = statements(body)
        has = any(local(s) and s.name in ("require", "import", "use") and s.args and s.args[0].kind == "alias" and s.args[0].name == "Logger" for s in top)
        if any(logs(s) for s in top) and not has:
            yield n.line, ""


# -- numbers


def _no_ops(t: Tree, bare: bool) -> Found:
    for n in t.nodes:
        if not (local(n) and n.name in ("*", "/", "+", "-") and len(n.args) == 2):
            continue
        a, b = n.args
        one = {"*": 1.0, "/": 1.0, "+": 0.0, "-": 0.0}[n.name]
        if b.kind == "float":
            x = a if b.value == one else None
        else:
            x = b if n.name in ("*", "+") and a.kind == "float" and a.value == one else None
        if x is not None and (x.kind == "var") == bare:
            yield n.line, n.name


@rule("NoIdentityFloatCoercion", "`{detail}` with a neutral float only coerces.")
def _(t: Tree) -> Found:
    return _no_ops(t, False)


@rule("PreferErlangFloat", "`{detail}` with a neutral float: use `:erlang.float/1`.", priority=499)
def _(t: Tree) -> Found:
    return _no_ops(t, True)


RULES.sort(key=lambda r: (r.priority, r.module))
