"""What the fixable idiom rules write: edits of spans, so everything else in a source stays as it is.

A rewrite takes a ``Tree`` and yields (start, end, text).  Edits that overlap an earlier one wait for the next pass; a
rule is applied until it finds nothing more to do.  Where a literal reading of an idiom would change what the code
means (a seed or a key that would be lost, a key callback that would get the value), the rewrite keeps the meaning or
leaves the code alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from loomlint.functions.elixir import Node
from loomlint.functions.tree import Tree, atom, direction, function, integer, keyed, keys, lambda_, last_step, local, names_in, pairs_next, pipe, remote, same_var, statements, steps, string, var
from loomlint.plans import patterns as p

Edit = tuple[int, int, str]
REWRITES: dict[str, Callable[[Tree], Iterator[Edit]]] = {}


def rewrite(*modules: str):
    def add(f):
        for m in modules:
            REWRITES[m] = f
        return f

    return add


def whole(n: Node, text: str) -> Edit:
    return n.start, n.end, text


def subject_of(t: Tree, n: Node, text: Callable[[str], str], piped: str) -> Edit:
    """Replace a call: nested form from its subject's text, or the last step of a pipe."""
    return whole(n.args[1], piped) if pipe(n) else whole(n, text(t.text(n.args[0])))


def since(t: Tree, n: Node, k: int, step: str, direct: Callable[[str], str]) -> Edit:
    """Replace the last k steps of a pipeline by one; if they are all of it, by a direct call on the first's subject."""
    s = steps(n)
    if len(s) > k:
        return s[-k].start, n.end, step
    return whole(n, direct(t.text(s[0].args[0])))


def call_of(t: Tree, f: Node, *args: str) -> str:
    """A function value applied to arguments."""
    return f"({t.text(f)}).({', '.join(args)})" if f.kind in ("fn", "call") else f"{t.text(f)}.({', '.join(args)})"


@rewrite("NoExplicitMaxReduce", "NoExplicitMinReduce")
def _(t):
    for n in t.remotes("Enum", "reduce", 3):
        f = lambda_(n.args[2])
        if not f or len(f[0]) != 2 or not all(map(var, f[0])):
            continue
        want = {var(x) for x in f[0]}
        for name, ops in (("max", (">", ">=")), ("min", ("<", "<="))):
            if p._picks(f[1], name, ops) and {var(x) for x in (f[1].args if local(f[1], name, 2) else f[1].args[0].args)} == want:
                yield whole(n, f"Enum.{name}({t.text(n.args[0])})")


@rewrite("NoExplicitSumReduce")
def _(t):
    lines = {line for line, _ in p_check("NoExplicitSumReduce")(t)}
    for n in t.remotes("Enum", "reduce", 3):
        if n.line in lines and integer(n.args[1]) == 0:
            yield whole(n, f"Enum.sum({t.text(n.args[0])})")


def p_check(module: str):
    return next(r.check for r in p.RULES if r.module == module)


@rewrite("NoManualFrequencies")
def _(t):
    for n in t.nodes:
        call = n.args[1] if pipe(n) else n
        if not remote(call, "Enum", "reduce", 2 if pipe(n) else 3) or not (call.args[-2].kind == "map" and not call.args[-2].args):
            continue
        f = lambda_(call.args[-1])
        if f and len(f[0]) == 2 and remote(f[1], "Map", "update", 4) and integer(f[1].args[2]) == 1 and same_var(f[1].args[0], f[0][1]):
            key = f[1].args[1]
            by = "" if same_var(key, f[0][0]) else f"fn {t.text(f[0][0])} -> {t.text(key)} end"
            name = "frequencies_by" if by else "frequencies"
            yield subject_of(t, n, lambda x, name=name, by=by: f"Enum.{name}({x}{', ' + by if by else ''})", f"Enum.{name}({by})")


@rewrite("NoManualMax", "NoManualMin")
def _(t):
    for name, module in (("max", "NoManualMax"), ("min", "NoManualMin")):
        lines = {line for line, _ in p_check(module)(t)}
        for n in t.calls("if", 2):
            if n.line in lines and (b := p._branches(n)):
                yield whole(n, f"{name}({t.text(b[0])}, {t.text(b[1])})")


@rewrite("NoMapThenAggregate")
def _(t):
    for n in t.nodes:
        if pipe(n):
            for a, b in pairs_next(steps(n)):
                if remote(a, "Enum", "map", 1, 2) and remote(b, "Enum", ("max", "min", "sum"), 0):
                    yield a.start, a.start + len("Enum"), "Stream"
        elif remote(n, "Enum", ("max", "min", "sum"), 1) and remote(n.args[0], "Enum", "map", 2):
            yield n.args[0].start, n.args[0].start + len("Enum"), "Stream"


def rename(n: Node, new: str) -> Edit:
    """Another name for a remote call, its arguments as they are."""
    return n.start, n.start + len(f"{n.target.name}.{n.name}"), new


@rewrite("NoEnumCountForLength")
def _(t):
    for n in t.remotes("Enum", "count", 0, 1):
        if not n.args or not (n.args[0].kind == "fn" or local(n.args[0], "&")):
            yield rename(n, "length")


@rewrite("NoSortForTopK")
def _(t):
    for n in p._whole_pipelines(t):
        s, top = steps(n), p._top(n)
        if top and top[1] == 1 and len(s[0].args) == 1:
            name = "max" if sum(remote(x, "Enum", "reverse") for x in s) % 2 else "min"
            yield whole(n, f"Enum.{name}({t.text(s[0].args[0])})")


@rewrite("NoSortThenAt")
def _(t):
    for call, feeder, rest, _line, at in p.fed(t):
        if remote(call, "Enum", "at") and len(rest) == 1 and integer(rest[0]) in (0, -1) and remote(feeder, "Enum", "sort", 1, 2):
            order = direction(feeder.args[1] if len(feeder.args) > 1 else None)
            if order and not (at is not None and pipe(at.args[0])):
                name = "min" if (order == "asc") == (integer(rest[0]) == 0) else "max"
                yield whole(at if at is not None else call, f"Enum.{name}({t.text(feeder.args[0])})")


@rewrite("NoSortThenReverse")
def _(t):
    for call, feeder, _rest, _line, at in p.fed(t):
        if remote(call, "Enum", "reverse") and remote(feeder, "Enum", "sort"):
            piped = at is not None and pipe(at.args[0])
            args = feeder.args if piped else feeder.args[1:]
            if len(args) < 2 and (order := direction(args[0] if args else None)):
                new = ":asc" if order == "desc" else ":desc"
                if piped:
                    yield feeder.start, at.end, f"Enum.sort({new})"
                else:
                    yield whole(at if at is not None else call, f"Enum.sort({t.text(feeder.args[0])}, {new})")


@rewrite("PreferDescSortOverNegativeTake")
def _(t):
    for n in t.pipes:
        a, b = last_step(n.args[0]), n.args[1]
        if pipe(n.args[0]) and remote(a, "Enum", "sort", 0) and remote(b, "Enum", "take", 1) and (k := integer(b.args[0])) is not None and k < 0:
            yield a.start, b.end, f"Enum.sort(:desc) |> Enum.take({-k})"


@rewrite("NoIdentityFunctionInEnum")
def _(t):
    lines = {(line, name) for line, name in p_check("NoIdentityFunctionInEnum")(t)}
    for n in t.remotes("Enum", ("uniq_by", "sort_by", "min_by", "max_by", "dedup_by"), 1, 2):
        if (n.line, n.name) in lines:
            yield whole(n, f"Enum.{n.name[:-3]}({t.text(n.args[0]) if len(n.args) == 2 else ''})")


@rewrite("PreferEnumSlice")
def _(t):
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "take", 1):
            a, b = last_step(n.args[0]), t.text(n.args[1].args[0])
            if pipe(n.args[0]) and remote(a, "Enum", "drop", 1):
                yield a.start, n.end, f"Enum.slice({t.text(a.args[0])}, {b})"
            elif not pipe(n.args[0]) and remote(a, "Enum", "drop", 2):
                yield whole(n, f"Enum.slice({t.text(a.args[0])}, {t.text(a.args[1])}, {b})")
        elif remote(n, "Enum", "take", 2) and remote(n.args[0], "Enum", "drop", 2):
            a = n.args[0]
            yield whole(n, f"Enum.slice({t.text(a.args[0])}, {t.text(a.args[1])}, {t.text(n.args[1])})")


@rewrite("NoEnumTakeNegative", "NoEnumDropNegative")
def _(t):
    for n in t.remotes("Enum", ("take", "drop"), 1, 2):
        k = integer(n.args[-1])
        if k is not None and k < 0:
            span = f"{k}..-1//1" if n.name == "take" else f"0..{k - 1}//1"
            first = f"{t.text(n.args[0])}, " if len(n.args) == 2 else ""
            yield whole(n, f"Enum.slice({first}{span})")


@rewrite("NoTakeWhileLengthCheck")
def _(t):
    def counter(f: Node) -> str:
        got = lambda_(f)
        item, test = (t.text(got[0][0]), t.text(got[1])) if got and len(got[0]) == 1 else ("item", call_of(t, f, "item"))
        return f"0, fn {item}, count -> if {test}, do: {{:cont, count + 1}}, else: {{:halt, count}} end"

    for n in t.nodes:
        if pipe(n) and (local(n.args[1], "length", 0) or remote(n.args[1], "Enum", "count", 0)):
            a = last_step(n.args[0])
            if remote(a, "Enum", "take_while", 1) and pipe(n.args[0]):
                yield a.start, n.end, f"Enum.reduce_while({counter(a.args[0])})"
            elif remote(a, "Enum", "take_while", 2):
                yield whole(n, f"Enum.reduce_while({t.text(a.args[0])}, {counter(a.args[1])})")
        elif (local(n, "length", 1) or remote(n, "Enum", "count", 1)) and remote(n.args[0], "Enum", "take_while", 2):
            a = n.args[0]
            yield whole(n, f"Enum.reduce_while({t.text(a.args[0])}, {counter(a.args[1])})")


@rewrite("NoMapGetSentinel")
def _(t):
    for block in t.blocks:
        for i, s in enumerate(block):
            if not (local(s, "=", 2) and var(s.args[0]) and remote(s.args[1], "Map", "get", 3)):
                continue
            name, get = s.args[0].name, s.args[1]
            sentinel = integer(get.args[2])
            if sentinel is None or sentinel >= 0:
                continue
            near = [x for y in p._after_until(block, i, name) for x in y.walk() if local(x) and len(x.args) == 2 and name in (var(x.args[0]), var(x.args[1]))]
            equal = [x for x in near if x.name in ("==", "!=", "===", "!==") and sentinel in (integer(x.args[0]), integer(x.args[1]))]
            order = [x for x in near if x.name in ("<", ">", "<=", ">=") and sentinel not in (integer(x.args[0]), integer(x.args[1]))]
            if equal or order:
                yield whole(get, f"Map.get({t.text(get.args[0])}, {t.text(get.args[1])})")
                for x in equal:
                    number = x.args[0] if integer(x.args[0]) == sentinel else x.args[1]
                    yield whole(number, "nil")
                for x in [] if equal else order:
                    yield whole(x, f"({name} != nil and {t.text(x)})")


#: How functions over keys or values become functions over pairs: the callback's place counted from the end, and what
#: is left to pick from the result ("" nothing, "map" from each element).
_CALLBACKS = {
    "all?": "", "any?": "", "each": "", "map": "", "flat_map": "", "frequencies_by": "", "find_value": "", "count": "", "filter": "map", "reject": "map", "take_while": "map", "drop_while": "map",
    "uniq_by": "map", "dedup_by": "map", "sort_by": "map",
}
_PLAIN = {"empty?": "", "take": "map", "drop": "map", "reverse": "map", "sample": "map", "shuffle": "map", "slice": "map", "take_every": "map", "drop_every": "map"}


@rewrite("NoMapKeysOrValuesForIteration")
def _(t):
    for n in t.nodes:
        call = n.args[1] if pipe(n) else n
        if call.kind != "call" or not remote(call, "Enum", (call.name,)) or not pipe(n) and not call.args:
            continue
        feeder, rest = (last_step(n.args[0]), call.args) if pipe(n) else (call.args[0], call.args[1:])
        if not remote(feeder, "Map", ("keys", "values")):
            continue
        if pipe(n) and pipe(n.args[0]):
            source = t.text(n.args[0].args[0])
        elif len(feeder.args) == 1:
            source = t.text(feeder.args[0])
        else:
            continue
        ours = (lambda x: f"{{{x}, _value}}") if feeder.name == "keys" else (lambda x: f"{{_key, {x}}}")
        pick = f"fn {ours('x')} -> x end"
        name, args = call.name, None
        if name in _CALLBACKS and len(rest) == 1:
            f = rest[0]
            got = lambda_(f)
            if got and len(got[0]) == 1 and not local(got[0][0], "when"):
                args = f"fn {ours(t.text(got[0][0]))} -> {t.text(got[1])} end"
            elif local(f, "&") or f.kind == "var":
                args = f"fn {ours('x')} -> {call_of(t, f, 'x')} end"
            after = _CALLBACKS[name]
        elif name == "count" and not rest:
            args, after = "", ""
        elif name in _PLAIN:
            args, after = ", ".join(map(t.text, rest)), _PLAIN[name]
        elif name in ("sort", "uniq", "dedup") and not rest:
            name, args, after = f"{name}_by", pick, "map"
        elif name == "frequencies" and not rest:
            name, args, after = "frequencies_by", pick, ""
        elif name == "join":
            name, args, after = "map_join", ", ".join([*map(t.text, rest), pick]), ""
        elif name in ("sum", "product") and not rest:
            name, args, after = "reduce", f"{int(name == 'product')}, fn {ours('x')}, acc -> acc {'*' if name == 'product' else '+'} x end", ""
        elif name in ("max", "min") and not rest:
            name, args, after = f"{name}_by", pick, "elem"
        if args is None:
            continue
        text = f"Enum.{name}({source}{', ' if args else ''}{args})"
        if after == "map":
            text += f" |> Enum.map({pick})"
        elif after == "elem":
            text = f"elem({text}, {0 if feeder.name == 'keys' else 1})"
        yield whole(n, text)


@rewrite("NoMapKeysEnumLookup")
def _(t):
    for n in t.nodes:
        call = n.args[1] if pipe(n) else n
        feeder = last_step(n.args[0]) if pipe(n) else (call.args[0] if call.kind == "call" and call.args else None)
        if not remote(call, "Enum", ("all?", "any?", "each", "map", "flat_map")):
            continue
        if remote(feeder, "Map", "keys", 1) and var(feeder.args[0]) and not (pipe(n) and pipe(n.args[0])):
            name = feeder.args[0].name
        elif pipe(n) and pipe(n.args[0]) and remote(feeder, "Map", "keys", 0) and var(n.args[0].args[0]):
            name = n.args[0].args[0].name
        else:
            continue
        f = lambda_(call.args[-1])
        if not f or len(f[0]) != 1 or not var(f[0][0]):
            continue
        key, body = f[0][0].name, f[1]
        text, at = [], body.start
        for x in body.walk():
            access = x.kind == "call" and x.flags == "access" and var(x.args[0]) == name and var(x.args[1]) == key
            if (access or remote(x, "Map", ("get", "fetch!"), 2) and var(x.args[0]) == name and var(x.args[1]) == key) and x.start >= at:
                text += [t.code[at : x.start], "value"]
                at = x.end
        if text and "value" not in names_in(body):
            text.append(t.code[at : body.end])
            yield whole(n, f"Enum.{call.name}({name}, fn {{{key}, value}} -> {''.join(text)} end)")


@rewrite("NoKeywordGetIntegerKey")
def _(t):
    piped = {id(n.args[1]) for n in t.pipes}
    for n in t.remotes("Keyword", "get", 1, 2):
        k = integer(n.args[-1])
        if k is not None and (len(n.args) == 2 or id(n) in piped):
            first = t.text(n.args[0]) if len(n.args) == 2 else ""
            name = {0: "List.first", -1: "List.last"}.get(k)
            yield whole(n, f"{name}({first})" if name else f"Enum.at({first}{', ' if first else ''}{k})")


@rewrite("NoEnumAtNegativeIndex")
def _(t):
    for n in t.nodes:
        call = n.args[1] if pipe(n) else n
        if remote(call, "Enum", "at", 1 if pipe(n) else 2) and (k := integer(call.args[-1])) is not None and k < 0:
            if pipe(n):
                yield whole(call, "List.last()" if k == -1 else f"Enum.reverse() |> Enum.at({-k - 1})")
            else:
                x = t.text(call.args[0])
                yield whole(call, f"List.last({x})" if k == -1 else f"Enum.at(Enum.reverse({x}), {-k - 1})")


@rewrite("NoLengthBasedIndexing")
def _(t):
    for block in t.blocks:
        for i, s in enumerate(block):
            right = s.args[1] if local(s, "=", 2) and var(s.args[0]) else None
            xs = var(right.args[0]) if right is not None and (local(right, "length", 1) or remote(right, "Enum", "count", 1)) else None
            if not xs:
                continue
            n = s.args[0].name
            found = [
                x for y in p._after_until(block, i, n, xs) for x in y.walk() if remote(x, "Enum", "at", 2) and var(x.args[0]) == xs and local(x.args[1], "-", 2) and var(x.args[1].args[0]) == n and (integer(x.args[1].args[1]) or 0) > 0
            ]
            for x in found:
                yield whole(x.args[1], f"-{t.text(x.args[1].args[1])}")
            if found and sum(v.name == n for y in block[i + 1 :] for v in y.walk() if v.kind == "var") == len(found) and i + 1 < len(block):
                yield s.start, block[i + 1].start, ""


@rewrite("NoListToTupleForAccess")
def _(t):
    source = {n.args[0].name: t.text(n.args[1].args[0]) for n in t.calls("=", 2) if var(n.args[0]) and remote(n.args[1], "List", "to_tuple", 1)}
    for n in t.calls("elem", 2):
        if var(n.args[0]) in source:
            yield whole(n, f"Enum.at({source[n.args[0].name]}, {t.text(n.args[1])})")


@rewrite("NoListAppendInReduce")
def _(t):
    piped = {id(n.args[1]) for n in t.pipes}
    for n in t.remotes("Enum", "reduce", 2, 3):
        if p.empty_list(n.args[-2]) and (len(n.args) == 3 or id(n) in piped) and (a := p._appending_reduce(n.args[-1])) is not None:
            yield whole(a, f"[{t.text(a.args[1].args[0])} | {t.text(a.args[0])}]")
            yield n.end, n.end, " |> Enum.reverse()"


@rewrite("NoListFold")
def _(t):
    for n in t.remotes("List", ("foldl", "foldr")):
        if n.name == "foldl":
            yield rename(n, "Enum.reduce")
        elif len(n.args) == 3:
            yield whole(n, f"Enum.reduce(Enum.reverse({t.text(n.args[0])}), {t.text(n.args[1])}, {t.text(n.args[2])})")
        elif len(n.args) == 2:
            yield rename(n, "Enum.reverse() |> Enum.reduce")


@rewrite("PreferEnumReverseTwo")
def _(t):
    for n in t.calls("++", 2):
        if remote(n.args[0], "Enum", "reverse", 1):
            yield whole(n, f"Enum.reverse({t.text(n.args[0].args[0])}, {t.text(n.args[1])})")


@rewrite("NoEagerWithIndexInReduce")
def _(t):
    for n in t.nodes:
        call = n.args[0] if remote(n, "Enum", "reduce") and n.args else last_step(n.args[0]) if pipe(n) and remote(n.args[1], "Enum", "reduce") else None
        if remote(call, "Enum", "with_index"):
            yield rename(call, "Stream.with_index")


def _two_steps(t: Tree, n: Node, first: Callable[[Node], bool], new: str) -> Iterator[Edit]:
    """Nested or piped `outer(first(x))` to `new(x)`; ``first`` stands last before ``n``."""
    a = last_step(n.args[0]) if pipe(n) else n.args[0]
    if not first(a):
        return
    if pipe(n) and pipe(n.args[0]):
        yield a.start, n.end, f"{new}({', '.join(map(t.text, a.args))})"
    elif a.args:
        yield whole(n, f"{new}({', '.join(map(t.text, a.args))})")


@rewrite("AvoidGraphemesEnumCount", "AvoidGraphemesLength")
def _(t):
    for n in t.nodes:
        step = n.args[1] if pipe(n) else None
        counted = step is not None and (remote(step, "Enum", "count", 0) or step.name == "length" and step.target is None and not step.args)
        if counted or local(n, "length", 1) or remote(n, "Enum", "count", 1):
            yield from _two_steps(t, n, lambda a: remote(a, "String", "graphemes"), "String.length")


@rewrite("NoIntegerToStringDigits")
def _(t):
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "String", "to_charlist") or remote(n, "String", "to_charlist", 1):
            yield from _two_steps(t, n, lambda a: remote(a, "Integer", "to_string"), "Integer.digits")


@rewrite("NoManualStringReverse")
def _(t):
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "join") and pipe(n.args[0]) and remote(n.args[0].args[1], "Enum", "reverse"):
            if not n.args[1].args or string(n.args[1].args[0], ""):
                yield from _two_steps(t, _spanning(n.args[0], n), lambda a: remote(a, "String", "graphemes"), "String.reverse")
        elif remote(n, "Enum", "join", 1) and remote(n.args[0], "Enum", "reverse", 1) and remote(n.args[0].args[0], "String", "graphemes", 1):
            yield whole(n, f"String.reverse({t.text(n.args[0].args[0].args[0])})")


def _spanning(inner: Node, outer: Node) -> Node:
    return Node("call", outer.line, outer.col, outer.start, outer.end, name="|>", args=inner.args, flags="op")


@rewrite("NoStringConcatInLoop")
def _(t):
    for n in t.nodes:
        call = n.args[1] if pipe(n) else n
        if remote(call, "Enum", "reduce", 2 if pipe(n) else 3) and string(call.args[-2], "") and p._joins(call.args[-1]):
            (item, _acc), body = lambda_(call.args[-1])
            made = body.args[1]
            plain = same_var(item, made)
            f = f"fn {t.text(item)} -> {t.text(made)} end"
            yield subject_of(t, n, lambda x, f=f, plain=plain: f"Enum.join({x})" if plain else f"Enum.map_join({x}, {f})", "Enum.join()" if plain else f"Enum.map_join({f})")


@rewrite("NoStringLengthForCharCheck")
def _(t):
    for n in t.nodes:
        if local(n) and n.name in ("==", "!=", "===", "!==") and len(n.args) == 2:
            for a, b in (n.args, n.args[::-1]):
                if remote(a, "String", "length", 1) and integer(b) == 1:
                    test = f"match?([_], String.graphemes({t.text(a.args[0])}))"
                    yield whole(n, f"not {test}" if n.name[0] == "!" else test)
                    break


@rewrite("NoRedundantEnumJoinSeparator")
def _(t):
    for n in t.nodes:
        if remote(n, "Enum", "join", 1, 2) and string(n.args[-1], ""):
            yield whole(n, f"Enum.join({t.text(n.args[0]) if len(n.args) == 2 else ''})")
        elif remote(n, "Enum", "map_join", 2, 3) and string(n.args[-2], ""):
            yield whole(n, f"Enum.map_join({', '.join(map(t.text, [*n.args[:-2], n.args[-1]]))})")


@rewrite("UseMapJoin")
def _(t):
    for n in t.nodes:
        if pipe(n) and remote(n.args[1], "Enum", "join", 0, 1):
            a, sep = last_step(n.args[0]), n.args[1].args
            if remote(a, "Enum", "map", 1) and pipe(n.args[0]):
                yield a.start, n.end, f"Enum.map_join({', '.join(map(t.text, [*sep, a.args[0]]))})"
            elif remote(a, "Enum", "map", 2):
                yield whole(n, f"Enum.map_join({', '.join(map(t.text, [a.args[0], *sep, a.args[1]]))})")
        elif remote(n, "Enum", "join", 1, 2) and remote(n.args[0], "Enum", "map", 2):
            a = n.args[0]
            yield whole(n, f"Enum.map_join({', '.join(map(t.text, [a.args[0], *n.args[1:], a.args[1]]))})")


@rewrite("UnnecessaryGraphemeChunking")
def _(t):
    for n in t.pipes:
        s = steps(n)
        if len(s) == 4 and remote(s[1], "String", "graphemes", 0) and p._sliding(s[2]) and p._maps_join(s[3]):
            x, k = t.text(s[0]), t.text(s[2].args[0])
            yield whole(n, f"for i <- 0..(String.length({x}) - {k})//1, do: String.slice({x}, i, {k})")


@rewrite("NoPipedRegexReplace")
def _(t):
    for n in t.pipes:
        if remote(n.args[1], "Regex", "replace"):
            yield rename(n.args[1], "String.replace")


@rewrite("NoRedundantBinarySyntax")
def _(t):
    for n in t.nodes:
        if n.kind == "bits" and len(n.args) == 1 and string(n.args[0]):
            yield whole(n, t.text(n.args[0]))


def _shape(k: int, more: bool) -> str:
    return "[" + ", ".join(["_"] * k) + (" | _]" if more else "]")


@rewrite("NoLengthComparisonForEmpty")
def _(t):
    lines = {line for line, _ in p_check("NoLengthComparisonForEmpty")(t)}
    for n in t.nodes:
        if n.line not in lines or not (local(n) and n.name in p._MIRROR and len(n.args) == 2):
            continue
        a, b = n.args
        op, size, k = (n.name, a, b) if local(a, "length", 1) and b.kind == "int" else (p._MIRROR[n.name], b, a)
        if not (local(size, "length", 1) and k.kind == "int" and var(size.args[0])):
            continue
        x, k = size.args[0].name, k.value
        if op in ("==", "!="):
            text = f"{x} {op} []" if k == 0 else f"{'' if op == '==' else '!'}match?({_shape(k, False)}, {x})"
        else:
            least = k + 1 if op in (">", "<=") else k
            holds = op in (">", ">=")
            text = f"{x} {'!=' if holds else '=='} []" if least == 1 else f"{'' if holds else '!'}match?({_shape(least, True)}, {x})"
        yield whole(n, text)


def _conjuncts(g: Node) -> list[Node]:
    return [*_conjuncts(g.args[0]), *_conjuncts(g.args[1])] if local(g, "and", 2) else [g]


def _without(t: Tree, when: Node, gone: list[Node]) -> Edit:
    """A guard without some of its conjuncts; without any left, no guard."""
    head, guard = when.args
    left = [c for c in _conjuncts(guard) if all(c is not g for g in gone)]
    return head.end, guard.end, f" when {' and '.join(map(t.text, left))}" if left else ""


def _into_head(t: Tree, made: Callable[[Node, list[Node]], tuple[Node, str] | None]) -> Iterator[Edit]:
    """Move a conjunct into the parameter that it is about."""
    for _n, when, guard in p._guarded(t):
        head = when.args[0]
        parts = _conjuncts(guard)
        for g in parts:
            got = made(g, head.args)
            if got:
                yield whole(*got)
                yield _without(t, when, [g])
                break


@rewrite("NoLengthGuardToPattern")
def _(t):
    def made(g, params):
        if p._owned_length(g) and var(g.args[0].args[0]):
            for x in params:
                if same_var(x, g.args[0].args[0]):
                    return x, f"{_shape(1, True) if g.name == '>' else _shape(g.args[1].value, False)} = {x.name}"
        return None

    return _into_head(t, made)


@rewrite("NoIsNilGuard")
def _(t):
    for n, when, guard in p._guarded(t):
        head, body = when.args[0], n.args[1] if len(n.args) > 1 else None
        for g in _conjuncts(guard):
            if local(g, "is_nil", 1):
                for x in head.args:
                    if same_var(x, g.args[0]):
                        rest = [c for c in _conjuncts(guard) if c is not g]
                        used = any(x.name in names_in(y) for y in [*rest, *([body] if body is not None else [])])
                        yield whole(x, f"nil = {x.name}" if used else "nil")
                        yield _without(t, when, [g])
                        return


@rewrite("NoGuardEqualityForPatternMatch")
def _(t):
    for n, when, guard in p._guarded(t):
        head, body = when.args[0], n.args[1] if len(n.args) > 1 else None
        for g in _conjuncts(guard):
            if not local(g, "==", 2):
                continue
            for a, b in (g.args, g.args[::-1]):
                target = next((x for x in head.args if same_var(x, a)), None)
                if target is not None and b.kind in ("int", "atom", "str"):
                    rest = [c for c in _conjuncts(guard) if c is not g]
                    if not any(a.name in names_in(y) for y in [*rest, *([body] if body is not None else [])]):
                        yield whole(target, t.text(b))
                        yield _without(t, when, [g])
                        return


@rewrite("RedundantListGuard")
def _(t):
    for f in t.functions:
        if f.guard is None:
            continue
        tails = {x.args[1].name for q in f.params or [] for x in q.walk() if local(x, "|", 2) and var(x.args[1])}
        gone = [g for g in _conjuncts(f.guard) if local(g, "is_list", 1) and var(g.args[0]) in tails]
        if gone:
            yield _without(t, f.when, gone)


@rewrite("NoRedundantNegatedGuard")
def _(t):
    lines = {line for line, _ in p_check("NoRedundantNegatedGuard")(t)}
    for f in t.functions:
        if f.line in lines and f.when is not None and f.guard.name in ("!=", "!=="):
            yield _without(t, f.when, [f.guard])


@rewrite("HallucinatedGuard")
def _(t):
    ops = {"is_pos_integer": "> 0", "is_non_neg_integer": ">= 0", "is_neg_integer": "< 0", "is_non_pos_integer": "<= 0"}
    for n in t.nodes:
        if local(n, None, 1) and n.name in ops:
            x = t.text(n.args[0])
            yield whole(n, f"(is_integer({x}) and {x} {ops[n.name]})")


def _indented(t: Tree, n: Node, pad: str) -> str:
    """The text of a body, its lines moved to a new indent."""
    first = t.code.rfind("\n", 0, n.start) + 1
    old = len(t.code[first : n.start]) - len(t.code[first : n.start].lstrip())
    lines = t.text(n).split("\n")
    return "\n".join([pad + lines[0].strip(), *[(pad + x[old:] if x[:old].strip() == "" else pad + x.lstrip()) if x.strip() else x for x in lines[1:]]])


def _if(t: Tree, n: Node, cond: str, yes: Node, no: Node) -> Edit:
    start = t.code.rfind("\n", 0, n.start) + 1
    line = t.code[start : n.start]
    pad = " " * (len(line) - len(line.lstrip()))
    return whole(n, f"if {cond} do\n{_indented(t, yes, pad + '  ')}\n{pad}else\n{_indented(t, no, pad + '  ')}\n{pad}end")


@rewrite("NoCaseTrueFalse")
def _(t):
    lines = {line for line, _ in p_check("NoCaseTrueFalse")(t)}
    for n in t.calls("case", 2):
        body = keyed(n.args[1], "do")
        if n.line in lines and body is not None and len(body.args) == 2 and keys(n.args[1]) == ["do"]:
            a, b = body.args
            first = atom(a.args[0], "true") or not atom(a.args[0], "false") and atom(b.args[0], "false")
            yield _if(t, n, t.text(n.args[0]), (a if first else b).body, (b if first else a).body)


@rewrite("NoCondTwoClauses")
def _(t):
    lines = {line for line, _ in p_check("NoCondTwoClauses")(t)}
    for n in t.calls("cond", 1):
        body = keyed(n.args[0], "do")
        if n.line in lines and body is not None and len(body.args) == 2:
            yield _if(t, n, t.text(body.args[0].args[0]), body.args[0].body, body.args[1].body)


@rewrite("NoUnlessElse")
def _(t):
    for n in t.calls("unless", 2):
        yes, no = keyed(n.args[1], "do"), keyed(n.args[1], "else")
        if yes is not None and no is not None:
            yield _if(t, n, t.text(n.args[0]), no, yes) if "do" in n.flags else whole(n, f"if {t.text(n.args[0])}, do: {t.text(no)}, else: {t.text(yes)}")


@rewrite("NoAnonFnApplicationInPipe")
def _(t):
    for n in t.pipes:
        if n.args[1].kind == "call" and n.args[1].flags == "anon" and n.args[1].target.kind == "fn" and not n.args[1].args:
            f = t.text(n.args[1].target)
            yield n.args[1].start, n.args[1].end, f"then({f[1:-1] if f.startswith('(') else f})"


@rewrite("NoKernelOpInPipeline")
def _(t):
    for n in t.pipes:
        if remote(n.args[1], "Kernel", ("==", "!=", "===", "!==", "<", ">", "<=", ">=", "and", "or"), 1):
            yield n.args[0].end, n.end, f" {n.args[1].name} {t.text(n.args[1].args[0])}"


@rewrite("NoRedundantAssignment")
def _(t):
    lines = {line for line, _ in p_check("NoRedundantAssignment")(t)}
    for block in t.blocks:
        if len(block) >= 2 and local(block[-2], "=", 2) and block[-2].line in lines and p.same(block[-2].args[0], block[-1]):
            yield block[-2].start, block[-1].end, t.text(block[-2].args[1])


def _renamed(t: Tree, names: dict[str, str], kinds: tuple[str, ...]) -> Iterator[Edit]:
    for n in t.nodes:
        if n.kind in kinds and n.target is None and n.name in names and t.code.startswith(n.name, n.start):
            yield n.start, n.start + len(n.name), names[n.name]


@rewrite("NoIsPrefixForNonGuard")
def _(t):
    names = {f.name: f.name for f in t.functions if f.params is not None and f.name.startswith("is_") and not f.name.endswith("?") and f.name not in p.TYPE_GUARDS}
    for name in names:
        base = name
        while base.startswith("is_"):
            base = base[3:]
        names[name] = f"{base}?"
    return _renamed(t, names, ("call",))


@rewrite("NoUnderscoreFunctionName")
def _(t):
    names = {f.name: f"do{f.name}" for f in t.functions if f.params is not None and f.name.startswith("_") and not f.name.startswith("__")}
    return _renamed(t, names, ("call",))


@rewrite("NoKernelShadowing")
def _(t):
    names = {name: f"{name}_val" for _, name in p_check("NoKernelShadowing")(t)}
    return _renamed(t, names, ("var",))


@rewrite("NonGroupedClauses")
def _(t):
    for n in t.calls("defmodule", 2):
        body = statements(keyed(n.args[1], "do"))
        key = lambda s: (f.name, len(f.params)) if (f := function(s)) and f.params is not None else None
        lines = [key(s) for s in body]
        for i, k in enumerate(lines):
            first = next((j for j in range(i) if lines[j] == k), None) if k else None
            if first is None or lines[i - 1] == k:
                continue
            end = first
            while end + 1 < i and lines[end + 1] == k:
                end += 1
            s, anchor = body[i], body[end]
            start = t.code.rfind("\n", 0, s.start) + 1
            pad = t.code[start : s.start]
            stop = s.end + 1 if t.code[s.end : s.end + 1] == "\n" else s.end
            if pad.strip() == "":
                yield anchor.end, anchor.end, f"\n{pad}{t.text(s)}"
                yield start, stop, ""
                return


@rewrite("NoUnnecessaryCatchAllRaise")
def _(t):
    for f in t.functions:
        if f.guard is None and f.params and all((var(q) or "").startswith("_") for q in f.params) and local(f.body, "raise"):
            start = t.code.rfind("\n", 0, f.node.start) + 1
            stop = f.node.end + 1 if t.code[f.node.end : f.node.end + 1] == "\n" else f.node.end
            yield start if not t.code[start : f.node.start].strip() else f.node.start, stop, ""


@rewrite("NoDocFalseOnPrivate")
def _(t):
    for block in t.blocks:
        for a, b in pairs_next(block):
            if local(a, "@", 1) and local(a.args[0], "doc", 1) and atom(a.args[0].args[0], "false") and local(b, "defp"):
                yield a.start, b.start, ""


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("#{", "\\#{") + '"'


@rewrite("NoTrailingNewlineInDoc")
def _(t):
    for n, _name, text in p._docs(t):
        if text.endswith("\n") and "\n" not in text.rstrip("\n"):
            yield whole(n.args[0].args[0], _quoted(text.rstrip("\n")))


@rewrite("PreferHeredocForMultiLineDoc")
def _(t):
    for n, _name, text in p._docs(t):
        if "\n" in text.rstrip("\n"):
            pad = " " * (n.start - t.code.rfind("\n", 0, n.start) - 1)
            body = "\n".join(pad + x if x else "" for x in text.rstrip("\n").replace("\\", "\\\\").replace("#{", "\\#{").split("\n"))
            yield whole(n.args[0].args[0], f'"""\n{body}\n{pad}"""')


@rewrite("NoMissingRequireLogger")
def _(t):
    lines = {line for line, _ in p_check("NoMissingRequireLogger")(t)}
    for n in t.calls("defmodule", 2):
        top = statements(keyed(n.args[1], "do"))
        if n.line in lines and top:
            pad = " " * (top[0].start - t.code.rfind("\n", 0, top[0].start) - 1)
            after = [s for s in top if local(s) and s.name in ("use", "import", "require", "alias") or local(s, "@", 1) and s.args[0].name == "moduledoc"]
            if after:
                yield after[-1].end, after[-1].end, f"\n{pad}require Logger"
            else:
                yield top[0].start, top[0].start, f"require Logger\n\n{pad}"


@rewrite("NoIdentityFloatCoercion", "PreferErlangFloat")
def _(t):
    for n in t.nodes:
        if local(n) and n.name in ("*", "/", "+", "-") and len(n.args) == 2:
            a, b = n.args
            one = {"*": 1.0, "/": 1.0, "+": 0.0, "-": 0.0}[n.name]
            x = a if b.kind == "float" and b.value == one else b if n.name in ("*", "+") and b.kind != "float" and a.kind == "float" and a.value == one else None
            if x is not None:
                yield whole(n, f":erlang.float({t.text(x)})" if x.kind == "var" else t.text(x))


@rewrite("NoDestructureReconstruct")
def _(t):
    def edits(q: Node, body: Node | None) -> Iterator[Edit]:
        names = [var(x) for x in q.args] if q.kind == "list" and not q.flags and len(q.args) >= 2 else []
        if names and all(x and not x.startswith("_") for x in names) and body is not None and "items" not in names_in(body):
            again = [x for x in body.walk() if x.kind == "list" and not x.flags and [var(y) for y in x.args] == names]
            if again:
                yield whole(q, f"{t.text(q)} = items")
                for x in again:
                    yield whole(x, "items")

    for n in t.nodes:
        if local(n, "case", 2) and (body := keyed(n.args[1], "do")) is not None:
            for c in body.args:
                if c.kind == "clause" and len(c.args) == 1:
                    yield from edits(c.args[0], c.body)
        elif f := function(n):
            for q in f.params or []:
                yield from edits(q, f.body)


@rewrite("NoManualEnumUniq")
def _(t):
    lines = {line for line, _ in p_check("NoManualEnumUniq")(t)}
    for n in t.nodes:
        call = n.args[1] if pipe(n) else n
        if remote(call, "Enum", "reduce", 2 if pipe(n) else 3) and n.line in lines and call.args[-2].kind == "tuple":
            after = [q for q in t.pipes if steps(q)[: len(steps(n))] == steps(n) and q is not n] if pipe(n) else [q for q in t.pipes if steps(q)[0] is n]
            end = n.end
            for q in sorted(after, key=lambda q: q.end):
                step = q.args[1]
                if q.end > end and (local(step, "elem", 1) or remote(step, "Enum", "reverse", 0)):
                    end = q.end
                else:
                    break
            yield (call.start, end, "Enum.uniq()") if pipe(n) else (n.start, end, f"Enum.uniq({t.text(n.args[0])})")


def apply(code: str, edits: Iterator[Edit]) -> str:
    """Edits that do not overlap an earlier one, from the end of the text to its start."""
    chosen: list[Edit] = []
    for e in edits:
        if all(e[1] <= c[0] or e[0] >= c[1] for c in chosen):
            chosen.append(e)
    for start, end, text in sorted(chosen, key=lambda e: (e[0], e[1]), reverse=True):
        code = code[:start] + text + code[end:]
    return code


# -- rewrites of several statements


def _line_span(t: Tree, s: Node) -> tuple[int, int]:
    """A statement with the rest of its lines, if it is alone on them."""
    start = t.code.rfind("\n", 0, s.start) + 1
    stop = t.code.find("\n", s.end)
    stop = len(t.code) if stop < 0 else stop + 1
    alone = not t.code[start : s.start].strip() and not t.code[s.end : stop].strip()
    return (start, stop) if alone else (s.start, s.end)


@rewrite("NoDoubleSortSameList")
def _(t):
    def sort_of(n: Node) -> tuple[str, str] | None:
        right = n.args[1]
        if remote(right, "Enum", "sort", 1, 2):
            source, given = var(right.args[0]), right.args[1:]
        elif pipe(right) and remote(right.args[1], "Enum", "sort", 0, 1):
            source, given = var(right.args[0]), right.args[1].args
        else:
            return None
        ok = source and (not given or atom(given[0], "asc", "desc"))
        return (source, given[0].value if given else "asc") if ok else None

    first: dict[str, str] = {}
    for n in t.calls("=", 2):
        if var(n.args[0]) and (got := sort_of(n)):
            if got[1] == "asc":
                first.setdefault(got[0], n.args[0].name)
            elif got[0] in first:
                yield whole(n.args[1], f"Enum.reverse({first[got[0]]})")


@rewrite("NoRedundantListTraversal")
def _(t):
    merged = {
        frozenset(("min", "max")): ("{{{min}, {max}}} = Enum.min_max({xs})"),
        frozenset(("count", "sum")): ("{{{count}, {sum}}} = Enum.reduce({xs}, {{0, 0}}, fn x, {{count, sum}} -> {{count + 1, sum + x}} end)"),
    }
    for block in t.blocks:
        bare = [(i, s, got) for i, s in enumerate(block) if local(s, "=", 2) and var(s.args[0]) and (got := p._traversal(s.args[1]))]
        for k, (i, s, (xs, kind)) in enumerate(bare):
            for j, other, (ys, kind2) in bare[k + 1 :]:
                form = merged.get(frozenset((kind, kind2)))
                same_list = [b for b in bare if b[2][0] == xs]
                if xs == ys and form and len(same_list) == 2 and not any(p._binds(x, xs) for x in block[i + 1 : j + 1]):
                    names = {kind: s.args[0].name, kind2: other.args[0].name}
                    yield whole(s, form.format(xs=xs, **names))
                    yield (*_line_span(t, other), "")


@rewrite("NoMultipleEnumAt")
def _(t):
    for block in t.blocks:
        groups: dict[str, list[tuple[int, str, Node]]] = {}
        held = [s for s in block if local(s, "=", 2) and var(s.args[0]) and remote(s.args[1], "Enum", "at", 2) and var(s.args[1].args[0]) and s.args[1].args[1].kind == "int"]
        if not held or [id(s) for s in block[block.index(held[0]) : block.index(held[0]) + len(held)]] != [id(s) for s in held]:
            continue
        for s in held:
            groups.setdefault(s.args[1].args[0].name, []).append((s.args[1].args[1].value, s.args[0].name, s))
        for xs, found in groups.items():
            places = {k: name for k, name, _ in found}
            span = max(places) + 1
            if len(found) >= 3 and len(places) == len(found) and span <= 2 * len(found):
                yield whole(found[0][2], f"[{', '.join(places.get(k, '_') for k in range(span))} | _] = {xs}")
                for _k, _name, s in found[1:]:
                    yield (*_line_span(t, s), "")


@rewrite("NoEnumAtMidpointAccess")
def _(t):
    for f in t.functions:
        if f.body is None or f.recursive or f.body.kind != "block":
            continue
        mids, found = set(), []
        for n in f.body.walk():
            if local(n, "=", 2) and var(n.args[0]) and p._midpoint(n.args[1]):
                mids.add(n.args[0].name)
            elif remote(n, "Enum", "at", 2) and var(n.args[0]) and (var(n.args[1]) in mids or p._midpoint(n.args[1])):
                found.append(n)
        bound = {x for s in f.body.walk() if local(s, "=", 2) for x in names_in(s.args[0])}
        top = f.body.args[0]
        pad = " " * (top.start - t.code.rfind("\n", 0, top.start) - 1)
        for xs in dict.fromkeys(n.args[0].name for n in found):
            if xs not in bound:
                yield top.start, top.start, f"{xs}_tuple = List.to_tuple({xs})\n{pad}"
        for n in found:
            if n.args[0].name not in bound:
                yield whole(n, f"elem({n.args[0].name}_tuple, {t.text(n.args[1])})")


@rewrite("NoGraphemePalindromeCheck")
def _(t):
    split = {}
    for n in t.calls("=", 2):
        right = n.args[1]
        if var(n.args[0]) and remote(last_step(right), "String", ("graphemes", "to_charlist")):
            made = last_step(right)
            if pipe(right):
                split[n.args[0].name] = (n, t.text(right.args[0]))
            elif len(made.args) == 1:
                split[n.args[0].name] = (n, t.text(made.args[0]))
    uses = {name: sum(v.kind == "var" and v.name == name for v in t.nodes) for name in split}
    for n in t.calls("==", 2):
        for a, b in (n.args, n.args[::-1]):
            name = var(a)
            # the variable holds the string afterwards, so it must serve nothing else
            if name in split and uses[name] == 3 and remote(b, "Enum", "reverse", 1) and same_var(a, b.args[0]):
                yield whole(split[name][0].args[1], split[name][1])
                yield rename(b, "String.reverse")


@rewrite("NoListAppendInRecursion")
def _(t):
    for group in t.clauses.values():
        adding = [(f, a) for f in group if f.recursive and (a := p._appending_recursion(f)) is not None]
        if not adding:
            continue
        place = next((i for f, a in adding for i, q in enumerate(f.params) if same_var(q, a.args[0])), None)
        base = [f for f in group if not f.recursive and place is not None and f.body is not None and var(f.params[place]) and same_var(statements(f.body)[-1], f.params[place])]
        if base and all(same_var(f.params[place], a.args[0]) for f, a in adding):
            for _f, a in adding:
                yield whole(a, f"[{t.text(a.args[1].args[0])} | {t.text(a.args[0])}]")
            for f in base:
                yield whole(statements(f.body)[-1], f"Enum.reverse({f.params[place].name})")


@rewrite("NoManualListLast")
def _(t):
    names = {name for _, name in p_check("NoManualListLast")(t)}
    for (name, arity), group in t.clauses.items():
        if name in names and arity == 1 and len(group) == 2:
            yield whole(group[0].node, f"{group[0].kind} {name}(list), do: List.last(list)")
            yield (*_line_span(t, group[1].node), "")


@rewrite("NoMapUpdateThenFetch")
def _(t):
    for block in t.blocks:
        for a, b in pairs_next(block):
            if not (local(a, "=", 2) and var(a.args[0]) and remote(a.args[1], "Map", ("update", "update!")) and var(a.args[1].args[0])):
                continue
            read = b.args[1] if local(b, "=", 2) else b
            m, key = a.args[0].name, a.args[1].args[1]
            if remote(read, "Map", ("fetch!", "get"), 2) and var(read.args[0]) == m and p.same(read.args[1], key):
                source, k, f = a.args[1].args[0].name, t.text(key), a.args[1].args[-1]
                start = t.code.rfind("\n", 0, a.start) + 1
                pad = " " * (a.start - start)
                if a.args[1].name == "update":
                    value = f"case Map.fetch({source}, {k}) do\n{pad}    {{:ok, old}} -> {call_of(t, f, 'old')}\n{pad}    :error -> {t.text(a.args[1].args[2])}\n{pad}  end"
                else:
                    value = call_of(t, f, f"Map.fetch!({source}, {k})")
                out = t.code[b.start : read.start] + "value" + t.code[read.end : b.end]
                yield a.start, b.end, f"value =\n{pad}  {value}\n\n{pad}{m} = Map.put({source}, {k}, value)\n{pad}{out}"


@rewrite("NoNestedEnumOnSameEnumerable")
def _(t):
    for n in t.remotes("Enum", ("map", "filter", "reject", "any?", "all?", "find", "count"), 2):
        xs = var(n.args[0])
        inner = [x for x in n.args[1].walk() if remote(x, "Enum", "member?", 2) and var(x.args[0]) == xs] if xs else []
        if inner:
            statement = n.start - (n.start - t.code.rfind("\n", 0, n.start) - 1)
            pad = t.code[statement : n.start]
            indent = pad[: len(pad) - len(pad.lstrip())]
            if pad.strip() == "" or local(_owner(t, n), "="):
                yield statement, statement, f"{indent}{xs}_set = MapSet.new({xs})\n"
                for x in inner:
                    yield whole(x, f"MapSet.member?({xs}_set, {t.text(x.args[1])})")


def _owner(t: Tree, n: Node) -> Node | None:
    """The node that has another as its last part."""
    return next((x for x in t.nodes if any(c is n for c in x.args)), None)


@rewrite("InconsistentParamNames")
def _(t):
    for group in t.clauses.values():
        if len(group) < 2:
            continue
        for i in range(len(group[0].params)):
            bases = [(var(f.params[i]) or "").lstrip("_") for f in group]
            if not all(bases) or len(set(bases)) < 2:
                continue
            for f, base in zip(group[1:], bases[1:], strict=True):
                if base != bases[0] and bases[0] not in {x.lstrip("_") for x in names_in(f.node)}:
                    for x in f.node.walk():
                        if x.kind == "var" and x.name == f.params[i].name:
                            yield x.start, x.start + len(x.name), "_" * x.name.startswith("_") + bases[0]


@rewrite("NoParamRebinding")
def _(t):
    for n in t.nodes:
        if n.kind != "fn":
            continue
        for c in n.args:
            params = {x for q in c.args for x in names_in(q) if not x.startswith("_")}
            body = statements(c.body)
            for i, s in enumerate(body):
                name = var(s.args[0]) if local(s, "=", 2) else None
                if name in params and f"new_{name}" not in names_in(c.body):
                    yield s.args[0].start, s.args[0].end, f"new_{name}"
                    for later in body[i + 1 :]:
                        for x in later.walk():
                            if x.kind == "var" and x.name == name:
                                yield x.start, x.start + len(name), f"new_{name}"
                    break
