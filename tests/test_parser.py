import pytest

from loomlint.functions.elixir import ParseError, parse
from loomlint.functions.tree import Tree


def shown(code):
    return repr(parse(code))


@pytest.mark.parametrize(
    ("code", "tree"),
    [
        ("1 + 2 * 3", "call:+(int:1(), call:*(int:2(), int:3()))"),
        ("a |> f(b) |> g()", "call:|>(call:|>(var:a(), call:f(var:b())), call:g())"),
        ("x = y = 1", "call:=(var:x(), call:=(var:y(), int:1()))"),
        ("a not in b", "call:not(call:in(var:a(), var:b()))"),
        ("f a, b: 1", "call:f(var:a(), list:(tuple:(atom:'b'(), int:1())))"),
        ("[h | t]", "list:(call:|(var:h(), var:t()))"),
        ("%{a | b: 1}", "map:(call:|(var:a(), tuple:(atom:'b'(), int:1())))"),
        ("&f/1", "call:&(call:/(var:f(), int:1()))"),
        ("&(&1 + 1)", "call:&(call:+(call:&(int:1()), int:1()))"),
        ("m[k]", "call:get(alias:Access(), var:m(), var:k())"),
        ("f.(x)", "call:(var:f(), var:x())"),
        ("A.B.c(1)", "call:c(alias:A.B(), int:1())"),
        ('"a#{b}c"', "interp:(str:'a'(), var:b(), str:'c'())"),
        ("~r/a+/i", "sigil:r'i'(str:'a+'())"),
        ("0..9//2", "call:..//(int:0(), int:9(), int:2())"),
        ("-x", "call:-(var:x())"),
        ("fn x, y -> x end", "fn:(clause:(var:x(), var:y(), var:x()))"),
        ("<<a::8, b>>", "bits:(call:::(var:a(), int:8()), var:b())"),
        ("?a", "int:97()"),
        ("%S{a: 1}", "struct:(alias:S(), map:(tuple:(atom:'a'(), int:1())))"),
    ],
)
def test_trees(code, tree):
    assert shown(code) == tree


def test_a_do_block_belongs_to_the_call_without_parentheses():
    f = Tree("def s(a, b) do\n  a\nend").functions[0]
    assert (f.name, len(f.params), f.body.name) == ("s", 2, "a")


def test_clauses_and_guards():
    t = Tree("case f(x) do\n  {:ok, v} when v > 1 ->\n    g(v)\n    h(v)\n  _ -> nil\nend")
    case = next(t.calls("case"))
    clauses = case.args[1].args[0].args[1].args
    assert [len(c.body.args) if c.body.kind == "block" else 1 for c in clauses] == [2, 1]
    assert clauses[0].args[0].name == "when"


def test_heredoc_indent_and_lines():
    node = parse('@doc """\n  one\n    two\n  """\n')
    assert node.args[0].args[0].value == "one\n  two\n"


def test_spans_are_the_source_of_each_node():
    code = "def f(x) when x > 1, do: Enum.map(x, fn y -> y + 1 end) |> g()"
    t = Tree(code)
    texts = {t.text(n) for n in t.nodes}
    assert {"Enum.map(x, fn y -> y + 1 end)", "y + 1", "x > 1", "g()"} <= texts


@pytest.mark.parametrize("code", ["def f(x), do: x * 3 div 2", "n % 2", "x = 2e-9", "f(", "[1, 2", '"abc', "fn x -> x", "a do b"])
def test_what_does_not_parse_says_where(code):
    with pytest.raises(ParseError) as e:
        parse(code)
    assert e.value.line >= 1


def test_empty_and_comments():
    assert parse("").args == []
    assert parse("# only\n\n").args == []
