import pytest

from loomlint.functions.elixir import parse
from loomlint.functions.tree import Tree
from loomlint.operators.fix import fix_idioms
from loomlint.plans.fixtures import CASES
from loomlint.plans.patterns import RULES
from loomlint.plans.rewrites import REWRITES

BY = {r.module: r for r in RULES}


def test_the_inventory():
    assert len(RULES) == 91
    assert sum(r.fixable for r in RULES) == 76
    assert set(BY) == set(CASES)
    assert {m for m, r in BY.items() if r.fixable} == set(REWRITES)


@pytest.mark.parametrize(("module", "code", "n"), [(m, c, n) for m, (bad, _) in CASES.items() for c, n in bad])
def test_reports(module, code, n):
    assert len(list(BY[module].check(Tree(code)))) == n


@pytest.mark.parametrize(("module", "code"), [(m, c) for m, (_, clean) in CASES.items() for c in clean])
def test_leaves_alone(module, code):
    assert list(BY[module].check(Tree(code))) == []
    assert fix_idioms(code, [module]) == (code, [])


#: Traversals that are reported but do not nest have nothing to rewrite.
KEPT = {"Enum.map(xs, f)\nEnum.filter(xs, g)"}


@pytest.mark.parametrize(("module", "code"), [(m, c) for m, (bad, _) in CASES.items() if m in REWRITES for c, _ in bad if c not in KEPT])
def test_a_fix_parses_and_settles(module, code):
    new, applied = fix_idioms(code, [module])
    parse(new)
    assert applied and applied[0][0] == module
    assert list(BY[module].check(Tree(new))) == []
    assert fix_idioms(new, [module]) == (new, [])


@pytest.mark.parametrize(
    ("module", "before", "after"),
    [
        ("NoSortThenAt", "Enum.at(Enum.sort(xs, :desc), -1)", "Enum.min(xs)"),
        ("NoManualFrequencies", "xs |> Enum.reduce(%{}, fn x, acc -> Map.update(acc, f(x), 1, &(&1 + 1)) end)", "xs |> Enum.frequencies_by(fn x -> f(x) end)"),
        ("NoMapKeysOrValuesForIteration", "Enum.map(Map.keys(m), fn k -> f(k) end)", "Enum.map(m, fn {k, _value} -> f(k) end)"),
        ("NoUnlessElse", "unless ok do\n  1\nelse\n  2\nend", "if ok do\n  2\nelse\n  1\nend"),
        ("NoIsPrefixForNonGuard", "def is_is_x(a), do: is_is_x(a)", "def x?(a), do: x?(a)"),
        ("NoListAppendInRecursion", "def go([], acc), do: acc\ndef go([h | t], acc), do: go(t, acc ++ [h])", "def go([], acc), do: Enum.reverse(acc)\ndef go([h | t], acc), do: go(t, [h | acc])"),
        ("NoExplicitSumReduce", "Enum.reduce(xs, 5, fn x, acc -> x + acc end)", "Enum.reduce(xs, 5, fn x, acc -> x + acc end)"),
    ],
)
def test_exact_rewrites(module, before, after):
    assert fix_idioms(before, [module])[0] == after


def test_a_later_traversal_counts_even_outside_the_first():
    found = list(BY["NoNestedEnumOnSameEnumerable"].check(Tree("Enum.map(xs, f)\nEnum.count(xs)\nEnum.find(xs, g)")))
    assert len(found) == 2


def test_pipelines_report_once_for_each_enclosing_pipe():
    assert len(list(BY["NoMapThenAggregate"].check(Tree("xs |> Enum.map(f) |> Enum.sum() |> a()")))) == 2


@pytest.mark.parametrize(
    ("module", "code", "n"),
    [
        ("NoMultipleEnumAt", "{Enum.at(l, 0), Enum.at(l, -1), Enum.at(l, 2)}", 1),
        ("NoMapGetSentinel", "v = Map.get(m, k, -1)\nv > -1", 0),
        ("PreferDescSortOverNegativeTake", "xs |> Enum.sort(fn a, b -> f(a) > g(b) end) |> Enum.take(-3)", 0),
        ("PreferDescSortOverNegativeTake", "Enum.sort(xs) |> Enum.map(&f/1) |> Enum.take(-3)", 1),
        ("NoRedundantListTraversal", "a = f(fn -> length(xs) end)\nb = Enum.sum(xs)\n{a, b}", 1),
        ("NoEnumCountForLength", "xs |> Enum.count(pred)", 1),
        ("NoMapKeysOrValuesForIteration", "a |> b() |> Map.keys() |> Enum.map(f)", 1),
        ("NoEnumAtInLoop", "for i <- is do\n  {Enum.at(xs, i), Enum.at(ys, i)}\nend", 1),
        ("InconsistentParamNames", "def f(_a, x), do: x\ndef f(b, x), do: {b, x}", 1),
        ("NonGroupedClauses", "defmodule M do\n  def f(1), do: 1\n  @doc \"x\"\n  def f(2), do: 2\nend", 1),
        ("NoListToTupleForAccess", "t = List.to_tuple(a)\nu = List.to_tuple(b)\n{elem(t, 0), elem(t, 1), elem(u, 0)}", 2),
    ],
)
def test_details_that_decide_counts(module, code, n):
    assert len(list(BY[module].check(Tree(code)))) == n
