"""What the queries over our own snippets must return: texts after a rewrite, lines of reports.

Recorded from a run, then read one by one against the meaning of the code before the rewrite; the lines and the small
tables below were checked by eye against the snippets.  SQL holds them as values, so that a change of a rule shows.
"""

from __future__ import annotations

#: Lines of reports that are not all in line 1, or have none: (rule module, number of the snippet): lines.
LINES: dict[tuple[str, int], list[int | None]] = {
    ("NoDestructureReconstruct", 1): [2],
    ("NoDestructureReconstruct", 2): [None],
    ("NoDocFalseOnPrivate", 1): [2],
    ("NoDoubleSortSameList", 1): [2],
    ("NoEnumAtBinarySearch", 1): [3],
    ("NoEnumAtMidpointAccess", 1): [3],
    ("NoGraphemePalindromeCheck", 1): [2],
    ("NoGraphemePalindromeCheck", 2): [2],
    ("NoListAppendInLoop", 2): [2],
    ("NoListAppendInRecursion", 1): [2],
    ("NoListToTupleForAccess", 1): [2],
    ("NoNestedEnumOnSameEnumerable", 1): [None],
    ("NoNestedEnumOnSameEnumerable", 2): [None],
    ("NoNestedEnumOnSameEnumerableUnfixable", 1): [None],
    ("NoRedundantAssignment", 1): [2],
    ("NoRedundantAssignment", 2): [2],
    ("NoRedundantNegatedGuard", 1): [2],
    ("NoUnnecessaryCatchAllRaise", 1): [2],
    ("NonGroupedClauses", 1): [4],
}
#: The text of each snippet of a rule after its rewrite, in order.
REWRITTEN: dict[str, list[str]] = {
    "NoExplicitMaxReduce": ["Enum.max(xs)", "Enum.max(xs)"],
    "NoExplicitMinReduce": ["Enum.min(xs)", "Enum.min(xs)"],
    "NoExplicitSumReduce": ["Enum.sum(xs)", "Enum.sum(xs)"],
    "NoManualFrequencies": ["Enum.frequencies(xs)", "xs |> Enum.frequencies_by(fn x -> f(x) end)"],
    "NoManualEnumUniq": ["Enum.uniq(xs)"],
    "NoManualMax": ["max(a, b)", "max(b, a)"],
    "NoManualMin": ["min(a, b)", "min(b, a)"],
    "NoMapThenAggregate": ["Stream.map(xs, &f/1) |> Enum.sum()", "Enum.max(Stream.map(xs, &f/1))", "xs |> Stream.map(&f/1) |> Enum.sum() |> g() |> h()"],
    "NoRedundantListTraversal": ["{n, s} = Enum.reduce(xs, {0, 0}, fn x, {count, sum} -> {count + 1, sum + x} end)\n{n, s}", "{a, b} = Enum.min_max(xs)\n{a, b}"],
    "NoEnumCountForLength": ["length(xs)", "xs |> length()"],
    "NoSortForTopK": ["Enum.min(xs)", "Enum.max(xs)", "Enum.min(xs)"],
    "NoSortThenAt": ["Enum.min(xs)", "Enum.min(xs)", "Enum.max(xs)"],
    "NoSortThenReverse": ["Enum.sort(xs, :desc)", "Enum.sort(xs, :asc)", "xs |> Enum.sort(:desc)"],
    "NoDoubleSortSameList": ["a = Enum.sort(xs)\nb = Enum.reverse(a)"],
    "PreferDescSortOverNegativeTake": ["xs |> Enum.sort(:desc) |> Enum.take(3)"],
    "NoIdentityFunctionInEnum": ["Enum.uniq(xs)", "xs |> Enum.sort()", "Enum.max(xs)"],
    "PreferEnumSlice": ["xs |> Enum.slice(2, 3)", "Enum.slice(xs, 2, 3)", "Enum.slice(xs, 2, 3)"],
    "NoEnumTakeNegative": ["Enum.slice(xs, -2..-1//1)", "xs |> Enum.slice(-2..-1//1)"],
    "NoEnumDropNegative": ["Enum.slice(xs, 0..-3//1)", "xs |> Enum.slice(0..-2//1)"],
    "NoTakeWhileLengthCheck": ["xs |> Enum.reduce_while(0, fn item, count -> if (&f/1).(item), do: {:cont, count + 1}, else: {:halt, count} end)", "Enum.reduce_while(xs, 0, fn x, count -> if x > 1, do: {:cont, count + 1}, else: {:halt, count} end)", "xs |> Enum.reduce_while(0, fn item, count -> if (&f/1).(item), do: {:cont, count + 1}, else: {:halt, count} end) |> g()"],
    "NoNestedEnumOnSameEnumerable": ["xs_set = MapSet.new(xs)\nEnum.map(xs, fn x -> MapSet.member?(xs_set, x) end)", "Enum.map(xs, f)\nEnum.filter(xs, g)"],
    "NoMapGetSentinel": ["v = Map.get(m, k)\nif v == nil, do: a, else: v", "v = Map.get(m, k)\n(v != nil and v >= start)"],
    "NoMapKeysEnumLookup": ["Enum.map(m, fn {k, value} -> value end)", "Enum.each(m, fn {k, value} -> f(value) end)"],
    "NoMapKeysOrValuesForIteration": ["Enum.all?(m, fn {_key, v} -> v == 0 end)", "Enum.map(m, fn {x, _value} -> (&f/1).(x) end)", "Enum.reduce(m, 0, fn {_key, x}, acc -> acc + x end)"],
    "NoMapUpdateThenFetch": ["value =\n  case Map.fetch(m, k) do\n    {:ok, old} -> (&(&1 + 1)).(old)\n    :error -> 1\n  end\n\nm = Map.put(m, k, value)\nvalue"],
    "NoKeywordGetIntegerKey": ["List.first(xs)", "xs |> List.last()"],
    "NoEnumAtMidpointAccess": ["def s(l, lo, hi) do\n  l_tuple = List.to_tuple(l)\n  mid = lo + div(hi - lo, 2)\n  elem(l_tuple, mid)\nend"],
    "NoEnumAtNegativeIndex": ["List.last(xs)", "xs |> Enum.reverse() |> Enum.at(1)"],
    "NoMultipleEnumAt": ["[a, b, c | _] = l\n"],
    "NoLengthBasedIndexing": ["Enum.at(xs, -1)"],
    "NoListToTupleForAccess": ["t = List.to_tuple(xs)\n{Enum.at(xs, 0), Enum.at(xs, 1)}"],
    "NoListAppendInRecursion": ["def go([], acc), do: Enum.reverse(acc)\ndef go([h | t], acc), do: go(t, [h | acc])"],
    "NoListAppendInReduce": ["Enum.reduce(xs, [], fn x, acc -> [f(x) | acc] end) |> Enum.reverse()", "xs |> Enum.reduce([], fn x, acc -> [x | acc] end) |> Enum.reverse()"],
    "NoListFold": ["Enum.reduce(xs, 0, fn x, acc -> x + acc end)", "Enum.reduce(Enum.reverse(xs), [], fn x, acc -> [x | acc] end)"],
    "PreferEnumReverseTwo": ["Enum.reverse(a, b)"],
    "NoDestructureReconstruct": ["case xs do\n  [a, b] = items -> f(items)\n  _ -> nil\nend", "def f([a, b] = items), do: g(items)"],
    "NoManualListLast": ["def last(list), do: List.last(list)\n"],
    "NoEagerWithIndexInReduce": ["Enum.reduce(Stream.with_index(xs), 0, f)", "xs |> Stream.with_index() |> Enum.reduce(0, f)"],
    "AvoidGraphemesEnumCount": ["String.length(s)", "s |> String.length()"],
    "AvoidGraphemesLength": ["String.length(s)", "s |> String.length()"],
    "NoGraphemePalindromeCheck": ["g = s\ng == String.reverse(g)", "g = s |> String.downcase()\nString.reverse(g) == g"],
    "NoManualStringReverse": ["s |> String.reverse()", "String.reverse(s)"],
    "NoIntegerToStringDigits": ["Integer.digits(n)", "n |> Integer.digits()"],
    "NoStringConcatInLoop": ["Enum.map_join(xs, fn x -> f(x) end)", "xs |> Enum.join()"],
    "NoStringLengthForCharCheck": ["match?([_], String.graphemes(s))", "not match?([_], String.graphemes(s))"],
    "NoRedundantEnumJoinSeparator": ["Enum.join(xs)", "xs |> Enum.map_join(&f/1)"],
    "UseMapJoin": ['xs |> Enum.map_join(",", &f/1)', "Enum.map_join(xs, &f/1)"],
    "UnnecessaryGraphemeChunking": ["for i <- 0..(String.length(s) - 3)//1, do: String.slice(s, i, 3)"],
    "NoPipedRegexReplace": ['s |> String.replace(~r/a/, "b")'],
    "NoRedundantBinarySyntax": ['"abc"'],
    "NoLengthComparisonForEmpty": ["xs == []", "match?([_, _, _ | _], xs)", "xs != []"],
    "NoLengthGuardToPattern": ["def f([_ | _] = xs), do: xs", "def f([_, _] = xs), do: xs"],
    "HallucinatedGuard": ["def f(n) when (is_integer(n) and n > 0), do: n"],
    "NoGuardEqualityForPatternMatch": ["def f(0), do: 1", "def f(:x, n) when n > 1, do: n"],
    "NoIsNilGuard": ["def f(nil), do: 1", "def f(nil, y) when y > 1, do: y"],
    "RedundantListGuard": ["def f([h | t]), do: h"],
    "NoRedundantNegatedGuard": ["def f(a, b) when a == b, do: 1\ndef f(a, b), do: 2"],
    "NoCaseTrueFalse": ["if f(x) do\n  1\nelse\n  2\nend", "if x > 1 do\n  1\nelse\n  2\nend"],
    "NoCondTwoClauses": ["if x > 1 do\n  1\nelse\n  2\nend"],
    "NoUnlessElse": ["if ok do\n  2\nelse\n  1\nend"],
    "NoAnonFnApplicationInPipe": ["x |> then(fn y -> y + 1 end)"],
    "NoKernelOpInPipeline": ["x |> f() == 1"],
    "NoRedundantAssignment": ["def f(x) do\n  g(x)\nend", "def f(x) do\n  g(x)\nend"],
    "NoParamRebinding": ["fn x -> new_x = x + 1\n new_x end"],
    "InconsistentParamNames": ["def f(a), do: a\ndef f(a), do: a"],
    "NoIsPrefixForNonGuard": ["def valid?(x), do: x"],
    "NoUnderscoreFunctionName": ["defp do_go(x), do: x\ndefp do_go(y), do: y"],
    "NoKernelShadowing": ["max_val = f(x)", "def f(length_val), do: length_val", "fn hd_val -> hd_val end"],
    "NonGroupedClauses": ["defmodule M do\n  def f(1), do: 1\n  def f(2), do: 2\n  def g(x), do: x\nend"],
    "NoUnnecessaryCatchAllRaise": ["def f(1), do: 1\n"],
    "NoDocFalseOnPrivate": ["defmodule M do\n  defp f(x), do: x\nend"],
    "NoTrailingNewlineInDoc": ['@doc "One line."\n'],
    "PreferHeredocForMultiLineDoc": ['@doc """\nOne.\nTwo.\n"""\n'],
    "NoMissingRequireLogger": ['defmodule M do\n  require Logger\n\n  def f, do: Logger.info("x")\nend'],
    "NoIdentityFloatCoercion": ["f(x)", "g(x)"],
    "PreferErlangFloat": [":erlang.float(x)", ":erlang.float(x)"],
}
#: The sources of the fixture corpus that say something: (source_id, phase, rule, line).
ISSUES = [
    (1, "syntax", "infix_div", 2),
    (2, "syntax", "python_modulo", 2),
    (3, "syntax", "python_scientific_notation", 2),
    (6, "pattern", "no_sort_for_top_k", 2),
    (7, "pattern", "no_map_then_aggregate", 2),
    (8, "pattern", "no_repeated_enum_traversal", 2),
    (8, "pattern", "no_repeated_enum_traversal", 2),
]
#: Lines that a fix of the fixture corpus changes: (source_id, rule, line before, line after); all are the second line.
CHANGES = [
    (1, "FixDivRem", "  def half(n), do: n * 3 div 2", "  div(def half(n), do: n * 3, 2)"),
    (2, "FixPythonModulo", "  def odd(n), do: n % 2 == 1", "  def odd(n), do: rem(n, 2) == 1"),
    (3, "FixScientificNotation", "  def eps, do: 2e-9", "  def eps, do: 2.0e-9"),
    (6, "NoSortForTopK", "  def best(xs), do: Enum.sort(xs) |> hd()", "  def best(xs), do: Enum.min(xs)"),
    (7, "NoMapThenAggregate", "  def t(xs), do: Enum.map(xs, &f/1) |> Enum.sum()", "  def t(xs), do: Stream.map(xs, &f/1) |> Enum.sum()"),
]
#: The text after the rewrite of each of the catalog's diagnosed lines, in order.
DIAGNOSED = [
    "List.last(xs)",
    ":neg_infinity",
    "Enum.at(xs, 1)",
    "Enum.take(xs, -n)",
    "Enum.sort(xs)",
    "Enum.max([a, b, c])",
    "1..n - 1",
    "String.match?(c, ~r/^[a-zA-Z0-9]$/)",
    "_n = count",
    "x + 1",
    "plain",
    'defmodule T do\n  use ExUnit.Case\n  test "x" do\n    1\n  end\nend',
]
#: Idiom rules that only report, and those whose place is not the usual 500.
REPORT_ONLY = [
    "NoEnumAtBinarySearch", "NoEnumAtInLoop", "NoEnumAtLoopAccess", "NoLengthInGuard", "NoListAppendInLoop", "NoListDeleteAtInLoop", "NoMapAsSet", "NoMapKeysOrValuesForRawIteration",
    "NoNestedEnumOnSameEnumerableUnfixable", "NoRepeatedEnumTraversal", "NoSortForTopKReduce", "NoSplitToCount", "NoStringConcatInLoopUnfixable", "PreferMapFetchOverHasKey", "UnnecessaryGraphemeChunkingUnfixable",
]
PLACES = {"NoPipedRegexReplace": 50, "NoIdentityFunctionInEnum": 499, "PreferErlangFloat": 499, "NoExplicitSumReduce": 501, "PreferHeredocForMultiLineDoc": 501, "MissingUseExunitCase": 100}
#: Names of issues that are not the rule's own name.
NAMES = {"NoSortForTopKReduce": "no_sort_for_top_k_reduce", "NoStringConcatInLoopUnfixable": "no_string_concat_in_loop_complex", "UnnecessaryGraphemeChunkingUnfixable": "unnecessary_grapheme_chunking"}
SYNTAX = ["FixDivRem", "FixMalformedSpec", "FixPythonModulo", "FixScientificNotation", "FixStaleAccessModifier"]
SEMANTIC = ["MissingUseExunitCase", "OutdentedHeredoc", "UndefinedFunction", "UndefinedStringAlphanumeric", "UnusedVariable", "UsedUnderscoreVariable"]
