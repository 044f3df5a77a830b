"""Small sources of our own for every idiom rule: what it must report, and what it must leave alone.

For each rule: sources with their number of issues.  Positive ids count up from 1, clean sources from 1001.
"""

from __future__ import annotations

#: module: ([(source, issues)], [clean sources])
CASES: dict[str, tuple[list[tuple[str, int]], list[str]]] = {
    "NoExplicitMaxReduce": ([("Enum.reduce(xs, 0, fn x, acc -> max(x, acc) end)", 1), ("Enum.reduce(xs, hd(xs), fn x, m -> if x > m, do: x, else: m end)", 1)], ["Enum.reduce(xs, 0, fn x, acc -> x + acc end)"]),
    "NoExplicitMinReduce": ([("Enum.reduce(xs, 9, fn x, acc -> min(x, acc) end)", 1), ("Enum.reduce(xs, hd(xs), fn x, m -> if x < m, do: x, else: m end)", 1)], ["Enum.reduce(xs, 9, fn x, acc -> max(x, acc) end)"]),
    "NoExplicitSumReduce": ([("Enum.reduce(xs, 0, fn x, acc -> x + acc end)", 1), ("Enum.reduce(xs, 0, fn x, acc -> acc + x end)", 1)], ["Enum.reduce(xs, 0, fn x, acc -> acc + x * 2 end)"]),
    "NoManualFrequencies": ([("Enum.reduce(xs, %{}, fn x, acc -> Map.update(acc, x, 1, &(&1 + 1)) end)", 1), ("xs |> Enum.reduce(%{}, fn x, acc -> Map.update(acc, f(x), 1, &(&1 + 1)) end)", 1)], ["Enum.reduce(xs, %{}, fn x, acc -> Map.put(acc, x, 1) end)"]),
    "NoManualEnumUniq": (
        [("Enum.reduce(xs, {[], MapSet.new()}, fn x, {out, seen} ->\n  if MapSet.member?(seen, x), do: {out, seen}, else: {[x | out], MapSet.put(seen, x)}\nend)", 1)],
        ["Enum.reduce(xs, {[], []}, fn x, {out, seen} -> if x in seen, do: {out, seen}, else: {[x | out], [x | seen]} end)"],
    ),
    "NoManualMax": ([("if a > b, do: a, else: b", 1), ("if a <= b, do: b, else: a", 1)], ["if a > b, do: b, else: a"]),
    "NoManualMin": ([("if a < b, do: a, else: b", 1), ("if a >= b, do: b, else: a", 1)], ["if a < b, do: b, else: a"]),
    "NoMapThenAggregate": ([("Enum.map(xs, &f/1) |> Enum.sum()", 1), ("Enum.max(Enum.map(xs, &f/1))", 1), ("xs |> Enum.map(&f/1) |> Enum.sum() |> g() |> h()", 3)], ["xs |> Enum.map(&f/1) |> Enum.sort()"]),
    "NoRedundantListTraversal": ([("n = length(xs)\ns = Enum.sum(xs)\n{n, s}", 1), ("a = Enum.min(xs)\nb = Enum.max(xs)\n{a, b}", 1)], ["n = length(xs)\nxs = f(xs)\ns = Enum.sum(xs)\n{n, s}"]),
    "NoRepeatedEnumTraversal": ([("{Enum.count(xs), Enum.max(xs)}", 2)], ["{Enum.count(xs), Enum.max(ys)}"]),
    "NoEnumCountForLength": ([("Enum.count(xs)", 1), ("xs |> Enum.count()", 1)], ["Enum.count(xs, &f/1)", "xs |> Enum.count(&f/1)"]),
    "NoSortForTopK": ([("Enum.sort(xs) |> hd()", 1), ("Enum.sort(xs) |> Enum.reverse() |> Enum.at(0)", 1), ("Enum.sort(xs) |> Enum.take(1)", 1)], ["xs |> Enum.sort() |> hd()", "Enum.sort(xs) |> Enum.take(2)"]),
    "NoSortForTopKReduce": ([("Enum.sort(xs) |> Enum.take(3)", 1), ("Enum.sort(xs) |> Enum.at(1)", 1)], ["Enum.sort(xs) |> Enum.take(1)"]),
    "NoSortThenAt": ([("Enum.sort(xs) |> Enum.at(0)", 1), ("Enum.at(Enum.sort(xs, :desc), -1)", 1), ("Enum.at(Enum.sort(xs, &>=/2), 0)", 1)], ["Enum.sort(xs) |> Enum.at(2)", "Enum.at(Enum.sort(xs, f), 0)"]),
    "NoSortThenReverse": ([("Enum.sort(xs) |> Enum.reverse()", 1), ("Enum.reverse(Enum.sort(xs, :desc))", 1), ("xs |> Enum.sort() |> Enum.reverse()", 1)], ["Enum.sort_by(xs, f) |> Enum.reverse()"]),
    "NoDoubleSortSameList": ([("a = Enum.sort(xs)\nb = Enum.sort(xs, :desc)", 1)], ["a = Enum.sort(xs)\nb = Enum.sort(ys, :desc)"]),
    "PreferDescSortOverNegativeTake": ([("xs |> Enum.sort() |> Enum.take(-3)", 1)], ["xs |> Enum.sort() |> Enum.take(3)", "xs |> Enum.sort(:desc) |> Enum.take(-3)"]),
    "NoIdentityFunctionInEnum": ([("Enum.uniq_by(xs, fn x -> x end)", 1), ("xs |> Enum.sort_by(& &1)", 1), ("Enum.max_by(xs, &Function.identity/1)", 1)], ["Enum.uniq_by(xs, fn x -> x.id end)"]),
    "PreferEnumSlice": ([("xs |> Enum.drop(2) |> Enum.take(3)", 1), ("Enum.take(Enum.drop(xs, 2), 3)", 1), ("Enum.drop(xs, 2) |> Enum.take(3)", 1)], ["xs |> Enum.take(3) |> Enum.drop(2)"]),
    "NoEnumTakeNegative": ([("Enum.take(xs, -2)", 1), ("xs |> Enum.take(-2)", 1)], ["Enum.take(xs, 2)"]),
    "NoEnumDropNegative": ([("Enum.drop(xs, -2)", 1), ("xs |> Enum.drop(-1)", 1)], ["Enum.drop(xs, 2)"]),
    "NoTakeWhileLengthCheck": ([("xs |> Enum.take_while(&f/1) |> length()", 1), ("length(Enum.take_while(xs, fn x -> x > 1 end))", 1), ("xs |> Enum.take_while(&f/1) |> Enum.count() |> g()", 2)], ["xs |> Enum.take_while(&f/1) |> Enum.sum()"]),
    "NoMapAsSet": ([("Map.put(m, k, true)", 1), ("m |> Map.put(k, false)", 1)], ["Map.put(m, k, 1)"]),
    "NoNestedEnumOnSameEnumerable": ([("Enum.map(xs, fn x -> Enum.member?(xs, x) end)", 1), ("Enum.map(xs, f)\nEnum.filter(xs, g)", 1)], ["Enum.map(xs, fn x -> Enum.member?(ys, x) end)"]),
    "NoNestedEnumOnSameEnumerableUnfixable": ([("xs |> Enum.map(fn x -> Enum.filter(xs, &(&1 > x)) end)", 1)], ["xs |> Enum.map(fn x -> Enum.filter(ys, &(&1 > x)) end)"]),
    "NoMapGetSentinel": ([("v = Map.get(m, k, -1)\nif v == -1, do: a, else: v", 1), ("v = Map.get(m, k, -1)\nv >= start", 1)], ["v = Map.get(m, k, -1)\nv = f(v)\nv == -1", "v = Map.get(m, k, 0)\nv == 0"]),
    "NoMapKeysEnumLookup": ([("Enum.map(Map.keys(m), fn k -> m[k] end)", 1), ("m |> Map.keys() |> Enum.each(fn k -> f(Map.get(m, k)) end)", 1)], ["Enum.map(Map.keys(m), fn k -> n[k] end)"]),
    "NoMapKeysOrValuesForIteration": ([("Enum.all?(Map.values(m), fn v -> v == 0 end)", 1), ("Map.keys(m) |> Enum.map(&f/1)", 1), ("m |> Map.values() |> Enum.sum()", 1)], ["Enum.zip(Map.values(m), xs)", "Enum.group_by(Map.values(m), &f/1)"]),
    "NoMapKeysOrValuesForRawIteration": ([("Enum.zip(Map.values(m), xs)", 1), ("Map.keys(m) |> Enum.group_by(&f/1)", 1)], ["Enum.map(Map.values(m), &f/1)"]),
    "NoMapUpdateThenFetch": ([("m = Map.update(m, k, 1, &(&1 + 1))\nMap.fetch!(m, k)", 1)], ["m = Map.put(m, k, 1)\nMap.fetch!(m, k)"]),
    "PreferMapFetchOverHasKey": ([("if Map.has_key?(m, k), do: m[k], else: 0", 1), ("cond do\n  Map.has_key?(m, k) and ok -> 1\n  true -> 2\nend", 1)], ["if ok, do: Map.has_key?(m, k), else: 0"]),
    "NoKeywordGetIntegerKey": ([("Keyword.get(xs, 0)", 1), ("xs |> Keyword.get(-1)", 1)], ["Keyword.get(xs, :a)"]),
    "NoEnumAtBinarySearch": ([("def s(l, lo, hi) do\n  mid = div(lo + hi, 2)\n  if Enum.at(l, mid) > 3, do: s(l, lo, mid), else: s(l, mid, hi)\nend", 1)], ["def s(l, lo, hi) do\n  mid = div(lo + hi, 2)\n  Enum.at(l, mid)\nend"]),
    "NoEnumAtMidpointAccess": ([("def s(l, lo, hi) do\n  mid = lo + div(hi - lo, 2)\n  Enum.at(l, mid)\nend", 1)], ["def s(l, i), do: Enum.at(l, i)"]),
    "NoEnumAtInLoop": ([("for i <- 0..3, do: Enum.at(xs, i)", 1), ("Enum.map(is, fn i -> Enum.at(xs, i) end)", 1)], ["Enum.at(xs, 3)"]),
    "NoEnumAtLoopAccess": ([("for i <- 0..3, do: Enum.at(xs, i)", 1), ("Enum.map(is, fn i -> Enum.at(xs, -1) end)", 1)], ["for i <- 0..3, do: Enum.at(xs, 0)", "Enum.at(xs, i)"]),
    "NoEnumAtNegativeIndex": ([("Enum.at(xs, -1)", 1), ("xs |> Enum.at(-2)", 1)], ["Enum.at(xs, 1)"]),
    "NoListDeleteAtInLoop": ([("for i <- is, do: List.delete_at(xs, i)", 1), ("Enum.map(is, fn i -> List.delete_at(xs, i) end)", 1)], ["List.delete_at(xs, 1)"]),
    "NoMultipleEnumAt": ([("a = Enum.at(l, 0)\nb = Enum.at(l, 1)\nc = Enum.at(l, 2)", 1)], ["a = Enum.at(l, 0)\nb = Enum.at(l, 1)\nc = Enum.at(k, 2)"]),
    "NoLengthBasedIndexing": ([("n = length(xs)\nEnum.at(xs, n - 1)", 1)], ["n = length(xs)\nxs = f(xs)\nEnum.at(xs, n - 1)", "n = length(xs)\nEnum.at(ys, n - 1)"]),
    "NoListToTupleForAccess": ([("t = List.to_tuple(xs)\n{elem(t, 0), elem(t, 1)}", 1)], ["t = {1, 2}\nelem(t, 0)"]),
    "NoListAppendInLoop": ([("Enum.reduce(xs, [0], fn x, acc -> f(acc ++ [x]) end)", 1), ("for x <- xs do\n  ys ++ [x]\nend", 1)], ["Enum.reduce(xs, [], fn x, acc -> acc ++ [x] end)", "xs ++ ys"]),
    "NoListAppendInRecursion": ([("def go([], acc), do: acc\ndef go([h | t], acc), do: go(t, acc ++ [h])", 1)], ["def go([h | t], acc), do: go(t, [h | acc])"]),
    "NoListAppendInReduce": ([("Enum.reduce(xs, [], fn x, acc -> acc ++ [f(x)] end)", 1), ("xs |> Enum.reduce([], fn x, acc -> acc ++ [x] end)", 1)], ["Enum.reduce(xs, [], fn x, acc -> [x | acc] end)"]),
    "NoListFold": ([("List.foldl(xs, 0, fn x, acc -> x + acc end)", 1), ("List.foldr(xs, [], fn x, acc -> [x | acc] end)", 1)], ["Enum.reduce(xs, 0, f)"]),
    "PreferEnumReverseTwo": ([("Enum.reverse(a) ++ b", 1)], ["Enum.reverse(a, b)", "b ++ Enum.reverse(a)"]),
    "NoDestructureReconstruct": ([("case xs do\n  [a, b] -> f([a, b])\n  _ -> nil\nend", 1), ("def f([a, b]), do: g([a, b])", 1)], ["def f([a, b]), do: g([b, a])"]),
    "NoManualListLast": ([("def last([x]), do: x\ndef last([_ | t]), do: last(t)", 1)], ["def last([x]), do: x\ndef last([h | t]), do: last(t)"]),
    "NoEagerWithIndexInReduce": ([("Enum.reduce(Enum.with_index(xs), 0, f)", 1), ("xs |> Enum.with_index() |> Enum.reduce(0, f)", 1)], ["xs |> Enum.with_index() |> Enum.map(f)"]),
    "AvoidGraphemesEnumCount": ([("Enum.count(String.graphemes(s))", 1), ("s |> String.graphemes() |> Enum.count()", 1)], ["s |> String.graphemes() |> Enum.count(&f/1)"]),
    "AvoidGraphemesLength": ([("length(String.graphemes(s))", 1), ("s |> String.graphemes() |> length()", 1)], ["length(xs)"]),
    "NoGraphemePalindromeCheck": ([("g = String.graphemes(s)\ng == Enum.reverse(g)", 1), ("g = s |> String.downcase() |> String.to_charlist()\nEnum.reverse(g) == g", 1)], ["g = f(s)\ng == Enum.reverse(g)"]),
    "NoManualStringReverse": ([("s |> String.graphemes() |> Enum.reverse() |> Enum.join()", 1), ("Enum.join(Enum.reverse(String.graphemes(s)))", 1)], ["s |> String.split() |> Enum.reverse() |> Enum.join()"]),
    "NoIntegerToStringDigits": ([("String.to_charlist(Integer.to_string(n))", 1), ("n |> Integer.to_string() |> String.to_charlist()", 1)], ["String.to_charlist(s)"]),
    "NoSplitToCount": ([('length(String.split(s, ",")) - 1', 1)], ['length(String.split(s, ",")) - 2']),
    "NoStringConcatInLoop": ([('Enum.reduce(xs, "", fn x, acc -> acc <> f(x) end)', 1), ('xs |> Enum.reduce("", fn x, acc -> acc <> x end)', 1)], ['Enum.reduce(xs, "", fn x, acc -> x <> acc end)']),
    "NoStringConcatInLoopUnfixable": ([('Enum.reduce(xs, "", fn x, acc -> x <> acc end)', 1), ('for x <- xs, do: "a" <> x', 1)], ['"a" <> b', 'Enum.reduce(xs, "", fn x, acc -> acc <> x end)']),
    "NoStringLengthForCharCheck": ([("String.length(s) == 1", 1), ("1 != String.length(s)", 1)], ["String.length(s) == 2"]),
    "NoRedundantEnumJoinSeparator": ([('Enum.join(xs, "")', 1), ('xs |> Enum.map_join("", &f/1)', 1)], ['Enum.join(xs, ",")']),
    "UseMapJoin": ([('xs |> Enum.map(&f/1) |> Enum.join(",")', 1), ("Enum.join(Enum.map(xs, &f/1))", 1)], ["xs |> Enum.filter(&f/1) |> Enum.join()"]),
    "UnnecessaryGraphemeChunking": ([("s |> String.graphemes() |> Enum.chunk_every(3, 1, :discard) |> Enum.map(&Enum.join/1)", 1)], ["s |> String.graphemes() |> Enum.chunk_every(3) |> Enum.map(&Enum.join/1)"]),
    "UnnecessaryGraphemeChunkingUnfixable": ([("s |> String.graphemes() |> Enum.chunk_every(3) |> Enum.map(&f/1)", 1), ("s |> String.codepoints() |> Enum.chunk_by(g) |> Enum.map(&f/1) |> h()", 2)], ["s |> String.graphemes() |> Enum.chunk_every(3, 1, :discard) |> Enum.map(&Enum.join/1)"]),
    "NoPipedRegexReplace": ([('s |> Regex.replace(~r/a/, "b")', 1)], ['Regex.replace(~r/a/, s, "b")']),
    "NoRedundantBinarySyntax": ([('<<"abc">>', 1)], ['<<"abc", x>>', "~r/<<x>>/", "<<1>>"]),
    "NoLengthComparisonForEmpty": ([("length(xs) == 0", 1), ("length(xs) > 2", 1), ("0 < length(xs)", 1)], ["length(xs) == 6", "length(f(x)) == 0", "length(xs) >= 0"]),
    "NoLengthGuardToPattern": ([("def f(xs) when length(xs) > 0, do: xs", 1), ("def f(xs) when length(xs) == 2, do: xs", 1)], ["def f(xs) when length(xs) > 1, do: xs"]),
    "NoLengthInGuard": ([("def f(xs) when length(xs) > 1, do: xs", 1)], ["def f(xs) when length(xs) > 0, do: xs"]),
    "HallucinatedGuard": ([("def f(n) when is_pos_integer(n), do: n", 1)], ["def f(n) when is_integer(n), do: n"]),
    "NoGuardEqualityForPatternMatch": ([("def f(n) when n == 0, do: 1", 1), ("def f(a, n) when :x == a and n > 1, do: n", 1)], ["def f(n) when n == m, do: 1"]),
    "NoIsNilGuard": ([("def f(x) when is_nil(x), do: 1", 1), ("def f(x, y) when is_nil(x) and y > 1, do: y", 1)], ["def f(x) when is_nil(x) or x == 1, do: 1"]),
    "RedundantListGuard": ([("def f([h | t]) when is_list(t), do: h", 1)], ["def f(t) when is_list(t), do: t"]),
    "NoRedundantNegatedGuard": ([("def f(a, b) when a == b, do: 1\ndef f(a, b) when a != b, do: 2", 1)], ["def f(a, b) when a == b, do: 1\ndef f(a, b) when a > b, do: 2"]),
    "NoCaseTrueFalse": ([("case f(x) do\n  true -> 1\n  false -> 2\nend", 1), ("case x > 1 do\n  true -> 1\n  _ -> 2\nend", 1)], ["case flag do\n  true -> 1\n  false -> 2\nend"]),
    "NoCondTwoClauses": ([("cond do\n  x > 1 -> 1\n  true -> 2\nend", 1)], ["cond do\n  x > 1 -> 1\n  x > 0 -> 3\n  true -> 2\nend"]),
    "NoUnlessElse": ([("unless ok do\n  1\nelse\n  2\nend", 1)], ["unless ok do\n  1\nend"]),
    "NoAnonFnApplicationInPipe": ([("x |> (fn y -> y + 1 end).()", 1)], ["x |> f.()"]),
    "NoKernelOpInPipeline": ([("x |> f() |> Kernel.==(1)", 1)], ["x |> Kernel.+(1)"]),
    "NoRedundantAssignment": ([("def f(x) do\n  y = g(x)\n  y\nend", 1), ("def f(x) do\n  {a, b} = g(x)\n  {a, b}\nend", 1)], ["def f(x) do\n  y = g(x)\n  z\nend"]),
    "NoParamRebinding": ([("fn x -> x = x + 1\n x end", 1)], ["fn x -> y = x + 1\n y end", "fn _x -> _x = 1 end"]),
    "InconsistentParamNames": ([("def f(a), do: a\ndef f(b), do: b", 1)], ["def f(a), do: a\ndef f(_a), do: 1", "def f(0), do: 0\ndef f(b), do: b"]),
    "NoIsPrefixForNonGuard": ([("def is_valid(x), do: x", 1)], ["def is_nil(x), do: x", "def valid?(x), do: x"]),
    "NoUnderscoreFunctionName": ([("defp _go(x), do: x\ndefp _go(y), do: y", 1)], ["defp go(x), do: x", "def __using__(x), do: x"]),
    "NoKernelShadowing": ([("max = f(x)", 1), ("def f(length), do: length", 1), ("fn hd -> hd end", 1)], ["max(a, b)"]),
    "NonGroupedClauses": ([("defmodule M do\n  def f(1), do: 1\n  def g(x), do: x\n  def f(2), do: 2\nend", 1)], ["defmodule M do\n  def f(1), do: 1\n  def f(2), do: 2\n  def g(x), do: x\nend"]),
    "NoUnnecessaryCatchAllRaise": ([('def f(1), do: 1\ndef f(_), do: raise("no")', 1)], ["def f(_), do: 1", 'def f(x), do: raise("no")']),
    "NoDocFalseOnPrivate": ([("defmodule M do\n  @doc false\n  defp f(x), do: x\nend", 1)], ["defmodule M do\n  @doc false\n  def f(x), do: x\nend"]),
    "NoTrailingNewlineInDoc": ([('@doc "One line.\\n"\n', 1)], ['@doc "One line."\n', '@doc """\nOne line.\n"""\n']),
    "PreferHeredocForMultiLineDoc": ([('@doc "One.\\nTwo."\n', 1)], ['@doc "One."\n', '@doc """\nOne.\nTwo.\n"""\n']),
    "NoMissingRequireLogger": ([('defmodule M do\n  def f, do: Logger.info("x")\nend', 1)], ['defmodule M do\n  require Logger\n  def f, do: Logger.info("x")\nend']),
    "NoIdentityFloatCoercion": ([("f(x) * 1.0", 1), ("0.0 + g(x)", 1)], ["x * 1.0", "f(x) * 2.0"]),
    "PreferErlangFloat": ([("x * 1.0", 1), ("x / 1.0", 1)], ["f(x) * 1.0", "x * 2.0"]),
}


def sources(module: str) -> list[tuple[int, str, str]]:
    bad, clean = CASES[module]
    return [(i, f"bad/{i}.ex", code) for i, (code, _) in enumerate(bad, 1)] + [(i, f"clean/{i}.ex", code) for i, code in enumerate(clean, 1001)]
