import pytest
from pyspark.sql import functions as F

from loomlint.functions.tree import Tree
from loomlint.operators import analysis, fix, matcher, semantic, syntax
from loomlint.plans.nodes import nodes
from loomlint.sources.corpus import diff, fixture_corpus, joined, lines, read_folder, write_table


def corpus(spark, *codes):
    return spark.createDataFrame([(i, f"{i}.ex", c) for i, c in enumerate(codes, 1)], "source_id long, path string, code string")


def fixed(spark, *codes, only=None):
    return {r.source_id: r.code for r in syntax.fix_lines(corpus(spark, *codes), only).collect()}


def test_lines_keep_trailing_blanks_and_come_back(spark):
    source = corpus(spark, "a\n\nb\n", "", None)
    assert sorted(map(tuple, lines(source).collect())) == [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (1, 4, ""), (2, 1, "")]
    assert {r.source_id: r.code for r in joined(lines(source)).collect()} == {1: "a\n\nb\n", 2: ""}


def test_diff_is_by_place(spark):
    got = sorted(map(tuple, diff(corpus(spark, "a\nb\nc"), corpus(spark, "a\nx")).collect()))
    assert got == [(1, "added", 2, "x"), (1, "removed", 2, "b"), (1, "removed", 3, "c")]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("x = n * 3 div 2", "x = div(n * 3, 2)"),
        ("y = a rem b", "y = rem(a, b)"),
        ("# a div b", "# a div b"),
        ("x |> div(2)", "x |> div(2)"),
        ("n % 2 == 1", "rem(n, 2) == 1"),
        ("n % 25.0", "rem(n, 2)5.0"),
        ("x = 1e-9 + 1.5e3", "x = 1.0e-9 + 1.5e3"),
        ("1.55e3", "1.55.0e3"),
        ("  private defp f(x), do: x", "  defp f(x), do: x"),
        ("pprivate def g, do: 1", "def g, do: 1"),
        ("@spec g(list(atom()) :: atom())", "@spec g(list(atom())) :: atom()"),
        ("@spec h(a :: b) :: c", "@spec h(a :: b) :: c"),
        ("  @spec k?(x :: y :: z)", "  @spec k?(x :: y) :: z"),
        ("@spec u(a", "@spec u(a"),
    ],
)
def test_syntax_rewrites(spark, before, after):
    assert fixed(spark, before)[1] == after


def test_syntax_issues_gate_the_rest(spark):
    found = analysis.analyze(fixture_corpus(spark)).collect()
    by = {}
    for r in found:
        by.setdefault(r.source_id, []).append((r.phase, r.rule))
    assert by[1] == [("syntax", "infix_div")]
    assert by[2] == [("syntax", "python_modulo")]
    assert by[3] == [("syntax", "python_scientific_notation")]
    assert by[6] == [("pattern", "no_sort_for_top_k")]
    assert by[8] == [("pattern", "no_repeated_enum_traversal")] * 2
    assert 9 not in by


def test_parse_errors_are_reported(spark):
    got = analysis.analyze(corpus(spark, "def f(", "x = 1", None)).collect()
    assert [(r.source_id, r.rule) for r in got] == [(1, "parse_error")]


def test_verdicts_and_rule_subset(spark):
    source = fixture_corpus(spark)
    v = {r.source_id: r.valid for r in analysis.verdicts(source, analysis.analyze(source, rules=["NoSortForTopK"])).collect()}
    assert v[6] is False and v[7] is True and v[9] is True


def test_empty_corpus(spark):
    empty = corpus(spark, "x").limit(0)
    assert analysis.analyze(empty).count() == 0
    assert fix.fix(empty).count() == 0
    assert nodes(empty).count() == 0


DIAG = "source_id long, ord int, severity string, message string, line int, col int"


def test_dispatch_takes_the_first_rule_and_one_severity(spark):
    rows = [
        (1, 0, "warning", 'variable "x" is unused', 1, None),
        (1, 1, "error", "undefined function describe/2", 2, None),
        (2, 0, "warning", "String.alphanumeric?/1 is undefined or private", 1, 1),
        (2, 1, "warning", "no rule for this", 1, 1),
        (3, 0, "warning", "Enum.partition/2 is deprecated", None, None),
    ]
    got = {(r.source_id, r.ord): r.rule for r in semantic.dispatched(spark.createDataFrame(rows, DIAG)).collect()}
    assert got == {(1, 1): "missing_use_exunit_case", (2, 0): "undefined_string_alphanumeric", (3, 0): "undefined_function"}


@pytest.mark.parametrize(
    ("line", "module", "message", "after"),
    [
        ("Enum.last(xs)", "UndefinedFunction", "Enum.last/1 is undefined or private", "List.last(xs)"),
        ("-Float.inf()", "UndefinedFunction", "Float.inf/0 is undefined or private", ":neg_infinity"),
        ("Float.inf", "UndefinedFunction", "Float.inf/0 is undefined or private", ":infinity"),
        ("List.second(f(a, b))", "UndefinedFunction", "List.second/1 is undefined or private", "Enum.at(f(a, b), 1)"),
        ("Enum.take_last(xs, n + 1)", "UndefinedFunction", "Enum.take_last/2 is undefined or private", "Enum.take(xs, -(n + 1))"),
        ("xs |> Enum.take_last(3)", "UndefinedFunction", "Enum.take_last/2 is undefined or private", "xs |> Enum.take(-3)"),
        ("len(xs) + a.len(xs)", "UndefinedFunction", "undefined function len/1", "length(xs) + a.len(xs)"),
        ("max(a, b, c)", "UndefinedFunction", "undefined function max/3", "Enum.max([a, b, c])"),
        ("range(1, f(n))", "UndefinedFunction", "undefined function range/2", "1..f(n) - 1"),
        ("range(a, b, 2)", "UndefinedFunction", "undefined function range/3", "a..b//2"),
        ("counter = count", "UnusedVariable", 'variable "count" is unused', "counter = _count"),
        ("String.alphanumeric?(c)", "UndefinedStringAlphanumeric", "x", "String.match?(c, ~r/^[a-zA-Z0-9]$/)"),
    ],
)
def test_diagnosed_lines(line, module, message, after):
    assert semantic.rewrite(f"a\n{line}\nb", module, message, 2) == f"a\n{after}\nb"


def test_diagnosed_blocks():
    code = "def f(_x) do\n  _x + 1\nend\ndef g(_x), do: 1"
    assert semantic.rewrite(code, "UsedUnderscoreVariable", 'variable "_x" is used after being set', 2) == "def f(x) do\n  x + 1\nend\ndef g(_x), do: 1"
    doc = '  @doc """\n bad\n  good\n  """'
    assert semantic.rewrite(doc, "OutdentedHeredoc", "outdented heredoc line", 2) == '  @doc """\n  bad\n  good\n  """'
    test = "defmodule T do\n  alias A\n  test \"x\" do\n    1\n  end\nend"
    assert "alias A\n  use ExUnit.Case\n" in semantic.rewrite(test, "MissingUseExunitCase", "undefined function test/2", 3)


LADDER = [("sorted", "sorted?", 100), ("store", "store!", 95), ("blank__", "blank?", 90), ("wipe__", "wipe!", 85), ("factorial", "fact", 80), ("scan", "scan_rows", 75), ("walk", "do_walk", 70), ("martha", "marhta", 57)]


def test_the_score_ladder(spark):
    matcher_rows = spark.createDataFrame(LADDER, "a string, b string, want int")
    from loomlint.session import ship_package

    ship_package(spark)
    assert [r.got for r in matcher_rows.select("a", matcher.score(F.col("a"), F.col("b")).alias("got")).collect()] == [w for _, _, w in LADDER]
    assert [matcher.plain_score(a, b) for a, b, _ in LADDER] == [w for _, _, w in LADDER]


def test_suggestions():
    t = Tree("defmodule A.B do\n  def scan_rows(x), do: x\n  defp scan(x), do: x\n  def scan_all(x, y), do: x + y\nend")
    assert matcher.suggest(t, "A.B", "scans", 1) == "scan"
    assert matcher.suggest(t, "A.B", "scans", 1, public_only=True) == "scan_rows"
    assert matcher.suggest(t, "A.B", "scans", 3) is None
    assert matcher.suggest(t, "C", "scans", 1) is None


def test_ranked_candidates(spark):
    from loomlint.session import ship_package

    ship_package(spark)
    functions = spark.createDataFrame([(1, "M", 0, "walk", 1, "defp"), (1, "M", 1, "do_walk", 1, "def"), (1, "M", 2, "walk", 2, "def")], "source_id long, module string, ord int, function string, arity int, visibility string")
    asked = spark.createDataFrame([(1, "M", "walks", 1, True)], "source_id long, module string, name string, arity int, public_only boolean")
    assert [(r.function, r.rank) for r in matcher.candidates(asked, functions).collect()] == [("do_walk", 1)]


def test_fix_runs_all_phases(spark):
    code = "def f(xs) do\n  y = Enum.sort(xs) |> Enum.reverse()\n  y\nend"
    got = {r.source_id: (r.code, [a.rule for a in r.applied]) for r in fix.fix(corpus(spark, code, "x = 7 div 2", "a +", None)).collect()}
    assert got[1] == ("def f(xs) do\n  Enum.sort(xs, :desc)\nend", ["NoRedundantAssignment", "NoSortThenReverse"])
    assert got[2] == ("x = div(7, 2)", ["FixDivRem"])
    assert got[3] == ("a +", [])
    assert got[4][0] is None


def test_fix_with_diagnostics_then_leftovers(spark):
    source = corpus(spark, "def f(xs), do: sorted(xs)")
    told = spark.createDataFrame([(1, 0, "error", "undefined function sorted/1", 1, 1)], DIAG)
    done, left = fix.fix_and_analyze(source, told)
    assert done.first().code == "def f(xs), do: Enum.sort(xs)"
    assert left.count() == 0


def test_rows_that_share_an_id_are_sources_of_their_own(spark):
    source = spark.createDataFrame([(1, None, "a = 1\nx = 7 rem 2\nb"), (1, None, "(\nb = 2"), (None, None, "Enum.at(xs, -1)")], "source_id long, path string, code string")
    assert sorted((str(r.source_id), r.code) for r in fix.fix(source).collect()) == [("1", "(\nb = 2"), ("1", "a = 1\nx = rem(7, 2)\nb"), ("None", "List.last(xs)")]
    plan = fix.fix(source)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_line_rewrites_keep_rows_and_columns(spark):
    source = spark.createDataFrame([(1, "x", "  private defp f(x), do: x % 2\n"), (1, "y", None), (2, "z", "")], "source_id long, path string, code string")
    got = {(r.source_id, r.path): (r.code, [a.rule for a in r.applied]) if r.code is not None else None for r in syntax.fix_lines(source).collect()}
    assert got == {(1, "x"): ("  defp f(x), do: rem(x, 2)\n", ["FixPythonModulo", "FixStaleAccessModifier"]), (1, "y"): None, (2, "z"): ("", [])}


def test_idioms_wait_for_supplied_errors(spark):
    code = "def f(xs), do: Enum.at(xs, -1) + g(xs)"
    told = lambda *rows: spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], DIAG)
    kept = fix.fix(corpus(spark, code), told(("error", 'undefined variable "q"', 1, 1))).first()  # no rule takes it
    assert (kept.code, kept.applied) == (code, [])
    idle = fix.fix(corpus(spark, code), told(("error", "undefined function sorted/1", 1, 1))).first()  # its rule changes nothing
    assert (idle.code, [tuple(a) for a in idle.applied]) == (code, [("UndefinedFunction", 1)])
    done = fix.fix(corpus(spark, code), told(("warning", 'variable "q" is unused', 1, 1))).first()
    assert [tuple(a) for a in done.applied] == [("UnusedVariable", 1), ("NoEnumAtNegativeIndex", 1)] and "List.last(xs)" in done.code


def test_an_entry_for_each_application(spark):
    done = fix.fix(corpus(spark, "def f(a, b), do: 1", "x = 7 div 2 + 9 % 4")).collect()
    assert [[tuple(a) for a in r.applied] for r in done] == [[("UnusedVariable", 1), ("UnusedVariable", 1)], [("FixDivRem", 1), ("FixPythonModulo", 1)]]


def test_analyze_with_diagnostics_parses_once(spark):
    told = spark.createDataFrame([(1, 0, "warning", 'variable "x" is unused', 1, None), (2, 0, "warning", 'variable "y" is unused', 1, None)], DIAG)
    found = analysis.analyze(corpus(spark, "Enum.at(xs, -1)", "x = 7 div 2", "a"), told)
    assert [(r.source_id, r.rule) for r in found.orderBy("source_id", "phase", F.desc("rule")).collect()] == [(1, "no_enum_at_negative_index"), (1, "unused_variable"), (2, "infix_div")]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_trace():
    assert fix.trace("a\nb", "a\nc\nd") == [("removed", 2, "b"), ("added", 2, "c"), ("added", 3, "d")]


def test_traced_fix(spark):
    source = corpus(spark, "def f(xs, n) do\n  Enum.at(xs, -1)\nend", "x", None, "a = 7 div 2\nb = Enum.sort(a) |> hd()")
    got = sorted((r.source_id, r.step, r.rule, r.op, r.line_no, r.text.strip()) for r in fix.traced(source).collect())
    assert got == [
        (1, 0, "UnusedVariable", "added", 1, "def f(xs, _n) do"),
        (1, 0, "UnusedVariable", "removed", 1, "def f(xs, n) do"),
        (1, 1, "NoEnumAtNegativeIndex", "added", 2, "List.last(xs)"),
        (1, 1, "NoEnumAtNegativeIndex", "removed", 2, "Enum.at(xs, -1)"),
        (4, 0, "FixDivRem", "added", 1, "a = div(7, 2)"),
        (4, 0, "FixDivRem", "removed", 1, "a = 7 div 2"),
        (4, 1, "NoSortForTopK", "added", 2, "b = Enum.min(a)"),
        (4, 1, "NoSortForTopK", "removed", 2, "b = Enum.sort(a) |> hd()"),
    ]


def test_node_table_is_interval_encoded(spark):
    rows = nodes(corpus(spark, "xs |> Enum.map(&f/1) |> Enum.sum()")).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert all(r.parent is None or rows[r.parent].id < r.id <= rows[r.parent].last_desc for r in rows)
    assert [r.name for r in sorted((r for r in rows if r.pipe_step is not None), key=lambda r: r.pipe_step)] == ["xs", "map", "sum"]


def test_folders_and_tables(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.ex").write_text("x = 1\n")
    (tmp_path / "in" / "deep" / "b.exs").write_text("length(xs) == 0\n")
    (tmp_path / "in" / "c.txt").write_text("not this")
    source = read_folder(spark, str(tmp_path / "in"))
    assert source.count() == 2
    write_table(analysis.analyze(source), str(tmp_path / "out"))
    assert [r.rule for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["no_length_comparison_for_empty"]
