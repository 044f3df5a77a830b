import pytest

from loomlint.functions.table_functions import register
from loomlint.functions.tree import Tree
from loomlint.operators.analysis import analyze, found_in
from loomlint.operators.diagnose import diagnose
from loomlint.operators.fix import fix, fix_derived
from loomlint.streaming.files import watch_folder, write_issues


@pytest.mark.parametrize(
    ("code", "messages"),
    [
        ("def f(a, b), do: a", ['variable "b" is unused']),
        ("def f(a, _b), do: a", []),
        ("def f(_a), do: _a + 1", ['the underscored variable "_a" is used after being set']),
        ("def f(x) do\n  case x do\n    {:ok, _v} -> 1\n    {:error, _v} -> 2\n  end\nend", []),
        ('def f(x), do: "#{x}"', []),
        ("def f(x) do\n  y = g(x)\n  x\nend", ['variable "y" is unused']),
        ("def f(x), do: Enum.filter(x, fn y -> y > 1 end)", []),
        ("def f(x), do: List.second(x)", ["List.second/1 is undefined or private"]),
        ("def f(x), do: x |> List.pop()", ["List.pop/1 is undefined or private"]),
        ("def f(x), do: Enum.partition(x, &g/1)", ["Enum.partition/2 is deprecated"]),
        ("defmodule M do\n  def f(x), do: len(x)\nend", ["undefined function len/1 (expected M to define such a function or for it to be imported)"]),
        ("defmodule M do\n  def len(x), do: x\n  def f(x), do: len(x)\nend", []),
        ("defmodule M do\n  use N\n  def f(x), do: len(x)\nend", []),
        ('defmodule M do\n  @doc """\n bad\n  """\n  def f, do: 1\nend', ["outdented heredoc line"]),
        ("defmodule M do\n  defmodule N do\n    def sum(xs), do: xs\n    def g(xs), do: sum(xs)\n  end\nend", []),
        ("defmodule M do\n  def len(x), do: x\n  defmodule N do\n    def g(xs), do: {len(xs), sorted(xs)}\n  end\nend", ["undefined function sorted/1 (expected N to define such a function or for it to be imported)"]),
        ("defmodule M do\n  import X\n  defmodule N do\n    def g(xs), do: len(xs)\n  end\nend", []),
        ('defmodule T do\n  test "x" do\n    1\n  end\nend', ["undefined function test/2 (there is no such import)"]),
    ],
)
def test_derived(code, messages):
    assert [m for _, m, _ in diagnose(Tree(code))] == messages


def test_errors_first_then_warnings():
    code = "defmodule M do\n  def f(xs, n), do: sorted(xs)\nend"
    assert [i["rule"] for i in found_in(code, [], derive=True)[1]] == ["undefined_function"]
    fixed, applied, clean = fix_derived(code)
    assert fixed == "defmodule M do\n  def f(xs, _n), do: Enum.sort(xs)\nend" and clean
    assert applied == [("UndefinedFunction", 1), ("UnusedVariable", 1)]


def test_a_module_of_many_idioms(spark):
    code = '''defmodule Stats do
  @doc false
  defp top(xs), do: Enum.sort(xs) |> Enum.reverse() |> hd()

  def is_blank(s), do: length(String.graphemes(s)) == 0

  def total(xs) do
    sum = Enum.map(xs, fn x -> x * 2 end) |> Enum.sum()
    sum
  end

  def last(xs), do: Enum.at(xs, -1)

  def words(s), do: s |> String.split() |> Enum.map(&String.upcase/1) |> Enum.join(" ")

  def flag(x) do
    case top(x) > 1 do
      true -> :big
      false -> :small
    end
  end
end
'''
    source = spark.createDataFrame([(1, "stats.ex", code)], "source_id long, path string, code string")
    done = fix(source).first()
    want = {"NoDocFalseOnPrivate", "NoSortForTopK", "NoIsPrefixForNonGuard", "AvoidGraphemesLength", "NoRedundantAssignment", "NoMapThenAggregate", "NoEnumAtNegativeIndex", "UseMapJoin", "NoCaseTrueFalse"}
    assert {a.rule for a in done.applied} == want
    again = source.sparkSession.createDataFrame([(1, None, done.code)], "source_id long, path string, code string")
    assert analyze(again).count() == 0
    assert fix(again).first().code == done.code


def test_a_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ex").write_text("Enum.at(xs, -1)\n")
    out, at = str(tmp_path / "out"), str(tmp_path / "cp")
    write_issues(watch_folder(spark, str(tmp_path / "in")), out, at, available_now=True).awaitTermination(120)
    (tmp_path / "in" / "b.ex").write_text("def f(")
    write_issues(watch_folder(spark, str(tmp_path / "in")), out, at, available_now=True).awaitTermination(120)
    assert sorted(r.rule for r in spark.read.parquet(out).collect()) == ["no_enum_at_negative_index", "parse_error"]


def test_table_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "length(xs) == 0"), (2, "x"), (3, None)], "id long, code string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("SELECT t.id, i.rule, i.line FROM texts t, LATERAL elixir_issues(t.code) i").collect()] == [(1, "no_length_comparison_for_empty", 1)]
    assert sorted(tuple(r) for r in spark.sql("SELECT t.id, f.code FROM texts t, LATERAL elixir_fix(t.code) f").collect()) == [(1, "xs == []"), (2, "x"), (3, "")]
