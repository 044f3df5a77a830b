"""SQL table functions: the rules from a query over any table with source texts.

    SELECT t.id, i.* FROM sources t, LATERAL elixir_issues(t.code) i
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomlint.operators.analysis import found_in
from loomlint.operators.fix import fix_derived, fix_idioms
from loomlint.session import ship_package


class ElixirIssues:
    def eval(self, code: str):
        for i in found_in(code or "", derive=True)[1]:
            yield i["phase"], i["rule"], i["message"], i["line"]


class ElixirFix:
    def eval(self, code: str):
        fixed, _, clean = fix_derived(code or "")
        yield (fix_idioms(fixed)[0] if clean else fixed,)


def register(spark: SparkSession) -> None:
    """Make ``elixir_issues(code)`` and ``elixir_fix(code)`` known to a session."""
    ship_package(spark)
    spark.udtf.register("elixir_issues", udtf(ElixirIssues, returnType="phase string, rule string, message string, line int"))
    spark.udtf.register("elixir_fix", udtf(ElixirFix, returnType="code string"))
