"""Idiom rules in SQL over node rows, for those whose shape is a join of nodes.

The rows are the nodes of a rule's fixture sources, written out as values, so another engine can hold the Python rules
against these definitions.  ``arg`` numbers arguments from 0; ``fed`` pairs a call with what feeds it: the step before
it in a pipeline, or its first argument.
"""

from __future__ import annotations

from loomlint.functions.tree import Tree
from loomlint.plans import fixtures, patterns
from loomlint.plans.nodes import node_rows

_COLUMNS = "source_id, id, parent, ord, last_desc, kind, name, mod, arity, line, lit_type, lit, tgt"
_CTES = """
node AS (SELECT CAST(source_id AS BIGINT) AS source_id, * EXCLUDE (source_id) FROM raw),
arg AS (SELECT c.*, p.id AS pid, p.kind AS pkind, p.name AS pname, p.mod AS pmod, p.arity AS parity, p.line AS pline, c.ord - p.tgt AS i
  FROM node c JOIN node p ON c.source_id = p.source_id AND c.parent = p.id WHERE c.ord >= p.tgt),
pipe AS (SELECT p.source_id, p.id, p.line, l.id AS left_id, r.id AS right_id FROM node p
  JOIN node l ON l.source_id = p.source_id AND l.parent = p.id AND l.ord = 0 JOIN node r ON r.source_id = p.source_id AND r.parent = p.id AND r.ord = 1 WHERE p.kind = 'call' AND p.name = '|>'),
fed AS (SELECT p.source_id, p.line, p.right_id AS call_id, coalesce(q.right_id, p.left_id) AS feeder_id, true AS piped, q.id IS NOT NULL AS long FROM pipe p LEFT JOIN pipe q ON q.source_id = p.source_id AND q.id = p.left_id
  UNION ALL SELECT source_id, pline, pid, id, false, false FROM arg WHERE i = 0 AND pkind IN ('call', 'remote') AND pname IS DISTINCT FROM '|>'),
negative AS (SELECT m.source_id, m.id, n.lit FROM node m JOIN node n ON n.source_id = m.source_id AND n.parent = m.id WHERE m.kind = 'call' AND m.name = '-' AND m.arity = 1 AND n.lit_type = 'int'),
held AS (SELECT a.source_id, a.pid AS id, a.name AS var FROM arg a WHERE a.i = 0 AND a.kind = 'var'),
loops AS (SELECT source_id, id, last_desc, kind, name FROM node WHERE kind = 'call' AND name = 'for' OR kind = 'remote' AND mod = 'Enum')
"""


def _calls(mod: str, names: str, arity: str = "true") -> str:
    return f"SELECT source_id, line FROM node WHERE kind = 'remote' AND mod = '{mod}' AND name IN ({names}) AND {arity}"


def _feeds(call: str, feeder: str, more: str = "true") -> str:
    return f"SELECT f.source_id, f.line FROM fed f JOIN node c ON c.source_id = f.source_id AND c.id = f.call_id JOIN node d ON d.source_id = f.source_id AND d.id = f.feeder_id WHERE {call} AND {feeder} AND {more}"


def _is(alias: str, mod: str, name: str) -> str:
    return f"{alias}.kind = 'remote' AND {alias}.mod = '{mod}' AND {alias}.name = '{name}'"


def _last_arg(mod: str, name: str, test: str) -> str:
    return f"SELECT source_id, pline AS line FROM arg a WHERE pkind = 'remote' AND pmod = '{mod}' AND pname = '{name}' AND i = parity - 1 AND {test}"


def _in_loop(mod: str, name: str, loops: str) -> str:
    return f"SELECT DISTINCT n.source_id, n.line FROM node n JOIN loops l ON l.source_id = n.source_id AND n.id > l.id AND n.id <= l.last_desc WHERE (l.kind = 'call' OR l.name IN ({loops})) AND n.kind = 'remote' AND n.mod = '{mod}' AND n.name = '{name}'"


def _neutral(bare: bool) -> str:
    return f"""SELECT o.source_id, o.line FROM node o JOIN arg x ON x.source_id = o.source_id AND x.pid = o.id AND x.i = 0 JOIN arg y ON y.source_id = o.source_id AND y.pid = o.id AND y.i = 1
WHERE o.kind = 'call' AND o.arity = 2 AND (y.lit_type = 'float' AND (o.name IN ('*', '/') AND y.lit = '1.0' OR o.name IN ('+', '-') AND y.lit = '0.0') AND (x.kind = 'var') = {bare}
OR y.lit_type IS DISTINCT FROM 'float' AND x.lit_type = 'float' AND (o.name = '*' AND x.lit = '1.0' OR o.name = '+' AND x.lit = '0.0') AND (y.kind = 'var') = {bare})"""


_PIPED = "EXISTS (SELECT 1 FROM pipe p WHERE p.source_id = a.source_id AND p.right_id = a.pid)"
_NEGATIVE = "EXISTS (SELECT 1 FROM negative n WHERE n.source_id = a.source_id AND n.id = a.id)"
DEFINITIONS = {
    "NoListFold": _calls("List", "'foldl', 'foldr'"),
    "NoMapAsSet": _last_arg("Map", "put", "lit_type = 'atom' AND lit IN ('true', 'false')"),
    "NoEnumCountForLength": "SELECT n.source_id, n.line FROM node n WHERE n.kind = 'remote' AND n.mod = 'Enum' AND n.name = 'count' AND n.arity <= 1 AND NOT EXISTS (SELECT 1 FROM arg a WHERE a.source_id = n.source_id AND a.pid = n.id AND (a.kind = 'fn' OR a.kind = 'call' AND a.name = '&'))",
    "NoEnumTakeNegative": _last_arg("Enum", "take", _NEGATIVE),
    "NoEnumDropNegative": _last_arg("Enum", "drop", _NEGATIVE),
    "NoEnumAtNegativeIndex": _last_arg("Enum", "at", f"{_NEGATIVE} AND (parity = 2 OR {_PIPED})"),
    "NoKeywordGetIntegerKey": _last_arg("Keyword", "get", f"(lit_type = 'int' OR {_NEGATIVE})"),
    "NoRedundantEnumJoinSeparator": "SELECT source_id, pline AS line FROM arg WHERE pkind = 'remote' AND pmod = 'Enum' AND lit_type = 'str' AND lit = '' AND (pname = 'join' AND i = parity - 1 OR pname = 'map_join' AND i = parity - 2)",
    "HallucinatedGuard": "SELECT source_id, line FROM node WHERE kind = 'call' AND arity = 1 AND name IN ('is_pos_integer', 'is_non_neg_integer', 'is_neg_integer', 'is_non_pos_integer')",
    "NoPipedRegexReplace": f"SELECT p.source_id, p.line FROM pipe p JOIN node c ON c.source_id = p.source_id AND c.id = p.right_id WHERE {_is('c', 'Regex', 'replace')}",
    "NoKernelOpInPipeline": "SELECT p.source_id, c.line FROM pipe p JOIN node c ON c.source_id = p.source_id AND c.id = p.right_id WHERE c.kind = 'remote' AND c.mod = 'Kernel' AND c.arity = 1 AND c.name IN ('==', '!=', '===', '!==', '<', '>', '<=', '>=', 'and', 'or')",
    "PreferEnumReverseTwo": "SELECT source_id, pline AS line FROM arg a WHERE pkind = 'call' AND pname = '++' AND i = 0 AND kind = 'remote' AND mod = 'Enum' AND name = 'reverse' AND arity = 1",
    "NoEagerWithIndexInReduce": _feeds(_is("c", "Enum", "reduce"), _is("d", "Enum", "with_index")),
    "AvoidGraphemesEnumCount": _feeds(_is("c", "Enum", "count") + " AND c.arity = CASE WHEN f.piped THEN 0 ELSE 1 END", _is("d", "String", "graphemes")),
    "AvoidGraphemesLength": _feeds("c.kind = 'call' AND c.name = 'length'", _is("d", "String", "graphemes")),
    "NoIntegerToStringDigits": _feeds(_is("c", "String", "to_charlist"), _is("d", "Integer", "to_string")),
    "UseMapJoin": _feeds(_is("c", "Enum", "join"), _is("d", "Enum", "map")),
    "PreferEnumSlice": _feeds(
        _is("c", "Enum", "take") + " AND c.arity = CASE WHEN f.piped THEN 1 ELSE 2 END", _is("d", "Enum", "drop") + " AND d.arity = CASE WHEN f.long THEN 1 ELSE 2 END"
    ),
    "NoMapKeysOrValuesForRawIteration": _feeds(
        "c.kind = 'remote' AND c.mod = 'Enum' AND (c.name IN (" + ", ".join(f"'{n}'" for n in patterns.NOT_OVER_PAIRS) + ") OR c.name = 'group_by' AND c.arity - CASE WHEN f.piped THEN 0 ELSE 1 END < 2)",
        "d.kind = 'remote' AND d.mod = 'Map' AND d.name IN ('keys', 'values')",
    ),
    "NoMapKeysOrValuesForIteration": _feeds(
        "c.kind = 'remote' AND c.mod = 'Enum' AND c.name IN (" + ", ".join(f"'{n}'" for n in patterns.OVER_PAIRS) + ") AND NOT (c.name = 'group_by' AND c.arity - CASE WHEN f.piped THEN 0 ELSE 1 END < 2)",
        "d.kind = 'remote' AND d.mod = 'Map' AND d.name IN ('keys', 'values')",
    ),
    "NoRepeatedEnumTraversal": "SELECT source_id, line FROM (SELECT n.source_id, n.line, count(*) OVER (PARTITION BY n.source_id, h.var) AS k FROM node n JOIN held h ON h.source_id = n.source_id AND h.id = n.id WHERE n.kind = 'remote' AND n.mod = 'Enum' AND n.name IN ('count', 'max', 'min', 'sum', 'member?', 'any?', 'all?', 'find', 'find_value')) WHERE k > 1",
    "NoMultipleEnumAt": f"SELECT n.source_id, min(n.line) AS line FROM node n JOIN held h ON h.source_id = n.source_id AND h.id = n.id JOIN arg a ON a.source_id = n.source_id AND a.pid = n.id AND a.i = 1 WHERE {_is('n', 'Enum', 'at')} AND n.arity = 2 AND (a.lit_type = 'int' OR {_NEGATIVE}) GROUP BY n.source_id, h.var HAVING count(*) >= 3",
    "NoMapUpdateThenFetch": "SELECT n.source_id, n.line FROM node n JOIN held h ON h.source_id = n.source_id AND h.id = n.id WHERE n.kind = 'remote' AND n.mod = 'Map' AND n.name IN ('fetch!', 'get') AND EXISTS (SELECT 1 FROM held e JOIN node b ON b.source_id = e.source_id AND b.id = e.id AND b.kind = 'call' AND b.name = '=' JOIN arg u ON u.source_id = b.source_id AND u.pid = b.id AND u.i = 1 WHERE e.source_id = n.source_id AND e.var = h.var AND u.kind = 'remote' AND u.mod = 'Map' AND u.name IN ('update', 'update!'))",
    "NoSplitToCount": "SELECT a.source_id, a.pline AS line FROM arg a JOIN arg one ON one.source_id = a.source_id AND one.pid = a.pid AND one.i = 1 JOIN arg s ON s.source_id = a.source_id AND s.pid = a.id WHERE a.pkind = 'call' AND a.pname = '-' AND a.parity = 2 AND a.i = 0 AND a.kind = 'call' AND a.name = 'length' AND one.lit_type = 'int' AND one.lit = '1' AND s.kind = 'remote' AND s.mod = 'String' AND s.name = 'split' AND s.arity = 2",
    "NoStringLengthForCharCheck": "SELECT a.source_id, a.pline AS line FROM arg a JOIN arg b ON b.source_id = a.source_id AND b.pid = a.pid AND b.i = 1 - a.i WHERE a.pkind = 'call' AND a.pname IN ('==', '!=', '===', '!==') AND a.parity = 2 AND a.kind = 'remote' AND a.mod = 'String' AND a.name = 'length' AND a.arity = 1 AND b.lit_type = 'int' AND b.lit = '1'",
    "NoListDeleteAtInLoop": _in_loop("List", "delete_at", "'reduce', 'map', 'flat_map', 'each', 'filter'"),
    "NoEnumAtInLoop": _in_loop("Enum", "at", "'reduce', 'reduce_while', 'map', 'flat_map', 'each', 'filter'"),
    "NoIdentityFloatCoercion": _neutral(False),
    "PreferErlangFloat": _neutral(True),
    "NoUnlessElse": "SELECT u.source_id, u.line FROM node u JOIN arg k ON k.source_id = u.source_id AND k.pid = u.id AND k.i = 1 JOIN arg p ON p.source_id = u.source_id AND p.pid = k.id JOIN arg e ON e.source_id = u.source_id AND e.pid = p.id AND e.i = 0 WHERE u.kind = 'call' AND u.name = 'unless' AND u.arity = 2 AND e.lit = 'else'",
    "NoRedundantBinarySyntax": "SELECT b.source_id, b.line FROM node b JOIN arg s ON s.source_id = b.source_id AND s.pid = b.id WHERE b.kind = 'bits' AND s.lit_type = 'str' AND (SELECT count(*) FROM arg x WHERE x.source_id = b.source_id AND x.pid = b.id) = 1",
    "NoLengthInGuard": "SELECT g.source_id, g.line FROM node g JOIN node w ON w.source_id = g.source_id AND w.kind = 'call' AND w.name = 'when' AND g.id > w.id AND g.id <= w.last_desc JOIN node d ON d.source_id = w.source_id AND d.id = w.parent AND d.name IN ('def', 'defp') LEFT JOIN node c ON c.source_id = g.source_id AND c.id = g.parent LEFT JOIN arg k ON k.source_id = g.source_id AND k.pid = c.id AND k.i = 1 WHERE g.kind = 'call' AND g.name = 'length' AND g.arity = 1 AND NOT coalesce(g.ord = 0 AND (c.name = '>' AND k.lit = '0' OR c.name = '==' AND k.lit_type = 'int' AND CAST(k.lit AS INTEGER) BETWEEN 1 AND 5), false)",
}


def _literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def oracle(module: str) -> str:
    """SQL for a rule's query: its definition over the nodes of its fixture sources."""
    rows = []
    for source_id, _, code in fixtures.sources(module):
        tree = Tree(code)
        targets = [int(n.target is not None) for n in tree.nodes]
        for r, tgt in zip(node_rows(source_id, tree), targets, strict=True):
            rows.append((r[0], r[1], r[2], r[3], r[5], r[6], r[7], r[8], r[9], r[10], r[14], r[15], tgt))
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    name = next(r.rule for r in patterns.RULES if r.module == module)
    return f"WITH raw({_COLUMNS}) AS (VALUES {values}), {_CTES} SELECT source_id, '{name}' AS rule, CAST(line AS BIGINT) AS line FROM ({DEFINITIONS[module]})"


ORACLES = {f"pattern_{m}": oracle(m) for m in DEFINITIONS}
