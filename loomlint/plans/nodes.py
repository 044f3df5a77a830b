"""Parsed sources as rows: one Arrow pass over a corpus gives its nodes, or its issues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loomlint import schema
from loomlint.functions.elixir import Node, ParseError
from loomlint.functions.tree import Tree, pipe
from loomlint.session import ship_package

_NODE = pa.schema(
    [
        ("source_id", pa.int64()), ("id", pa.int32()), ("parent", pa.int32()), ("ord", pa.int32()), ("depth", pa.int32()), ("last_desc", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
        ("mod", pa.string()), ("arity", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("lit_type", pa.string()), ("lit", pa.string()),
        ("lit_long", pa.int64()), ("lit_double", pa.float64()), ("shape_hash", pa.int64()), ("block_id", pa.int32()), ("fn_id", pa.int32()), ("pipe_id", pa.int32()), ("pipe_step", pa.int32()),
    ]
)
LITERALS = ("int", "float", "str", "charlist", "atom", "sigil")


def node_rows(source_id: int, tree: Tree) -> list[tuple]:
    """Rows of a source's nodes in pre-order; a node's descendants are those with ids up to ``last_desc``."""
    rows: list[list] = []

    def visit(n: Node, parent: int | None, ord_: int, depth: int, block: int | None, fn: int | None, pipeline: int | None, step: int | None) -> int:
        me = len(rows)
        mod = n.target.name if n.target is not None and n.target.kind == "alias" else None
        kind = "remote" if n.kind == "call" and mod and n.flags not in ("anon", "access") else n.kind
        lit = str(n.value) if n.kind in LITERALS else None
        number = n.value if n.kind == "int" and -(1 << 63) <= n.value < 1 << 63 else None
        shape = xxhash.xxh64_intdigest(repr(n.shape()))
        rows.append([
            source_id, me, parent, ord_, depth, me, kind, n.name, mod, len(n.args) if n.kind in ("call", "fn") else None, n.line, n.col, n.start, n.end, n.kind if lit is not None else None, lit,
            number, float(n.value) if n.kind == "float" else None, shape - (1 << 64) if shape >> 63 else shape, block, fn, pipeline, step,
        ])
        if n.kind == "block" and n.flags != "clauses":
            block = me
        if n.kind == "call" and n.target is None and n.name in ("def", "defp"):
            fn = me
        end = me
        if pipe(n):
            top = pipeline if step is not None and step < 0 else me
            end = visit(n.args[0], me, 0, depth + 1, block, fn, top, -1 if pipe(n.args[0]) else 0)
            # steps are numbered from the pipeline's first expression
            here = 1 + sum(1 for _ in _left_pipes(n.args[0]))
            end = visit(n.args[1], me, 1, depth + 1, block, fn, top, here)
        else:
            for i, c in enumerate(n.children()):
                end = visit(c, me, i, depth + 1, block, fn, None, None)
        rows[me][5] = end
        if rows[me][22] == -1:
            rows[me][22] = None
        return end

    visit(tree.root, None, 0, 0, None, None, None, None)
    return [tuple(r) for r in rows]


def _left_pipes(n: Node) -> Iterator[Node]:
    while pipe(n):
        yield n
        n = n.args[0]


def nodes(source: DataFrame) -> DataFrame:
    """The node table of a corpus; sources that do not parse have no nodes."""
    ship_package(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source_id, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += node_rows(source_id, Tree(code or ""))
                except (ParseError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_NODE)], schema=_NODE)

    return source.select("source_id", "code").mapInArrow(run, schema.NODE)
