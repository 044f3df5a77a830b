"""Table schemas: sources, lines, diagnostics, issues, nodes."""

SOURCE = "source_id long, path string, code string"
LINE = "source_id long, line_no int, text string"
DIAGNOSTIC = "source_id long, ord int, severity string, message string, line int, col int"
ISSUE = "source_id long, phase string, rule string, module string, message string, line int, rule_ord int, issue_ord int"
NODE = (
    "source_id long, id int, parent int, ord int, depth int, last_desc int, kind string, name string, mod string, arity int, "
    "line int, col int, span_start int, span_end int, lit_type string, lit string, lit_long long, lit_double double, shape_hash long, "
    "block_id int, fn_id int, pipe_id int, pipe_step int"
)
FIX = "source_id long, code string, applied array<struct<rule:string,count:int>>"
