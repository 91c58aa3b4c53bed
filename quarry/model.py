"""Schemas of the fact tables and the tier vocabulary.  Lines and columns count from 1; columns count bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tiers by rank.
TIERS = ("unknown", "stdlib", "indirect", "direct", "workspace")
UNKNOWN, STDLIB, INDIRECT, DIRECT, WORKSPACE = range(5)

#: Scopes and the tiers that each lets through.
SCOPES = {"workspace": (WORKSPACE,), "workspace+direct": (WORKSPACE, DIRECT), "all": (WORKSPACE, DIRECT, INDIRECT, STDLIB)}
DEFAULT_SCOPE = "workspace+direct"

SCHEMAS = {
    "packages": "pkg_path string, variant string, module_path string, module_main boolean, module_indirect boolean, tier string, tier_rank int, load_order int",
    "imports": "src_pkg string, dst_pkg string, alias string",
    "files": "path string, pkg_path string, is_test boolean, n_lines int, load_order int",
    "file_lines": "path string, line int, text string",
    "symbols": "obj_id string, kind string, qname string, sname string, pkg_path string, file string, line int, col int, tier string, tier_rank int, load_order int",
    "idents": "file string, line int, col int, end_col int, obj_id string, qname string, kind string, is_def boolean",
    "uses": "obj_id string, file string, line int, col int, pkg_path string, tier_rank int, resolved boolean",
    "named_types": "type_id string, qname string, pkg_path string, is_interface boolean, file string, line int, col int, tier_rank int",
    "method_sets": "type_id string, via_pointer boolean, name string, signature string, fn_qname string",
    "iface_methods": "type_id string, name string, signature string",
    "ast_nodes": "kind string, pkg_path string, file string, line int, col int, visit_seq int, callee_qname string, n_args int, fun_is_type boolean, target_qname string, target_is_ptr boolean, enclosing_fn string, tier_rank int",
    "struct_fields": "struct_qname string, go_field string, tag string, exported boolean, obj_id string, pkg_path string, tier_rank int, load_order int",
    "functions": "fn_id string, qname string, variant string, synthetic boolean",
    "call_edges": "caller string, callee string, file string, line int, col int, dispatch string",
    "dyn_sites": "caller string, iface_type_id string, method string, signature string, file string, line int, col int",
    "instantiations": "fn string, type_id string",
    "func_values": "taker string, fn string, signature string",
    "func_sites": "caller string, signature string, file string, line int, col int",
    "diagnostics": "analyzer string, severity string, file string, line int, col int, message string, category string",
    "fs_events": "ts timestamp, path string, op string",
    "docs": "path string, text string",
}

Facts = dict[str, DataFrame]


class QueryError(ValueError):
    """A query that the engine refuses; its text is for the user."""


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
