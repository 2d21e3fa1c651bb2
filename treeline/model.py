"""The node relation: one row for each tree node, with pre-order places as the only structure.

descendant of a: pre in (a.pre, a.pre + a.size); child of a: parent_pre = a.pre; document order: pre. Trees of one document never
meet those of another, so doc_id is the unit of parallelism in every plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORE = ("literal", "variable", "list", "map", "pair", "tuple", "binary_op", "unary_op", "function_call", "conditional", "early_return", "block", "assignment", "inline_match")
EXTENDED = ("loop", "lambda", "collection_op", "pattern_match", "match_arm", "exception_handling", "async_operation")
STRUCTURAL = ("container", "function_def", "param", "attribute_access", "augmented_assignment", "property")
NATIVE = ("language_specific",)
LITERALS = ("integer", "float", "string", "boolean", "null", "symbol", "regex")
CATEGORIES = ("arithmetic", "comparison", "boolean")
CONTAINERS = ("module", "class", "namespace")
LOOPS = ("while", "for", "for_each")
COLLECTIONS = ("map", "filter", "reduce")
SEVERITIES = ("error", "warning", "info", "refactoring_opportunity")

SCHEMA = (
    "doc_id string, pre long, parent_pre long, ix int, depth int, size int, n_children int, role string, type string, subtype string, value string, "
    "category string, operator string, name string, op_type string, loop_type string, container_type string, visibility string, kind string, "
    "language string, line int, nest int, in_meta boolean"
)
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))


def layer(kind: Column) -> Column:
    """core, extended, structural, native or unknown."""
    return (
        F.when(kind.isin(*CORE), "core").when(kind.isin(*EXTENDED), "extended").when(kind.isin(*STRUCTURAL), "structural").when(kind.isin(*NATIVE), "native").otherwise("unknown")
    )


def leaf(kind: Column) -> Column:
    return kind.isin("literal", "variable", "param")
