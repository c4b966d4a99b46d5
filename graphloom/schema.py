"""Vocabularies, edge sets and row types of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies that facts are written in.
LANGUAGES = ("python", "typescript", "java", "go", "rust", "javascript", "csharp", "c", "cpp", "kotlin", "swift")
NODE_KINDS = ("module", "file", "symbol", "statement", "predicate", "doc_section", "test", "external_package", "api_endpoint", "route")
STRUCTURAL_EDGES = ("calls", "imports", "depends_on", "defines", "references", "inherits", "implements")
EDGE_TYPES = (*STRUCTURAL_EDGES, "control_flow", "control_dep", "data_dep", "tests", "documents", "exposes", "links_to", "consumes", "inferred_relates")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
PROVENANCES = ("tree-sitter", "lsp", "stack-graphs", "cfg", "pdg", "manifest", "doc", "semantic-skill", "graphify")
VISIBILITY_RANK = {"internal": 0, "exported": 1, "public": 2}

#: Edges that a block may rest on, and the narrower sets of the queries.
GATE_EDGES = STRUCTURAL_EDGES
REFERENCE_EDGES = ("calls", "references", "imports", "inherits", "implements")
EXERCISE_EDGES = ("calls", "references", "inherits", "implements")
FILE_GRAPH_EDGES = ("calls", "imports", "references", "inherits")
EXTERNALS_UNIT = "<externals>"

LOCATION = T.StructType([T.StructField("path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
SITE = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType())])
NODES = T.StructType(
    [
        T.StructField("load_seq", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("id", "repo_id", "kind", "name", "qualified_name", "language", "unit", "signature", "body_hash", "module", "layer")],
        T.StructField("location", LOCATION),
        *[T.StructField(c, T.StringType()) for c in ("visibility", "provenance", "confidence", "content_hash")],
        T.StructField("is_top_level", T.BooleanType()),
        T.StructField("is_type_decl", T.BooleanType()),
        T.StructField("stmt_ordinal", T.IntegerType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)
EDGES = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("type", "src", "dst")],
        T.StructField("weight", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in ("provenance", "confidence")],
        T.StructField("source_location", SITE),
        T.StructField("unit", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)
