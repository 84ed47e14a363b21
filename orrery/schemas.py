"""Row types of the index and its fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of chunks, symbols and imports.
CHUNK_KINDS = ("ImportBlock", "Preamble", "Function", "TypeHeader", "Method", "Declaration", "TextWindow")
SYMBOL_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "type_alias", "impl_block", "module", "declaration")
IMPORT_KINDS = ("module", "named", "wildcard", "default", "side_effect", "include", "reexport")
# File extensions of the nine parsed languages.
EXTENSIONS = {
    "Python": ("py", "pyi", "pyw"),
    "JavaScript": ("js", "mjs", "cjs", "jsx"),
    "TypeScript": ("ts", "mts", "cts"),
    "Tsx": ("tsx",),
    "Rust": ("rs",),
    "Go": ("go",),
    "Java": ("java",),
    "C": ("c", "h"),
    "Cpp": ("cc", "cpp", "cxx", "hpp", "hxx", "hh"),
}
DEFAULT_DIM = 384

CHUNK_FIELDS = "text string, kind string, symbol_name string, parent_context string, line_start int, line_end int"
SYMBOL_FIELDS = "name string, qualified_name string, kind string, line_start int, line_end int, signature string, doc_comment string, visibility string, parent_name string"
IMPORT_FIELDS = "import_kind string, raw_specifier string, imported_names array<string>, line_number int"


def vector_table() -> T.StructType:
    """chunk_id must be present; the length of vector is checked by the store, since Spark has no fixed-size list."""
    return T.StructType([T.StructField("chunk_id", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), True), True)])
