"""Code intelligence: one parse per file gives its chunks, symbols and imports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_header, language_of_path
from ..schemas import CHUNK_FIELDS, IMPORT_FIELDS, SYMBOL_FIELDS
from .chunking import MAX_CHARS, window_arrays


def analyze(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(id, path, chunks, symbols, imports, rest, error) of (id, path, text): arrays of structs, from one parse of each file.

    Files in other languages, and null or empty ones, have empty arrays.  rest is the text of a
    file without chunks, for windows.  A file that cannot be scanned has empty arrays too and says
    why in error, which is null for all others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..parse.extract import File

        for pdf in batches:
            rows = []
            for i, path, lang, text in pdf.itertuples(index=False, name=None):
                c, s, m, error = [], [], [], None
                if lang and text:
                    try:
                        f = File(text, lang, limit)
                        c, s, m = f.chunks(), f.symbols(), f.imports()
                    except (IndexError, KeyError, RecursionError) as e:
                        c, s, m, error = [], [], [], f"{type(e).__name__}: {e}"
                rows.append((i, path, c, s, m, None if c else text, error))
            yield pd.DataFrame(rows, columns=["id", "path", "chunks", "symbols", "imports", "rest", "error"])

    struct = lambda fields: "array<struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in fields.split(", ")) + ">>"
    schema = f"id bigint, path string, chunks {struct(CHUNK_FIELDS)}, symbols {struct(SYMBOL_FIELDS)}, imports {struct(IMPORT_FIELDS)}, rest string, error string"
    return files.select("id", "path", language_of_path(F.col("path")).alias("lang"), "text").mapInPandas(run, schema)


def chunks(analyzed: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(id, path, chunk_index, text, kind, ..., context_header): semantic chunks, windows where a file has none; no file is parsed or read again."""
    d = window_arrays(analyzed.select("id", "path", "chunks", F.col("rest").alias("text")), ["id", "path", "chunks"], limit)
    none = F.lit("")
    w = F.transform("windows", lambda x: F.struct(x["text"].alias("text"), F.lit("TextWindow").alias("kind"), none.alias("symbol_name"), none.alias("parent_context"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    own = F.transform("chunks", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "kind", "symbol_name", "parent_context", "line_start", "line_end")]))
    d = d.select("id", "path", F.posexplode(F.when(F.size("chunks") > 0, own).otherwise(w)).alias("chunk_index", "c")).select("id", "path", "chunk_index", "c.*")
    return d.withColumn("context_header", context_header(F.col("kind"), F.col("symbol_name"), F.col("parent_context"), F.col("path")))


def errors(analyzed: DataFrame) -> DataFrame:
    """(id, path, error) of the files that could not be scanned."""
    return analyzed.where("error is not null").select("id", "path", "error")


def symbols(analyzed: DataFrame) -> DataFrame:
    return analyzed.select("id", "path", F.explode("symbols").alias("s")).select("id", "path", "s.*")


def imports(analyzed: DataFrame) -> DataFrame:
    return analyzed.select("id", "path", F.explode("imports").alias("m")).select("id", "path", "m.*")
