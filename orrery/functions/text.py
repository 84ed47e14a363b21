"""Column functions on paths, texts and names; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXTENSIONS

TOKEN = r"[\p{L}\p{N}]+"


def extension(path: Column) -> Column:
    """Lower-cased last extension of a path's last part; "" without one or for a dot file that is only an extension."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1))


def language_of_extension(ext: Column) -> Column:
    """Language of an extension as written, "" if none parses it."""
    known = F.create_map(*[F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)])
    return F.coalesce(known[ext], F.lit(""))


def language_of_path(path: Column) -> Column:
    return language_of_extension(extension(path))


def normalize_path(path: Column) -> Column:
    """A relative path without "." parts and roots; ".." takes away the part before it, if there is one."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.array_join(fold, "/")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def signature(text: Column) -> Column:
    """What stands before the first "{"; else up to and with the first ":"; else the first line."""
    brace, colon = F.instr(text, "{"), F.instr(text, ":")
    return strip(F.when(brace > 0, F.substring_index(text, "{", 1)).when(colon > 0, F.concat(F.substring_index(text, ":", 1), F.lit(":"))).otherwise(F.substring_index(text, "\n", 1)))


def context_header(kind: Column, symbol: Column, parent: Column, path: Column) -> Column:
    """The lines that tell an embedding where a chunk lives."""
    named = F.coalesce(symbol, F.lit("")) != ""
    titles = {"Function": "Function", "Method": "Method", "TypeHeader": "Type", "Declaration": "Declaration"}
    last = F.when(kind == "ImportBlock", "// Imports").when(kind == "Preamble", "// File preamble")
    for k, title in titles.items():
        last = last.when((kind == k) & named, F.concat(F.lit(f"// {title}: "), symbol))
    return F.concat_ws("\n", F.concat(F.lit("// File: "), path), F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("// Context: "), parent)), last)


def embedding_input(header: Column, text: Column) -> Column:
    return F.concat_ws("\n", header, text)


def line_of(text: Column, chars: Column) -> Column:
    """1-based line of a position: one more than the line ends before it."""
    before = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.least(chars, F.length(text))))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def query_class(query: Column) -> Column:
    """PathQuery, CodePattern, NaturalLanguage or Symbol, tried in this order; NaturalLanguage if none fits."""
    q = strip(F.coalesce(query, F.lit("")))
    path = q.rlike(r"^\S*/\S*$|(^|\s)\*\.\w+|^\S*\.(py|js|ts|tsx|jsx|rs|go|java|c|h|cc|cpp|hpp|md|toml|yml|yaml|json)$")
    code = q.rlike(r"(^|\s)(fn|def|class|struct|impl|func|function|interface|enum|trait|const|let|var|public|private|static|async|import|return)\s+\S")
    spoken = F.lower(q).rlike(r"^(how|what|why|where|when|which|who|explain|describe|show|find|list|does|is|are|can)\s") | q.rlike(r"\?$")
    name = q.rlike(r"^[A-Za-z_][A-Za-z0-9_]*([.:]+[A-Za-z_][A-Za-z0-9_]*)*$")
    return F.when(path, "PathQuery").when(code, "CodePattern").when(spoken, "NaturalLanguage").when(name, "Symbol").otherwise("NaturalLanguage")


def query_class_sql(q: str) -> str:
    """The same rule for the oracle, written against RE2."""
    s = f"regexp_replace(coalesce({q}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN regexp_matches({s}, '^\\S*/\\S*$|(^|\\s)\\*\\.\\w+|^\\S*\\.(py|js|ts|tsx|jsx|rs|go|java|c|h|cc|cpp|hpp|md|toml|yml|yaml|json)$') THEN 'PathQuery'
 WHEN regexp_matches({s}, '(^|\\s)(fn|def|class|struct|impl|func|function|interface|enum|trait|const|let|var|public|private|static|async|import|return)\\s+\\S') THEN 'CodePattern'
 WHEN regexp_matches(lower({s}), '^(how|what|why|where|when|which|who|explain|describe|show|find|list|does|is|are|can)\\s') OR regexp_matches({s}, '\\?$') THEN 'NaturalLanguage'
 WHEN regexp_matches({s}, '^[A-Za-z_][A-Za-z0-9_]*([.:]+[A-Za-z_][A-Za-z0-9_]*)*$') THEN 'Symbol' ELSE 'NaturalLanguage' END"""
