"""Problem 2: files not written by hand in their project.

Merkle hashes, built bottom-up over the directory trees without names, find the files and
subtrees that unrelated projects share.  Header and layout rules find the rest: generated,
minified and bulk-data files, and single copies by the licence line of a named release or by
a place under a vendor directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Directories that package managers and habits use for copied code.
VENDOR_PATH = r"(^|/)(node_modules|bower_components|third[_-]?party|vendor|vendored|bundled|external|extern|externals|deps|dependencies)/"
# What generators write into the first or last comment of a file.
GENERATED = (
    r"@generated\b|<auto-?generated|\bauto-?\s?generated\b|\b(code|file|source|module|sources) (was |is )?(automatically |auto-?)?generated\b|\bgenerated (automatically )?(by|from|with|using)\b"
    r"|\bdo not (edit|modify)\s*(!|[.;-]|$)|\b(edits?|changes?|modifications?) (is|are|will be|get|gets) (lost|overwritten|discarded)\b|\bmachine[- ]?(made|generated|written)\b"
    r"|\bproduced (by|from) (the build|templates?|\S+ \d|\S+\.\w+)|\b(emitted|created|compiled|built|made|written) (from|by) [\w./-]+(\.(idl|proto|tpl|gy|y|g4|json|xml|thrift|avsc)\b|;)"
    r"|\boutput of \S+ --?\w+|\b(re-?run|run) [`'\"][^`'\"]+[`'\"] to (refresh|update|regenerate|rebuild)\b|\btables?, .*\bfrom [\w./-]+\.(gy|y|yy|g4|l|lalr|peg|pest)\b"
    r"|generado autom[aá]ticamente|automatisch (erzeugt|generiert)|сгенерировано автоматически|автоматически сгенерирован|g[eé]n[eé]r[eé] automatiquement|自動生成|自动生成|gerado automaticamente|generato automaticamente"
)
# Marks in comments that an editor writes for people to fill in, or that say the file is no such one.
BY_HAND = r"\bgenerated by the (editor|ide)\b|\bauto-?generated (\w+ )?stub\b|\b(not|never|isn't|n't) (auto-?)?generated\b|\b(written|kept|maintained) by hand\b"
# Release and licence lines that third-party code carries.
LICENCE = (
    r"(^|\s)@licen[cs]e\s+\S|redistribution (and use )?in source\b|\(c\) (the )?[\w.-]+ (authors|contributors|team|project)|^\s*(/\*!|//!?|#|\*)\s*[a-z][\w.-]+ v?\d+\.\d+(\.\d+)?\b"
    r"|this is part of [\w.-]+, release \d|see licen[cs]e in the upstream|\bv?\d+\.\d+\.\d+ \| "
)
_LITERAL = r"(?s)\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_COMMENT = r"(?m)/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*|(?:^|\s)#(?!include|define|if|endif|pragma)[^\n]*"
_HEAD = r"\A﻿?\s*(?:#![^\n]*\n\s*)?((?:[ \t]*(?://|#(?!include|define|if|ifdef|ifndef|pragma|!?\[)|--|;;)[^\n]*(?:\n|\z)|[ \t]*\n|\s*/\*(?:[^*]|\*(?!/))*+\*/[ \t]*(?:\n|\z)|[ \t]*(?:package \w+;?|<\?php|'use strict';?|\"use strict\";?)[ \t]*\n)*)"
_TAIL = r"((?:(?m:^)(?://|#(?!endif|include|define))[^\n]*\s*|(?m:^)/\*(?:[^*]|\*(?!/))*+\*/\s*)+)\z"


def _minified(text: Column, path: Column) -> Column:
    """Code in very long lines with hardly any white space; a few long strings do not count."""
    bare = F.regexp_replace(text, _LITERAL, '""')
    lines = F.length(bare) - F.length(F.replace(bare, F.lit("\n"))) + 1
    blank = F.length(bare) - F.length(F.regexp_replace(bare, r"\s+", ""))
    return path.rlike(r"(?i)\.(js|mjs|cjs|jsx|ts|mts|cts|tsx)$") & (F.length(bare) >= 200) & (F.length(bare) / lines >= 120) & (blank / F.length(bare) <= 0.09)


def _bulk_data(text: Column) -> Column:
    """Literals outweigh words: tables of numbers, records or encoded bytes with a name around them."""
    code = F.regexp_replace(text, _COMMENT, " ")
    strings = F.length(code) - F.length(F.regexp_replace(code, r"\"[^\"\s]*\"|'[^'\s]*'", ""))  # words in a sentence are no data
    bare = F.regexp_replace(code, _LITERAL, " ")
    numbers = F.regexp_count(bare, F.lit(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"))
    words = F.regexp_count(bare, F.lit(r"(?<![\w])[A-Za-z_]\w*"))
    items = numbers + F.least(strings / 8, F.lit(1e6))
    return (items >= 40) & (words * 6 <= items)


#: Lines in a row that are equal but for their numbers, from this share of a file's lines of code on, are a tool's work.
REPEATED_SHARE, REPEATED_LINES = 0.6, 8


def _repeated(text: Column) -> Column:
    """Most lines of code recur with nothing but other numbers: accessors, cases or entries written out by a tool."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, _COMMENT, " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= 8)
    shapes = F.transform(F.filter(lines, lambda x: x.rlike(r"\d")), lambda x: F.regexp_replace(x, r"\d+", "0"))
    again = F.size(shapes) - F.size(F.array_distinct(shapes))
    return (again >= REPEATED_LINES) & (again >= REPEATED_SHARE * F.size(lines))


def signs(files: DataFrame) -> DataFrame:
    """(file_id, project, path, hash, size, generated, minified, data, licensed, vendor_path), all from built-in expressions."""
    text, path = F.col("text"), F.coalesce("path", F.lit(""))
    head = F.regexp_extract(text, _HEAD, 1)
    tail = F.regexp_extract(text, _TAIL, 1)
    code = F.create_map(*[F.lit(x) for kv in common.EXTENSIONS.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))].isNotNull()
    lines = F.split(F.concat(head, F.lit("\n"), tail), "\n")
    says = F.exists(lines, lambda x: F.lower(x).rlike(GENERATED) & ~F.lower(x).rlike(BY_HAND))
    licensed = F.exists(F.split(head, "\n"), lambda x: F.lower(x).rlike(LICENCE) & ~x.rlike("(?i)rewritten|old licen[cs]e|respective authors"))
    whole = F.regexp_replace(text, r"\s+", "")
    body = F.regexp_replace(F.substring(text, F.length(F.regexp_extract(text, _HEAD, 0)) + 1, F.length(text)), r"\s+", "")
    squeezed = F.when(F.length(body) > 0, body).otherwise(whole)
    return files.where(code & (F.length(whole) > 0)).select(
        "file_id", "project", "path",
        F.xxhash64(squeezed).alias("hash"), F.xxhash64(F.reverse(squeezed), F.lit(1)).alias("hash2"), F.length(squeezed).alias("size"),
        (says | (_repeated(text) & ~_bulk_data(text))).alias("generated"), _minified(text, path).alias("minified"), _bulk_data(text).alias("data"),
        licensed.alias("licensed"), path.rlike(VENDOR_PATH).alias("vendor_path"),
    )


def merkle(files: DataFrame, depth: int) -> DataFrame:
    """(project, dir, hash, hash2, n, copies): subtree hashes of every directory, the root "" included, bottom-up, level by level.

    A directory's hash is the sum of its entries' hashed hashes: it does not depend on names or
    order, is combined on the map side, and no directory's entries are ever collected.  copies is
    how many of its n files are copied.
    """
    entry = files.select("project", F.split("path", "/").alias("p"), "hash", "hash2", F.lit(1).cast("bigint").alias("n"), F.col("copied").cast("bigint").alias("copies")).withColumn("level", F.size("p") - 1)
    entry = entry.select("project", F.array_join(F.expr("slice(p, 1, level)"), "/").alias("dir"), "level", "hash", "hash2", "n", "copies")
    out, carry = None, None
    for level in range(depth, -1, -1):
        here = entry.where(F.col("level") == level)
        if carry is not None:
            here = here.unionByName(carry)
        total = lambda c, seed: F.sum(F.xxhash64(c, F.lit(seed)).cast("decimal(20,0)"))
        done = here.groupBy("project", "dir").agg(total("hash", 7).alias("a"), total("hash2", 11).alias("b"), F.sum("n").alias("n"), F.sum("copies").alias("copies"))
        done = done.select("project", "dir", F.xxhash64("a", "n").alias("hash"), F.xxhash64("b", "n").alias("hash2"), "n", "copies")
        if (depth - level) % LEVELS_A_PLAN == LEVELS_A_PLAN - 1 and level:
            done = common.materialize(done)
        out = done if out is None else out.unionByName(done)
        carry = done.select("project", F.regexp_replace("dir", r"/?[^/]*$", "").alias("dir"), F.lit(level - 1).alias("level"), "hash", "hash2", "n", "copies")
    return out


#: The lineage of the directory hashes is cut after so many levels, since each level's plan holds those below it.
LEVELS_A_PLAN = 6
#: Shared content counts as copied from this many characters without white space; less may be coincidence.
LEAST_SHARED = 120
#: A directory below the root of so many files, of which this share is copied, is a copy with changes.
PARTLY_FILES, PARTLY_SHARE = 5, 0.8
#: Rows of one project and directory are spread over so many keys where they are joined.
SALTS = 16


def _salted(big: DataFrame, small: DataFrame, key: list[str], by: str) -> DataFrame:
    """big's rows whose key is in small, which has a row per key; a hot key of big is spread by a hash of column by."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_")
    return big.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(small.select(*key, salt), [*key, "salt_"], "left_semi").drop("salt_")


def origin(chunks: DataFrame) -> DataFrame:
    """One row per source file: reasons why it is not hand-written in its project, an empty array if it is.

    copied: by Merkle hashes its content of LEAST_SHARED characters or more is in another project too,
    or a directory above it is, or most of that directory's files are.  third party: by header and
    place, or content equal to such a file's.  generated, minified, data: by header and layout.
    Null paths count as files at the root; files without a project are in no tree.  Configuration
    and blank files are left out.
    """
    s = signs(common.files(chunks, languages=True)).withColumn("path", F.coalesce("path", F.lit("")))
    s = common.materialize(s.withColumn("known", F.col("licensed") | F.col("vendor_path")).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    # files by content: map-side combinable flags, no group is collected
    each = s.groupBy("hash", "hash2", "project").agg(F.max("known").alias("known"), F.max("size").alias("size_"))
    same = each.groupBy("hash", "hash2").agg(F.max("known").alias("of_known"), F.count("project").alias("projects"), F.max("size_").alias("size_"))
    same = same.where((F.col("size_") >= LEAST_SHARED) & (F.col("of_known") | (F.col("projects") >= 2))).select("hash", "hash2", "of_known", (F.col("projects") >= 2).alias("copied"))
    s = s.join(same, ["hash", "hash2"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("of_known", "copied")})
    s = common.materialize(s.select("file_id", "project", "path", "dir", "hash", "hash2", "generated", "minified", "data", "known", "of_known", "copied"))
    depth = s.agg(F.max(F.size(F.split("path", "/")) - 1)).first()[0] or 0
    trees = common.materialize(merkle(s, depth))  # read three times below; without this the plan holds all levels thrice
    whole = trees.where("n >= 2").groupBy("hash", "hash2").agg(F.min("project").alias("p1"), F.max("project").alias("p2")).where("p1 <> p2").select("hash", "hash2")
    partly = trees.where((F.col("dir") != "") & (F.col("n") >= PARTLY_FILES) & (F.col("copies") >= PARTLY_SHARE * F.col("n"))).select("project", "dir")
    found = trees.join(whole, ["hash", "hash2"], "left_semi").select("project", "dir").unionByName(partly).distinct()
    above = F.expr("transform(sequence(0, if(dir = '', 0, size(split(dir, '/')))), k -> array_join(slice(split(dir, '/'), 1, k), '/'))")
    under = _salted(trees.select("project", F.col("dir").alias("own"), F.explode(above).alias("dir")), found, ["project", "dir"], "own").select("project", F.col("own").alias("dir")).distinct()
    in_tree = _salted(s.select("file_id", "project", "dir"), under, ["project", "dir"], "file_id").select("file_id", F.lit(True).alias("in_tree"))
    j = s.join(in_tree, "file_id", "left")
    reason = lambda c, name: F.when(c, F.lit(name))
    copied = F.col("copied") | F.coalesce("in_tree", F.lit(False))
    return j.select(
        "file_id", "project", "path",
        F.array_compact(F.array(reason(F.col("generated"), "generated"), reason(F.col("minified"), "minified"), reason(copied, "copied"), reason(F.col("known") | F.col("of_known"), "third party"), reason(F.col("data"), "data"))).alias("reasons"),
    )


def not_hand_written(chunks: DataFrame) -> DataFrame:
    """file_id of files that a tool emitted, that were compressed, copied in or hold bulk data."""
    return origin(chunks).where(F.size("reasons") > 0).select("file_id")
