"""Import resolution as equi-joins.

Each import yields its candidate paths in order; files yield the keys a candidate can meet: the
whole path and every suffix of it.  The first candidate that meets a file of the project wins.
Work is per import and per file, never imports times files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory, language_of_path, normalize_path

# What is probed after a relative specifier, in order.
SCRIPT_PROBES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def _ordered(*paths: Column, suffix: bool = True) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("rank"), p.alias("path"), F.lit(suffix).alias("suffix")) for k, p in enumerate(paths)])


def candidates(lang: Column, spec: Column, source: Column) -> Column:
    """Array of (rank, path, suffix) that the languages' rules try; suffix tells whether a longer path that ends so will do."""
    none = F.array().cast("array<struct<rank:int,path:string,suffix:boolean>>")
    dotted = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.when(dotted == "", none).otherwise(_ordered(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(F.lit("src/"), dotted, F.lit(".py")), F.concat(F.lit("src/"), dotted, F.lit("/__init__.py"))))
    near = normalize_path(F.concat_ws("/", F.nullif(directory(source), F.lit("")), spec))
    script = F.when(spec.startswith("."), _ordered(*[F.concat(near, F.lit(e)) for e in SCRIPT_PROBES])).otherwise(none)
    crate = F.replace(F.substring(spec, F.lit(8), F.length(spec)), F.lit("::"), F.lit("/"))
    rust = F.when(spec.startswith("crate::"), _ordered(F.concat(F.lit("src/"), crate, F.lit(".rs")), F.concat(F.lit("src/"), crate, F.lit("/mod.rs")), suffix=False)).otherwise(none)
    here = F.struct(F.lit(0).alias("rank"), near.alias("path"), F.lit(False).alias("suffix"))
    c = F.array(here, F.struct(F.lit(1).alias("rank"), spec.alias("path"), F.lit(True).alias("suffix")))
    return F.when(lang == "Python", python).when(lang.isin("JavaScript", "TypeScript", "Tsx"), script).when(lang == "Rust", rust).when(lang.isin("C", "Cpp"), c).otherwise(none)


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, project, source_file, raw_specifier) with resolved: a path, or "" where nothing fits.

    files are (project, path, ordinal): Go and Java take the first file by ordinal, the others the
    first candidate, which is returned as probed even if only a longer path ends with it.
    """
    i = imports.select("import_id", "project", "source_file", "raw_specifier").withColumn("lang", language_of_path(F.col("source_file")))
    f = files.select("project", "path", "ordinal").distinct()
    probe = i.where(~F.col("lang").isin("Go", "Java", "")).select("import_id", "project", F.explode(candidates(F.col("lang"), F.col("raw_specifier"), F.col("source_file"))).alias("c")).select("import_id", "project", "c.*")
    parts = F.split("path", "/")
    ends = f.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("path"), (k > 1).alias("cut")))).alias("e")).select("project", "e.*").distinct()
    hit = probe.join(ends, ["project", "path"]).where("suffix or not cut").groupBy("import_id").agg(F.min(F.struct("rank", "path")).alias("m")).select("import_id", F.col("m.path").alias("resolved"))
    # Go: the first file with the last segment as a directory
    segment = F.element_at(F.split("raw_specifier", "/"), -1)
    go = i.where("lang = 'Go'").select("import_id", "project", segment.alias("segment")).where("segment <> ''")
    dirs = f.select("project", "path", "ordinal", F.explode(F.array_distinct(F.slice(parts, 1, F.size(parts) - 1))).alias("segment"))
    first = dirs.groupBy("project", "segment").agg(F.min(F.struct("ordinal", "path")).alias("m"))
    go = go.join(first, ["project", "segment"]).select("import_id", F.col("m.path").alias("resolved"))
    # Java: the first file that ends with the path of the class; joined on the file name's ending
    want = F.concat(F.replace("raw_specifier", F.lit("."), F.lit("/")), F.lit(".java"))
    java = i.where("lang = 'Java'").select("import_id", "project", want.alias("want")).withColumn("name", F.element_at(F.split("want", "/"), -1)).withColumn("rest", F.expr("left(want, length(want) - length(name))"))
    base = F.element_at(parts, -1)
    exact = f.withColumn("name", base)
    deep = java.where("rest <> ''").join(exact, ["project", "name"]).where(F.endswith("path", F.col("want")))
    names = f.where(F.endswith(base, F.lit(".java"))).select("project", "path", "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.length(base) - 5), lambda k: base.substr(k, F.length(base)))).alias("name"))
    flat = java.where("rest = ''").join(names, ["project", "name"])
    java = deep.select("import_id", "ordinal", "path").unionByName(flat.select("import_id", "ordinal", "path")).groupBy("import_id").agg(F.min(F.struct("ordinal", "path")).alias("m")).select("import_id", F.col("m.path").alias("resolved"))
    found = hit.unionByName(go).unionByName(java)
    return i.join(found, "import_id", "left").select("import_id", "project", "source_file", "raw_specifier", F.coalesce("resolved", F.lit("")).alias("resolved"))


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (project, src_path, dst_path) of resolved imports."""
    return resolved.where("resolved <> ''").select("project", F.col("source_file").alias("src_path"), F.col("resolved").alias("dst_path")).distinct()
