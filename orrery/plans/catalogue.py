"""The core's queries, each over whole tables, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blobs, text
from ..operators import chunking, code, fusion, graph, imports, lexical, packing, vectors
from ..sources import corpus, store
from . import search as plan

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# -- vector store and search ------------------------------------------------------------------

_EMB = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"


def _embeddings(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


_DIST = "round(pow(list_distance(a.v, b.v), 2), 6)"


@query(
    f"""WITH e AS ({_EMB}), h AS (SELECT b.id AS item_id, round({_DIST}, 6) AS distance FROM e a, e b WHERE a.id = 0 ORDER BY distance, item_id LIMIT 20),
s AS (SELECT item_id, 1 / (1 + distance) AS sim FROM h), m AS (SELECT min(sim) lo, max(sim) hi FROM s)
SELECT item_id, round(CASE WHEN hi - lo < 2.220446049250313e-16 THEN 1.0 ELSE (sim - lo) / (hi - lo) END, 6) AS score FROM s, m"""
)
def knn_topk(spark, d):
    """The 20 nearest of one vector, normalised."""
    e = _embeddings(spark, d)
    q = e.where("item_id = 0").select(F.col("item_id").alias("query_id"), "vector")
    return vectors.search(e, q, 20, rounded=6).select("item_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH e AS ({_EMB}), h AS (SELECT a.id AS query_id, b.id AS item_id, {_DIST} AS distance FROM e a, e b WHERE a.id % 20 = 0
 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) <= 10),
s AS (SELECT query_id, item_id, 1 / (1 + distance) AS sim FROM h), m AS (SELECT query_id, min(sim) lo, max(sim) hi FROM s GROUP BY 1)
SELECT query_id, item_id, round(CASE WHEN hi - lo < 2.220446049250313e-16 THEN 1.0 ELSE (sim - lo) / (hi - lo) END, 5) AS score FROM s JOIN m USING (query_id)"""
)
def knn_batch(spark, d):
    """The 10 nearest of every vector whose id is divisible by 20, against all vectors."""
    e = _embeddings(spark, d)
    q = e.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return vectors.search(e, q, 10, rounded=6).select("query_id", "item_id", F.round("score", 5).alias("score"))


def _rows(table: DataFrame) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table.select("chunk_id", F.size("vector").cast("bigint").alias("dim"), F.round(total, 5).alias("total"))


_ONCE = "SELECT chunk_id, arg_max(vector, stored_at)::DOUBLE[] AS v FROM chunks WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) GROUP BY 1"


def _stored(spark, d):
    return plan.latest_vectors(_t(spark, d, "chunks")).select(F.col("item_id").alias("chunk_id"), "vector")


@query(f"WITH o AS ({_ONCE}) SELECT chunk_id, len(v)::BIGINT AS dim, round(list_sum(CASE WHEN chunk_id % 2 = 0 THEN list_transform(v, lambda x: x * 2) ELSE v END), 5) AS total FROM o WHERE chunk_id % 2 = 0 OR chunk_id % 3 <> 0")
def vector_upsert(spark, d):
    """A store of the ids not divisible by 3, with twice the vectors of the even ids put in."""
    s = _stored(spark, d)
    new = s.where("chunk_id % 2 = 0").select("chunk_id", F.transform("vector", lambda x: x * F.lit(2).cast("float")).alias("vector"))
    return _rows(store.upsert(s.where("chunk_id % 3 <> 0"), new, 64))


@query(f"WITH o AS ({_ONCE}) SELECT chunk_id, len(v)::BIGINT AS dim, round(list_sum(v), 5) AS total FROM o WHERE chunk_id % 7 <> 0")
def vector_delete(spark, d):
    s = _stored(spark, d)
    return _rows(store.delete(s, s.where("chunk_id % 7 = 0").select("chunk_id")))


@query("SELECT count(DISTINCT chunk_id)::BIGINT AS vectors FROM chunks WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x)))")
def vector_count(spark, d):
    return _stored(spark, d).agg(F.count("*").alias("vectors"))


@query(
    """WITH o AS (SELECT chunk_id, arg_max(vector, stored_at)::DOUBLE[] AS v, max(stored_at) AS t FROM chunks WHERE vector IS NOT NULL AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) GROUP BY 1),
n AS (SELECT greatest(1, len(arg_min(v, chunk_id))) AS dim FROM o)
SELECT chunk_id, len(v)::BIGINT AS dim, round(list_sum(v), 5) AS total FROM o, n WHERE len(v) = n.dim"""
)
def vector_rebuild(spark, d):
    """Vectors encoded as blobs, decoded again; rows of another length than the first row's are skipped."""
    c = _t(spark, d, "chunks").where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    c = c.groupBy("chunk_id").agg(F.max(F.struct("stored_at", "vector")).alias("m")).select("chunk_id", "m.vector")
    rows = c.select("chunk_id", F.lit("model").alias("model"), F.size("vector").alias("dim"), blobs.encode("vector").alias("vector"))
    return _rows(store.rebuild(rows, "model"))


# -- chunking ---------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) > 0),
k AS (SELECT *, unnest(range(0, greatest(0, ceil((n - 1500) / 1250.0)::INT) + 1)) AS k FROM d),
w AS (SELECT *, substring(text, (k * 1250 + 1)::INT, 1500) AS w, substring(text, 1, (k * 1250)::INT) AS before FROM k),
p AS (SELECT *, length(w) - length(string_split(w, chr(10))[-1]) - 1 AS pos FROM w),
c AS (SELECT *, CASE WHEN k * 1250 + 1500 < n AND strpos(w, chr(10)) > 0 AND strlen(substring(w, 1, pos::INT)) > 750 THEN substring(w, 1, pos::INT) ELSE w END AS t FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i FROM c WHERE n <= 1500 OR regexp_matches(t, '[^\\s\\x0b]'))
SELECT id AS doc_id, i::BIGINT AS chunk_index, (CASE WHEN n <= 1500 THEN 1 ELSE length(before) - length(replace(before, chr(10), '')) + 1 END)::BIGINT AS line_start,
(CASE WHEN n <= 1500 THEN greatest(1, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END) ELSE length(before) - length(replace(before, chr(10), '')) + 1 + length(t) - length(replace(t, chr(10), '')) END)::BIGINT AS line_end,
md5(t) AS text_md5 FROM f WHERE i < 28"""
)
def window_chunks(spark, d):
    w = chunking.windows(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return w.select(F.col("id").alias("doc_id"), *_big("chunk_index", "line_start", "line_end"), F.md5("text").alias("text_md5"))


@query()
def line_packs(spark, d):
    """Chunks above the limit packed by whole lines."""
    c = plan.latest_chunks(_t(spark, d, "semantic_chunks")).where(F.octet_length("text") > chunking.MAX_CHARS)
    return chunking.line_packs(c.select(F.col("chunk_id").alias("id"), "text", "line_start")).select(F.col("id").alias("chunk_id"), "chunk_index", "line_start", "line_end", F.md5("text").alias("text_md5"))


_CHUNKS = "SELECT chunk_id, arg_max(file_id, indexed_at) file_id, arg_max(project, indexed_at) project, arg_max(rel_path, indexed_at) rel_path, arg_max(chunk_index, indexed_at) chunk_index, arg_max(line_start, indexed_at) line_start, arg_max(line_end, indexed_at) line_end, arg_max(text, indexed_at) AS text, arg_max(symbol_name, indexed_at) symbol_name, arg_max(kind, indexed_at) kind, arg_max(parent_context, indexed_at) parent_context FROM semantic_chunks GROUP BY 1"


@query(
    f"""WITH c AS ({_CHUNKS}), g AS (SELECT file_id, line_start, coalesce(text, '') AS t, greatest(0, coalesce(line_start, 1) - coalesce(lag(coalesce(line_end, line_start, 1)) OVER (PARTITION BY file_id ORDER BY line_start, chunk_index), 1)) AS gap, chunk_index FROM c)
SELECT file_id, md5(string_agg(repeat(chr(10), gap) || t, '' ORDER BY line_start, chunk_index)) AS text_md5 FROM g GROUP BY 1"""
)
def full_documents(spark, d):
    """Every file stitched from its chunks."""
    return packing.documents(_t(spark, d, "semantic_chunks")).select("file_id", F.md5("text").alias("text_md5"))


@query(
    f"""WITH c AS ({_CHUNKS}) SELECT chunk_id, '// File: ' || rel_path || CASE WHEN coalesce(parent_context, '') <> '' THEN chr(10) || '// Context: ' || parent_context ELSE '' END ||
CASE kind WHEN 'ImportBlock' THEN chr(10) || '// Imports' WHEN 'Preamble' THEN chr(10) || '// File preamble' WHEN 'TextWindow' THEN '' ELSE CASE WHEN coalesce(symbol_name, '') = '' THEN '' ELSE
 CASE kind WHEN 'Function' THEN chr(10) || '// Function: ' || symbol_name WHEN 'Method' THEN chr(10) || '// Method: ' || symbol_name WHEN 'TypeHeader' THEN chr(10) || '// Type: ' || symbol_name WHEN 'Declaration' THEN chr(10) || '// Declaration: ' || symbol_name ELSE '' END END END AS header
FROM c WHERE rel_path IS NOT NULL AND kind IS NOT NULL"""
)
def context_header(spark, d):
    m = _t(spark, d, "semantic_chunks").groupBy("chunk_id").agg(F.max(F.struct("indexed_at", "kind", "symbol_name", "parent_context", "rel_path")).alias("m")).select("chunk_id", "m.*")
    m = m.where("rel_path is not null and kind is not null")
    return m.select("chunk_id", text.context_header(F.col("kind"), F.col("symbol_name"), F.col("parent_context"), F.col("rel_path")).alias("header"))


@query(
    f"""WITH c AS ({_CHUNKS}), s AS (SELECT chunk_id, CASE WHEN strpos(text, '{{') > 0 THEN split_part(text, '{{', 1) WHEN strpos(text, ':') > 0 THEN split_part(text, ':', 1) || ':' ELSE split_part(text, chr(10), 1) END AS s FROM c WHERE text IS NOT NULL)
SELECT chunk_id, regexp_replace(s, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS signature FROM s"""
)
def signature(spark, d):
    c = plan.latest_chunks(_t(spark, d, "semantic_chunks")).where("text is not null")
    return c.select("chunk_id", text.signature(F.col("text")).alias("signature"))


_EXT = "lower(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {{e}} IN ({', '.join(repr(x) for x in exts)}) THEN '{lang}'" for lang, exts in text.EXTENSIONS.items()) + " ELSE '' END"
_FILES = "SELECT file_id, arg_max(project, seen_at) project, arg_max(path, seen_at) AS path, arg_max(mtime, seen_at) mtime, arg_max(size, seen_at) size, arg_max(content_hash, seen_at) content_hash FROM file_state GROUP BY 1"


@query(f"WITH f AS ({_FILES}) SELECT file_id, {_LANG.format(e=_EXT)} AS lang FROM f")
def language_detect(spark, d):
    return corpus.latest_files(_t(spark, d, "file_state")).select("file_id", text.language_of_path(F.col("path")).alias("lang"))


_IMPORT_ROWS = f"""WITH f AS ({_FILES}), i AS (SELECT import_id, min(file_id) AS file_id, min(trim(raw_specifier, ' ' || chr(9) || chr(10) || chr(13))) AS spec FROM raw_imports WHERE import_id IS NOT NULL GROUP BY 1),
j AS (SELECT import_id, project, path AS source_file, spec FROM i JOIN f USING (file_id) WHERE spec <> '')"""


def _imports(spark, d):
    i = _t(spark, d, "raw_imports").where("import_id is not null").groupBy("import_id").agg(F.min("file_id").alias("file_id"), F.min(text.strip(F.col("raw_specifier"))).alias("raw_specifier"))
    f = corpus.latest_files(_t(spark, d, "file_state"))
    return i.where("raw_specifier <> ''").join(f.select("file_id", "project", F.col("path").alias("source_file")), "file_id"), f


_NORMAL = "list_reduce(list_prepend('', list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.')), lambda a, s: CASE WHEN s = '..' THEN CASE WHEN strpos(a, '/') > 0 THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END WHEN a = '' THEN s ELSE a || '/' || s END)"


@query(_IMPORT_ROWS + f" SELECT import_id, {_NORMAL.format(p="regexp_extract(source_file, '^(.*)/[^/]*$', 1) || '/' || spec")} AS normalized FROM j WHERE spec LIKE '.%'")
def path_normalize(spark, d):
    """Relative specifiers joined to their file's directory."""
    i, _ = _imports(spark, d)
    i = i.where(F.col("raw_specifier").startswith("."))
    return i.select("import_id", text.normalize_path(F.concat_ws("/", text.directory(F.col("source_file")), F.col("raw_specifier"))).alias("normalized"))


_PROBES = ", ".join(repr(p) for p in imports.SCRIPT_PROBES)


@query(
    _IMPORT_ROWS
    + f""", k AS (SELECT *, {_LANG.format(e="lower(regexp_extract(split_part(source_file, '/', -1), '^.+\\.([^.]+)$', 1))")} AS lang, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM j),
n AS (SELECT *, {_NORMAL.format(p="dir || '/' || spec")} AS near, replace(regexp_replace(spec, '^\\.+', ''), '.', '/') AS dotted FROM k),
c AS (SELECT import_id, project, unnest([{{'r': 0, 'p': dotted || '.py'}}, {{'r': 1, 'p': dotted || '/__init__.py'}}, {{'r': 2, 'p': 'src/' || dotted || '.py'}}, {{'r': 3, 'p': 'src/' || dotted || '/__init__.py'}}]) AS c, true AS suffix FROM n WHERE lang = 'Python' AND dotted <> ''
 UNION ALL SELECT import_id, project, unnest(list_transform([{_PROBES}], lambda e, i: {{'r': (i - 1)::INT, 'p': near || e}})), true FROM n WHERE lang IN ('JavaScript', 'TypeScript', 'Tsx') AND spec LIKE '.%'
 UNION ALL SELECT import_id, project, unnest([{{'r': 0, 'p': 'src/' || replace(substring(spec, 8), '::', '/') || '.rs'}}, {{'r': 1, 'p': 'src/' || replace(substring(spec, 8), '::', '/') || '/mod.rs'}}]), false FROM n WHERE lang = 'Rust' AND spec LIKE 'crate::%'
 UNION ALL SELECT import_id, project, {{'r': 0, 'p': near}}, false FROM n WHERE lang IN ('C', 'Cpp') UNION ALL SELECT import_id, project, {{'r': 1, 'p': spec}}, true FROM n WHERE lang IN ('C', 'Cpp')),
h AS (SELECT c.import_id, arg_min(c.c.p, c.c.r) AS resolved FROM c WHERE EXISTS (SELECT 1 FROM f WHERE f.project = c.project AND (f.path = c.c.p OR (c.suffix AND suffix(f.path, '/' || c.c.p)))) GROUP BY 1
 UNION ALL SELECT import_id, arg_min(f.path, f.file_id) FROM n JOIN f USING (project) WHERE lang = 'Go' AND split_part(spec, '/', -1) <> '' AND contains('/' || f.path, '/' || split_part(spec, '/', -1) || '/') GROUP BY 1
 UNION ALL SELECT import_id, arg_min(f.path, f.file_id) FROM n JOIN f USING (project) WHERE lang = 'Java' AND suffix(f.path, replace(spec, '.', '/') || '.java') GROUP BY 1)
SELECT n.import_id, n.project, n.source_file, n.spec AS raw_specifier, coalesce(h.resolved, '') AS resolved FROM n LEFT JOIN h USING (import_id)"""
)
def import_resolve(spark, d):
    """Every import resolved in its project; files in order of file_id."""
    i, f = _imports(spark, d)
    return imports.resolve(i, f.select("project", "path", F.col("file_id").alias("ordinal")))


@query("SELECT DISTINCT project, source_file AS src_path, resolved AS dst_path FROM (" + SQL["import_resolve"] + ") WHERE resolved <> ''")
def dependency_edges(spark, d):
    return imports.dependency_edges(import_resolve(spark, d))


def _sources(spark, d):
    s = packing.documents(_t(spark, d, "semantic_chunks"))
    f = corpus.latest_files(_t(spark, d, "file_state"))
    return s.join(f.select("file_id", "path"), "file_id").select(F.col("file_id").alias("id"), "path", "text")


@query()
def code_chunks(spark, d):
    """Files parsed again into semantic chunks, windows where nothing was found."""
    return code.chunks(code.analyze(_sources(spark, d))).select(F.col("id").alias("file_id"), "chunk_index", "kind", "symbol_name", "parent_context", "line_start", "line_end", F.md5("text").alias("text_md5"), "context_header")


@query()
def code_symbols(spark, d):
    return code.symbols(code.analyze(_sources(spark, d))).withColumnRenamed("id", "file_id")


@query()
def code_imports(spark, d):
    return code.imports(code.analyze(_sources(spark, d))).withColumnRenamed("id", "file_id")


# -- lexical ----------------------------------------------------------------------------------

def _top(sql: str, k: int) -> str:
    return sql.replace("{k}", str(k))


_TOK = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK.format(t='text')}) AS token FROM documents WHERE text IS NOT NULL) SELECT token, count(*)::BIGINT AS uses, count(DISTINCT doc_id)::BIGINT AS docs FROM t GROUP BY 1")
def token_stats(spark, d):
    return lexical.token_stats(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_SYMBOLS = "SELECT symbol_id, arg_max(name, indexed_at) AS name, arg_max(signature, indexed_at) AS signature, arg_max(file_id, indexed_at) AS file_id FROM symbols WHERE symbol_id IS NOT NULL GROUP BY 1"
_SPLIT_NAME = "regexp_replace(replace(name, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


def _symbols(spark, d):
    return _t(spark, d, "symbols").where("symbol_id is not null").groupBy("symbol_id").agg(F.max(F.struct("indexed_at", "name", "signature", "file_id")).alias("m")).select("symbol_id", "m.name", "m.signature", "m.file_id")


def _name_queries(spark, d):
    """The words of every symbol name whose id is divisible by 20."""
    s = _symbols(spark, d).where("symbol_id % 20 = 0 and name <> ''")
    return s.select(F.col("symbol_id").alias("query_id"), F.regexp_replace(F.replace("name", F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2").alias("text"))


_NAME_QUERIES = f"q AS (SELECT symbol_id AS query_id, {_SPLIT_NAME} AS text FROM ({_SYMBOLS}) WHERE symbol_id % 20 = 0 AND name <> '')"
_BM25 = f"""c AS (SELECT chunk_id AS id, {_TOK.format(t="coalesce(text, '')")} AS t FROM ({_CHUNKS})), n AS (SELECT count(*) AS n, avg(len(t)) AS av FROM c),
qt AS (SELECT query_id, unnest(list_distinct({_TOK.format(t='text')})) AS token FROM q),
p AS (SELECT id, len(t) AS dl, unnest(t) AS token FROM c), tf AS (SELECT id, dl, token, count(*) AS tf FROM p WHERE token IN (SELECT token FROM qt) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, id, round(sum(round(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6)), 6) AS score FROM qt JOIN df USING (token) JOIN tf USING (token), n GROUP BY 1, 2),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < {{k}})"""


def _chunk_texts(spark, d):
    return plan.latest_chunks(_t(spark, d, "semantic_chunks"), "text").withColumnRenamed("chunk_id", "id")


@query("WITH " + _NAME_QUERIES + ", " + _top(_BM25, 10) + " SELECT query_id, id AS chunk_id, score FROM lex")
def bm25_topk(spark, d):
    """The 10 best chunks for the words of every twentieth symbol."""
    return lexical.bm25(_chunk_texts(spark, d), _name_queries(spark, d)).select("query_id", F.col("id").alias("chunk_id"), "score")


_PATHS = f"""fp AS (SELECT file_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(path), '[/._-]'), lambda x: x <> ''))) AS word FROM ({_FILES})),
qw AS (SELECT query_id, list_distinct({_TOK.format(t='text')}) AS t FROM q), qp AS (SELECT query_id, len(t) AS n, unnest(t) AS word FROM qw WHERE len(t) > 0),
ps AS (SELECT query_id, id, round(count(*) / any_value(n), 6) AS score FROM qp JOIN fp USING (word) GROUP BY 1, 2),
path AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM ps QUALIFY rank < {{k}})"""


@query("WITH q AS (SELECT DISTINCT p.file_id + 0 AS query_id, replace(regexp_extract(p.path, '([^/]*)\\.[^./]*$', 1), '_', ' ') AS text FROM (" + _FILES + ") p WHERE file_id % 20 = 0), " + _top(_PATHS, 10) + " SELECT query_id, id AS file_id, score, rank::BIGINT AS rank FROM path")
def path_keyword_match(spark, d):
    """The words of every twentieth file's name looked up in all paths."""
    f = corpus.latest_files(_t(spark, d, "file_state"))
    q = f.where("file_id % 20 = 0").select(F.col("file_id").alias("query_id"), F.replace(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), F.lit("_"), F.lit(" ")).alias("text"))
    m = lexical.path_matches(f.select(F.col("file_id").alias("id"), "path"), q)
    return m.select("query_id", F.col("id").alias("file_id"), "score", *_big("rank"))


@query(
    f"""WITH s AS (SELECT symbol_id AS id, lower(name) AS name FROM ({_SYMBOLS}) WHERE name <> ''), q AS (SELECT symbol_id AS query_id, lower(left(name, 7)) AS prefix FROM ({_SYMBOLS}) WHERE name <> '' AND symbol_id % 20 = 0),
m AS (SELECT query_id, id, round(length(prefix) / length(name), 6) AS score FROM q JOIN s ON starts_with(name, prefix))
SELECT query_id, id AS symbol_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::BIGINT AS rank FROM m QUALIFY rank < 10"""
)
def symbol_prefix(spark, d):
    """Every twentieth symbol's first seven letters as a prefix."""
    s = _symbols(spark, d)
    q = s.where("symbol_id % 20 = 0").select(F.col("symbol_id").alias("query_id"), F.substring("name", 1, 7).alias("text"))
    m = lexical.symbol_prefix(s.select(F.col("symbol_id").alias("id"), "name"), q)
    return m.select("query_id", F.col("id").alias("symbol_id"), "score", *_big("rank"))


# -- classes, fusion and re-ranking -----------------------------------------------------------


@query(
    f"""WITH t AS (SELECT 'symbol' AS source, symbol_id AS id, name AS text FROM ({_SYMBOLS}) UNION ALL SELECT 'signature', symbol_id, signature FROM ({_SYMBOLS})
 UNION ALL SELECT 'path', file_id, path FROM ({_FILES}) UNION ALL SELECT 'document', doc_id, split_part(text, '.', 1) || '?' FROM documents)
SELECT source, id, {text.query_class_sql('text')} AS query_class FROM t"""
)
def query_classify(spark, d):
    s, f, docs = _symbols(spark, d), corpus.latest_files(_t(spark, d, "file_state")), _t(spark, d, "documents")
    rows = s.select(F.lit("symbol").alias("source"), F.col("symbol_id").alias("id"), F.col("name").alias("text"))
    rows = rows.unionByName(s.select(F.lit("signature").alias("source"), F.col("symbol_id").alias("id"), F.col("signature").alias("text")))
    rows = rows.unionByName(f.select(F.lit("path").alias("source"), F.col("file_id").alias("id"), F.col("path").alias("text")))
    rows = rows.unionByName(docs.select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.concat(F.substring_index("text", ".", 1), F.lit("?")).alias("text")))
    return rows.select("source", "id", text.query_class(F.col("text")).alias("query_class"))


_WEIGHTS = "w(query_class, source, weight) AS (VALUES " + ", ".join(f"('{c}', '{s}', {x})" for c, ws in fusion.WEIGHTS.items() for s, x in ws.items()) + ")"


_FUSE3 = "WITH " + _NAME_QUERIES + ", " + _top(_BM25, 20) + f""", cp AS (SELECT chunk_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(rel_path), '[/._-]'), lambda x: x <> ''))) AS word FROM ({_CHUNKS}) WHERE rel_path IS NOT NULL),
qw AS (SELECT query_id, list_distinct({_TOK.format(t='text')}) AS t FROM q), qp AS (SELECT query_id, len(t) AS n, unnest(t) AS word FROM qw WHERE len(t) > 0),
ps AS (SELECT query_id, id, round(count(*) / any_value(n), 6) AS score FROM qp JOIN cp USING (word) GROUP BY 1, 2),
path AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM ps QUALIFY rank < 20),
ss AS (SELECT query_id, c.chunk_id AS id, round(length(trim(q.text)) / length(c.symbol_name), 6) AS score FROM q JOIN ({_CHUNKS}) c ON c.symbol_name <> '' AND starts_with(lower(c.symbol_name), lower(trim(q.text)))),
sym AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM ss QUALIFY rank < 20),
k AS (SELECT query_id, {text.query_class_sql('text')} AS query_class FROM q), {_WEIGHTS}, """
_HITS3 = "SELECT query_id, 'lexical' AS source, id, rank FROM lex UNION ALL SELECT query_id, 'path', id, rank FROM path UNION ALL SELECT query_id, 'symbol', id, rank FROM sym"
_SUM = "SELECT query_id, id, round(sum(weight / (60 + rank + 1)), 9) AS score FROM h JOIN k USING (query_id) JOIN w USING (query_class, source) GROUP BY 1, 2"


@query(_FUSE3 + f"""h AS ({_HITS3}), r AS ({_SUM})
SELECT query_id, id AS chunk_id, round(score, 7) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20""")
def rrf_fusion(spark, d):
    """Three sources fused by weighted reciprocal rank."""
    q = _name_queries(spark, d)
    c = plan.latest_chunks(_t(spark, d, "semantic_chunks"), "rel_path", "symbol_name").withColumnRenamed("chunk_id", "id")
    parts = {
        "lexical": lexical.bm25(_chunk_texts(spark, d), q, 20),
        "path": lexical.path_matches(c.where("rel_path is not null").select("id", F.col("rel_path").alias("path")), q, 20),
        "symbol": lexical.symbol_prefix(c.select("id", F.col("symbol_name").alias("name")), q, 20),
    }
    hits = None
    for name, h in parts.items():
        h = h.select("query_id", F.lit(name).alias("source"), "id", "rank")
        hits = h if hits is None else hits.unionByName(h)
    fused = fusion.fuse(hits, q.select("query_id", text.query_class(F.col("text")).alias("query_class")), 20)
    return fused.select("query_id", F.col("id").alias("chunk_id"), F.round("score", 7).alias("score"))


_VECTORS = f"""st AS ({_ONCE}), fi AS (SELECT file_id, min(chunk_id) AS chunk_id FROM ({_CHUNKS}) GROUP BY 1),
qv AS (SELECT symbol_id AS query_id, st.v FROM ({_SYMBOLS}) y JOIN fi USING (file_id) JOIN st USING (chunk_id) WHERE symbol_id % 20 = 0),
nd AS (SELECT query_id, st.chunk_id AS id, round(pow(list_distance(qv.v, st.v), 2), 6) AS distance FROM qv, st),
nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM nd QUALIFY rank < {{k}})"""
_FUSE4 = _FUSE3 + _top(_VECTORS, 60) + f""", h AS ({_HITS3} UNION ALL SELECT query_id, 'vector', id, rank FROM nr WHERE rank < 20), r AS ({_SUM}),
fu AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM r QUALIFY rank < 20)"""


def _asked(spark, d):
    """Latest chunks and vectors, the words of every twentieth symbol, the vectors of the symbols' first chunks, and the chunks without texts.

    Vectors and small columns are written once, so that what looks at them shuffles neither texts nor vectors.
    """
    from ..shared import written

    q = _name_queries(spark, d)
    s = _t(spark, d, "semantic_chunks")
    light = written(plan.latest_chunks(s, "file_id", "project", "rel_path", "symbol_name"), "light")
    stored = written(plan.latest_vectors(_t(spark, d, "chunks")), "vectors")
    first = light.groupBy("file_id").agg(F.min("chunk_id").alias("item_id"))
    asked = written(_symbols(spark, d).where("symbol_id % 20 = 0").join(first, "file_id").select(F.col("symbol_id").alias("query_id"), "item_id"), "firsts")
    qv = stored.join(lexical.few(asked), "item_id").select("query_id", "vector")
    return plan.latest_chunks(s, "text"), stored, q, qv, light


@query(_FUSE4 + " SELECT query_id, id AS chunk_id, round(score, 7) AS score, rank::BIGINT AS rank FROM fu")
def search(spark, d):
    """Four sources, fused: the words of every twentieth symbol, with the vector of the symbol's first chunk as query vector."""
    *asked, light = _asked(spark, d)
    return plan.fused(*asked, light=light).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 7).alias("score"), *_big("rank"))


@query(
    "WITH " + _NAME_QUERIES + ", " + _top(_BM25, 20) + f""", m AS (SELECT query_id, id, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS s FROM lex WINDOW w AS (PARTITION BY query_id)),
g AS (SELECT m.query_id, m.id, coalesce(s, 1.0) AS s, list_distinct({_TOK.format(t='q.text')}) AS a, list_distinct({_TOK.format(t="coalesce(c.text, '')")}) AS b FROM m JOIN q USING (query_id) JOIN ({_CHUNKS}) c ON c.chunk_id = m.id)
SELECT query_id, id AS chunk_id, round(0.7 * len(list_intersect(a, b)) / len(a) + 0.3 * s, 5) AS score FROM g"""
)
def rerank_blend(spark, d):
    """The lexical hits graded by the overlap of words, 0.7 to 0.3."""
    from pyspark.sql import Window

    q, of = lexical.representatives(_name_queries(spark, d))
    c = _chunk_texts(spark, d)
    h = lexical.bm25(c, q, 20)
    w = Window.partitionBy("query_id")
    span = F.max("score").over(w) - F.min("score").over(w)
    h = h.withColumn("score", F.coalesce((F.col("score") - F.min("score").over(w)) / F.nullif(span, F.lit(0.0)), F.lit(1.0)))
    pairs = h.join(q.withColumnRenamed("text", "query"), "query_id").join(c, "id").select("query_id", "id", "score", F.array_join(text.tokens(F.col("query")), " ").alias("query"), F.array_join(text.tokens(F.col("text")), " ").alias("text"))
    return lexical.for_all(fusion.rerank(pairs).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 5).alias("score")), of)


@query(
    "WITH " + _NAME_QUERIES + ", " + _top(_BM25, 20) + ", " + _top(_PATHS, 20)
    + " SELECT query_id, id, round(0.7 * coalesce(lex.score, 0) + 0.3 * coalesce(path.score, 0), 9) AS score FROM lex FULL JOIN path USING (query_id, id)"
)
def hyde_blend(spark, d):
    """Two result lists blended 0.7 to 0.3, a missing side counting nothing."""
    q, of = lexical.representatives(_name_queries(spark, d))
    f = corpus.latest_files(_t(spark, d, "file_state"))
    a = lexical.bm25(_chunk_texts(spark, d), q, 20)
    b = lexical.path_matches(f.select(F.col("file_id").alias("id"), "path"), q, 20)
    return lexical.for_all(fusion.hyde_blend(a, b), of)


@query(
    "WITH " + _NAME_QUERIES + ", " + _top(_BM25, 50) + f""", h AS (SELECT query_id, id, c.project, score FROM lex JOIN ({_CHUNKS}) c ON c.chunk_id = id), b AS (SELECT query_id, project, max(score) AS best FROM h GROUP BY 1, 2),
t AS (SELECT query_id, project FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, project) <= 5) SELECT h.query_id, h.id AS chunk_id, h.project, h.score FROM h JOIN t USING (query_id, project)"""
)
def tiered_search(spark, d):
    """Hits of each query's five best projects; the tier is set to start at one project here."""
    q, of = lexical.representatives(_name_queries(spark, d))
    h = lexical.bm25(_chunk_texts(spark, d), q, 50)
    p = plan.latest_chunks(_t(spark, d, "semantic_chunks"), "project").withColumnRenamed("chunk_id", "id")
    return lexical.for_all(fusion.tier(h.join(p, "id").select("query_id", "id", "project", "score"), _t(spark, d, "projects"), 1, 5).select("query_id", F.col("id").alias("chunk_id"), "project", "score"), of)


# -- graph and feedback -----------------------------------------------------------------------

_EDGES = f"""fe AS (SELECT DISTINCT f.project, trim(i.raw_specifier) AS feature FROM raw_imports i JOIN ({_FILES}) f USING (file_id) WHERE trim(i.raw_specifier) <> '' AND f.project IS NOT NULL), sz AS (SELECT project, count(*) AS n FROM fe GROUP BY 1),
cm AS (SELECT a.project AS src, b.project AS dst, count(*) AS n_both FROM fe a JOIN fe b ON a.feature = b.feature AND a.project <> b.project GROUP BY 1, 2),
ed AS (SELECT src, dst, round(n_both / (x.n + y.n - n_both), 6) AS strength FROM cm JOIN sz x ON x.project = src JOIN sz y ON y.project = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) <= 8)"""


def _edges(spark, d):
    f = corpus.latest_files(_t(spark, d, "file_state")).select("file_id", "project")
    i = _t(spark, d, "raw_imports").select("file_id", F.trim("raw_specifier").alias("feature")).where("feature <> ''")
    return graph.project_edges(i.join(f, "file_id"))


def _kept_edges(spark, d):
    """The edges written once: at most eight per project, read by every hop."""
    from ..shared import written

    return written(_edges(spark, d), "edges")


@query("WITH " + _EDGES + " SELECT * FROM ed")
def project_edges(spark, d):
    return _edges(spark, d)


@query(
    "WITH " + _EDGES + """, w AS (SELECT src, dst, least(0.90, 0.20 + 0.70 * strength) * 0.6 AS w FROM ed), z AS (SELECT DISTINCT src AS seed FROM ed),
o AS (SELECT seed, dst AS project, w AS weight FROM z JOIN w ON seed = src), t AS (SELECT seed, w.dst AS project, weight * w.w AS weight FROM o JOIN w ON project = src),
a AS (SELECT seed, seed AS project, 1.0 AS weight FROM z UNION ALL SELECT * FROM o UNION ALL SELECT * FROM t) SELECT seed, project, round(max(weight), 9) AS weight FROM a GROUP BY 1, 2"""
)
def graph_expand(spark, d):
    """Every project with its neighbours within two hops."""
    e = _kept_edges(spark, d)
    return graph.expand(e.select(F.col("src").alias("project")), e)


@query("WITH " + _EDGES + " SELECT src AS seed, dst AS id, (row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst))::BIGINT AS rank FROM ed QUALIFY rank <= 3")
def related_projects(spark, d):
    e = _kept_edges(spark, d)
    return graph.related(e.select(F.col("src").alias("id")), e.withColumnRenamed("strength", "weight")).select("seed", "id", *_big("rank"))


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, round(sum(exp(-(epoch_us(now) - epoch_us(ts)) / 86400e6 / 14.0)), 4) AS frecency FROM events, n WHERE user_id IS NOT NULL GROUP BY 1")
def frecency(spark, d):
    e = _t(spark, d, "events")
    now = e.agg(F.max("ts")).scalar()
    return graph.frecency(e, "user_id", now).select("user_id", F.round("frecency", 4).alias("frecency"))


_DECISION = "CASE event_type WHEN 'error' THEN 'Suppress' WHEN 'click' THEN 'Restore' WHEN 'purchase' THEN 'Good' WHEN 'view' THEN 'Weak' ELSE 'Clear' END"


@query(f"WITH l AS (SELECT user_id % 97 AS src, user_id % 89 AS dst, ts, {_DECISION} AS decision FROM events) SELECT src, dst, arg_max(decision, (ts, decision)) AS decision, max(ts) AS ts FROM l GROUP BY 1, 2")
def feedback_latest(spark, d):
    """Events read as decisions on relations: the latest of each."""
    log = _t(spark, d, "events").select((F.col("user_id") % 97).alias("src"), (F.col("user_id") % 89).alias("dst"), "ts", F.expr(_DECISION).alias("decision"))
    return graph.latest_feedback(log, ["src", "dst"])


# -- corpus -----------------------------------------------------------------------------------


@query(
    f"""WITH n AS ({_FILES}), o AS (SELECT project, path, CASE WHEN file_id % 5 = 1 THEN mtime - INTERVAL 1 HOUR ELSE mtime END AS mtime, CASE WHEN file_id % 7 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN file_id % 7 = 1 THEN 'x' ELSE content_hash END AS content_hash FROM n WHERE file_id % 11 <> 0),
m AS (SELECT * FROM n WHERE file_id % 13 <> 0)
SELECT coalesce(o.project, m.project) AS project, coalesce(o.path, m.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'removed' WHEN o.mtime = m.mtime AND o.size = m.size THEN 'unchanged' WHEN o.content_hash IS NOT DISTINCT FROM m.content_hash THEN 'touched' ELSE 'modified' END AS state
FROM o FULL JOIN m ON o.project = m.project AND o.path = m.path"""
)
def incremental_diff(spark, d):
    """The files against a version of them with other times, sizes, hashes and rows."""
    n = corpus.latest_files(_t(spark, d, "file_state"))
    o = n.where("file_id % 11 <> 0").select(
        "project", "path", F.when(F.col("file_id") % 5 == 1, F.col("mtime") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(F.col("file_id") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("file_id") % 7 == 1, F.lit("x")).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return corpus.changes(o, n.where("file_id % 13 <> 0"))


@query(f"WITH f AS ({_FILES}) SELECT file_id, project, path FROM f WHERE NOT EXISTS (SELECT 1 FROM (SELECT project AS p, unnest(excludes) AS e FROM projects) x WHERE p = f.project AND (f.path = trim(e, '/') OR starts_with(f.path, trim(e, '/') || '/')) AND trim(e, '/') <> '')")
def exclude_filter(spark, d):
    f = corpus.latest_files(_t(spark, d, "file_state")).select("file_id", "project", "path")
    return corpus.without_excluded(f, _t(spark, d, "projects"))


@query("WITH c AS (SELECT user_id::VARCHAR AS query, event_type AS model, max(ts) AS last_used, max(ts) AS cached_at FROM events GROUP BY 1, 2), n AS (SELECT max(last_used) AS now FROM c) SELECT query, model, last_used FROM c, n WHERE epoch_us(now) - epoch_us(cached_at) < 864000000000 ORDER BY last_used DESC, query, model LIMIT 4096")
def query_cache(spark, d):
    """Events as uses of cached queries: what is younger than ten days, the 4096 used last."""
    c = _t(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("model")).agg(F.max("ts").alias("last_used"), F.max("ts").alias("cached_at"))
    now = c.agg(F.max("last_used")).scalar()
    return corpus.cached(c, now, 864_000).select("query", "model", "last_used")


# -- packing ----------------------------------------------------------------------------------


def _hits(spark, d, *columns: str, k: int = 60):
    """The hits of one of all queries with the same words, with these columns of their chunks or all that packing needs, and which query has whose hits."""
    c = plan.latest_chunks(_t(spark, d, "semantic_chunks"), *(columns or ("text", "file_id", "project", "chunk_index"))).withColumnRenamed("chunk_id", "id")
    q, of = lexical.representatives(_name_queries(spark, d))
    h = lexical.bm25(_chunk_texts(spark, d), q, k)
    return h.select("query_id", "id", "score").join(c, "id"), of


_HITS = "WITH " + _NAME_QUERIES + ", " + _top(_BM25, 60) + f", hits AS (SELECT query_id, id, score, c.text, c.file_id, c.project, c.chunk_index FROM lex JOIN ({_CHUNKS}) c ON c.chunk_id = id)"


@query(_HITS + ", a AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, project ORDER BY score DESC, id) <= 8) SELECT query_id, id AS chunk_id, score FROM b")
def pack_diversity(spark, d):
    h, of = _hits(spark, d, "file_id", "project")
    return lexical.for_all(packing.diverse(h).select("query_id", F.col("id").alias("chunk_id"), "score"), of)


@query(_HITS + ", b AS (SELECT *, sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM hits) SELECT query_id, id AS chunk_id, score FROM b WHERE used <= 8000")
def pack_budget(spark, d):
    h, of = _hits(spark, d, "text")
    return lexical.for_all(packing.within_budget(h, 8000).select("query_id", F.col("id").alias("chunk_id"), "score"), of)


@query(
    _HITS + ", o AS (SELECT *, max(score) OVER (PARTITION BY query_id, file_id) AS best FROM hits) SELECT query_id, id AS chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY best DESC, file_id, chunk_index, id))::BIGINT AS position FROM o"
)
def pack_order(spark, d):
    h, of = _hits(spark, d, "file_id", "chunk_index")
    return lexical.for_all(packing.coherent(h).select("query_id", F.col("id").alias("chunk_id"), *_big("position")), of)


_DEDUP = f""", pt AS MATERIALIZED (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r, list_transform(list_distinct({_TOK.format(t="coalesce(text, '')")}), lambda x: hash(x)) AS t FROM hits),
pp AS MATERIALIZED (SELECT a.query_id, a.r AS ra, b.r AS rb, len(a.t) + len(b.t) AS n, len(list_intersect(a.t, b.t)) AS i FROM pt a JOIN pt b ON a.query_id = b.query_id AND a.r < b.r AND len(a.t) <= 3 * len(b.t) AND len(b.t) <= 3 * len(a.t)),
nl AS MATERIALIZED (SELECT pt.query_id, pt.r, list(pp.ra) FILTER (WHERE pp.i > 0.5 * (pp.n - pp.i)) AS like_ FROM pt LEFT JOIN pp ON pp.query_id = pt.query_id AND pp.rb = pt.r GROUP BY 1, 2),
kf AS (SELECT DISTINCT query_id, 0 AS r, []::BIGINT[] AS kept FROM pt UNION ALL SELECT nl.query_id, nl.r, CASE WHEN len(list_intersect(kf.kept, coalesce(nl.like_, []))) > 0 THEN kf.kept ELSE list_append(kf.kept, nl.r) END FROM kf JOIN nl ON nl.query_id = kf.query_id AND nl.r = kf.r + 1),
kl AS (SELECT query_id, unnest(arg_max(kept, r)) AS r FROM kf GROUP BY 1), dd AS (SELECT h.* FROM hits h JOIN pt USING (query_id, id) JOIN kl USING (query_id, r))"""
_RECURSIVE = _HITS.replace("WITH ", "WITH RECURSIVE ", 1)
_PACK = _RECURSIVE + _DEDUP + """, a AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, project ORDER BY score DESC, id) <= 8),
u AS (SELECT *, sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM b), ch AS (SELECT query_id, id, score, file_id, project, chunk_index FROM u WHERE used <= 12000)"""


@query(_RECURSIVE + _DEDUP + " SELECT query_id, id AS chunk_id, score FROM dd")
def pack_dedup(spark, d):
    """A greedy pass over each query's sixty best."""
    h, of = _hits(spark, d, "text")
    return lexical.for_all(packing.dedup(h).select("query_id", F.col("id").alias("chunk_id"), "score"), of)


@query(
    _PACK + f""", al AS (SELECT chunk_id AS id, file_id, chunk_index FROM ({_CHUNKS})),
rc AS (SELECT ch.query_id, ch.id AS seed, ch.score, al.id, row_number() OVER (PARTITION BY ch.query_id, ch.id ORDER BY abs(al.chunk_index - ch.chunk_index), al.chunk_index, al.id) AS rank FROM ch JOIN al ON al.file_id = ch.file_id AND al.chunk_index <> ch.chunk_index AND abs(al.chunk_index - ch.chunk_index) <= 3 WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.query_id = ch.query_id AND x.id = al.id) QUALIFY rank <= 3),
rl AS (SELECT query_id, id, max(score) AS score FROM rc GROUP BY 1, 2), ev AS (SELECT query_id, id, score, file_id, chunk_index, 'hit' AS role FROM ch UNION ALL SELECT rl.query_id, rl.id, rl.score, al.file_id, al.chunk_index, 'related' FROM rl JOIN al USING (id)),
o AS (SELECT *, max(score) OVER (PARTITION BY query_id, file_id) AS best FROM ev)
SELECT query_id, id AS chunk_id, file_id, chunk_index::BIGINT AS chunk_index, role, (row_number() OVER (PARTITION BY query_id ORDER BY best DESC, file_id, chunk_index, id))::BIGINT AS position FROM o"""
)
def pack_context(spark, d):
    """Dedup, caps, budget, related chunks and order in one chain."""
    c = plan.latest_chunks(_t(spark, d, "semantic_chunks"))
    h, of = _hits(spark, d)
    return lexical.for_all(plan.context(h, c).select("query_id", F.col("id").alias("chunk_id"), "file_id", *_big("chunk_index"), "role", *_big("position")), of)


@query(
    _PACK + f""", cd AS (SELECT DISTINCT query_id, file_id FROM ch), c2 AS ({_CHUNKS}), g AS (SELECT file_id, line_start, coalesce(text, '') AS t, greatest(0, coalesce(line_start, 1) - coalesce(lag(coalesce(line_end, line_start, 1)) OVER (PARTITION BY file_id ORDER BY line_start, chunk_index), 1)) AS gap, chunk_index FROM c2),
wf AS (SELECT file_id, md5(string_agg(repeat(chr(10), gap) || t, '' ORDER BY line_start, chunk_index)) AS text_md5 FROM g GROUP BY 1) SELECT query_id, file_id, text_md5 FROM cd JOIN wf USING (file_id)"""
)
def pack_documents(spark, d):
    """The whole documents of what was packed."""
    h, of = _hits(spark, d)
    p = packing.pack(h).select("query_id", "file_id").distinct()
    c = _t(spark, d, "semantic_chunks").join(p.select("file_id").distinct(), "file_id", "left_semi")
    whole = packing.documents(c).select("file_id", F.md5("text").alias("text_md5"))  # so that rows, not texts, meet the queries
    return lexical.for_all(p.join(whole, "file_id").select("query_id", "file_id", "text_md5"), of)


def _hyde(texts: list[str]) -> list[str]:
    return [t + " " + t.replace(" ", "_") for t in texts]


@query(
    _FUSE4.replace("WITH ", "WITH ", 1) + ", " + _EDGES + f""", pj AS (SELECT fu.query_id, fu.id, c.project, fu.score FROM fu JOIN ({_CHUNKS}) c ON c.chunk_id = fu.id), tb AS (SELECT query_id, project, max(score) AS best FROM pj GROUP BY 1, 2),
tt AS (SELECT query_id, project FROM tb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, project) <= 10), hi AS (SELECT pj.* FROM pj JOIN tt USING (query_id, project)),
se AS (SELECT query_id, project, max(score) AS seed_score FROM (SELECT * FROM hi WHERE project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5) GROUP BY 1, 2),
ew AS (SELECT src, dst, least(0.90, 0.20 + 0.70 * strength) * 0.6 AS w FROM ed), z AS (SELECT DISTINCT project AS seed FROM se), o1 AS (SELECT seed, dst AS project, w AS weight FROM z JOIN ew ON seed = src), o2 AS (SELECT seed, ew.dst AS project, weight * ew.w AS weight FROM o1 JOIN ew ON project = src),
wy AS (SELECT seed, project, round(max(weight), 9) AS weight FROM (SELECT seed, seed AS project, 1.0 AS weight FROM z UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2) GROUP BY 1, 2),
dr AS (SELECT nr.query_id, nr.id, se.seed_score * CASE WHEN wy.seed = wy.project THEN 0.76 + 0.12 * round(1 / (1 + nr.distance), 9) ELSE wy.weight END AS score FROM nr JOIN ({_CHUNKS}) c ON c.chunk_id = nr.id JOIN wy ON wy.project = c.project JOIN se ON se.query_id = nr.query_id AND se.project = wy.seed),
ex AS (SELECT query_id, id, round(max(score), 9) AS score FROM (SELECT query_id, id, score FROM hi UNION ALL SELECT * FROM dr) GROUP BY 1, 2),
po AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 60), sc AS (SELECT query_id, id, CASE WHEN max(score) OVER v > min(score) OVER v THEN (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) ELSE 1.0 END AS score FROM po WINDOW v AS (PARTITION BY query_id)),
gr AS (SELECT sc.query_id, sc.id, sc.score, list_distinct({_TOK.format(t='q.text')}) AS a, list_distinct({_TOK.format(t="coalesce(c.text, '')")}) AS b FROM sc JOIN q USING (query_id) JOIN ({_CHUNKS}) c ON c.chunk_id = sc.id)
SELECT query_id, id AS chunk_id, round(0.7 * len(list_intersect(a, b)) / len(a) + 0.3 * score, 5) AS score FROM gr"""
)
def full_search(spark, d):
    """Four sources fused, narrowed to ten projects, expanded through the graph, sixty re-ranked in batches; the tier starts at one project here."""
    c, stored, q, qv, light = _asked(spark, d)
    found = plan.full(c, stored, q, qv, _t(spark, d, "projects"), _kept_edges(spark, d), _word_grade, tier_from=1, tier_keep=10, light=light)
    return found.select("query_id", F.col("id").alias("chunk_id"), F.round("score", 5).alias("score"))


def _word_grade(pairs: list[tuple[str, str]]) -> list[float]:
    """Grades by the share of the query's tokens, letters and digits, that the text has."""
    import regex

    words = lambda x: set(regex.findall(r"[\p{L}\p{N}]+", (x or "").lower()))
    return [10.0 * len(words(a) & words(b)) / max(1, len(words(a))) for a, b in pairs]


@query()
def hyde_search(spark, d):
    """The first sentences of documents as queries; those in natural language get a hypothetical text, embedded by hashed words, as a second vector query."""
    docs = _t(spark, d, "documents")
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("how does "), F.substring_index(F.substring_index("text", "\n", 1), ".", 1)).alias("text"))
    stored = vectors.embed(docs.select(F.col("doc_id").alias("id"), "text"), vectors.hashed_words()).withColumnRenamed("id", "item_id")
    qv = vectors.embed(q.withColumnRenamed("query_id", "id"), vectors.hashed_words()).withColumnRenamed("id", "query_id")
    second = vectors.search(stored, plan.hypothetical(q, _hyde, vectors.hashed_words()), 20, rounded=6)
    return fusion.hyde_blend(vectors.search(stored, qv, 20, rounded=6).withColumnRenamed("item_id", "id"), second.withColumnRenamed("item_id", "id"))


@query(f"WITH o AS ({_ONCE}) SELECT chunk_id, len(v)::BIGINT AS dim, round(list_sum(v), 5) AS total FROM o")
def stream_upsert(spark, d):
    """The vector table taken in as a stream of micro-batches into a versioned store; equal to one batch."""
    from ..shared import scratch
    from ..streaming import watch

    folder = scratch(spark, "stream")
    s = _t(spark, d, "chunks")
    fine = F.col("chunk_id").isNotNull() & (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    s.where(fine).repartition(4).write.mode("overwrite").parquet(f"{folder}/in")
    events = watch.source(spark, f"{folder}/in", "chunk_id bigint, vector array<float>, stored_at timestamp", 2)
    table = store.Store(f"{folder}/store", 64)
    watch.upsert_stream(events, table, f"{folder}/state").awaitTermination()
    return _rows(table.open(spark))
