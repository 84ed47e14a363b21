"""Lexical search: tokens, statistics, BM25, path words and symbol prefixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shared import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def token_stats(docs: DataFrame) -> DataFrame:
    """(token, uses, docs) over (id, text): counted in the JVM with map-side combination."""
    t = docs.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))
    return t.groupBy("token").agg(F.sum("tf").alias("uses"), F.count("*").alias("docs"))


def index(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(token, id, dl, tf): the postings of (id, text), written once, with a row of the empty token per document.

    The texts are scanned and cut into tokens once, whatever is asked of the index afterwards.
    With asked (token), only those tokens are written.
    """
    d = docs.select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    words = d.select("id", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("token"))
    if asked is not None:
        mark = docs.sparkSession.range(1).select(F.lit("").alias("token"))
        words = words.join(few(written(asked.select("token").unionByName(mark).distinct(), "wanted")), "token", "left_semi")
    return written(words.groupBy("token", "id", "dl").agg(F.count("*").alias("tf")), "postings")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """``ranked_by_index`` over postings of docs (id, text) made for these queries (query_id, text)."""
    asked = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")), "asked")
    return ranked_by_index(index(docs, asked), asked, k, digits)


#: Aimed-at postings of a block of documents, and terms of a block of queries; a pair of blocks is the unit of work.
BLOCK, TERMS = 250_000, 500_000
#: Tokens up to this many are sent to every task; more are joined by a shuffle.
FEW_TOKENS = 200_000
#: Steps of a posting's weight, of 0 to 2.2, at which postings are counted for the lower bound of the k-th.
STEPS = 22
#: Only essential tokens make candidates where that leaves at most one of so many pairs of query and document.
PRUNE_FROM = 3
#: Sums of parts stay below; a document's sum has this added for each of its tokens, so that one of parts 0 is seen too.
_MARK = 1 << 40


def few(tokens: DataFrame) -> DataFrame:
    """tokens, a written table of one row per token, to be broadcast where they are few."""
    return F.broadcast(tokens) if tokens.count() <= FEW_TOKENS else tokens


def alike(asked: DataFrame) -> DataFrame:
    """(query_id, set_id, tokens) of (query_id, token): queries of the same tokens have the least of their ids as set_id."""
    sets = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return sets.withColumn("set_id", F.min("query_id").over(Window.partitionBy("tokens")))


def representatives(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, of): one of all queries (query_id, text) with the same tokens, and (query_id, set_id), of which query each has the result.

    Those without a token are left out.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    of = written(alike(asked).select("query_id", "set_id"), "alike")
    return queries.join(of.where("query_id = set_id").select("query_id"), "query_id", "left_semi"), of


def for_all(results: DataFrame, of: DataFrame) -> DataFrame:
    """results (query_id, ...) of ``representatives`` given to every query that they stand for."""
    columns = results.columns
    return of.join(results.withColumnRenamed("query_id", "set_id"), "set_id").select(columns)


def _merged(code: np.ndarray, at: np.ndarray, s: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Postings in the order of code and place, those of the same two added up: (code -> slice, places, marked sums)."""
    order = np.lexsort((at, code))
    code, at, s = code[order], at[order], s[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])])
    code, at, s = code[first], at[first], np.add.reduceat(s, first) + _MARK
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return {int(code[a]): slice(a, b) for a, b in zip(starts, np.r_[starts[1:], len(code)])}, at, s


def _best_of_block(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(set_id, id, s): the k best of these postings (code, id, s) for each set of these terms (set_id, code, essential, least), ties to the smaller id."""
    out_set, out_at, out_s = [], [], []
    ids, at = np.unique(left["id"].to_numpy(), return_inverse=True)
    where, at, s = _merged(left["code"].to_numpy(), at, left["s"].to_numpy()) if len(left) else ({}, at, at)
    terms = right[right["code"].isin(where.keys())].sort_values(["set_id", "code"])
    sets, codes, essential, least = (terms[c].to_numpy() for c in ("set_id", "code", "essential", "least"))
    starts = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]]) if len(sets) else np.zeros(0, int)
    n, sums = len(ids), np.zeros(len(ids), np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(sets)]):
        own = [where[int(c)] for c in codes[a:b]]
        for x in own:
            sums[at[x]] += s[x]
        places, totals = [], []
        for x, needed in zip(own, essential[a:b]):
            if needed:  # what was taken is set to 0, so that it is taken once
                p = at[x]
                v = sums[p]
                some = v > 0
                sums[p] = 0
                v &= _MARK - 1
                some &= v >= least[a]
                places.append(p[some])
                totals.append(v[some])
        for x in own:
            sums[at[x]] = 0
        if not places:
            continue
        key = np.concatenate(totals) * n + (n - 1 - np.concatenate(places))  # greater: more, then the smaller id
        if len(key) > k:
            key = np.partition(key, len(key) - k)[len(key) - k :]
        v, p = np.divmod(key, n)
        out_set.append(np.repeat(sets[a : a + 1], len(key)))
        out_at.append(n - 1 - p)
        out_s.append(v)
    if not out_set:
        return pd.DataFrame({"set_id": [], "id": [], "s": []})
    return pd.DataFrame({"set_id": np.concatenate(out_set), "id": ids[np.concatenate(out_at)], "s": np.concatenate(out_s)})


def best(postings: DataFrame, terms: DataFrame, size: int, asked: int, k: int) -> DataFrame:
    """(set_id, id, s): the k best ids of each set by the sum of s, and more; of each block of documents its k best.

    postings are (code, id, s), size of them, terms (set_id, code, essential, least), asked of them.  A
    posting is shuffled once for each block of queries, and pairs of query and document are never
    written: they are summed up inside a task, of which at most k per set leave it.  A sum below
    least, or without an essential token, is left out.
    """
    sc = postings.sparkSession.sparkContext
    docs, queries = max(-(-size // BLOCK), min(2 * sc.defaultParallelism, -(-size // 20_000)), 1), max(1, -(-asked // TERMS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    kinds = dict(terms.dtypes) | {"id": dict(postings.dtypes)["id"]}
    p = postings.where("id is not null").select("code", "id", "s", F.pmod(F.xxhash64("id"), F.lit(docs)).alias("d"), every(queries).alias("q"))
    t = terms.select("set_id", "code", "essential", "least", F.pmod(F.xxhash64("set_id"), F.lit(queries)).alias("q"), every(docs).alias("d"))
    p, t = (x.repartition(docs * queries, "d", "q").groupBy("d", "q") for x in (p, t))
    run = lambda left, right: _best_of_block(k, left, right)
    return p.cogroup(t).applyInPandas(run, f"set_id {kinds['set_id']}, id {kinds['id']}, s bigint")


def ranked_by_index(postings: DataFrame, asked: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best documents per query, rank from 0, ties to the smaller id.

    asked are (query_id, token), each token once per query; queries of the same tokens are looked up
    once.  Parts are rounded before they are summed, so that the score does not depend on the order of
    rows.  What the k-th posting of a query's most telling token weighs at least is a lower bound of
    the k-th score: what stays below it is dropped.  Tokens whose greatest parts together stay below
    it are not essential, and a document without an essential token cannot be among the k best.
    """
    size = postings.where("token = ''").agg(F.count("*"), F.avg("dl")).first()
    n, avg = F.lit(size[0]), F.lit(size[1] or 1.0)
    g = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))
    post = postings.where("token <> ''").select("token", "id", g.alias("g"))
    at = [(K1 + 1) * x / STEPS for x in range(1, STEPS)]
    many = [F.count(F.when(F.col("g") >= x, 1)).alias(f"c{i}") for i, x in enumerate(at)]
    df = post.groupBy("token").agg(F.count("*").alias("df"), F.max("g").alias("most"), *many)
    idf = F.greatest(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    kth = F.greatest(F.lit(0.0), *[F.when(F.col(f"c{i}") >= k, x).otherwise(0.0) for i, x in enumerate(at)])
    known = df.select("token", "df", idf.alias("idf"), (idf * F.col("most")).alias("most"), (idf * kth).alias("kth"))
    known = written(known.withColumn("code", F.monotonically_increasing_id()), "tokens")
    sets = written(alike(asked), "sets")
    terms = sets.where("query_id = set_id").select("set_id", F.explode("tokens").alias("token")).join(few(known), "token")
    of, rising = Window.partitionBy("set_id"), Window.partitionBy("set_id").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.max("kth").over(of)
    essential = F.sum("most").over(rising) + 1e-4 >= bound
    least = F.floor((bound - 1e-4) * 10**digits)  # the parts are rounded, the bound is not
    terms = written(terms.select("set_id", "code", "df", essential.alias("essential"), least.alias("least")), "terms")
    pairs = terms.agg(F.sum("df"), F.sum(F.when(F.col("essential"), F.col("df"))), F.count("*")).first()
    if (pairs[1] or 0) * PRUNE_FROM > (pairs[0] or 0):  # both ways give the same rows
        terms = terms.withColumn("essential", F.lit(True))
    part = F.round(F.col("idf") * F.col("g") * 10**digits).cast("bigint").alias("s")  # whole numbers add up exactly
    total = known.agg(F.sum("df")).first()[0] or 0
    s = best(post.join(few(known), "token").select("code", "id", part), terms, total, pairs[2], k)
    found = ranked(s.select("set_id", "id", (F.col("s") / 10**digits).alias("score")), "set_id", "id", "score", k)
    return sets.select("query_id", "set_id").join(found, "set_id").select("query_id", "id", "score", "rank")


def ranked(hits: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items per query with their rank from 0; ties go to the smaller item."""
    r = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return hits.withColumn("rank", r).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)  # the plain bound lets each task cut to k before the shuffle


def path_matches(paths: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): share of a query's words among the parts of (id, path), split at / . _ and -."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    sets = written(alike(asked), "sets")
    terms = sets.where("query_id = set_id").select("set_id", F.explode("tokens").alias("token"))
    known = few(written(terms.select("token").distinct().withColumn("code", F.monotonically_increasing_id()), "words"))
    words = F.array_distinct(F.filter(F.split(F.lower("path"), "[/._-]"), lambda x: x != ""))
    p = written(paths.select("id", F.explode(words).alias("token")).join(known, "token").select("code", "id", F.lit(1).cast("bigint").alias("s")), "path-words")
    t = terms.join(known, "token").select("set_id", "code", F.lit(True).alias("essential"), F.lit(0).cast("bigint").alias("least"))
    s = best(p, written(t, "terms"), p.count(), t.count(), k)
    found = ranked(s, "set_id", "id", "s", k)
    j = sets.select("query_id", "set_id", F.size("tokens").alias("n")).join(found, "set_id")
    return j.select("query_id", "id", F.round(F.col("s") / F.col("n"), 6).alias("score"), "rank")


def symbol_prefix(symbols: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): symbols (id, name) whose lower-cased name starts with the query, shorter names first.

    Names are cut to the lengths that queries have and joined on the whole prefix; of each prefix
    only the k best names leave a task, so a prefix that a third of all names share moves little.
    """
    q = queries.select("query_id", F.lower(F.trim("text")).alias("prefix")).where("prefix <> ''")
    wanted = few(written(q.select("prefix").distinct(), "prefixes"))
    lengths = wanted.agg(F.array_sort(F.collect_set(F.length("prefix")))).first()[0]  # no more than the longest prefix has characters
    s = symbols.where("name <> ''").select("id", F.lower("name").alias("name"))
    cuts = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("name"))
    keys = s.select("id", F.length("name").alias("n"), F.explode(F.transform(cuts, lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("prefix")).join(wanted, "prefix", "left_semi")
    keys = keys.groupBy("prefix", "id").agg(F.min("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy("n", "id"))).where(F.col("r") <= k)
    j = q.join(keys, "prefix").groupBy("query_id", "id").agg(F.max(F.round(F.length("prefix") / F.col("n"), 6)).alias("score"))
    return ranked(j, "query_id", "id", "score", k)
