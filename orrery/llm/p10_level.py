"""Problem 10: the reading level of each document, as a band.

Words of the whole corpus's English prose are ranked by frequency; for each document the smallest
frequency-ranked vocabulary that covers a fixed share of its words gives its coverage ranks.
Together with the length of sentences and words they are calibrated to the rated bands by linear
discriminants whose moments and scores are computed in SQL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BANDS = (1, 2, 3, 4)
SHARES = (0.5, 0.7, 0.8, 0.9, 0.95)
LEAST_WORDS = 50
#: Bound of the ranked vocabulary that is sent to the workers; rarer words share the next rank.
VOCABULARY = 50_000
FEATURES = ["log_sentence", "word_length", *[f"log_rank_{int(100 * s)}" for s in SHARES]]

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_NOT_PROSE = re.compile(
    r"(?m)^[ \t]*(?:\|.*|.*\|[ \t]*|#{1,6}[ \t].*|\[?\d{1,4}[-:/]\d\d[-:/T ]\d\d.*|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b.*|[-=*_|+ ]{3,}|.*[{};][ \t]*|[$>]{1,3} \S+ .*--?\w.*)$"
    r"|^(?:    |\t)[ \t]*(?:.*[=(){}\[\];].*|(?:return|else|try|pass|break|end)\b.*)$"
)
_INLINE = re.compile(r"<[^<>\n]{1,300}>|https?://\S+|`[^`\n]*`|&[a-z]{2,8};")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n|\n(?=[ \t]*(?:[-*+>]|\d+[.)])\s)|\n(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# Function words of other languages, by which their prose is told from English.
_FOREIGN = frozenset(
    """der die das und ist nicht ein eine einen zu den von mit für auf dem wenn es sie wird im le la les des et est une un du pour dans que qui pas sur au aux el los las y en por con para una se del al como si
    il lo gli che di non per sono è na um uma os as não com het een van niet op te dat och att det som är på""".split()
)
_ENGLISH = frozenset("the a an of to and in is it that you for on with as be this not do we so but can has its when if or at by from which are was were will must no have they every each after any more than before".split())
_SUFFIX = re.compile(r"(?:tion|tions|ity|ities|ize|izes|ized|ing|ly|ness|ment|ments|ous|able|ible|ed|ism|ance|ence|ates|al)$")


def prose(text: str) -> str:
    """A text without code, tables, logs, headings, mark-up and addresses; line ends are kept."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    return _INLINE.sub(" ", _NOT_PROSE.sub("\n", text))


def english(words: list[str], counts: Counter) -> bool:
    """Prose in English: few function words of other languages or other scripts, and English ones or English endings."""
    n = len(words)
    foreign = sum(c for w, c in counts.items() if w in _FOREIGN)
    other = sum(c for w, c in counts.items() if not w.isascii())
    if foreign >= 0.12 * n or other >= 0.1 * n:
        return False
    known = sum(c for w, c in counts.items() if w in _ENGLISH)
    return known >= 0.12 * n or known + sum(c for w, c in counts.items() if w not in _ENGLISH and _SUFFIX.search(w)) >= 0.3 * n


def profile(documents: DataFrame) -> DataFrame:
    """(doc_id, words, sentences, letters, bag): English prose of at least LEAST_WORDS words; bag holds word hashes and counts.

    Null and empty texts, and documents in other languages, have no row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                if not text:
                    continue
                body = prose(text)
                words = _WORD.findall(body.lower())
                if len(words) < LEAST_WORDS:
                    continue
                counts = Counter(words)
                if not english(words, counts):
                    continue
                sentences = sum(1 for s in _SENTENCE.split(body) if s and _WORD.search(s))
                if len(hashes) > 500_000:
                    hashes.clear()
                keys = np.empty(len(counts), np.uint64)
                for k, w in enumerate(counts):
                    h = hashes.get(w)
                    if h is None:
                        h = hashes[w] = xxhash.xxh3_64_intdigest(w)
                    keys[k] = h
                tf = np.fromiter(counts.values(), np.uint32, len(counts))
                letters = sum(len(w) * c for w, c in counts.items())
                rows.append((doc_id, len(words), max(1, sentences), letters, keys.tobytes() + tf.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "sentences", "letters", "bag"])

    return documents.where("doc_id is not null and length(text) > 100").select("doc_id", "text").mapInPandas(read, "doc_id bigint, words int, sentences int, letters bigint, bag binary")


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def vocabulary(profiles: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Word hashes by falling corpus frequency: counted over all documents, the size most frequent kept."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            parts = [_bag(b) for b in pdf["bag"]]
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield pd.DataFrame({"word": keys.view(np.int64), "n": np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)})

    total = profiles.select("bag").mapInPandas(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = total.orderBy(F.desc("n"), "word").limit(size).toPandas()
    return top["word"].to_numpy(np.int64).view(np.uint64)


def features(profiles: DataFrame, ranked: np.ndarray) -> DataFrame:
    """doc_id with FEATURES: coverage ranks at SHARES (in logs), mean sentence length (in logs) and word length."""
    order = np.argsort(ranked)
    keys, ranks = ranked[order], order.astype(np.int64) + 1
    last = len(ranked) + 1

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty((len(pdf), len(SHARES)))
            for k, raw in enumerate(pdf["bag"]):
                w, tf = _bag(raw)
                if len(keys):
                    p = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
                    r = np.where(keys[p] == w, ranks[p], last)
                else:
                    r = np.full(len(w), last)
                o = np.argsort(r, kind="stable")
                c = np.cumsum(tf[o])
                out[k] = r[o][np.searchsorted(c, np.ceil(np.array(SHARES) * c[-1] - 1e-9))]
            y = pd.DataFrame(np.log(out), columns=FEATURES[2:])
            y.insert(0, "word_length", (pdf["letters"] / pdf["words"]).to_numpy())
            y.insert(0, "log_sentence", np.log(pdf["words"] / pdf["sentences"]).to_numpy())
            y.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield y

    return profiles.mapInPandas(cover, "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def truth(labels: DataFrame) -> DataFrame:
    """(doc_id, band): rated documents on which the raters agree; null bands and repeated rows do not count."""
    b = labels.where(F.col("doc_id").isNotNull() & F.col("band").isin(*BANDS)).groupBy("doc_id").agg(F.min("band").alias("band"), F.max("band").alias("high"))
    return b.where("band = high").select("doc_id", "band")


def calibrate(feats: DataFrame, labels: DataFrame, ridge: float = 1e-2) -> list[tuple[int, float, list[float]]]:
    """Per band the constant and weights of its linear discriminant: moments in one SQL aggregation, a small solve on the driver."""
    j = feats.join(truth(labels), "doc_id")
    k = len(FEATURES)
    aggs = [F.count("*").alias("n"), *[F.sum(f).alias(f"s{a}") for a, f in enumerate(FEATURES)]]
    aggs += [F.sum(F.col(FEATURES[a]) * F.col(FEATURES[b])).alias(f"q{a}_{b}") for a in range(k) for b in range(a, k)]
    rows = j.groupBy("band").agg(*aggs).collect()  # one row per band
    n = sum(r["n"] for r in rows)
    if not n:
        return []
    within = np.zeros((k, k))
    means = {}
    for r in rows:
        m = np.array([r[f"s{a}"] for a in range(k)]) / r["n"]
        means[r["band"]] = (r["n"] / n, m)
        for a in range(k):
            for b in range(a, k):
                c = r[f"q{a}_{b}"] - r["n"] * m[a] * m[b]
                within[a, b] += c
                within[b, a] = within[a, b]
    inverse = np.linalg.inv(within / n + ridge * np.eye(k))
    return [(band, float(np.log(p) - 0.5 * m @ inverse @ m), [float(x) for x in inverse @ m]) for band, (p, m) in sorted(means.items())]


def score(rule: list[tuple[int, float, list[float]]]) -> Column:
    """The band with the highest discriminant, the easier one of equals."""
    s = [F.struct((F.lit(c) + sum((F.col(f) * F.lit(w) for f, w in zip(FEATURES, ws)), F.lit(0.0))).alias("s"), F.lit(-band).alias("b")) for band, c, ws in rule]
    return (-(F.greatest(*s) if len(s) > 1 else s[0])["b"]).cast("int")


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, band, FEATURES) of every document with enough English prose; no rows without any usable label."""
    p = common.materialize(profile(documents))
    f = features(p, vocabulary(p))
    f = common.materialize(f)
    rule = calibrate(f, labels)
    if not rule:
        return f.withColumn("band", F.lit(None).cast("int")).where("band is not null").select("doc_id", "band", *FEATURES)
    return f.withColumn("band", score(rule)).select("doc_id", "band", *FEATURES)
