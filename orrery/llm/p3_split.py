"""Problem 3: items above a size limit, cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 150
#: Boundary classes, best first: after a blank line, after a line, after a statement or sentence, after white space.
_TOKENS = re.compile(r"\n[ \t\r]*\n\s*|\n[ \t]*|[ \t\r\f\v]+|\w+|[^\w\s]+|\s", re.S)


def boundaries(text: str):
    """(offsets in characters, offsets in bytes, class) of every token end: prefix sums over the token lengths."""
    tokens = _TOKENS.findall(text)
    chars = np.cumsum([len(t) for t in tokens]) if tokens else np.zeros(0, int)
    plain = text.isascii()
    sizes = chars if plain else np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in tokens])
    kinds = []
    prev = ""
    for t in tokens:
        if t[0] == "\n":
            kinds.append(0 if t.count("\n") > 1 else 1)
        elif t.isspace():
            kinds.append(2 if prev[-1:] in ".;:!?}" else 3)
        else:
            kinds.append(4)
        prev = t
    return chars, sizes, np.array(kinds, dtype=np.int8)


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of text as [start, end) in characters, each within limit bytes of UTF-8.

    The end is the last boundary of the best class within the limit that leaves the piece at least
    half full, found by binary search in that class's sorted offsets; without one, a token end; a
    token longer than the limit is cut hard between characters.  The next piece steps back by at
    most overlap bytes to a boundary; the text is covered without a gap.
    """
    if overlap >= limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    chars, sizes, kinds = boundaries(text)
    total = int(sizes[-1]) if len(sizes) else 0
    if total <= limit:
        return [(0, len(text))]
    at = [np.flatnonzero(kinds <= k) for k in range(4)] + [np.arange(len(kinds))]
    by_class = [sizes[i].tolist() for i in at]
    char_of = dict(zip(sizes.tolist(), chars.tolist()))
    char_of[0] = 0
    raw = None if text.isascii() else text.encode("utf-8", "surrogatepass")
    out, start = [], 0
    while True:
        if total - start <= limit:
            out.append((start, total))
            break
        end = 0
        for k, offsets in enumerate(by_class):
            j = bisect_right(offsets, start + limit) - 1
            if j >= 0 and offsets[j] > start + (limit // 2 if k < 4 else 0):
                end = offsets[j]
                break
        if not end:  # hard cut, at a character
            end = start + limit
            while raw is not None and end > start + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append((start, end))
        back = end
        for offsets in by_class[1:4]:
            j = bisect_right(offsets, end - overlap - 1)
            if j < len(offsets) and start < offsets[j] < end:
                back = offsets[j]
                break
        else:
            if overlap and end - overlap > start:
                back = end - overlap
                while raw is not None and raw[back] & 0xC0 == 0x80:
                    back += 1
        start = back if back > out[-1][0] else end
    if raw is None:
        return out
    place = lambda b: char_of[b] if b in char_of else len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(place(a), place(b)) for a, b in out]


_SCHEMA = "chunk_id bigint, piece int, pieces int, kind string, line_start int, line_end int, bytes int, char_start int, char_end int, text string"
# The chunk kinds of the index.
KINDS = ["ImportBlock", "Preamble", "Function", "TypeHeader", "Method", "Declaration", "TextWindow"]


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk above limit bytes; chunks within the limit are left out.

    kind is spelled as the index spells it, null stays null.  line_start counts on from the
    chunk's line_start (from 1 if null).  Rows of one chunk_id count once, the latest text wins;
    null and empty texts have no pieces.  Sizes are compared before any text is shuffled.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk_id, kind, first, text in pdf.itertuples(index=False, name=None):
                parts = split(text, limit, overlap)
                first = 1 if pd.isna(first) else int(first)
                for k, (a, b) in enumerate(parts):
                    line = first + text.count("\n", 0, a)
                    piece = text[a:b]
                    rows.append((chunk_id, k, len(parts), kind, line, line + piece[:-1].count("\n"), len(piece.encode("utf-8", "surrogatepass")), a, b, piece))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    named = F.create_map(*[x for k in KINDS for x in (F.lit(k.lower()), F.lit(k))])
    big = chunks.where(F.col("chunk_id").isNotNull() & (F.octet_length("text") > limit)).select("chunk_id", F.struct("indexed_at", "text", "kind", "line_start").alias("row"))
    one = big.groupBy("chunk_id").agg(F.max("row").alias("row")).select("chunk_id", F.coalesce(named[F.lower("row.kind")], "row.kind").alias("kind"), "row.line_start", "row.text")
    return one.mapInPandas(cut, _SCHEMA)


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id of every chunk that ``pieces`` cut."""
    return pieces(chunks, limit).where("piece = 0").select("chunk_id")
