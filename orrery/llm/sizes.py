"""Token counts of documents, with a place on a space-filling curve for packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CURVE_DIMS, CURVE_BITS = 3, 10
#: Ranks below this are the most common subwords; they say nothing about the subject and get no weight.
COMMON_RANKS = 2000


def hilbert(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, dims), by the transposed-axes rule."""
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit down
        p = q - 1
        for k in range(dims):
            high = (x[k] & q) != 0
            swap = (x[0] ^ x[k]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[k] = np.where(high, x[k], x[k] ^ swap)
        q >>= 1
    for k in range(1, dims):  # Gray code
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | (((x[k] ^ t) >> b) & 1)
    return key


def sized(documents: DataFrame, keep: list[str], curve: bool = False, folder: str | None = None) -> DataFrame:
    """The keep columns with n_tokens under the public byte-level vocabulary; with curve, also the Hilbert key.

    Null and empty texts have 0 tokens.  The text is read once and goes no further.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokenizer import byte_bpe

        enc = byte_bpe(folder=folder)
        table = np.random.default_rng(5).standard_normal((enc.n_vocab + 1, CURVE_DIMS)).astype(np.float32)
        table[:COMMON_RANKS] = 0
        for pdf in batches:
            texts = pdf.pop("text")
            n = np.zeros(len(pdf), np.int64)
            at = np.zeros((len(pdf), CURVE_DIMS), np.float32)
            for k, text in enumerate(texts):
                if not text:
                    continue
                ids = enc.encode_ordinary(text)
                n[k] = len(ids)
                if curve:
                    v = table[np.asarray(ids, np.int32)]
                    at[k] = v.sum(0) / np.sqrt(max(1, np.count_nonzero(v[:, 0])))
            pdf["n_tokens"] = n
            if curve:
                cells = np.clip(((np.arctan(at) / np.pi + 0.5) * (1 << CURVE_BITS)).astype(np.int64), 0, (1 << CURVE_BITS) - 1)
                pdf["curve"] = hilbert(cells)
            yield pdf

    kinds = dict(documents.select(*keep).dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint" + (", curve bigint" if curve else "")
    return common.spread(documents.select(*keep, F.col("text"))).mapInPandas(count, schema)
