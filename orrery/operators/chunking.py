"""Chunking without a parser: overlapping windows and whole-line packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread

MAX_CHARS, MAX_WINDOWS = 1500, 28


def windows(docs: DataFrame, size: int = MAX_CHARS, most: int = MAX_WINDOWS) -> DataFrame:
    """(id, chunk_index, line_start, line_end, text) windows of (id, text), built in the row: nothing is shuffled.

    Windows of size characters start every size - size // 6; each but the last is cut at its last
    line end if that lies beyond half the size in bytes.  Texts within size are one window, blank or
    not; blank windows of longer texts are dropped, and at most ``most`` windows are kept.  Null and
    empty texts have none.
    """
    d = window_arrays(spread(docs.where("length(text) > 0").select("id", "text")), ["id"], size, most)
    return d.select("id", F.posexplode("windows").alias("chunk_index", "w")).select("id", "chunk_index", "w.line_start", "w.line_end", "w.text")


def window_arrays(docs: DataFrame, keep: list[str], size: int = MAX_CHARS, most: int = MAX_WINDOWS) -> DataFrame:
    """The keep columns of docs with the windows of text as an array of (text, line_start, line_end), null for null text."""
    step = max(size - size // 6, 1)
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n")))
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int"))
    d = docs.select(*keep, "text", F.length("text").alias("n_"), F.when(F.length("text") > 0, F.sequence(F.lit(0), last)).alias("ks_"))

    # one step after the other, so that what a later one needs twice is made once
    cut = F.transform("ks_", lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * step + 1, F.lit(size)).alias("w")))
    headed = F.transform(cut, lambda x: F.struct(x["k"].alias("k"), x["w"].alias("w"), F.substring(x["w"], F.lit(1), F.length(x["w"]) - F.locate("\n", F.reverse(x["w"]))).alias("head")))  # up to the last line end
    short = lambda x: (x["k"] * step + size < F.col("n_")) & (F.instr(x["w"], "\n") > 0) & (F.octet_length(x["head"]) > size // 2)
    ended = F.transform(headed, lambda x: F.struct(x["k"].alias("k"), F.when(short(x), x["head"]).otherwise(x["w"]).alias("t")))
    kept = F.slice(F.filter(ended, lambda x: (F.col("n_") <= size) | x["t"].rlike(r"\S")), 1, most)
    # line ends of every step, so that those before a window are a sum of the steps before it
    steps = F.transform("ks_", lambda k: ends(F.substring(F.col("text"), k * step + 1, F.lit(step))))
    whole = F.col("n_") <= size

    def placed(x, steps):
        t, one = x["t"], F.aggregate(F.slice(steps, F.lit(1), x["k"]), F.lit(1), lambda s, y: s + y)
        lines = F.greatest(F.lit(1), ends(t) + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1))
        return F.struct(t.alias("text"), one.alias("line_start"), F.when(whole, lines).otherwise(one + ends(t)).cast("int").alias("line_end"))

    # the one-row transform binds the steps: named as a column, the optimizer would count them anew for every window
    bound = F.transform(F.array(F.struct(kept.alias("kept"), steps.alias("steps"))), lambda z: F.transform(z["kept"], lambda x: placed(x, z["steps"])))
    return d.select(*keep, F.element_at(bound, 1).alias("windows"))


def pack_lines(text: str, limit: int = MAX_CHARS, base: int = 1) -> list[tuple[str, int, int]]:
    """Whole lines packed greedily into (text, first line, last line); sizes are UTF-8 bytes.

    A line above the limit stands alone and whole; empty lines at the start of a pack vanish from
    its text, white space at its end too; a blank last pack is left out.
    """
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out, held, used, first = [], [], 0, base
    for k, line in enumerate(lines):
        line = line[:-1] if line.endswith("\r") else line
        size = len(line.encode("utf-8", "surrogatepass"))
        if used and used + size + 1 > limit:
            out.append(("\n".join(held).rstrip(), first, max(base + k - 1, first)))
            held, used, first = [], 0, base + k
        if used:
            used += 1
            held.append(line)
        else:
            held = [line]
        used += size
    whole = "\n".join(held)
    if whole.strip():
        out.append((whole.rstrip(), first, max(base + len(lines) - 1, first)))
    return out


def line_packs(docs: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(id, chunk_index, line_start, line_end, text) of (id, text, line_start) by ``pack_lines``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, t) for i, text, base in zip(pdf["id"], pdf["text"], pdf["line_start"]) for k, (t, a, b) in enumerate(pack_lines(text, limit, int(base)))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "line_start", "line_end", "text"])

    d = docs.where("length(text) > 0").select("id", "text", F.coalesce("line_start", F.lit(1)).alias("line_start"))
    return d.mapInPandas(run, "id bigint, chunk_index int, line_start int, line_end int, text string")
