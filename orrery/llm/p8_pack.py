"""Problem 8: documents packed into containers of fixed capacity, along a space-filling curve.

Hashed document vectors are projected to three dimensions; documents are range-sorted by their
Hilbert key, so that neighbours on the curve, which share a subject, fill the same containers.
Each range is packed in one pass: a window of neighbours is placed largest first into the open
container it fits best, and few containers stay open, so that one's documents lie close together on
the curve.  Only a document above the capacity is split.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import sizes

#: Documents of a range that are placed together, and containers that stay open for later ones.
WINDOW, OPEN = 256, 128
#: No more capacities than this are packed in one call; more are an error.
MOST_CAPACITIES = 1000
#: Gaps that a split document may fill at either end.
FILLS = 3
#: The smallest gap worth a piece, as a fraction of the capacity.
LEAST = 32
#: Documents of a range; only the containers still open at its end can be badly filled.
RANGE = 25_000
_SCHEMA = "container string, capacity int, container_id bigint, doc_id bigint, piece int, token_start bigint, token_end bigint"


class Packer:
    """Best fit with a bounded number of open containers, for one capacity."""

    def __init__(self, name: str, capacity: int, base: int):
        self.name, self.capacity, self.next, self.open = name, capacity, base, []  # open: sorted (room, id)

    def place(self, size: int) -> int:
        k = bisect_left(self.open, (size, -1))
        if k < len(self.open):
            room, c = self.open.pop(k)
        else:
            room, c = self.capacity, self.next
            self.next += 1
            if len(self.open) >= OPEN:
                self.open.pop(0)  # the fullest is closed
        if room > size:
            insort(self.open, (room - size, c))
        return c

    def pour(self, doc: int, n: int) -> list[tuple]:
        """Rows for a document of n tokens above the capacity: it fills gaps whole, then containers of its own, and its rest fits in best."""
        rows, start = [], 0

        def put(c, size):
            rows.append((self.name, self.capacity, c, doc, len(rows), start, start + size))
            return start + size

        for _ in range(FILLS):
            if not self.open or self.open[-1][0] < self.capacity // LEAST or n - start < self.open[-1][0]:
                break
            room, c = self.open.pop()
            start = put(c, room)
        while n - start >= self.capacity:
            start, self.next = put(self.next, self.capacity), self.next + 1
        for _ in range(FILLS):
            k = bisect_left(self.open, (n - start, -1))
            if k < len(self.open) or k == 0 or self.open[k - 1][0] < self.capacity // LEAST:
                break
            room, c = self.open.pop(k - 1)
            start = put(c, room)
        if n > start:
            put(self.place(n - start), n - start)
        return rows

    def add(self, items: list[tuple[int, int]]) -> list[tuple]:
        """Rows for (size, doc_id): whole documents first, largest first; those above the capacity then fill the gaps."""
        rows = []
        for n, doc in sorted((x for x in items if x[0] <= self.capacity), key=lambda x: (-x[0], x[1])):
            rows.append((self.name, self.capacity, self.place(n), doc, 0, 0, n))
        for n, doc in sorted((x for x in items if x[0] > self.capacity), key=lambda x: (-x[0], x[1])):
            rows += self.pour(doc, n)
        return rows


def pack(documents: DataFrame, limits: DataFrame, folder: str | None = None) -> DataFrame:
    """A row per document, capacity and piece: the container it is in and its tokens [token_start, token_end).

    Every row of documents is packed for every capacity; null and empty texts take no room.
    limits is a small table of capacities (null or non-positive ones are left out) that is read to
    the driver; more than MOST_CAPACITIES raise.  Texts are cut into tokens once; only ids, sizes and
    places on the curve are sorted.
    """
    spark = documents.sparkSession
    caps = [(r[0], r[1]) for r in limits.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("capacity_tokens", "container").limit(MOST_CAPACITIES + 1).collect()]
    if len(caps) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    d = written(sizes.sized(documents, ["doc_id"], curve=True, folder=folder), "sized")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packers = [Packer(name, capacity, base) for name, capacity in caps]
        columns = [c.split()[0] for c in _SCHEMA.split(", ")]
        waiting: list[tuple[int, int]] = []
        for pdf in batches:
            waiting += zip(pdf["n_tokens"].tolist(), pdf["doc_id"].tolist())
            while len(waiting) >= WINDOW:
                head, waiting = waiting[:WINDOW], waiting[WINDOW:]
                yield pd.DataFrame([r for p in packers for r in p.add(head)], columns=columns)
        if waiting:
            yield pd.DataFrame([r for p in packers for r in p.add(waiting)], columns=columns)

    n = max(1, -(-d.count() // RANGE))
    d = d.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return d.mapInPandas(run, _SCHEMA)


def report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the share left unused, the fullest and how many documents were split."""
    c = packed.groupBy("container", "capacity", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.sum((F.col("piece") == 1).cast("bigint")).alias("split"))
    return c.groupBy("container", "capacity").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), (1 - F.sum("used") / (F.count("*") * F.first("capacity"))).alias("unused"), F.max("used").alias("fullest"), F.sum("split").alias("documents_split")
    )
