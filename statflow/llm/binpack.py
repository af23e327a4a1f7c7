"""Token-ID output in binary rows, packed best-fit-decreasing.

Texts become ids (16 bits hold the vocabulary) with a closing id; a document
longer than a row is split into pieces without loss. Pieces gather until SHARD
ids are there; then, longest first, each goes into the open row with the least
sufficient room, found in a segment tree over rooms. No data is shuffled: a
shard is a stretch of an input partition, so memory is bounded by SHARD and the
longest document, and a lost executor costs its own partitions.

A row holds its ids, padded to the capacity (``ids``, little-endian unsigned
16-bit), the cumulative segment lengths (``segments``: 0, first end, ..., last
end), the position of each id within its segment (``positions``, same format,
0 in the padding), and which piece of which document each segment is.

Edge cases: a null or empty text is its closing id alone; ties go to the room
found last and, in the order of pieces, to the earlier row; repeated rows are
packed one by one; null ids are carried; an empty table gives no rows; extra
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.llm.tokens import rank_encoding

CAPACITY = 2048
SHARD = 4_000_000
END = 50256
ROWS = "doc_ids array<long>, pieces array<int>, segments array<int>, n_tokens int, ids binary, positions binary"


class Rooms:
    """Open rows by room left; finds the least room of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int32).tolist()
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def pop(self, least: int) -> tuple[int, int] | None:
        """(room, row), taken out; None if no row has that much room."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``lengths``, each within the capacity."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = rooms.pop(n)
        if found is None:
            rows.append([i])
            room, row = capacity - n, len(rows) - 1
        else:
            room, row = found[0] - n, found[1]
            rows[row].append(i)
        if room:
            rooms.push(room, row)
    return rows


def _emit(shard: list[tuple[int, int, np.ndarray]], capacity: int) -> pd.DataFrame:
    out = []
    for row in best_fit([len(x[2]) for x in shard], capacity):
        ids, positions, ends = np.zeros(capacity, "<u2"), np.zeros(capacity, "<u2"), [0]
        for i in row:
            part, at = shard[i][2], ends[-1]
            ids[at : at + len(part)] = part
            positions[at : at + len(part)] = np.arange(len(part))
            ends.append(at + len(part))
        out.append(([shard[i][0] for i in row], [shard[i][1] for i in row], ends, ends[-1], ids.tobytes(), positions.tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])


def pack_rows(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ROWS: one per packed row. ``ranks`` and ``pattern``: the vocabulary file and its splitting pattern."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, held, size = rank_encoding(ranks, pattern).encode_ordinary, [], 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):  # ids as text: pandas has no long with nulls
                ids = np.array([*encode(t or ""), END], "<u2")
                i = None if i is None else int(i)
                held += [(i, k, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
                size += len(ids)
                if size >= shard:
                    yield _emit(held, capacity)
                    held, size = [], 0
        if held:
            yield _emit(held, capacity)

    return docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(pack, ROWS)
