"""Order-preserving packing by dynamic programming.

Each partition of the input is one stream of documents in the order of its rows; a stream is cut into sequences of at
most ``LENGTH`` tokens, so nothing is shuffled. Cuts may fall at document ends, at sentence ends, and in longer stretches
without either every ``HARD`` tokens. The cost of a sequence is its padding (none at a power of two) plus the
penalty of its cut; the cheapest cuts come from f(j) = penalty(j) + min over i of f(i) + padding(j - i), where the minimum
over the window of 1024 tokens is kept in a monotone queue, since the padding is linear there, and sequences of a power of
two are looked up besides. A stream is solved in portions; the last sequence of a portion is taken back into the next.

Token ids: those that the tokenizers library gives for the public vocabulary's JSON file (``tokens``); ``<|endoftext|>`` in a
text is one id.

Defined cases: a text of very long white space is encoded like any other; a null text is empty, and an empty text is the one id 0; repeated rows are packed each; null and very large ids come
back as they are; an empty table or partition yields no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of
from tessera.llm.tokens import byte_tokens, default_vocabulary

LENGTH, HARD, PORTION = 1024, 128, 300_000
DOC_CUT, SENTENCE_CUT, HARD_CUT = 0, 3, 24
SHORT = 16  # cost of a sequence of a smaller power of two, which has no padding but is short
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_ends: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """Which ids end a sentence; once a worker."""
    if path not in _ends:
        _ends[path] = np.array([raw.endswith((b".", b"!", b"?")) or b"\n" in raw for raw in byte_tokens(path, True).pieces])
    return _ends[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall (0 and the end among them), and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int16)
    penalty[1:][ends[ids]] = SENTENCE_CUT
    penalty[doc_ends] = DOC_CUT
    penalty[0] = penalty[n] = 0
    soft = np.flatnonzero(penalty >= 0)
    gap = np.diff(soft)
    for a, g in zip(soft[:-1][gap > HARD].tolist(), gap[gap > HARD].tolist(), strict=True):
        penalty[a + HARD : a + g : HARD] = HARD_CUT
    points = np.flatnonzero(penalty >= 0)
    return points, penalty[points]


def cheapest_cuts(points: np.ndarray, penalty: np.ndarray) -> list[int]:
    """Numbers of the points at which the sequences end, cheapest in all."""
    extra: dict[int, list[int]] = {}
    power = 1
    while power < LENGTH:
        at = np.searchsorted(points, points - power)
        hit = np.flatnonzero(points[at] == points - power)
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            extra.setdefault(j, []).append(i)
        power *= 2
    pos, pen = points.tolist(), penalty.tolist()
    cost, back = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, number), ascending
    none: list[int] = []
    for j in range(1, len(pos)):
        p = pos[j]
        least = p - LENGTH
        while queue[0][1] < least:
            queue.popleft()
        g, _, best = queue[0]
        c = g + LENGTH - p
        for i in extra.get(j, none):
            if cost[i] + SHORT < c:
                c, best = cost[i] + SHORT, i
        c += pen[j] + 1  # 1: of equal ways the one of fewer sequences
        cost[j], back[j] = c, best
        g = c + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, p, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Stream:
    """Documents in, pieces out; holds what is not yet packed."""

    def __init__(self, ends: np.ndarray, first_id: int):
        self.ends, self.next_id = ends, first_id
        self.docs: list[tuple] = []  # doc_id, ids that are left, ids before them, ids in all
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch:
        rows: list[tuple] = []
        if self.docs:
            lengths = np.array([len(x[1]) for x in self.docs])
            doc_ends = lengths.cumsum()
            points, penalty = cut_points(np.concatenate([x[1] for x in self.docs]), doc_ends, self.ends)
            cuts = points[cheapest_cuts(points, penalty)]
            if not last:
                cuts = cuts[:-1]
            end = int(cuts[-1]) if len(cuts) else 0
            marks = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends <= end]]))
            begins = doc_ends - lengths
            which = np.searchsorted(doc_ends, marks[:-1], "right")
            sequence = np.searchsorted(cuts, marks[:-1], "right")
            open_at = np.append(0, cuts)[sequence]
            for a, b, d, s, o in zip(marks[:-1].tolist(), marks[1:].tolist(), which.tolist(), sequence.tolist(), open_at.tolist(), strict=True):
                doc_id, ids, before, total = self.docs[d]
                x = a - int(begins[d])
                rows.append((doc_id, before + x, b - a, zlib.crc32(ids[x : x + b - a].tobytes()), total, self.next_id + s, a - o))
            self.next_id += len(cuts)
            d = int(np.searchsorted(doc_ends, end, "right"))
            rest = self.docs[d:]
            if rest and (x := end - int(begins[d])):
                doc_id, ids, before, total = rest[0]
                rest[0] = (doc_id, ids[x:], before + x, total)
            self.docs, self.size = rest, int(doc_ends[-1]) - end
        columns = zip(*rows, strict=True) if rows else [[] for _ in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or default_vocabulary()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(path, True)
        stream = Stream(sentence_ends(path), TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokens.encode(text)
                ids.append(0)
                stream.add(doc_id, np.array(ids, "<u4"))
                if stream.size >= PORTION:
                    yield stream.pack(False)
        yield stream.pack(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(packed, SCHEMA)
