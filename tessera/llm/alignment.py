"""Alignment of the tokens of two tokenizers, A (byte-level BPE) and B (SentencePiece), over the same bytes.

A slice of an Arrow batch is taken as one stretch of bytes, in which each document has its offset. The ends of all A
tokens and of all B tokens are counted once each (``bincount``), and the stretch is cut where both tokenizers end a token; document
ends are such places. A running sum of the cuts gives the group of every token, and running sums of per-group products
give each document's links as a difference at its borders. Bounded by the slice: a document is never split, a
slice holds documents of ``SLICE_BYTES`` or one longer document.

A link is an A and a B token occurrence of one group. The distinct id pairs of a document are a list of codes (A id, B id)
with how often each is linked; a group of many tokens is reduced to its distinct ids first. The corpus-wide number of
documents of each pair is a group-by over these lists, the best of each A id another. The ``HEAD`` most frequent pairs (bounded,
16 bytes each) go to all tasks, where most links are summed with no shuffle; what is not among them is joined.

Defined cases: null and empty texts, and texts whose tokens of either side don't spell them out, have no tokens: counts of
zero and an empty ``groups_sha256``; strings of special tokens in a text are plain text; repeated rows are documents each, also for the
counts; null ids come back; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_of
from tessera.llm.tokens import byte_tokens, default_vocabulary

SLICE_BYTES = 1_000_000
#: Pairs whose counts all tasks get: 16 bytes each. The others are joined.
HEAD = 1_000_000
#: Groups of more links are reduced to distinct ids before their pairs are listed.
LARGE = 4_096
#: A code is an A id times this, and a B id.
WIDE = 1 << 16
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTokens:
    """Ids of a SentencePiece model, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = np.array([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)] + [b""], object)[:-1]
        if len(names) > WIDE:
            raise ValueError(f"a model of over {WIDE} pieces does not fit the codes of pairs")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_models: dict[str, PieceTokens] = {}


def piece_tokens(path: str) -> PieceTokens:
    """Read once a worker."""
    if path not in _models:
        _models[path] = PieceTokens(path)
    return _models[path]


class Aligner:
    """The two vocabularies: the length of each id's bytes, and its decimal with what may follow it in a list of groups."""

    def __init__(self, vocabulary: str, model: str):
        self.a, self.b = byte_tokens(vocabulary, False), piece_tokens(model)
        self.a_length = np.array([len(x) for x in self.a.pieces], np.int64)
        self.b_length = np.array([len(x) for x in self.b.pieces], np.int64)
        n = max(len(self.a.pieces), len(self.b.pieces))
        self.n = n
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], object)

    def tokens(self, text: str, b_ids: list[int]) -> tuple[list[int], list[int]] | None:
        """Ids of both sides, None if there are none or they don't spell the text out."""
        if not text:
            return None
        spelled = f" {text}"
        raw = spelled.encode()
        a_ids = self.a.encode(spelled)
        if b"".join(self.a.pieces[a_ids].tolist()) != raw or b"".join(self.b.pieces[b_ids].tolist()) != raw:
            return None
        return a_ids, b_ids

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Counts (documents, COUNTS), digests of the groups, codes of the distinct linked pairs, and their links."""
        a_parts, b_parts = [], []
        for text, b_ids in zip(texts, self.b.encode(texts), strict=True):
            a, b = self.tokens(text, b_ids) or ([], [])
            a_parts.append(np.array(a, np.int64))
            b_parts.append(np.array(b, np.int64))
        n_a, n_b = (np.array([len(x) for x in parts], np.int64) for parts in (a_parts, b_parts))
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        if not len(a):
            none = np.empty(0, np.int64)
            return np.zeros((len(texts), 4), np.int64), [""] * len(texts), [none] * len(texts), [none] * len(texts)
        a_end, b_end = self.a_length[a].cumsum(), self.b_length[b].cumsum()
        size = int(a_end[-1]) + 1
        cuts = (np.bincount(a_end, minlength=size) > 0) & (np.bincount(b_end, minlength=size) > 0)
        before = cuts.cumsum() - cuts  # cuts before each place: the group of the token that ends there
        a_group, b_group = before[a_end], before[b_end]
        n_groups = int(cuts.sum())
        k_a, k_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        links = k_a * k_b
        # borders of the documents among tokens and groups
        a_at, b_at = np.append(0, n_a.cumsum()), np.append(0, n_b.cumsum())
        group_at = np.append(0, before[a_end] + 1)[a_at]
        link_sum = np.append(0, links.cumsum())
        counts = np.stack([n_a, n_b, np.diff(group_at), np.diff(link_sum[group_at])], 1)
        digests = self.digests(a, b, a_group, b_group, k_a, k_b, a_at + b_at)
        doc_of = np.repeat(np.arange(len(texts)), np.diff(group_at))
        codes, times, borders = self.pairs(a, b, k_a, k_b, links, doc_of, len(texts))
        return counts, digests, np.split(codes, borders), np.split(times, borders)

    def digests(self, a, b, a_group, b_group, k_a, k_b, at) -> list[str]:
        """SHA-256 of each document's groups, written as a1,a2|b1;a3|b2: all tokens in their order, groups by groups."""
        b_before, a_through = k_b.cumsum() - k_b, k_a.cumsum()
        parts = np.empty(len(a) + len(b), np.int64)
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_last = np.append(b_group[1:] != b_group[:-1], True)
        parts[np.arange(len(a)) + b_before[a_group]] = a + self.n * a_last
        parts[np.arange(len(b)) + a_through[b_group]] = b + 2 * self.n * b_last
        written = self.written[parts]
        return [hashlib.sha256("".join(written[x:y].tolist())[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pairs(self, a, b, k_a, k_b, links, doc_of, n_docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct pairs of each document in turn, their links, and where documents change."""
        a_start, b_start = k_a.cumsum() - k_a, k_b.cumsum() - k_b
        usual = np.flatnonzero(links <= LARGE)
        n = links[usual]
        which = np.repeat(usual, n)
        k = np.arange(len(which)) - np.repeat(n.cumsum() - n, n)
        own = a[a_start[which] + k // k_b[which]] * WIDE + b[b_start[which] + k % k_b[which]]
        docs, codes, times = [doc_of[which]], [own], [np.ones(len(own), np.int64)]
        for g in np.flatnonzero(links > LARGE).tolist():
            x, n_x = np.unique(a[a_start[g] : a_start[g] + k_a[g]], return_counts=True)
            y, n_y = np.unique(b[b_start[g] : b_start[g] + k_b[g]], return_counts=True)
            codes.append((x[:, None] * WIDE + y).ravel())
            times.append((n_x[:, None] * n_y).ravel())
            docs.append(np.full(len(codes[-1]), doc_of[g]))
        doc, code, time = np.concatenate(docs), np.concatenate(codes), np.concatenate(times)
        order = np.argsort(doc << 33 | code, kind="stable")  # a code has 33 bits at most
        doc, code, time = doc[order], code[order], time[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))
        starts = np.flatnonzero(new)
        return code[starts], np.add.reduceat(time, starts), np.searchsorted(doc[starts], np.arange(1, n_docs))


def text_slices(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield slice(start, len(texts))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in parts]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


def aligned(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (codes), times (links of each)."""
    vocabulary, model = vocabulary or default_vocabulary(), model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = some.column("text").to_pylist()
                for part in text_slices(texts):
                    counts, digests, codes, times = aligner.align(texts[part])
                    columns = [some.column("doc_id").slice(part.start, part.stop - part.start), *(pa.array(x) for x in counts.T.copy())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(digests), lists(codes), lists(times)], ["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    numbers = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"doc_id long, {numbers}, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, a, b, docs (documents that hold it linked), best (whether no pair of its A id is held by more), over all documents."""
    counts = materialise(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    a = F.shiftright("pair", 16)
    # at most one row for each id of the vocabulary
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("top"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "a", F.col("pair").bitwiseAND(WIDE - 1).alias("b"), "docs", (F.col("docs") == F.col("top")).alias("best"))


def head_of(counts: DataFrame) -> tuple[pa.Table, bool]:
    """The pairs in at least so many documents, a power of two, that there are at most HEAD of them; and whether these are all."""
    level = F.floor(F.log2("docs"))
    sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    least, n = 64, 0
    while least and n + sizes.get(least - 1, 0) <= HEAD:
        least -= 1
        n += sizes.get(least, 0)
    return counts.where(F.col("docs") >= F.lit(2.0) ** least).toArrow(), least == 0


def report(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = materialise(aligned(docs, vocabulary, model).withColumn("row_no", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(table).select("pair", "docs", "best"), "counts")
    head, all_pairs = head_of(counts)
    order = np.argsort(head.column("pair").to_numpy())
    columns = [head.column(c).to_numpy()[order] for c in ("pair", "docs", "best")]
    none = np.array([-1], np.int64)  # no pair has this code, so that a place is always found
    known = table.sparkSession.sparkContext.broadcast([np.append(none * k, x) for k, x in zip((1, 0, 0), columns, strict=True)])
    own = ["row_no", "doc_id", *COUNTS, "groups_sha256"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n_docs, best = known.value
        for batch in batches:
            at = batch.column("pairs").offsets.to_numpy()
            pairs, times = (batch.column(c).values.to_numpy()[at[0] : at[-1]] for c in ("pairs", "times"))
            place = np.searchsorted(codes, pairs, "right") - 1
            found = codes[place] == pairs
            sums = [np.append(0, (times * found * x[place]).cumsum())[at - at[0]] for x in (best, n_docs)]
            left = np.append(0, (~found).cumsum())[at - at[0]]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~found], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(np.diff(x)) for x in sums), *rest], [*own, "n_best", "count_sum", "pairs", "times"])

    fields = ", ".join(f"{c} {t}" for c, t in table.select(*own).dtypes)
    summed = table.mapInArrow(add, f"{fields}, n_best long, count_sum long, pairs array<long>, times array<long>")
    if not all_pairs:
        summed = materialise(summed, "summed")
        rest = summed.select("row_no", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row_no", F.col("x.pairs").alias("pair"), "x.times")
        rest = rest.join(counts, "pair").groupBy("row_no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
        summed = summed.join(rest, "row_no", "left")
        for c, more in (("n_best", "more_best"), ("count_sum", "more_sum")):
            summed = summed.withColumn(c, F.col(c) + F.coalesce(more, F.lit(0)))
    return summed.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
