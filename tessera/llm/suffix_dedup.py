"""Suffix-array dedup: repeated 200-byte strings, by merging shards' Burrows-Wheeler transforms by interleave refinement.

Equal strings must meet in one task, so the suffixes are dealt first: of the ``GRAM``-byte strings in every 200-byte window the
one of least hash is the window's anchor. Equal windows have equal anchors at equal offsets, and one anchor serves a contiguous
range of windows, its context.

1. ``anchors``: a pass over the whole texts gives each anchor's gram hash and the 128-bit digest of its context (all bytes of
   its windows). An anchor whose gram is unique has no repeated window. If a whole context occurs twice, all its windows
   are repeated.
2. The distinct contexts of the other grams are what is sorted, a group of whole grams at a time (the README has the measured
   share). Contexts that share neither the bytes before nor those after the gram with another stay out. The others are split into shards; each shard's suffixes are sorted for themselves and kept as a
   Burrows-Wheeler transform. Its symbols are ``STEP`` bytes, one starting at every byte. The transforms are merged by
   refining their interleave: after k rounds it is the order of all suffixes by their first k symbols. A round reads the
   symbols before the suffixes in the order reached and places them stably, so no suffix is compared again; the round in
   which a boundary appears between two places is the length of their common prefix. Places without a boundary after
   200 / STEP rounds are the repeated intervals.
3. Grams of more than ``HOT`` distinct contexts would make a task too large; their windows' 128-bit digests are counted
   in a group-by, which combines before the shuffle and gives the same result.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; a repeated row counts as another occurrence, so
both lose all their windows; overlapping occurrences count; ties in the anchor hash go to the leftmost gram; null and very
large ids come back as they are. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import block_count, block_of, discard, join_groups, materialise, nested, text_of
from tessera.llm.groups import starts_of, whole_groups

WINDOW, GRAM = 200, 48
SPAN = WINDOW - GRAM + 1  # grams in a window
HOT, SHARD, TOGETHER = 4_096, 32, 128  # contexts
SIDE = (WINDOW - GRAM) // 2
STEP = 8  # bytes of a symbol of the transforms; divides WINDOW
DEPTH = WINDOW // STEP
PIECE = 1 << 19  # bytes handled at once

_rng = np.random.Generator(np.random.PCG64(7_001))
_TABLE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all stretches of one length of a byte array, by prefix sums of a polynomial modulo 2^64."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if len(Rolling._powers[0]) < n:
            size, inverse = max(n, PIECE * 2), pow(_BASE, -1, 2**64)
            Rolling._powers = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse))
        up, self.down = Rolling._powers
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[raw] * up[: n - 1], out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def anchor_runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts laid end to end (each ending at one of ends): anchor position, first and last window start, gram hash."""
    low_bits = np.uint64(24)
    key = mix(Rolling(raw).all_of(GRAM))
    gram = key
    key = (key >> low_bits << low_bits) | np.arange(len(key), dtype=np.uint64)
    reach = 1
    while reach * 2 <= SPAN:
        key = np.minimum(key[:-reach], key[reach:]) if len(key) > reach else key[:0]
        reach *= 2
    rest = SPAN - reach
    key = np.minimum(key[: len(key) - rest], key[rest:]) if len(key) > rest else key[:0]
    begins = np.append(0, ends[:-1])
    lengths = np.maximum(ends - begins - WINDOW + 1, 0)
    at = np.repeat(begins - np.append(0, lengths.cumsum()[:-1]), lengths) + np.arange(lengths.sum())
    place = (key[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    p = place[first]
    return p, at[first], at[last], gram[p]


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of the texts of about PIECE bytes: bytes, ends, text numbers and offsets; very long texts come in overlapping stretches."""
    held: list[bytes] = []
    owner: list[int] = []
    offset: list[int] = []
    size = 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(owner), np.array(offset)

    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[start : start + PIECE + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            held.append(part)
            owner.append(i)
            offset.append(start)
            size += len(part)
            if size >= PIECE:
                yield out()
                held, owner, offset, size = [], [], [], 0
    if held:
        yield out()


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = pdf["key"].to_numpy()
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        for raw, ends, owner, offset in _pieces(texts):
            p, lo, hi, gram = anchor_runs(raw, ends)
            which = np.searchsorted(ends, p, "right")
            base = offset[which] - np.append(0, ends[:-1])[which]
            whole = raw.tobytes()
            # where the anchor stands in its context belongs to it
            context = [digest(whole[a : b + WINDOW] + bytes([x])) for a, b, x in zip(lo.tolist(), hi.tolist(), (p - lo).tolist(), strict=True)]
            pos = ((p + base) << 16) | ((p - lo) << 8) | (p - hi)
            yield pd.DataFrame({"key": keys[owner[which]], "pos": pos, "gram": gram.view(np.int64), "context": context})


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last window start."""
    p = pos >> 16
    return p, p - ((pos >> 8) & 255), p - (pos & 255)


@dataclass
class Transform:
    """A shard's Burrows-Wheeler transform over symbols of STEP bytes, one starting at every byte.

    Suffixes of fewer than STEP bytes (the tails) differ from each other and from all symbols, and come first."""

    before: np.ndarray  # the symbol before each suffix, in the suffixes' order
    starts: np.ndarray  # whether nothing stands before it: fewer than STEP bytes
    tails: int
    order: np.ndarray  # where each suffix starts in the contexts laid end to end, one place after each


def transform(contexts: list[bytes]) -> Transform:
    """Sorts the suffixes of one shard by doubling, and keeps what stands before them."""
    size = np.array([len(c) + 1 for c in contexts])
    n = int(size.sum())
    begin = np.append(0, size.cumsum()[:-1])
    offset = np.arange(n) - np.repeat(begin, size)
    left = np.repeat(size, size) - 1 - offset  # bytes to the end
    raw = np.frombuffer(b"\0".join([*contexts, b""]) + bytes(STEP), np.uint8).astype(np.uint64)
    symbol = np.zeros(n, np.uint64)
    for j in range(STEP):
        symbol = (symbol << np.uint64(8)) | raw[j : j + n]
    tail = left < STEP
    tails = int(tail.sum())
    rank = np.empty(n, np.int64)
    rank[tail] = np.arange(tails)
    live = np.flatnonzero(~tail)
    by = np.argsort(symbol[live])
    live = live[by]
    key, floor = symbol[live], np.full(len(live), tails)
    reach = STEP
    while len(live):
        block = np.append(True, floor[1:] != floor[:-1])
        new = block | np.append(True, key[1:] != key[:-1])
        at = np.arange(len(live))
        rank[live] = floor + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(block, at, 0))
        live = live[~(new & np.append(new[1:], True))]
        # suffixes that still share their rank reach at least that far on in their contexts
        key = (rank[live] << 32) | rank[live + reach]
        by = np.argsort(key)
        live, key = live[by], key[by]
        floor = key >> 32
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    starts = offset[order] < STEP
    return Transform(symbol[np.maximum(order - STEP, 0)], starts, tails, order)


def interleave(shards: list[Transform], depth: int, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms by refining their interleave ``depth`` times, a symbol further each time.

    Returns for each place the number of its suffix, counting through the shards in their own sorted orders, the
    symbols that it shares with the place before, ``depth`` for as many or more, and its block. Blocks of one suffix are
    settled and skipped. ``need`` gives for each suffix the symbols by which it must be ordered, at most one more than for the
    suffix that starts a symbol later; with it, only suffixes of full need have a meaning in what is returned."""
    sizes = np.array([len(t.before) for t in shards])
    base = np.append(0, sizes.cumsum()[:-1])
    n, m = int(sizes.sum()), sum(t.tails for t in shards)
    # the suffix that starts one symbol earlier, read off each transform by itself: its symbol's place, stably
    earlier, later = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for t, b in zip(shards, base, strict=True):
        some = np.flatnonzero(~t.starts)
        earlier[b + some[np.argsort(t.before[some], kind="stable")]] = b + t.tails + np.arange(len(some))
    starts = np.concatenate([t.starts for t in shards])
    some = np.flatnonzero(~starts)
    later[earlier[some]] = some
    symbol = np.zeros(n, np.int64)
    symbol[some] = np.unique(np.concatenate([t.before for t in shards])[some], return_inverse=True)[1]
    symbol <<= 32
    is_tail = np.arange(n) - np.repeat(base, sizes) < np.repeat([t.tails for t in shards], sizes)
    open_ = np.flatnonzero(~is_tail).astype(np.int32)  # suffixes in blocks of several
    suffix = np.concatenate([np.flatnonzero(is_tail).astype(np.int32), open_])  # the interleave: at first shard by shard
    place = np.empty(n, np.int64)
    place[suffix] = np.arange(n)
    common = np.full(n, depth, np.int16)
    common[: m + 1] = 0
    block = np.zeros(n, np.int32)  # named by a place in it
    at = np.arange(m, n)  # the places of the open suffixes
    if need is not None:
        wanted = need[open_] > 0
        open_, at = open_[wanted], at[wanted]
    for k in range(1, depth + 1):
        if not len(at):
            break
        after = later[open_]
        key = np.sort(symbol[after] | place[after])  # what stands before the suffixes, in the order reached
        moved = key & 0xFFFFFFFF
        read, source, former = key >> 32, block[moved], block[at]
        open_ = earlier[suffix[moved]]
        suffix[at], place[open_] = open_, at
        inside = former[1:] == former[:-1]
        differs = (read[1:] != read[:-1]) | (source[1:] != source[:-1])
        fresh = inside & differs
        common[at[1:][fresh]] = k - 1
        first = np.append(True, differs | ~inside)
        block[at] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        if k == 1:  # the ends of contexts are known at once, and are used from the second round on
            block[:m] = np.arange(m)
        elif not fresh.any():
            break
        on = ~(first & np.append(first[1:], True))
        if need is not None:
            on &= need[open_] > k
        open_, at = open_[on], at[on]
    return suffix, common, block


def may_repeat(pdf: pd.DataFrame) -> np.ndarray:
    """Rows of whole groups that can share a window: each window holds the SIDE bytes before its gram or those after it."""
    p, lo, hi = unpack(pdf["pos"].to_numpy())
    before: dict[tuple[int, bytes], list[int]] = {}
    after: dict[tuple[int, bytes], list[int]] = {}
    for k, (gram, raw, at, rest) in enumerate(zip(pdf["gram"].tolist(), pdf["bytes"], (p - lo).tolist(), (p - hi).tolist(), strict=True)):
        if at >= SIDE:
            before.setdefault((gram, raw[at - SIDE : at]), []).append(k)
        if rest <= SIDE:
            after.setdefault((gram, raw[at + GRAM : at + GRAM + SIDE]), []).append(k)
    keep = np.zeros(len(pdf), bool)
    for some in (*before.values(), *after.values()):
        if len(some) > 1:
            keep[some] = True
    return keep


def repeated_windows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and runs of window starts (first, last) that are repeated, for whole groups of distinct contexts."""
    none = np.zeros(0, np.int64)
    _, lo, hi = unpack(pdf["pos"].to_numpy())
    contexts = list(pdf["bytes"])
    if not contexts:
        return none, none, none
    size = np.array([len(c) + 1 for c in contexts])
    begins = np.append(0, size.cumsum()[:-1])
    shards = [slice(at, at + SHARD) for at in range(0, len(contexts), SHARD)]
    built = [transform(contexts[x]) for x in shards]
    where = np.concatenate([t.order + begins[x.start] for t, x in zip(built, shards, strict=True)])
    # what follows the last window's start is ordered only as far as the windows reach
    beyond = np.arange(len(where)) - np.repeat(begins + hi - lo, size)
    need = np.clip(DEPTH - -(-beyond // STEP), 0, DEPTH).astype(np.int16)
    suffix, _, block = interleave(built, DEPTH, need[where])
    starts = where[suffix]
    window = beyond[starts] <= 0
    _, inverse, times = np.unique(block[window], return_inverse=True, return_counts=True)
    repeated = np.zeros(len(where) + 1, bool)
    repeated[starts[window][times[inverse] > 1]] = True
    edge = np.diff(repeated.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    row = np.searchsorted(begins, first, "right") - 1
    return row, lo[row] + first - begins[row], lo[row] + last - begins[row]


def portions(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Whole groups of a sorted frame, about TOGETHER rows at a time, so that what is merged at once stays in the cache."""
    starts = np.append(starts_of(pdf, ["gram"]), len(pdf))
    begin = 0
    for end in starts[1:].tolist():
        if end - begin >= TOGETHER or end == len(pdf):
            yield pdf.iloc[begin:end]
            begin = end


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["gram"], TOGETHER):
        found = []
        for pdf in portions(frame):
            pdf = pdf[may_repeat(pdf)]
            row, first, last = repeated_windows(pdf)
            use = ~pdf["settled"].to_numpy()[row]
            found.append(pd.DataFrame({"key": pdf["key"].to_numpy()[row][use], "begin": first[use], "end": last[use] + WINDOW}))
        yield pd.concat(found)


def _contexts(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The context bytes of the wanted anchors of a block."""
    wanted = wanted[["key", "pos", "gram", "settled", "hot"]]
    if not len(wanted):
        return wanted.assign(bytes=pd.Series([], dtype=object))
    keys = set(wanted["key"])
    text = {k: t.encode("utf-8", "surrogatepass") for k, t in zip(docs["key"], docs["text"], strict=True) if k in keys}
    _, lo, hi = unpack(wanted["pos"].to_numpy())
    return wanted.assign(bytes=[text[k][a : b + WINDOW] for k, a, b in zip(wanted["key"], lo, hi, strict=True)])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of hot groups' contexts: its start and its digest."""
    for pdf in batches:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            _, lo, hi = unpack(part["pos"].to_numpy())
            n = hi - lo + 1
            start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.append(0, n.cumsum()[:-1]), n)
            hashes = [digest(b[k : k + WINDOW]) for b, m in zip(part["bytes"], n, strict=True) for k in range(m)]
            yield pd.DataFrame({"key": part["key"].to_numpy().repeat(n), "settled": part["settled"].to_numpy().repeat(n), "start": start, "hash": hashes})


def covers(docs: DataFrame) -> DataFrame:
    """key, begin, end: stretches of the rows' texts that are covered by repeated windows. docs: key, text, _block."""
    anchors = docs.select("key", "text").mapInPandas(_anchors, "key binary, pos long, gram long, context binary")
    anchors = materialise(anchors, "anchors")
    # what is joined to is written first: both sides are then plain shuffles, of which Spark can split the hot partitions
    total = anchors.count()
    grams = materialise(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    shared = materialise(join_groups(anchors, grams, ["gram"], "n", total).drop("n"), "shared")
    discard(anchors, grams)
    contexts = shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("one"))
    contexts = materialise(contexts, "contexts")
    counted = materialise(join_groups(shared, contexts.drop("one"), ["gram", "context"], "n", total).select("key", "pos", "n"), "counted")
    discard(shared)
    # settled: the whole context occurs again
    whole = counted.where("n > 1").select(
        "key", (F.shiftright("pos", 16) - F.shiftright("pos", 8).bitwiseAND(255)).alias("begin"), (F.shiftright("pos", 16) - F.col("pos").bitwiseAND(255) + WINDOW).alias("end")
    )
    groups = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("open")).where("kinds > 1 AND open > 0")
    wanted = join_groups(contexts, materialise(groups, "groups"), ["gram"], "kinds", contexts.count()).select(
        "one.key", "one.pos", "gram", (F.col("n") > 1).alias("settled"), (F.col("kinds") > HOT).alias("hot")
    )
    n = docs._tessera_blocks
    wanted = wanted.withColumn("_block", block_of(n, "key"))
    parts = docs.groupBy("_block").cogroup(wanted.groupBy("_block")).applyInPandas(_contexts, "key binary, pos long, gram long, settled boolean, hot boolean, bytes binary")
    parts = materialise(parts, "parts")
    merged = parts.where("NOT hot").drop("hot").repartition("gram").sortWithinPartitions("gram", "key", "pos").mapInPandas(_merge, "key binary, begin long, end long")
    windows = parts.where("hot").select("key", "pos", "settled", "bytes").mapInPandas(_hashes, "key binary, settled boolean, start long, hash binary")
    again = windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    hot = windows.where("NOT settled").join(again, "hash").select("key", F.col("start").alias("begin"), (F.col("start") + WINDOW).alias("end"))
    return whole.unionByName(merged).unionByName(hot)


def union(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching stretches."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return list(zip(begin[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist(), strict=True))


def _strip(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    spans = {k: union(g["begin"].to_numpy(), g["end"].to_numpy()) for k, g in found.groupby("key")} if len(found) else {}
    rows = []
    for doc_id, key, text in zip(docs["doc_id"], docs["key"], docs["text"], strict=True):
        raw, own = text.encode("utf-8", "surrogatepass"), spans.get(key, [])
        kept = b"".join(raw[b:e] for b, e in zip([0, *(e for _, e in own)], [*(b for b, _ in own), len(raw)], strict=True))
        rows.append((doc_id, key, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if own else text))
    return pd.DataFrame(rows, columns=["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def key_of(docs: DataFrame) -> Column:
    """128 bits that stand for a row's doc_id and text; rows that are equal in both share them."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_of())))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes, n_removed, n_spans, kept_sha256, kept_text for every row of docs.

    kept_text is the text of the remaining bytes, without the parts of characters that a cut has torn."""
    # as text in the tasks, where a null would turn a column of numbers into floating point
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), key_of(docs).alias("key"), text_of().alias("text"))
    n = block_count(rows)
    rows = rows.withColumn("_block", block_of(n, "key"))
    rows._tessera_blocks = n
    found = materialise(covers(rows), "covers").withColumn("_block", block_of(n, "key"))
    out = rows.groupBy("_block").cogroup(found.groupBy("_block")).applyInPandas(
        lambda a, b: _strip(a, b), "doc_id string, key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def stripped(docs: DataFrame) -> DataFrame:
    """The rows of docs with their own columns; text without its repeated stretches, n_chars to match."""
    kept = dedup(docs).where("n_removed > 0").select("key", "kept_text").dropDuplicates(["key"])
    found = nested(docs, own=key_of(docs)).join(kept, F.col("own") == F.col("key"), "left")
    cut = F.col("kept_text").isNotNull()
    row = F.col("row").withField("text", F.coalesce("kept_text", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")
