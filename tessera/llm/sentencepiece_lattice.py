"""SentencePiece encoding and decoding by a relational lattice.

A text becomes words (a run of word marks and what follows it; no piece reaches over that border, nor over a line end).
The lattice of a word is relational: its substrings up to the longest piece's length are exploded, equi-joined to the
piece table, grouped by word, and folded with a higher-order ``aggregate``:

* unigram models: Viterbi, the path of the highest sum of scores;
* BPE models, as the public 32k model is one: the edges in the order of their merge score, each applied where it joins two
  neighbouring segments. Viterbi over BPE scores gives other ids than the model's own encoder does (README).

The ``HEAD`` most frequent words are encoded so in Spark, and broadcast (a bounded table). The rest of the words, too many to
broadcast and as heavy as the texts to join back, are encoded by the same lattice in the task that meets them: substrings of
a batch of words, equi-joined by hash to the sorted piece table and compared, then folded for all words at a time. Words of
over ``LONG`` characters merge by a heap. Decoding maps ids to bytes in DataFrame functions.

Defined cases: a null text is empty, an empty text has no ids; characters without a piece become bytes; repeated rows each
get their row; ties of scores go to the left. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_of

MARK = "▁"
WORDS = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
HEAD, LONG = 200_000, 256
BYTE, BETWEEN = "\ue000", "\ue001"  # private characters, which no piece holds


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """The piece table: text, id and score of the pieces that may be edges; ids of the 256 bytes; all pieces for decoding."""

    text: list[str]
    ids: list[int]
    score: list[float]
    byte_ids: list[int]
    unknown: int
    spelled: list[str]  # hexadecimal bytes of every id
    unigram: bool

    @property
    def unlisted(self) -> float:
        """The score of a character without a piece, in unigram models."""
        return min(self.score) - 10.0


def load(path: str | None = None) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    text, ids, score, spelled, byte_ids = [], [], [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(piece[3:5])
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            spelled.append("")
        else:
            text.append(piece)
            ids.append(i)
            score.append(sp.get_score(i))
            spelled.append(piece.replace(MARK, " ").encode().hex())
    # BPE scores are whole numbers, minus the order of the merges
    unigram = any(s != int(s) for s in score)
    return Pieces(text, ids, score, byte_ids, sp.unk_id(), spelled, unigram)


# --- the lattice in Spark ---------------------------------------------------------------------------------------------


def marked(text: Column) -> Column:
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK))))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, edges (rank, s, e, id, score), sorted by rank and start; words must be distinct."""
    spark = words.sparkSession
    rank = np.empty(len(pieces.text), np.int64)
    order = sorted(range(len(pieces.text)), key=lambda i: -pieces.score[i])
    level, last = -1, None
    for i in order:
        level, last = level + (pieces.score[i] != last), pieces.score[i]
        rank[i] = level
    table = spark.createDataFrame(pd.DataFrame({"piece": pieces.text, "id": np.array(pieces.ids, np.int32), "rank": rank.astype(np.int32), "score": pieces.score}))
    longest = max(map(len, pieces.text))
    ends = F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, F.col("n"))))
    edges = (
        words.select("word", F.length("word").alias("n"))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("e", ends)
        .withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
        .join(F.broadcast(table), "piece")
    )
    return edges.groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "s", "e", "id", "score"))).alias("edges"))


def fold_merges(edges: Column, n: Column) -> Column:
    """Starts to ends of the final segments: after each edge that joins two neighbours, the array of ends (0: no start)."""
    singles = F.transform(F.sequence(F.lit(1), n), lambda e: e.cast("int"))

    def apply(ends, x):
        middle = F.get(ends, x["s"])
        joins = (middle > 0) & (F.get(ends, middle) == x["e"])
        return F.when(joins, F.transform(ends, lambda v, i: F.when(i == x["s"], x["e"]).when(i == middle, F.lit(0)).otherwise(v))).otherwise(ends)

    return F.aggregate(F.filter(edges, lambda x: x["e"] - x["s"] > 1), singles, apply)


def fold_viterbi(edges: Column, n: Column, unlisted: float) -> Column:
    """The same for the path of the highest sum of scores; a character without an edge has the score ``unlisted``."""
    by_end = F.array_sort(edges, lambda a, b: F.when(a["e"] != b["e"], a["e"] - b["e"]).otherwise(b["s"] - a["s"]))
    start = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(1).alias("m"), F.lit(-1).alias("b")))  # m: of equal ways the longer last piece

    def reach(best, e):
        into = F.filter(by_end, lambda x: x["e"] == e)
        ways = F.concat(
            F.transform(into, lambda x: F.struct((F.get(best, x["s"])["v"] + x["score"]).alias("v"), (-x["s"]).alias("m"), x["s"].alias("b"))),
            F.array(F.struct((F.get(best, e - 1)["v"] + F.lit(unlisted)).alias("v"), (1 - e).alias("m"), (e - 1).alias("b"))),
        )
        return F.concat(best, F.array(F.array_max(ways)))

    best = F.aggregate(F.sequence(F.lit(1), n), start, reach)
    back = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), F.array_repeat(F.lit(0), n).alias("ends")),
        lambda acc, k: F.when(acc["at"] <= 0, acc).otherwise(
            F.struct(F.get(best, acc["at"])["b"].alias("at"), F.transform(acc["ends"], lambda v, i: F.when(i == F.get(best, acc["at"])["b"], acc["at"]).otherwise(v)).alias("ends"))
        ),
    )
    return back["ends"]


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word and ids of distinct words, -1 where a character has no piece; words without any piece are left out."""
    edges, n = F.col("edges"), F.col("n")
    folded = lattice(words, pieces).withColumn("ends", fold_viterbi(edges, n, pieces.unlisted) if pieces.unigram else fold_merges(edges, n))
    found = lambda e, s: F.get(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == e)), F.lit(0))["id"]
    ids = F.filter(F.transform("ends", lambda e, s: F.when(e > 0, F.coalesce(found(e, s), F.lit(-1))).otherwise(F.lit(-2))), lambda x: x > -2)
    return folded.select("word", ids.cast("array<int>").alias("ids"))


# --- the lattice of a batch of words in a task --------------------------------------------------------------------------


class Encoder:
    """Ids of words (the bytes of int32): from the table of frequent words, else by the lattice; remembered up to a bound."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    MOST = 300_000

    def __init__(self, pieces: Pieces, head: dict[str, bytes]):
        self.pieces, self.head = pieces, head
        self.known = dict(head)
        self.score = dict(zip(pieces.text, zip(pieces.score, pieces.ids, strict=True), strict=True))
        self.longest = max(map(len, pieces.text))
        self.letters = np.zeros((len(pieces.text), self.longest), np.uint32)
        hashes = np.zeros(len(pieces.text), np.uint64)
        for i, p in enumerate(pieces.text):
            self.letters[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = np.cumprod(np.full(self.longest, self.BASE, np.uint64))
        size = np.array([len(p) for p in pieces.text])
        for k in range(self.longest):
            hashes = np.where(size > k, hashes * self.BASE + self.letters[:, k] + np.uint64(1), hashes)
        self.order = np.argsort(hashes)
        self.hashes, self.size = hashes[self.order], size
        self.maybe = np.zeros(1 << 20, bool)  # by the upper bits of the hash
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.ids = np.array(pieces.ids)
        self.rank = np.unique(-np.array(pieces.score), return_inverse=True)[1]

    def fallback(self, char: str) -> list[int]:
        raw = [self.pieces.byte_ids[b] for b in char.encode("utf-8", "replace")]
        return raw if min(raw) >= 0 else [self.pieces.unknown]

    def finish(self, word: str, starts: list[int], ids: list[int]) -> bytes:
        if min(ids) < 0:
            ids = [y for s, i in zip(starts, ids, strict=True) for y in ([i] if i >= 0 else self.fallback(word[s]))]
        return array("i", ids).tobytes()

    def long_word(self, word: str) -> bytes:
        """Merges by a heap; for unigram models Viterbi."""
        n = len(word)
        if self.pieces.unigram:
            worst = self.pieces.unlisted
            best, back = [0.0] + [-1e30] * n, [0] * (n + 1)
            for e in range(1, n + 1):
                best[e], back[e] = best[e - 1] + worst, e - 1
                for s in range(max(0, e - self.longest), e):
                    if (x := self.score.get(word[s:e])) and best[s] + x[0] > best[e]:
                        best[e], back[e] = best[s] + x[0], s
            cut, e = [], n
            while e:
                cut.append((back[e], e))
                e = back[e]
            cut.reverse()
        else:
            after, before, end = [*range(1, n), -1], [*range(-1, n - 1)], [*range(1, n + 1)]
            heap: list[tuple[float, int, int, int]] = []

            def offer(a: int, b: int) -> None:
                if a >= 0 and b >= 0 and (x := self.score.get(word[a : end[b]])):
                    heapq.heappush(heap, (-x[0], a, b, end[b]))

            for i in range(n - 1):
                offer(i, i + 1)
            while heap:
                _, a, b, e = heapq.heappop(heap)
                if end[a] != b or end[b] != e:  # one of the two has changed since
                    continue
                end[a], end[b] = e, -1
                after[a] = after[b]
                if after[b] >= 0:
                    before[after[b]] = a
                offer(before[a], a)
                offer(a, after[a])
            cut, s = [], 0
            while s < n:
                cut.append((s, end[s]))
                s = end[s]
        return self.finish(word, [s for s, _ in cut], [x[1] if (x := self.score.get(word[s:e])) else -1 for s, e in cut])

    def batch(self, words: list[str]) -> list[bytes]:
        """Ids of words of up to LONG characters, by the lattice of all of them."""
        length = np.array([len(w) for w in words])
        offset = np.append(0, length.cumsum())
        letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        total = len(letter)
        word_of = np.repeat(np.arange(len(words)), length)
        room = offset[1:][word_of] - np.arange(total)  # letters to the end of the word
        hashed = np.zeros(total, np.uint64)
        single = np.full(total, -1)
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, min(self.longest, int(length.max(initial=0))) + 1):
            n = total - k + 1
            hashed = hashed[:n] * self.BASE + letter[k - 1 :] + np.uint64(1)
            live = np.flatnonzero(self.maybe[(hashed >> np.uint64(44)).view(np.int64)] & (room[:n] >= k))
            at = np.searchsorted(self.hashes, hashed[live])
            hit = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashed[live])
            s, piece = live[hit], self.order[at[hit]]
            same = (self.size[piece] == k) & (self.letters[piece, :k] == letter[s[:, None] + np.arange(k)]).all(1)
            s, piece = s[same], piece[same]
            if k == 1:
                single[s] = self.ids[piece]
            else:
                edges.append((s, s + k, piece))
        after, ids = np.arange(1, total + 2), np.append(single, -1)
        if edges:
            s, e, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
            word = word_of[s]
            by = np.argsort(((word << 16 | self.rank[piece]) << 24) | s)  # by word, score and start
            s, e, piece, word = s[by], e[by], piece[by], word[by]
            while len(s):
                middle = after[s]
                ready = np.flatnonzero((middle > 0) & (middle < e) & (after[np.minimum(middle, total)] == e))
                if not len(ready):
                    break
                pick = ready[np.append(True, np.diff(word[ready]) > 0)]  # the first of each word
                after[middle[pick]] = -1
                after[s[pick]] = e[pick]
                ids[s[pick]] = self.ids[piece[pick]]
                # an edge stays open while it starts and ends at borders and is longer than its first segment
                border = after > 0
                border[offset] = True
                goes_on = np.zeros(len(words), bool)
                goes_on[word[pick]] = True
                keep = border[s] & border[e] & (after[s] < e) & goes_on[word]
                s, e, piece, word = s[keep], e[keep], piece[keep], word[keep]
        start = np.flatnonzero(after[:total] > 0)
        cut = np.searchsorted(start, offset)
        flat = ids[start].astype(np.int32)
        raw, ends = flat.tobytes(), (cut * 4).tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i in np.unique(word_of[start[flat < 0]]).tolist():  # words with a character that has no piece
            own = start[cut[i] : cut[i + 1]]
            out[i] = self.finish(words[i], (own - offset[i]).tolist(), ids[own].tolist())
        return out

    def learn(self, words: set[str]) -> None:
        short = [w for w in words if len(w) <= LONG and not self.pieces.unigram]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            self.known.update(zip(part, self.batch(part), strict=True))
        self.known.update((w, self.long_word(w)) for w in words if w not in self.known)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [re.findall(WORDS, MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        if new:
            self.learn(new)
        out = [b"".join(map(self.known.__getitem__, words) if None in ids else ids) for words, ids in zip(split, found, strict=True)]
        if len(self.known) > len(self.head) + self.MOST:  # only between batches: a batch needs all of its words
            self.known = dict(self.head)
        return out


#: The encoder of the last broadcast that this Python worker has seen, with the words that it has learnt.
_encoders: dict[str, Encoder] = {}


def encoder_of(name: str, shared: Broadcast) -> Encoder:
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(*shared.value)
    return _encoders[name]


def frequent_words(docs: DataFrame, most: int = HEAD) -> DataFrame:
    """The most frequent words of the texts (what stands between white space, with a word mark), ties by the word; no more
    than most."""
    words = docs.select(F.explode(F.split(F.replace(text_of(), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") < LONG) & (F.length("word") > 0) & ~F.col("word").contains(MARK))
    return counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).select(F.concat(F.lit(MARK), "word").alias("word"))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens, ids for every row of docs."""
    spark = docs.sparkSession
    pieces = load(model)
    head = materialise(frequent_words(docs), "head")
    known = encode_words(head.repartition("word"), pieces)
    table = {r["word"]: array("i", r["ids"]).tobytes() for r in known.toPandas().to_dict("records") if len(r["ids"]) and min(r["ids"]) >= 0}
    shared, name = spark.sparkContext.broadcast((pieces, table)), uuid.uuid4().hex

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, shared)
        for batch in batches:
            start, texts = 0, batch.column("text").to_pylist()
            while start < len(texts):
                end, size = start + 1, len(texts[start])
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end])
                    end += 1
                ids = encoder.encode(texts[start:end])
                n_tokens = np.array([len(x) // 4 for x in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, n_tokens.cumsum()).astype(np.int32)), flat)
                # doc_id and text stay Arrow columns: a null beside them changes no id
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(n_tokens), lists], ["doc_id", "text", "n_tokens", "ids"])
                start = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(encoded, "doc_id long, text string, n_tokens long, ids array<int>")


def decode(coded: DataFrame, pieces: Pieces) -> DataFrame:
    """coded with a column decoded: the text of its ids, without the first word mark.

    Ids of bytes make the text be put together from the pieces' bytes and read as UTF-8; other texts are their pieces'
    letters. ``BYTE`` marks such ids. A text that holds it itself has it as bytes."""
    own = set(pieces.byte_ids)
    shown = [BYTE if i in own else bytes.fromhex(raw).decode() for i, raw in enumerate(pieces.spelled)]

    if any(BYTE in t or BETWEEN in t for t in pieces.text):
        raise ValueError("a piece holds a private character")

    def table(values: list[str], mark: str) -> Column:
        return coded.sparkSession.range(1).select(F.split(F.lit(mark.join(values)), mark)).scalar()

    def joined(name: str) -> Column:
        return F.concat_ws("", F.transform("ids", lambda i: F.get(name, i)))

    out = coded.select(F.struct("*").alias("row"), "ids", table(shown, BETWEEN).alias("shown"), table(pieces.spelled, ",").alias("spelled"))
    out = out.withColumn("letters", joined("shown"))
    raw = F.make_valid_utf8(F.unhex(joined("spelled")).cast("string"))
    text = F.when(F.contains("letters", F.lit(BYTE)), raw).otherwise(F.col("letters"))
    return out.select("row.*", F.substring(text, 2, 2**31 - 1).alias("decoded"))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, same (whether decoding gives the text again) for every row of docs."""
    return decode(encode(docs, model), load(model)).select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("same"))
