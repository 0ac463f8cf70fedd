"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts and ratios of the whole text (lengths, classes of bytes, repetition of words and lines); no
label, id, language or source goes in. Training is on a bounded sample: the ``SAMPLE`` labelled rows with the smallest
hash of their id. The fitted trees are flat arrays (feature, threshold, left, right, value) that a task walks for a whole
batch at a time. Scoring is one pass without a shuffle.

Defined cases: a null text is empty; an empty text gets a score like any other; rows without a label are scored but not
learnt from; repeated labels count once per row; without labels of both classes every score is the share of label 1
(0.5 without any label). Columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import nested, text_of

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST, LAMBDA = 20_000, 80, 5, 64, 0.15, 12, 1.0

FEATURES = (
    "log_bytes log_words log_lines word_len letters_share upper_share digit_share space_share mark_share symbol_share high_share "
    "distinct_words top_word distinct_lines longest_line_share line_len stop_ends double_marks long_words one_letter_words "
    "upper_words digit_words marked_words repeated_pairs word_len_spread"
).split()

_CLASS = np.full(256, 6, np.int8)  # 0 upper, 1 lower, 2 digit, 3 white, 4 sentence marks, 5 other ASCII symbols, 6 beyond ASCII
for _c in range(128):
    _k = chr(_c)
    _CLASS[_c] = 0 if _k.isupper() else 1 if _k.islower() else 2 if _k.isdigit() else 3 if _k.isspace() else 4 if _k in ".,;:?!'\"-()" else 5
_END = re.compile(r"[.!?][\"')]?$")


def features(text: str) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    upper, lower, digit, white, mark, symbol, high = (np.bincount(_CLASS[raw], minlength=7) / n).tolist()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    count: dict[str, int] = {}
    for x in words:
        count[x] = count.get(x, 0) + 1
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = list(count)
    share = lambda test: sum(count[x] for x in kinds if test(x)) / w
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), float(length.mean()), upper + lower, upper, digit, white, mark, symbol, high,
        len(count) / w, max(count.values(), default=0) / w, len(set(lines)) / k, max(map(len, lines), default=0) / n, len(text) / k / 100,
        sum(bool(_END.search(x)) for x in lines) / k, (text.count("!!") + text.count("??") + text.count("..")) / w,
        float((length > 15).mean()), float((length == 1).mean()), share(lambda x: len(x) > 1 and x.isupper()), share(lambda x: any("0" <= c <= "9" for c in x)),
        share(lambda x: not x[-1].isalnum() and x[-1] not in ".,;:?!'\")"), 1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        float(length.std()),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees one after another in flat arrays; feature -1 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (f := self.feature[node]).max(initial=-1) >= 0:
                inner = f >= 0
                goes_left = x[rows, np.where(inner, f, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Histogram gradient boosting of the logistic loss."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    arrays: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value)):
            arrays[k].append(v)
        return len(arrays["feature"]) - 1

    if len(y) and 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        offset = np.arange(x.shape[1]) * BINS
        score = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            root = add(0.0)
            roots.append(root)
            todo = [(root, np.arange(len(y)), 0)]
            while todo:
                node, rows, depth = todo.pop()
                total_g, total_h = g[rows].sum(), h[rows].sum()
                arrays["value"][node] = float(-RATE * total_g / (total_h + LAMBDA))
                best = None
                if depth < DEPTH and len(rows) >= 2 * LEAST:
                    cell = (binned[rows] + offset).ravel()
                    size = BINS * x.shape[1]
                    shape = (x.shape[1], BINS)
                    lg, lh, ln = (
                        np.bincount(cell, np.repeat(v, x.shape[1]), size).reshape(shape).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows)))
                    )
                    gain = lg**2 / (lh + LAMBDA) + (total_g - lg) ** 2 / (total_h - lh + LAMBDA) - total_g**2 / (total_h + LAMBDA)
                    gain[(ln < LEAST) | (len(rows) - ln < LEAST)] = -1
                    for j, c in enumerate(cuts):
                        gain[j, len(c) :] = -1
                    if gain.max() > 1e-6:
                        best = np.unravel_index(gain.argmax(), shape)
                if best is None:
                    score[rows] += arrays["value"][node]
                    continue
                j, b = int(best[0]), int(best[1])
                arrays["feature"][node], arrays["threshold"][node] = j, float(cuts[j][b])
                goes_left = binned[rows, j] <= b
                for side, mask in (("left", goes_left), ("right", ~goes_left)):
                    arrays[side][node] = add(0.0)
                    todo.append((arrays[side][node], rows[mask], depth + 1))
    kinds = {"feature": np.int64, "left": np.int64, "right": np.int64}
    return Forest(**{k: np.array(v, kinds.get(k, np.float64)) for k, v in arrays.items()}, roots=np.array(roots, np.int64), base=base)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"quality": pdf["quality"], "x": [features(t) for t in pdf["text"]]})


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: those whose CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled rows outside the held-out third, those of the smallest id hash."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = F.broadcast(chosen).join(docs.select("doc_id", text_of().alias("text")), "doc_id").select("quality", "text")
    got = rows.mapInPandas(_measure, "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["quality"].to_numpy()))  # the order in which rows arrive changes nothing
    return fit(x[order], got["quality"].to_numpy(np.float64)[order])


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """row (the row of docs) and score: a pass over the whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([features(t) for t in batch], np.float64).reshape(len(batch), len(FEATURES))
            yield pd.Series(shared.value.scores(x))

    return nested(docs, score=scored(text_of()))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that are not rejected (score of 0.5 or more)."""
    return score(docs, train(docs, labels)).where("score >= 0.5").select("row.*")
