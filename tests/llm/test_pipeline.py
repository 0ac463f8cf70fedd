"""The rows of the whole pipeline against a brute-force version of its five stages."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tessera.llm import packing, quality

WINDOW = 200


def sentence(r: random.Random) -> str:
    words = ["".join(r.choice("aeiounrstl") for _ in range(r.randint(2, 9))) for _ in range(r.randint(6, 14))]
    return " ".join(words).capitalize() + "."


def article(r: random.Random, n: int) -> str:
    return "\n".join(" ".join(sentence(r) for _ in range(4)) for _ in range(n))


def corpus() -> list[tuple[int, str | None]]:
    r = random.Random(11)
    good = [article(r, r.randint(1, 5)) for _ in range(90)]
    junk = ["".join(r.choice("!#$%&*<>") for _ in range(r.randint(5, 300))) for _ in range(90)]
    passage = article(r, 2)
    near = [g.replace(" ", " extra ", 1) for g in good[:8] if len(g.split()) > 120]
    texts = [*good, *junk, *[g.upper() for g in good[10:14]], *good[12:15], *near]
    texts += [good[k] + "\n" + passage for k in range(20, 26)] + [article(r, 1) + "é" + passage[:150] for _ in range(3)]
    texts += [None, "", " ", passage, good[0] + good[1], article(r, 60)]
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


def chance(forest: quality.Forest, text: str) -> float:
    """Walks the trees one by one."""
    x, total = quality.features(text), forest.base
    for node in forest.roots:
        while forest.feature[node] >= 0:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return 1 / (1 + math.exp(-total))


def one_of_equal(rows: dict[int, str]) -> dict[int, str]:
    last: dict[str, int] = {}
    for i, t in sorted(rows.items()):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in t)] = i
    return {i: rows[i] for i in last.values()}


def one_of_near(rows: dict[int, str]) -> dict[int, str]:
    words = {i: t.lower().split() for i, t in rows.items()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in rows}
    linked = [
        (a, b)
        for a in rows
        for b in rows
        if a < b and (words[a] == words[b] or (grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])))
    ]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {i: t for i, t in rows.items() if root[i] == i}


def without_repeats(rows: dict[int, str]) -> dict[int, str]:
    raws = {i: t.encode() for i, t in rows.items()}
    seen = Counter(b[k : k + WINDOW] for b in raws.values() for k in range(len(b) - WINDOW + 1))
    out = {}
    for i, b in raws.items():
        covered = bytearray(len(b))
        for k in range(len(b) - WINDOW + 1):
            if seen[b[k : k + WINDOW]] > 1:
                covered[k : k + WINDOW] = b"\1" * WINDOW
        out[i] = bytes(x for x, c in zip(b, covered, strict=True) if not c).decode("utf-8", "ignore")
    return out


@pytest.fixture
def folder(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(k < 90), 0) for k, (i, _) in enumerate(rows) if k < 180]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def pieces(df: DataFrame) -> dict[int, list]:
    by: dict[int, list] = {}
    for r in df.collect():
        by.setdefault(r.doc_id, []).append(r)
    return by


def test_pipeline_equals_brute_force(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    forest = quality.train(docs, labels)
    every = {i: t or "" for i, t in corpus()}
    kept = {i: t for i, t in every.items() if chance(forest, t) >= 0.5}
    assert 90 < len(kept) < len(every)
    single = one_of_equal(kept)
    apart = one_of_near(single)
    assert len(apart) < len(single) < len(kept)
    left = without_repeats(apart)
    assert sum(map(len, left.values())) < sum(map(len, apart.values())) - 1000

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, folder)
    got = pieces(packed)
    assert got.keys() == left.keys()
    sequences: dict[int, list] = {}
    for i, text in left.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids)
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]]
        assert sum(n for _, n in own) <= packing.LENGTH


def test_pipeline_over_nothing(spark, folder, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
