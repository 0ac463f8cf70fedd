"""Alignment of two tokenizers against a plain reading, token by token, by the libraries themselves."""

import hashlib
from collections import Counter

import pytest

from tessera.llm import alignment
from tessera.llm.tokens import byte_letters

SCHEMA = "doc_id long, text string, pairs string, row_no int"


def plain(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in enumerate(byte_letters())}
    docs = []
    for i, text in rows:
        raw = f" {text}".encode()
        a = [(k, bytes(byte[c] for c in a_side.id_to_token(k))) for k in a_side.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = []
        for k in b_side.encode(text) if text else []:
            piece = b_side.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if b_side.is_byte(k) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        groups, at_a, at_b, x, y = [], 0, 0, [], []
        a, b = a[:], b[:]
        while a or b:
            if at_a <= at_b:
                k, s = a.pop(0)
                at_a += len(s)
                x.append(k)
            else:
                k, s = b.pop(0)
                at_b += len(s)
                y.append(k)
            if at_a == at_b:
                groups.append((x, y))
                x, y = [], []
        docs.append((i, groups))
    held = Counter()
    for _, groups in docs:
        held.update({(p, q) for x, y in groups for p in x for q in y})
    top = {}
    for (p, _), n in held.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for i, groups in docs:
        links = [(p, q) for x, y in groups for p in x for q in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), digest))
    return out


ROWS = [
    (1, "The quick brown fox; don't jump! 12345 6789"), (2, "Straße  München\n\tcafé — déjà vu…"), (3, "日本語のテキスト、한국어 텍스트 🙂👩‍👩‍👧"), (4, ""), (5, None), (6, " "), (7, "   lead  and trail   "),
    (8, "▁looks like a space ▁"), (9, "<|endoftext|><s>[INST]</s><unk> <0x41>"), (10, "a\x00b\x01﻿​\r\n"), (None, "null id"), (1, "The quick brown fox; don't jump! 12345 6789"),
    (2**60 + 1, "The the THE tHe"), (11, "x" * 3000), (12, " " * 900 + "end"), (13, "word " * 700), (14, "שלום עולם مرحبا ไทย हिन्दी ελληνικά"), (15, "▁"), (16, "ﬁ ½ Å é"), (17, "!?!?;;" * 200),
]


@pytest.mark.parametrize(("head", "piece", "large"), [(1_000_000, 1_000_000, 4096), (100, 400, 3), (0, 1, 1), (1500, 50, 4096)])
def test_alignment_equals_a_plain_reading(spark, monkeypatch, head, piece, large):
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "SLICE_BYTES", piece)
    monkeypatch.setattr(alignment, "LARGE", large)
    sf = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = ROWS + [(i + 100, t) for i, t in sf if len(t) < 4000]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in alignment.report(docs).collect())
    assert got == Counter(plain(rows))


def test_workers_get_the_slice_sizes():
    """The parametrised sizes above only reach the workers by closure where they are read on the driver: cut here, too."""
    aligner = alignment.Aligner(alignment.default_vocabulary(), alignment.default_model())
    texts = [t or "" for _, t in ROWS]
    wanted = {(w[0], *w[1:5], w[7]) for w in plain(ROWS)}
    for large in (1, 4096):
        alignment.LARGE = large
        got = aligner.align(texts)
        assert {(i, *c, d) for (i, _), c, d in zip(ROWS, got[0].tolist(), got[1], strict=True)} == wanted
        alone = [aligner.align([t]) for t in texts]
        for k in range(len(texts)):
            assert got[2][k].tolist() == alone[k][2][0].tolist() and got[3][k].tolist() == alone[k][3][0].tolist()
            assert got[3][k].sum() == got[0][k][3]
    assert list(alignment.text_slices([])) == [] and list(alignment.text_slices(["", ""])) == [slice(0, 2)]


def test_alignment_of_hostile_texts_takes_little_time_and_room():
    import time
    import tracemalloc

    aligner = alignment.Aligner(alignment.default_vocabulary(), alignment.default_model())
    tracemalloc.start()
    start = time.perf_counter()
    for text in (" " * 1_000_000, "\n " * 300_000, "x" * 1_000_000, "é" * 500_000):
        counts = aligner.align([text])[0]
        assert counts[0][3] >= counts[0][2] > 0
    assert time.perf_counter() - start < 90
    assert tracemalloc.get_traced_memory()[1] < 700_000_000
    tracemalloc.stop()


def test_alignment_of_nothing(spark):
    assert alignment.report(spark.createDataFrame([], SCHEMA)).count() == 0
    one = alignment.report(spark.createDataFrame([(None, None, "p", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(None, 0, 0, 0, 0, 0, 0, "")]
