"""Operators on documents against brute force, on a small fixture with the awkward cases in it."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tessera.llm import exact_dedup, fingerprints, licenses, ngram_join, packing, quality, sentencepiece_lattice, suffix_dedup

#: The columns of documents, and others whose names the operators use themselves.
CLASHES = "sha string, key long, kept boolean, _block int, row string, id string, hash string, score string, own string, kept_text string, copies int, n int, text_hash string, node int, root int, _keep_id int, _again int"
CLASHES += ", _tessera_keep int, _tessera_key int, _tessera_own string, _tessera_score string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
EXTRA = tuple({"string": "x", "long": 2, "int": 5, "boolean": True}[x.split()[1]] for x in CLASHES.split(", "))
BIG = 2**60 + 1  # no floating-point number


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("aeiounrstlé") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def make() -> list[tuple[int | None, str | None]]:
    r = random.Random(3)
    base = [prose(r, n) for n in (4, 60, 120, 200, 400)]
    near = base[3].split(" ")
    near[50] = "changed"
    passage = prose(r, 60)
    rows = list(enumerate([*base, base[1], base[1].upper(), " ".join(near), passage + " " + base[4][:300], prose(r, 30) + passage, None, "", "   \n", "a" * 700, "ab" * 4000, "x", "x"]))
    rows += [(40, base[2]), (40, base[2]), (41, prose(r, 30_000)), (42, "😀漢字 " * 100), (46, "a\x00b\x01c \ue000\ue001 \x7f" * 3), (43, "\n".join([prose(r, 8)] * 60)), (None, base[2]), (44, "x y z"), (45, "x y z")]
    return rows


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t in ROWS]


def lowered(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_exact_dedup(docs, empty):
    groups: dict[str, list] = {}
    for i, t in texts():
        groups.setdefault(lowered(t), []).append(i)
    wanted = Counter()
    for i, t in texts():
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        wanted[(i, keep, len(g), hashlib.sha256(lowered(t).encode()).hexdigest())] += 1
    got = exact_dedup.annotate(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == wanted
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.deduplicate(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.annotate(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_chunks_cover_the_text(spark):
    r = random.Random(1)
    text = prose(r, 5000) + "z" * 9000
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"regexp_extract_all(t, '{exact_dedup.CHUNKS}', 0) AS c").first()
    assert "".join(row.c) == text and max(map(len, row.c)) <= exact_dedup.MAX_CHUNK


def test_stages_keep_rows_and_clashing_columns(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.deduplicate(docs), ngram_join.keep_one(docs), suffix_dedup.stripped(docs), quality.keep_good(docs, labels)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r)[5:] == EXTRA and r.lang == "en" for r in got)


def test_exact_dedup_keeps_one_of_case_twins(spark):
    docs = spark.createDataFrame([(5, "Hello"), (5, "hello"), (4, "HELLO"), (6, "x"), (6, "x"), (None, "y"), (None, "Y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text.lower()) for r in exact_dedup.deduplicate(docs).collect())
    assert got == [(0, "y"), (5, "hello"), (6, "x")]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.annotate(docs).collect()) == Counter(
        [(5, 5, 3, True), (5, 5, 3, False), (4, 5, 3, False), (6, 6, 2, True), (6, 6, 2, False), (None, None, 2, True), (None, None, 2, False)]
    )


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op8_exact_dedup"])
def test_documents_equal_their_sql(spark, name, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tessera.llm import queries

    r = random.Random(5)
    base = [prose(r, 30) for _ in range(6)]
    rows = [(i, r.choice(base) + r.choice(["", " end", " End"]), "en", "s", 1) for i in range(60)]
    if name == "op8_exact_dedup":  # the other SQL knows texts by their ids
        more = [(5, "Hello"), (5, "hello"), (5, "hello"), (4, "HELLO"), (6, "x"), (6, None), (7, ""), (None, "y"), (None, "Y"), (None, "hello")]
        rows += [(*x, "en", "s", 1) for x in more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(result.fetchall())


def test_exact_dedup_of_a_hot_group(spark, monkeypatch):
    rows = [(i, "same" if i % 3 else f"own {i // 6}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usual = Counter(map(tuple, exact_dedup.annotate(docs).collect()))
    for share in (1, 10**9):  # no group is hot, every group is
        monkeypatch.setattr("tessera.llm.common.HOT_SHARE", share)
        assert Counter(map(tuple, exact_dedup.annotate(docs).collect())) == usual


def test_large_ids_beside_a_null(spark):
    text = [prose(random.Random(k), 150) for k in range(3)]
    rows = [(BIG, text[0]), (None, text[1]), (BIG + 1, text[0] + " more"), (BIG + 2, text[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = Counter(i for i, _ in rows)
    assert Counter(r.doc_id for r in sentencepiece_lattice.round_trip(docs).collect()) == ids
    assert {r.doc_id for r in packing.pack(docs).collect()} == set(ids)
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert set(got) == set(ids) and got[BIG + 1].class_id == BIG and got[BIG + 1].copy_of == BIG + 1
    assert Counter(r.doc_id for r in suffix_dedup.dedup(docs).collect()) == ids
    assert Counter(r.doc_id for r in fingerprints.compare(docs).collect()) == ids
    assert Counter(r.doc_id for r in exact_dedup.annotate(docs).collect()) == ids


def similar(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_ngram_join(docs, empty):
    words = [(i, tuple(t.lower().split())) for i, t in texts()]
    grams = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for _, w in words}
    kinds = list(grams)
    links = {a: {b for b in kinds if a and b and a != b and similar(grams[a], grams[b]) >= 0.8} for a in kinds}
    root = {w: w for w in kinds}
    for _ in kinds:
        for a in kinds:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    first = {}
    for i, w in words:
        first[root[w]] = min(x for x in (first.get(root[w]), i) if x is not None) if (first.get(root[w]), i) != (None, None) else None
    wanted = Counter((i, first[root[w]], sum(x == w for _, x in words), len(links[w])) for i, w in words)
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.join(docs).collect())
    assert got == wanted
    assert any(links.values())
    assert ngram_join.join(empty).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_ngram_join_knows_texts_by_their_words(spark):
    r = random.Random(12)
    texts = [prose(r, 120).split() for _ in range(4)]
    near = lambda w, k: " ".join([*w[:k], f"changed{k}", *w[k + 1 :]])
    a, b, c, d = (" ".join(w) for w in texts)
    rows = [(1, a), (1, a), (2, near(texts[0], 60))]  # a repeated row with a near copy
    rows += [(None, b), (None, near(texts[1], 60)), (None, near(texts[1], 70))]  # only null ids, linked
    rows += [(7, c), (7, d), (8, near(texts[2], 60))]  # two texts under one doc_id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = Counter((x.doc_id, x.class_id, x.copy_of, x.n_copies, x.n_links, x.n_linked_docs) for x in ngram_join.join(docs).collect())
    assert got == Counter([(1, 1, 1, 2, 1, 1)] * 2 + [(2, 1, 2, 1, 1, 2)] + [(None, None, None, 1, 2, 2)] * 3 + [(7, 7, 7, 1, 1, 1), (7, 7, 7, 1, 0, 0), (8, 7, 8, 1, 1, 1)])
    kept = Counter(map(tuple, ngram_join.keep_one(docs).collect()))
    assert sum(kept.values()) == 4 and kept[(1, a)] == kept[(7, c)] == kept[(7, d)] == 1 and sum(i is None for i, _ in kept) == 1


def test_ngram_join_cuts_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    r = random.Random(9)
    base = prose(r, 300).split()
    rows = []
    for i in range(40):
        w = list(base)
        w[(7 * i) % len(w)] = f"only{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}
    monkeypatch.setattr(ngram_join, "SPREAD", 3)
    monkeypatch.setattr("tessera.llm.common.BROADCAST_ROWS", 3)  # both ways give the same rows
    monkeypatch.setattr(ngram_join, "PAIRS", 10)
    assert Counter(map(tuple, got)) == Counter(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_pruning_table_keeps_what_is_likely():
    least = ngram_join.least_matches()
    steps = range(ngram_join.STEP, ngram_join.HASHES + 1, ngram_join.STEP)
    assert all(m < 0.75 * n for m, n in zip(least, steps, strict=True)) and least[-1] > 0.5 * ngram_join.HASHES


def test_suffix_dedup(docs, empty):
    raws = [t.encode() for _, t in texts()]
    seen = Counter(b[k : k + 200] for b in raws for k in range(len(b) - 199))
    wanted = Counter()
    for (i, _), b in zip(texts(), raws, strict=True):
        covered = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        wanted[(i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == wanted
    assert sum(x[2] for x in wanted) > 1000
    assert suffix_dedup.dedup(empty).count() == 0
    out = suffix_dedup.stripped(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_interleave_is_the_sorted_order():
    r = random.Random(1)
    base = "".join(r.choice("abc") for _ in range(40))
    contexts = ["".join(r.choice("ab") for _ in range(r.randint(0, 30))) + base[r.randint(0, 10) : r.randint(20, 40)] for _ in range(60)]
    contexts = [c.encode() for c in [*contexts, "", *["ab" * 16] * 3, "é" * 20]]
    step, begin, symbols = suffix_dedup.STEP, 0, {}
    for k, c in enumerate(contexts):
        for at in range(len(c) + 1):
            whole = [(1, c[p : p + step]) for p in range(at, len(c) - step + 1, step)]
            symbols[begin + at] = [*whole, (0, k, at + step * len(whole))]  # what is left is less than any symbol, and like no other
        begin += len(c) + 1
    for cuts in ([65], [20, 35, 65], list(range(1, 66))):
        shards = [contexts[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        built = [suffix_dedup.transform(x) for x in shards]
        first = [sum(len(c) + 1 for x in shards[:k] for c in x) for k in range(len(shards))]
        where = [at + b for t, b in zip(built, first, strict=True) for at in t.order.tolist()]
        for depth in (1, 3, 12):
            suffix, common, _ = suffix_dedup.interleave(built, depth)
            order = [symbols[where[x]] for x in suffix.tolist()]
            assert sorted(where[x] for x in suffix.tolist()) == sorted(symbols)
            for a, b, n in zip(order, order[1:], common[1:].tolist(), strict=False):
                assert a[:depth] <= b[:depth]
                assert n == min(depth, next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y))


def test_suffix_dedup_hot_groups(docs, monkeypatch):
    usual = Counter(map(tuple, suffix_dedup.dedup(docs).select("doc_id", "n_removed", "kept_sha256").collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert Counter(map(tuple, suffix_dedup.dedup(docs).select("doc_id", "n_removed", "kept_sha256").collect())) == usual


def generalised(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / total if (total := sum((a | b).values())) else 1.0


def test_fingerprints(docs, empty):
    def bag(t: str) -> Counter:
        w = t.lower().split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    got = fingerprints.compare(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {i: t for i, t in texts() if i is not None and i != 40}
    order = sorted(by_id)
    off = []
    for r in got:
        if r.doc_id in (15, 16, 20, 41, 42, 43, 44, 45):  # documents with a plain successor
            t, after = by_id[r.doc_id], by_id[order[order.index(r.doc_id) + 1]] if r.doc_id != order[-1] else ""
            n = len(t)
            edited = t[: n - n // 2] + after[: n // 2]
            assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            for got_near, b in ((r.near_edited, bag(edited)), (r.near_next, bag(after))):
                near = generalised(bag(t), b)  # the samples agree with this probability, each for itself
                off.append(abs(got_near - near) / max((near * (1 - near) / fingerprints.SAMPLES) ** 0.5, 1e-3))
    assert off and max(off) < 4
    prints: dict[str, set] = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {5, 1} <= next(s for s in prints.values() if 1 in s)
    assert fingerprints.compare(empty).count() == 0


def test_fingerprint_estimates_weights(spark):
    a, b = " ".join(["one two three four five six"] * 30), " ".join(["one two three four five six"] * 18 + ["seven eight nine ten eleven twelve"] * 6)
    rows = [(f"{k}{s}", x) for k in range(40) for s, x in (("a", a.replace("o", f"o{k}")), ("b", b.replace("o", f"o{k}")))]
    got = {r.k: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame(rows, "k string, text string"), ["k"]).collect()}
    w = lambda t: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
    n = fingerprints.SAMPLES
    mean = sum(sum(got[f"{k}a"][4 * i : 4 * i + 4] == got[f"{k}b"][4 * i : 4 * i + 4] for i in range(n)) / n for k in range(40)) / 40
    assert abs(mean - generalised(w(a), w(b))) < 0.06


def test_quality(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, prose(r, 80) if i % 3 else "!!! ###" * r.randint(5, 40)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.classify(many, labels).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    held = [x for x in got if x.held_out]
    assert held and sum(x.predicted == (x.doc_id % 3 > 0) for x in held) >= 0.97 * len(held)
    assert quality.classify(docs, labels).count() == len(ROWS)
    assert all(0 <= x.score <= 1 for x in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, t in texts():
        wanted[(i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1)] += 1
    got = packing.pack(docs).collect()
    total = Counter()
    for r in got:
        total[(r.doc_id, r.doc_tokens)] += r.length
    assert total == Counter({k: k[1] * n for k, n in wanted.items()})
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    one = {i: t for i, t in texts()}[41]
    import numpy as np

    ids = np.array(tokenizer.encode(one, add_special_tokens=False).ids + [0], "<u4")
    for r in got:
        if r.doc_id == 41:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack(empty).count() == 0


def test_packing_matches_added_tokens(spark):
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    said = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "<|endoftext|", "don't <|END|> <|endoftext|>é",
            " " * 1_000_000, "\n\u00a0" * 500_000, "a<|endoftext|>" + " " * 700_000 + "b\t\t"]
    got = {}
    for r in packing.pack(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(said):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(got[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]], i
        for r in pieces:
            assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes())), i
        assert sum(r.length for r in pieces) == len(ids)


def test_packing_keeps_short_documents_whole(spark):
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    said = ["a<|endoftext|>b", "<|endoftext|", "é"]
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)).collect()}
    for i, t in enumerate(said):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].length, got[i].doc_tokens, got[i].ids_crc32) == (0, len(ids), len(ids), zlib.crc32(ids.tobytes())), t


def test_cheapest_cuts_are_cheapest():
    import numpy as np

    r = random.Random(4)
    for _ in range(20):
        gaps = [r.randint(1, packing.HARD) for _ in range(60)]
        points = np.append(0, np.cumsum(gaps))
        penalty = np.array([0, *[r.choice([0, 3, 24]) for _ in gaps[:-1]], 0])
        cost = [0] + [10**9] * len(gaps)
        for j in range(1, len(points)):
            for i in range(j):
                n = int(points[j] - points[i])
                if n <= packing.LENGTH:
                    own = packing.LENGTH - n if n & (n - 1) else packing.SHORT * (n < packing.LENGTH)
                    own = min(own, packing.LENGTH - n)
                    cost[j] = min(cost[j], cost[i] + own + int(penalty[j]) + 1)
        cuts = packing.cheapest_cuts(points, penalty)
        spent, last = 0, 0
        for c in cuts:
            n = int(points[c] - points[last])
            spent += min(packing.LENGTH - n, packing.SHORT if not n & (n - 1) else 10**9) + int(penalty[c]) + 1
            last = c
        assert spent == cost[-1]


def test_sentencepiece(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.default_model())
    got = sentencepiece_lattice.round_trip(docs).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(sp.encode(t))) for i, t in texts())
    assert all(r.same and r.n_tokens == len(r.ids) for r in got)
    assert sentencepiece_lattice.round_trip(empty).count() == 0


def test_sentencepiece_folds_agree(spark):
    r = random.Random(6)
    pieces = sentencepiece_lattice.load()
    encoder = sentencepiece_lattice.Encoder(pieces, {})
    words = sorted({"▁" + "".join(r.choice("aehinorst") for _ in range(r.randint(1, 14))) for _ in range(500)})
    encoder.learn(set(words))
    numbers = lambda raw: list(memoryview(raw).cast("i"))
    got = sentencepiece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()
    assert len(got) == len(words)
    for row in got:
        assert row.ids == numbers(encoder.known[row.word]) == numbers(encoder.long_word(row.word))


def test_sentencepiece_forgets_words(monkeypatch):
    """Words that an earlier batch has learnt are there in a batch that fills the memory."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.default_model())
    monkeypatch.setattr(sentencepiece_lattice.Encoder, "MOST", 4)
    encoder = sentencepiece_lattice.Encoder(sentencepiece_lattice.load(), {})
    r = random.Random(8)
    for _ in range(30):
        texts = [" ".join(r.choice("one two three four five six seven eight nine ten".split()) for _ in range(r.randint(0, 6))) for _ in range(3)]
        assert [list(memoryview(x).cast("i")) for x in encoder.encode(texts)] == [sp.encode(t) for t in texts]
        assert len(encoder.known) <= 4


def test_viterbi_of_unlisted_characters(spark):
    pieces = sentencepiece_lattice.Pieces(["a", "b", "aab"], [0, 1, 2], [-1.0, -2.0, -30.0], [-1] * 256, 6, [], True)
    got = {r.word: r.ids for r in sentencepiece_lattice.encode_words(spark.createDataFrame([("axb",), ("aab",), ("xxa",)], "word string"), pieces).collect()}
    encoder = sentencepiece_lattice.Encoder(pieces, {})
    assert {w: [x if x >= 0 else 6 for x in i] for w, i in got.items()} == {w: list(memoryview(encoder.long_word(w)).cast("i")) for w in got}


def test_viterbi_fold(spark):
    pieces = sentencepiece_lattice.Pieces(["a", "b", "ab", "abc", "c", "bc"], [0, 1, 2, 3, 4, 5], [-2.5, -2.25, -3.0, -9.5, -1.5, -2.0], [-1] * 256, 6, [], True)
    got = {r.word: r.ids for r in sentencepiece_lattice.encode_words(spark.createDataFrame([("abc",), ("ab",), ("cab",), ("aab",)], "word string"), pieces).collect()}
    encoder = sentencepiece_lattice.Encoder(pieces, {})
    assert got == {w: list(memoryview(encoder.long_word(w)).cast("i")) for w in got}
    assert got["abc"] == [0, 5]  # as good as ab, c: the longer last piece


def test_licenses(spark, docs, empty):
    mit = (
        'The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More."
    )
    back = ". ".join(reversed(mit.replace("\n", " ").split(". ")))
    rows = {
        "a": ("Foo bar\nReleased under the MIT License.\nx", "MIT"),
        "b": (mit, "MIT"),
        "c": (back, ""),  # the order counts
        "d": ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        "e": ("A. This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,GPL-3.0"),
        "f": ("under the bridge, a license to kill", ""),
        "g": ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        "h": ("Distributed under GPL v3", "GPL-3.0"),
    }
    got = licenses.scan(spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: v[1] for k, v in rows.items()}
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(empty).count() == 0


#: Whole public licence texts, wrapped as they come.
MIT_TEXT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE."""
BSD_2_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3_TEXT = BSD_2_TEXT + """
3. Neither the name of Example Widgets, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_TEXT = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL_TEXT = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
LGPL_TEXT = """This library is free software: you can redistribute it and/or modify it under the
terms of the GNU Lesser General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies."""


def test_licenses_of_whole_texts(spark):
    rows = {
        MIT_TEXT: "MIT", BSD_2_TEXT: "BSD-2-Clause", BSD_3_TEXT: "BSD-3-Clause", APACHE_TEXT: "Apache-2.0", GPL_TEXT: "GPL-2.0-or-later",
        LGPL_TEXT: "LGPL-3.0-or-later", ISC_TEXT: "ISC", MIT_TEXT + "\n\n" + BSD_3_TEXT: "BSD-3-Clause,MIT", GPL_TEXT.replace(" * ", "").replace(" *", ""): "GPL-2.0-or-later",
    }
    got = licenses.scan(spark.createDataFrame([(k, k) for k in rows], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == rows


#: Beginnings and notices of further public licences, as they come.
MORE_TEXTS = {
    '''                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.''': "Apache-2.0",
    """This library is free software; you can redistribute it and/or modify it
under the terms of the GNU Lesser General Public License version 2.1 only, as
published by the Free Software Foundation.""": "LGPL-2.1",
    """it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.""": "GPL-2.0",
    """This Font Software is licensed under the SIL Open Font License, Version 1.1.
This license is copied below, and is also available with a FAQ at:
https://scripts.sil.org/OFL""": "OFL-1.1",
    """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License.""": "CDDL-1.0",
    """PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2
--------------------------------------------

1. This LICENSE AGREEMENT is between the Python Software Foundation
("PSF"), and the Individual or Organization ("Licensee") accessing and
otherwise using this software ("Python") in source or binary form and
its associated documentation.""": "PSF-2.0",
    "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL.": "EUPL-1.2",
    """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES""": "0BSD",
    "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0": "CDDL-1.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at": "EPL-2.0",
    "Released under the GNU Free Documentation License, Version 1.3 or any later version": "GFDL-1.3-or-later",
    "Licensed under the Academic Free License version 3.0": "AFL-3.0",
    "Use of this source code is governed by the Blue Oak Model License 1.0.0": "BlueOak-1.0.0",
    "This database is made available under the Open Database License: ODbL 1.0": "ODbL-1.0",
    "The code was never intended to be released under the MIT License": "",
    "It has not been licensed under the Apache License, Version 2.0": "",
    "This is not a toy for children and it is licensed under the MIT License": "MIT",
}


def test_licenses_of_more_texts(spark):
    got = licenses.scan(spark.createDataFrame([(k, k) for k in MORE_TEXTS], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == MORE_TEXTS
    assert len(licenses.NAMES) > 65 and len(licenses.names()) < 260


def test_expressions_stay_as_they_are(spark):
    rows = {
        "// SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR  GPL-2.0-only WITH Classpath-exception-2.0\nint x;": "(MIT AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0",
        "/* SPDX-License-Identifier: GPL-2.0+ */\n# spdx-license-identifier: MIT\n# SPDX-License-Identifier: MIT": "GPL-2.0+;MIT",
        "SPDX-License-Identifier:": "",
        "SPDX": "",
        "": "",
    }
    got = licenses.scan(spark.createDataFrame([(k, k) for k in rows], "doc_id string, text string")).collect()
    assert {r.doc_id: r.expressions for r in got} == rows


def test_licenses_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    texts = [MIT_TEXT, BSD_3_TEXT, APACHE_TEXT, GPL_TEXT, LGPL_TEXT, ISC_TEXT, "", None, "SPDX-License-Identifier: MIT OR Apache-2.0", "Not released under GPL v2.\nMIT License",
             *MORE_TEXTS, "/* SPDX-License-Identifier:  (GPL-2.0-only WITH\tClasspath-exception-2.0) OR MIT */\n// SPDX-License-Identifier: ISC"]
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    result = con.execute(licenses.sql())
    names = [c[0] for c in result.description]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(result.fetchall())


def test_licenses_finds_all_notices(spark):
    long = "and all of its parts " * 12
    rows = {
        "Use of this code is governed by GPLv3.": "GPL-3.0",
        "This file is covered by GPL v2.": "GPL-2.0",
        "This package, including all of its documentation and examples and test data, is licensed under the MIT License.": "MIT",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "Licensed under the MIT License, see LICENSE for details.": "MIT",
        f"This {long}is licensed under the MIT License {long}": "MIT",
        "A file that is\ncovered\nby GPL v2.": "GPL-2.0",
        "This is free and unencumbered software released into the public\ndomain.": "Unlicense",
        "Published by Foo and licensed under the GNU GPL v3 or a commercial license.": "GPL-3.0,Proprietary",
        "Published by the MIT Press.": "",
        "Available under commercial pressure.": "",
        "Licensed under Apache 2.1": "",
        "This file is not licensed under the MIT License.": "",
        "Apache License, Version 2.0 or MIT": "Apache-2.0,MIT",
        "The MIT License (MIT)": "MIT",
        "License: BSD 3-Clause": "BSD-3-Clause",
        "A license to kill, a licence to thrill.": "",
        "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: (GPL-2.0+ AND MIT) OR ISC": "GPL-2.0-or-later,ISC,MIT",
        "Licensed under the GNU GPL, version 3 or (at your option) any later version.": "GPL-3.0-or-later",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
    }
    got = licenses.scan(spark.createDataFrame([(k, k) for k in rows], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == rows
    assert all(r.n_sentences == (r.licenses != "") for r in got)
