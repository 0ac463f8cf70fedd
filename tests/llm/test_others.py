"""Chat formatting, HTML extraction, groups and the pipeline."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import chat, html_blocks, html_training
from tessera.llm.groups import components, local_roots

TURNS = "conv_id long, turn long, role string, text string, perspective string, part int"


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é😀"), (1, 2, "ann", "again"), (1, 70, "bob", None), (1, 2, "ann", "again"),
    (2, 0, "system", "alone"), (None, None, None, "x"), (3, 5, "user", ""), (4, 0, "a", "<|im_end|>"), (4, 1, "b", "<|im_start|>a"),
    *[(None, None, "ann" if k % 2 else "bob", f"{k % 5}") for k in range(300)], *[(7, 3, "user", "same")] * 50,
]


@pytest.mark.parametrize("most", [chat.PART, 9_000])
def test_chat(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "PART", most)
    got = chat.rotate(spark.createDataFrame([(*r, "p", 9) for r in CHATS], TURNS).repartition(3)).collect()
    wanted, cut = {}, {}
    for conv in {r[0] for r in CHATS}:
        own = sorted((r[1] if r[1] is not None else -1, r[2] or "unknown", r[3] or "") for r in CHATS if r[0] == conv)
        for who in {r for _, r, _ in own} - {"system"}:
            text, masks, weight = "", [], 0
            for _, role, said in own:
                head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
                line = f"<|im_start|>{head}\n{said}<|im_end|>\n"
                if role == who:
                    masks.append(f"{len(text) + len(line) - len(said) - 11}-{len(text) + len(line) - 1}")
                cut.setdefault((conv, who, weight // most), len(text))
                weight += len(said) + chat.TURN
                text += line
            wanted[(conv, who)] = text, masks
    whole = {}
    for r in sorted(got, key=lambda r: r.part):
        text, masks = whole.setdefault((r.conv_id, r.perspective), ["", []])
        assert cut.pop((r.conv_id, r.perspective, r.part)) == r.start == len(text)
        whole[(r.conv_id, r.perspective)] = [text + r.text, masks + (r.masks.split(",") if r.masks else [])]
        spans = [tuple(map(int, m.split("-"))) for m in r.masks.split(",")] if r.masks else []
        assert all(r.text[a - r.start : b - r.start].endswith("<|im_end|>") for a, b in spans) and r.n_masked == sum(b - a for a, b in spans)
        assert r.n_turns <= most // chat.TURN
    assert {k: tuple(v) for k, v in whole.items()} == wanted and not cut
    assert (max(r.part for r in got) > 20) == (most < chat.TURN * 20)
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = con.execute(queries.SQL["op9_chat_formatting"])
    names = [c[0] for c in result.description]
    got = queries.op9_chat_formatting(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, result.fetchall()))


def test_html_cases(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a><li>News</ul></nav>
    <div class="cookie-notice"><p>We use cookies</p></div><article><h1>Big&nbsp;&amp; bold</h1><p>One<br>two   <b>three</b>
    <script>var x = "<p>no</p>";</script><p>Second &lt;b&gt; para</p><aside class="related">Read more</aside><ul><li>item</li></ul></article>
    <section id="comments"><p>Great read!</p></section><form><label>Mail</label></form><footer>&copy; us</footer>"""
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", page, "x", 0), (2, "u", None, "x", 0), (3, None, "", "x", 0), (4, "u", "<nav>menu only</nav>", "x", 0), (4, "u", "<nav>menu only</nav>", "x", 0), (5, "u", "<<<>>&#x110000;<p", "x", 0)]
    got = sorted(html_blocks.extract(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.page_id)
    assert got[0].text == "Big & bold\nOne two three\nSecond <b> para\nitem" and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:5]] == ["", "", "", ""] and len(got) == 6
    assert html_blocks.extract(spark.createDataFrame([], schema)).count() == 0


class Articles(HTMLParser):
    """A plain reading of the test tables' pages: what stands in <article>, a block for each h1 and p."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts += [""] * (tag in ("article", "h1", "p", "h2", "ul", "li", "div"))
        self.parts[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts += [""] * (tag in ("h1", "p", "article"))

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data


def test_html_extraction_equals_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    right = 0
    for r in pages.collect():
        reader = Articles()
        reader.feed(r.html or "")
        reader.close()
        right += got[r.page_id] == "\n".join(t for p in reader.parts if (t := " ".join(p.split())))
    assert len(got) == pages.count() and right >= 0.99 * len(got)


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<head><title>x</title><p>Text is here", ["Text is here"]),
        ("<html><head><title>x</title>Text is here<p>and here", ["Text is here", "and here"]),
        ("<p>a</p><svg><g>no</g><p>rest of it", ["a", "rest of it"]),
        ("<p>so <svg><title>t</title><text>no</text></svg> on</p>", ["so on"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>", ["so x=2 holds"]),
        ("<object><p>in its place</p></object>", ["in its place"]),
        ("<template><p>no</p><template>no</template>no</template><p>yes", ["yes"]),
        ("<p title='a > b' alt=\"<p>\">q</p>", ["q"]),
        ("<p title='never closed>q</p><p>r", ["q", "r"]),
        ("<p>a < b and c<d</p>", ["a < b and c"]),
        ("<p>one<script>var x = '<p>no';</script>two</p>", ["onetwo"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("a &amp;lt; b &#233;\u00a0 c", ["a &lt; b é c"]),
    ],
)
def test_blocks(page, wanted):
    assert [b.text for b in html_blocks.blocks(page)] == wanted


@pytest.mark.parametrize("part", ["<a '", "<a \">' ", "<a x=\">\"y", "<a<", "<", "<!--", "<![CDATA[", "<svg>", "<script>", "<p '>\"", "</svg"])
def test_blocks_of_hostile_pages_take_little_time(part):
    start = time.process_time()
    html_blocks.blocks(part * (400_000 // len(part)))
    html_blocks.blocks("<p>" + part * (400_000 // len(part)) + ">'\"><p>x")
    assert time.process_time() - start < 8


DEEP = ["<div>a" * 166_000, "<div>" * 60_000 + "</section>" * 60_000 + "x", "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "x",
        "<table>" + "<b>" * 100_000 + "<tr>x" * 50_000, "<p><i>" * 100_000, "<ul><li>a" * 80_000]


@pytest.mark.parametrize("page", DEEP)
def test_deep_pages_take_little_time_and_room(page):
    import tracemalloc

    labeller = html_blocks.Labeller.load()
    start = time.perf_counter()
    html_blocks.main_text([page], labeller)
    assert time.perf_counter() - start < 20
    tracemalloc.start()
    html_blocks.blocks(page)
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()


def test_paths_are_those_of_the_open_elements():
    page = "<div class='a b'><ul><li>x<li id=q><b>y</b></ul><p>u<p>v<section>w</p></section></table>z</div><tr><td>1<td>2<tr><td>3"
    read = [(b.text, [" ".join(w) for w in b.node.path()] if b.node else []) for b in html_blocks.blocks(page)]
    top = "div .a .b"
    assert read == [
        ("x", [top, "ul", "li"]), ("y", [top, "ul", "li .q"]), ("u", [top, "p"]), ("v", [top, "p"]), ("w", [top, "section"]), ("z", [top]),
        ("1", ["tr", "td"]), ("2", ["tr", "td"]), ("3", ["tr", "td"]),
    ]


def test_labeller_on_fresh_pages():
    blocks, pages = html_training.accuracy(html_blocks.Labeller.load(), 300, seed=991)
    assert blocks > 0.999 and pages > 0.98


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    m = html_blocks.Labeller({k: v.astype(np.float64) for k, v in html_training.weights(rng).items()})
    make = html_training.Maker(4)
    batch = []
    while len(batch) < 3:
        read, y = html_training.labelled(make.page())
        if read:
            batch.append((m.numbers(read), y))
    _, grad = html_training.step(m, batch)
    blocks = sum(len(y) for _, y in batch)
    for name in ("x_f", "h_b", "b_f", "out", "path"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        keep = m.w[name][at]
        values = []
        for d in (1e-2, -1e-2):
            m.w[name][at] = keep + d
            values.append(html_training.step(m, batch)[0] * blocks / len(batch))
        m.w[name][at] = keep
        assert (values[0] - values[1]) / 2e-2 == pytest.approx(grad[name][at], rel=0.08, abs=2e-3)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {n: k for k, n in enumerate(nodes)}
    kept = [(place[a], place[b]) for a, b in edges if a != b]
    roots = local_roots(len(nodes), np.array([a for a, _ in kept]), np.array([b for _, b in kept]))
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: nodes[roots[k]] for k, n in enumerate(nodes)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).agg({"length": "sum"}).first()[0] > n
