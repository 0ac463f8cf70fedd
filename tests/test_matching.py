"""The greedy choice of the third tier (query M6_greedy_links_M1_tier3, which SQL can't express) against plain loops."""

import random

import pytest

from tessera.operators import matcher

SCHEMA = "pair_id long, side string, pos int, locator string, kind string, boundary string, air_date string, runtime double, title string"


def streams(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for pair in range(12):
        for side in ("left", "right"):
            for pos in range(r.randint(2, 7)):
                day = f"2024-01-{1 + pos // 2 if r.random() < 0.4 else 1 + pos:02d}" if r.random() < 0.8 else None
                kind = "special" if r.random() < 0.2 else "regular"
                title = f"Part {r.randint(0, 6)}" if r.random() < 0.7 else None
                rows.append((pair, side, pos, f"s1e{pos + 1}", kind, "complete", day, r.choice([None, 20.0, 24.0, 48.0]), title))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_links(spark, seed):
    rows = streams(seed)
    stream = spark.createDataFrame(rows, SCHEMA)
    found = matcher.candidates(matcher.units(stream))
    place = {(p, s, loc): pos for p, s, pos, loc, kind, *_ in rows if kind == "regular"}
    wanted = set()
    for pair in range(12):
        chosen: list[tuple[list, list]] = []
        own = sorted((c for c in found.collect() if c.pair_id == pair and c.score >= matcher.MID), key=lambda c: (-c.score, c.left_seq, c.right_seq))
        for c in own:
            if any(set(c.left) & set(x) or set(c.right) & set(y) for x, y in chosen):
                continue
            ends = [[place[(pair, s, loc)] for loc in locs if (pair, s, loc) in place] for s, locs in (("left", c.left), ("right", c.right))]
            crossed = False
            for other in chosen:
                orders = []
                for s, mine, theirs in zip(("left", "right"), ends, other, strict=True):
                    them = [place[(pair, s, loc)] for loc in theirs if (pair, s, loc) in place]
                    if mine and them:
                        orders.append(-1 if max(mine) < min(them) else 1 if max(them) < min(mine) else 0)
                crossed = crossed or 0 in orders or sum(orders) == 0 and len(orders) == 2
            if not crossed:
                chosen.append((c.left, c.right))
            wanted.add((pair, tuple(c.left), tuple(c.right), "crossing" if crossed else "high" if c.score >= matcher.HIGH else "low"))
    got = {(r.pair_id, tuple(r.left), tuple(r.right), r.outcome) for r in matcher.greedy_links(found).collect()}
    assert got == wanted and {x[3] for x in wanted} >= {"high", "crossing"}


def test_walk_gives_whole_chains_and_ends_in_cycles(spark):
    from tessera.operators import discovery

    edges = [(k, k + 1) for k in range(100)] + [(1000 + k, 1000 + (k + 1) % 40) for k in range(40)] + [(2000, 1005), (3000, 3000)]
    nexts = spark.createDataFrame(edges, "from_id long, to_id long")
    heads = spark.createDataFrame([(0,), (2000,), (1007,), (3000,), (9,)], "node long")
    got = sorted(map(tuple, discovery.walk(nexts, heads).select("chain_id", "node", "pos").collect()))
    after, wanted = dict(edges), []
    for head in (0, 2000, 1007, 3000, 9):
        node, seen = head, []
        while node is not None and node not in seen:
            seen.append(node)
            node = after.get(node)
        wanted += [(head, x, k) for k, x in enumerate(seen)]
    assert got == sorted(wanted) and len(wanted) == 101 + 41 + 40 + 1 + 92


def rows(pair: int, side: str, segments: list[list], first: int = 1, kind: str = "regular") -> list[tuple]:
    """Instalments of segments given as lists of (air date, title)."""
    out, pos = [], 0
    for k, segment in enumerate(segments):
        for n, (day, title) in enumerate(segment):
            out.append((pair, side, first + k, pos, n + 1, f"s{first + k}e{n + 1}", kind, "complete", day, None, title))
            pos += 1
    return out


LADDER = "pair_id long, side string, segment_no int, pos int, number int, locator string, kind string, boundary string, air_date string, runtime double, title string"


def days(n: int, start: int = 1) -> list[tuple]:
    return [(f"2024-01-{start + 2 * k:02d}", f"Part {start + k}") for k in range(n)]


def test_t2_pattern(spark):
    four = days(4)
    pairs = {
        0: (rows(0, "left", [four]), rows(0, "right", [four[:3]]), 0),  # unequal totals: a partial fit is none
        1: (rows(1, "left", [four[:2], four[2:]]), rows(1, "right", [four[:2], four[2:]], first=4), 4),  # segments 4 and 5 against 1 and 2
        2: (rows(2, "left", [four]), rows(2, "right", [four[:2], four[2:]]), 4),  # continuous against segmented
        3: (rows(3, "left", [[(None, None)] * 3]), rows(3, "right", [[(None, "")] * 3]), 0),  # no evidence
        4: (rows(4, "left", [four]), rows(4, "right", [[*four[:3], ("2024-05-01", "Part 4")]]), 0),  # one disagrees
        5: (rows(5, "left", [[("soon", "A"), *four[1:]]]), rows(5, "right", [[("2024-01-01", "a!"), *four[1:]]]), 4),  # a date that can't be read
        6: (rows(6, "left", [four]), [], 0),
    }
    frame = spark.createDataFrame([r for left, right, _ in pairs.values() for r in left + right], LADDER)
    got = matcher.t2_pattern(frame).collect()
    assert {k: sum(r.pair_id == k for r in got) for k in pairs} == {k: n for k, (_, _, n) in pairs.items()}
    assert {(r.left, r.right) for r in got if r.pair_id == 1} == {("s1e1", "s4e1"), ("s1e2", "s4e2"), ("s2e1", "s5e1"), ("s2e2", "s5e2")}
    assert ("s1e3", "s2e1") in {(r.left, r.right) for r in got if r.pair_id == 2}
    assert matcher.t2_pattern(spark.createDataFrame([], LADDER)).count() == 0


def test_greedy_links_cross_nothing_that_is_placed(spark):
    found = spark.createDataFrame(
        [(1, ["s1e1"], ["s1e3"], 0.9, 1, 1, 0, 0, 2, 2), (1, ["s1e4"], ["s1e4"], 0.7, 2, 2, 3, 3, 3, 3)],
        "pair_id long, left array<string>, right array<string>, score double, left_seq int, right_seq int, l_low int, l_high int, r_low int, r_high int",
    )
    placed = spark.createDataFrame([(1, 1, 1, 1, 1), (2, 0, 0, 0, 0)], "pair_id long, l_low int, l_high int, r_low int, r_high int")
    assert [(r.left, r.outcome) for r in matcher.greedy_links(found, placed).collect()] == [(["s1e1"], "crossing"), (["s1e4"], "low")]


def test_first_decision_settles(spark):
    from tessera.operators import curation

    log = [(1, "2024-01-02", 2, "accepted"), (1, "2024-01-01", 1, "rejected"), (2, "2024-01-01", 4, "accepted"), (2, "2024-01-01", 3, "rejected"), (3, None, 5, None)]
    got = curation.settle(spark.createDataFrame(log, "candidate_id long, at string, decision_id long, verdict string"))
    assert {r.candidate_id: r.status for r in got.collect()} == {1: "rejected", 2: "rejected", 3: "open"}


def test_stale_reactivation(spark):
    """An ended subscription is not started again by a late event of its own; another one starts."""
    import pandas as pd

    from tessera.streaming import events

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    run = lambda *rows: list(events._fold((1,), iter([pd.DataFrame(rows, columns=["seq", "sub", "event_type"])]), state))[0].iloc[0]
    assert tuple(run((1, 7, "purchase"), (2, 7, "error")))[1:3] == ("inactive", 7)
    assert tuple(run((4, 8, "signup"), (3, 7, "purchase")))[1:] == ("active", 8, 1)
    assert tuple(run((5, 7, "purchase")))[1:] == ("active", 7, 1)
    assert tuple(run((6, 7, "error"), (7, 7, "signup"), (8, 7, "signup")))[1:] == ("inactive", 7, 3)


def test_official_hosts(spark):
    from pyspark.sql import functions as F

    from tessera.functions import identity

    urls = [("https://API.myanimelist.net/v2", "MAL", True), ("https://evil-myanimelist.net/", "mal", False), ("https://myanimelist.net.evil.example/", "mal", False), ("http://imdb.com:80/x", "imdb", True),
            ("https://imdb.com/x", "mal", False), ("nothing", "mal", False), ("https://kitsu.io", None, True), (None, "mal", False), ("https://user@kitsu.io/", None, True)]
    frame = spark.createDataFrame(urls, "url string, operator string, wanted boolean")
    assert all(r.got == r.wanted for r in frame.select("wanted", identity.official_host(F.col("url"), F.col("operator")).alias("got")).collect())


def test_anidb_is_an_anime_catalogue(spark):
    from tessera.operators import graph, publication

    titles = [(1, 1, "anidb", "5", 2), (2, 1, "anilist", "6", 1), (3, 1, "tmdb", "movie:7", 1), (4, 2, "imdb", "tv:8", 1), (5, 3, "tmdb", "tv:9", 1), (6, 4, "anidb", "9", 3), (7, 4, "anidb", "8", 1)]
    frame = spark.createDataFrame(titles, "title_id long, group_id long, service string, native string, ordinal int")
    assert {r.group_id: r.media_kind for r in graph.media_kind(frame).collect()} == {1: "anime", 2: "film", 3: "tv", 4: "anime"}
    assert sorted(map(tuple, graph.spine(frame).select("group_id", "title_id", "place").collect())) == [(1, 1, 1), (3, 5, 1), (4, 6, 2), (4, 7, 1)]
    assert {r.title_id for r in publication.segment_kinds(frame).where("kind = 'atomic'").collect()} == {1, 2, 3}


def walked(spark, types, edges, starts):
    from tessera.operators import discovery

    frame = spark.createDataFrame
    got = discovery.continuity(frame(types, "entry_id string, type string"), frame(edges, "from_id string, kind string, to_id string"), frame([(x,) for x in starts], "entry_id string"))
    chains: dict = {}
    for r in sorted(got.chains.collect(), key=lambda r: r.pos):
        assert r.pos == len(chains.setdefault(r.chain_id, []))
        chains[r.chain_id].append(r.node)
    return chains, {r.chain_id: (r.reason, r.entry_id, [tuple(x) for x in r.competing]) for r in got.refusals.collect()}


def test_continuity_refuses_to_guess(spark):
    s, p = "sequel", "prequel"
    types = [(x, "anime") for x in "a b c d e f g h i j k l m n o q r u v w x y z".split()] + [("film", "movie"), ("show", "show"), ("side", "movie"), ("start", "movie"), ("z2", "anime"), ("e2", "anime"), ("bb", "anime")]
    edges = [("a", s, "b"), ("b", p, "a"), ("b", s, "c"), ("c", p, "b")]  # a plain chain
    edges += [("d", p, "a9"), ("d", s, "film"), ("film", p, "d"), ("film", "side_story", "side")]  # a film in it, and a missing prequel
    edges += [("e", s, "f"), ("e", s, "e2"), ("f", p, "e")]  # a branch, met from behind
    edges += [("g", s, "h"), ("h", s, "g")]  # a cycle of sequels
    edges += [("i", s, "show"), ("j", s, "i"), ("i", p, "j")]
    edges += [("k", p, "l"), ("l", p, "m"), ("m", p, "l")]  # back into a cycle that the start is not on
    edges += [("n", p, "o"), ("n", s, "o")]  # forward into what was walked back
    edges += [("q", p, "r"), ("r", p, "q"), ("q", s, "show")]  # both ways refuse: back counts
    edges += [("u", s, "u")]
    edges += [("v", p, "w"), ("v", p, "x"), ("v", s, "w"), ("v", s, "x")]  # both kinds branch: prequels are named
    edges += [("y", p, "show"), ("z", s, "z2"), ("z", s, "z2")]  # repeated rows are two edges
    chains, refused = walked(spark, types, edges, [*"abcdegijknquvyz", "film", "start", "bb", "a"])
    assert chains == {"a": ["a", "b", "c"], "b": ["a", "b", "c"], "c": ["a", "b", "c"], "d": ["d", "film"], "bb": ["bb"]}
    assert refused == {
        "e": ("ambiguous-branch", "e", [("e", s, "e2"), ("e", s, "f")]),
        "g": ("cycle-closing-link", "h", [("h", s, "g")]),
        "i": ("non-anime-candidate", "show", [("i", s, "show")]),
        "j": ("non-anime-candidate", "show", [("i", s, "show")]),
        "k": ("cycle-closing-link", "m", [("m", p, "l")]),
        "n": ("cycle-closing-link", "n", [("n", s, "o")]),
        "q": ("cycle-closing-link", "r", [("r", p, "q")]),
        "u": ("cycle-closing-link", "u", [("u", s, "u")]),
        "v": ("ambiguous-branch", "v", [("v", p, "w"), ("v", p, "x")]),
        "y": ("non-anime-candidate", "show", [("y", p, "show")]),
        "z": ("ambiguous-branch", "z", [("z", s, "z2"), ("z", s, "z2")]),
        "film": ("non-anime-candidate", "film", []),
        "start": ("non-anime-candidate", "start", []),
    }
    assert walked(spark, [], [], []) == ({}, {})
