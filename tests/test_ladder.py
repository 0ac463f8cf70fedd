"""The whole ladder against a plain one that takes each pair by itself, and cases with orders and budgets."""

import random
import re
from datetime import date
from itertools import combinations

import pytest

from tessera.operators import ladder, matcher

STREAM = "pair_id long, side string, pos int, locator string, kind string, boundary string, air_date string, runtime double, title string"
SEGMENTS = "pair_id long, side string, segment_no int, pos int, number int, locator string, air_date string, title string"
ORDERS = "pair_id long, order_no long, segment_no int, pos int, locator string, air_date string, title string"
BUDGETS = "pair_id long, most double, t1_cost double, list_cost double, detail_cost double"


def day(text):
    try:
        return date.fromisoformat(text).toordinal()
    except (TypeError, ValueError):
        return None


def normal(text):
    return " ".join(re.sub(r"[\W_]+", " ", (text or "").lower()).split())


def similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    p, q = set(a.split()), set(b.split())
    return 0.5 * (1 - row[-1] / max(len(a), len(b))) + 0.5 * len(p & q) / len(p | q)


def span(locators, places, regular):
    at = [places[x] for x in locators if x in regular and x in places]
    return (min(at), max(at)) if at else None


def crossed(links, places, regular):
    """Pairs of links that overlap on a side, or run in different orders."""
    n = 0
    for x, y in combinations([tuple(span(k[s], places[s], regular[s]) for s in (0, 1)) for k in links], 2):
        sides = [None if a is None or b is None else "overlap" if a[0] <= b[1] and b[0] <= a[1] else a < b for a, b in zip(x, y, strict=True)]
        n += sides.count("overlap") + (None not in sides and "overlap" not in sides and sides[0] != sides[1])
    return n


def evidence(a, b):
    if day(a[1]) is not None and day(b[1]) is not None:
        return 1 if abs(day(a[1]) - day(b[1])) <= 1 else -1
    x, y = normal(a[2]), normal(b[2])
    return 0 if not x or not y else 1 if x == y else -1


def transforms(left, right):
    """left, right: sorted [(segment number, [(locator, date, title)])]."""
    tries = []
    if left and right and len(left) == len(right) and left[0][0] != right[0][0]:
        off = right[0][0] - left[0][0]
        if all(b[0] == a[0] + off and len(a[1]) == len(b[1]) for a, b in zip(left, right, strict=True)):
            tries.append([p for a, b in zip(left, right, strict=True) for p in zip(a[1], b[1], strict=True)])
    x, y = [i for s in left for i in s[1]], [i for s in right for i in s[1]]
    if x and len(x) == len(y):
        tries.append(list(zip(x, y, strict=True)))
    for pairs in tries:
        found = [evidence(a, b) for a, b in pairs]
        if min(found) >= 0 and 1 in found:
            return [((a[0],), (b[0],)) for a, b in pairs]
    return None


def units(stream, consumed):
    out, run = [], []

    def make(members):
        timed = all(m[1][5] for m in members)
        out.append((tuple(m[1][1] for m in members), members[0][1][4], any(m[1][2] == "special" for m in members), sum(m[0] for m in members) / len(members) / max(1, len(stream) - 1),
                    sum(m[1][5] for m in members) if timed else None, normal(" ".join(m[1][6] or "" for m in members))))

    def flush():
        if len(run) > 1:
            make(run)
        run.clear()

    for k, x in enumerate(stream):
        if x[1] in consumed:
            flush()
            continue
        # a run's own unit comes after its last member's
        if run and run[-1][1][4] != x[4]:
            flush()
        make([(k, x)])
        if x[4] is None:
            flush()
            continue
        run.append((k, x))
    flush()
    return out


def third(streams, placed, places, regular):
    used = [{x for k in placed for x in k[s]} for s in (0, 1)]
    scored = []
    sides = [units(s, u) for s, u in zip(streams, used, strict=True)]
    for i, a in enumerate(sides[0]):
        for j, b in enumerate(sides[1]):
            signs = []
            if day(a[1]) is not None and day(b[1]) is not None:
                gap = abs(day(a[1]) - day(b[1]))
                if gap > 1:
                    continue
                signs.append(0.9 - gap * 0.12)
            if a[5] and b[5]:
                signs.append(similar(a[5], b[5]))
            if not signs:
                continue
            score = sum(signs) / len(signs)
            if a[4] and b[4] and (r := min(a[4], b[4]) / max(a[4], b[4])) > 0.8:
                score += (r - 0.8) / (1 - 0.8) * 0.15
            if not a[2] and not b[2]:
                score += max(0, 1 - abs(a[3] - b[3])) * 0.05
            scored.append((-score, i, j, a[0], b[0]))
    taken, chosen = [set(), set()], []
    for score, _, _, a, b in sorted(scored):
        if -score < 0.5:
            break
        if taken[0] & set(a) or taken[1] & set(b) or crossed([*placed, *chosen, (a, b)], places, regular):
            continue
        taken[0] |= set(a)
        taken[1] |= set(b)
        chosen.append((a, b, "high" if -score >= 0.8 else "low"))
    return chosen


def plain(streams, segments, budget, orders):
    """streams: two lists of (pos, locator, kind, boundary, date, runtime, title); segments: two lists as for transforms with numbers."""
    most, t1, listing, detail = budget
    regular = [{x[1] for x in s if x[2] == "regular"} for s in streams]
    places = [{x[1]: k for k, x in enumerate(s)} for s in streams]
    over, spent = t1 > most, [0 if t1 > most else t1, 0]
    links = []
    kept = [[(n, [i for i in items if i[0] in regular[s]]) for n, items in side] for s, side in enumerate(segments)]
    kept = [[(n, items) for n, items in side if items] for side in kept]
    shape = [[(n, [i[3] for i in items]) for n, items in side] for side in kept]
    if not over and shape[0] == shape[1] and shape[0]:
        agree = all(day(a[k][1]) is None or day(b[k][1]) is None or abs(day(a[k][1]) - day(b[k][1])) <= 1 for (_, a), (_, b) in zip(*kept, strict=True) for k in (0, -1))
        if agree:
            links = [("t1-structure", (a[0],), (b[0],), "high") for (_, x), (_, y) in zip(*kept, strict=True) for a, b in zip(x, y, strict=True)]
    if not links:
        free = transforms(*kept)
        total = sum(len(x[1]) for x in kept[1])
        if free is None and orders and listing <= most - spent[0]:
            spent[1] += listing
            looked = 0
            for order in [o for o in orders if sum(len(s[1]) for s in o) == total and total]:
                if looked == 3 or detail > most - sum(spent):
                    break
                looked += 1
                spent[1] += detail
                pairs = transforms(order, kept[1])
                anew = list(dict.fromkeys(i[0] for s in order for i in s[1] if i[0] in places[0]))
                anew = {x: k for k, x in enumerate(anew + [x for x in places[0] if x not in anew])}
                if pairs is not None and not crossed(pairs, [anew, places[1]], regular):
                    free, places = pairs, [anew, places[1]]
                    break
        links = [("t2-pattern", a, b, "high") for a, b in free or []]
    links += [("t3-episode", *x) for x in third(streams, [x[1:3] for x in links], places, regular)]
    pairs = [x[1:3] for x in links]
    strays = sum(x not in places[s] for k in pairs for s in (0, 1) for x in k[s])
    claims = [[x for k in pairs for x in set(k[s])] for s in (0, 1)]
    reused = sum(c.count(x) > 1 for c in claims for x in set(c))
    crossings = crossed(pairs, places, regular)
    status = "unmatched" if over else "unpublishable" if any(x[3] == "truncated" for s in streams for x in s) else "invalid" if strays + reused else "conflict" if crossings else "published"
    return links, spent, (strays, reused, crossings, status)


def make(seed, n):
    rng = random.Random(seed)
    rows, segs, orders, budgets, wanted = [], [], [], [], {}
    for pair in range(n):
        size, alike = rng.randint(1, 7), rng.random()
        streams, segments = [], []
        base = [(f"2024-01-{1 + (k if rng.random() < 0.7 else k // 2):02d}", f"Part {rng.randint(0, 9)}") for k in range(9)]
        for s, side in enumerate(("left", "right")):
            boundary = rng.choice(["complete"] * 6 + ["airing", "truncated"])
            count = size if alike < 0.7 else rng.randint(1, 7)
            stream, side_segments, first, per = [], [], rng.choice([1, 1, 4]), rng.choice([2, 3, 9])
            order = list(range(count))
            if s == 0 and rng.random() < 0.4:
                rng.shuffle(order)
            for pos, k in enumerate(order):
                when, title = base[k]
                if rng.random() < 0.1:
                    when = rng.choice([None, "soon"])
                if rng.random() < 0.1:
                    title = rng.choice([None, "", f"Part {k}!"])
                kind = "special" if rng.random() < 0.1 else "regular"
                locator = f"{side[0]}{k}"
                runtime = rng.choice([None, 20.0, 24.0, 48.0])
                stream.append((pos, locator, kind, boundary, when, runtime, title))
                number = pos % per + 1
                if pos % per == 0:
                    side_segments.append((first + pos // per, []))
                side_segments[-1][1].append((locator, when, title, number))
                rows.append((pair, side, *stream[-1]))
                segs.append((pair, side, side_segments[-1][0], pos, number, locator, when, title))
            streams.append(stream)
            segments.append(side_segments)
        listed = []
        for no in range(rng.choice([0, 1, 5])):
            items = sorted(({i[0]: i for seg in segments[0] for i in seg[1]}).values(), key=lambda i: i[0])
            if rng.random() < 0.5:
                rng.shuffle(items)
            if rng.random() < 0.2 and len(items) > 1:
                items[1] = items[0]
            if rng.random() < 0.1:
                items[0] = ("zz", *items[0][1:])
            items = [i for i in items if rng.random() < 0.97 or no % 2]
            cut = rng.choice([2, 9])
            order = [(1 + a // cut, items[a : a + cut]) for a in range(0, len(items), cut)]
            listed.append(order)
            orders += [(pair, no, seg, k, i[0], i[1], i[2]) for seg, part in order for k, i in enumerate(part)]
        listed = [o for o in listed if o]
        budget = (float(rng.choice([0, 1, 2, 3, 4, 9])), float(rng.choice([0, 1, 2])), 1.0, float(rng.choice([0, 1, 1])))
        if rng.random() < 0.8:
            budgets.append((pair, *budget))
        else:
            budget = (float("inf"), 0.0, 0.0, 0.0)
        wanted[pair] = plain(streams, segments, budget, listed)
    return rows, segs, budgets, orders, wanted


def test_ladder_equals_a_plain_one(spark):
    rows, segs, budgets, orders, wanted = make(1, 400)
    got = ladder.climb(spark.createDataFrame(rows, STREAM), spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(budgets, BUDGETS), spark.createDataFrame(orders, ORDERS))
    links, trace, outcome = {}, {}, {r.pair_id: tuple(r)[1:] for r in got.outcome.select("pair_id", "n_strays", "n_reused", "n_crossings", "status").collect()}
    for r in got.links.collect():
        links.setdefault(r.pair_id, []).append((r.tier, tuple(r.left), tuple(r.right), r.confidence))
    for r in got.trace.collect():
        trace.setdefault(r.pair_id, {})[r.tier] = r
    for pair, (own, spent, result) in wanted.items():
        assert sorted(links.get(pair, [])) == sorted(own), pair
        assert [trace[pair][t].spent for t in ladder.TIERS] == [*spent, 0], pair
        assert outcome[pair] == result, pair
        assert {t: trace[pair][t].n_links for t in ladder.TIERS} == {t: sum(x[0] == t for x in own) for t in ladder.TIERS}
    assert {r[3] for _, _, r in wanted.values()} >= {"published", "unmatched", "unpublishable"}
    assert sum(s[1] > 0 for _, s, _ in wanted.values()) > 5 and sum(any(x[0] == "t2-pattern" for x in o) for o, _, _ in wanted.values()) > 5


def numbered(items):
    return [(k, x, "regular", "complete", d, None, None) for k, (x, d) in enumerate(items)]


DAYS = ["2024-03-01", "2024-03-08", "2024-03-15", "2024-03-22"]
RIGHT = numbered([(f"r#{k + 1}", d) for k, d in enumerate(DAYS)])
ALIGNED = [(f"l#{k + 1}", d) for k, d in enumerate(DAYS)]
SCRAMBLED = numbered([ALIGNED[k] for k in (2, 0, 3, 1)])
WRONG = [(x[1], x[4]) for x in SCRAMBLED]
TWICE = [ALIGNED[0], ("l#1", DAYS[1]), *ALIGNED[2:]]
STRAY = [*ALIGNED[:3], ("l#9", DAYS[3])]
#: left stream, other orders, what the budget holds (a listing and an order cost one each), links of the second tier, spent by it, status
ORDERED = {
    1: (SCRAMBLED, [ALIGNED], 10, 4, 2, "published"),
    2: (SCRAMBLED, [ALIGNED[:2], WRONG, WRONG, WRONG, ALIGNED, WRONG], 10, 0, 4, "published"),
    3: (SCRAMBLED, [WRONG, ALIGNED], 0, 0, 0, "published"),
    4: (SCRAMBLED, [WRONG, ALIGNED], 1, 0, 1, "published"),
    5: (SCRAMBLED, [WRONG, ALIGNED], 2, 0, 2, "published"),
    6: (SCRAMBLED, [WRONG, ALIGNED], 3, 4, 3, "published"),
    7: (numbered(ALIGNED), [ALIGNED], 10, 4, 0, "published"),
    8: (SCRAMBLED, [TWICE], 10, 0, 2, "published"),
    9: (SCRAMBLED, [STRAY], 10, 4, 2, "invalid"),
    10: (SCRAMBLED, [], 10, 0, 0, "published"),
}


def test_other_orders(spark):
    """An accepted order is handed on; three are looked into, never one that can't cover; the budget ends them; a free transform spends nothing."""
    rows = [(p, side, *x) for p, case in ORDERED.items() for side, s in (("left", case[0]), ("right", RIGHT)) for x in s]
    segs = [(p, side, 1, x[0], x[0] + (5 if side == "left" else 1), x[1], x[4], x[6]) for p, side, *x in rows]
    listing = [(p, no, 1, k, x, d, None) for p, case in ORDERED.items() for no, o in enumerate(case[1]) for k, (x, d) in enumerate(o)]
    budgets = [(p, float(case[2]), 0.0, 1.0, 1.0) for p, case in ORDERED.items()]
    got = ladder.climb(spark.createDataFrame(rows, STREAM), spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(budgets, BUDGETS), spark.createDataFrame(listing, ORDERS))
    links, status = got.links.where("tier = 't2-pattern'").collect(), {r.pair_id: r.status for r in got.outcome.collect()}
    spent = {r.pair_id: r.spent for r in got.trace.where("tier = 't2-pattern'").collect()}
    assert {p: (sum(r.pair_id == p for r in links), spent[p], status[p]) for p in ORDERED} == {p: case[3:] for p, case in ORDERED.items()}
    assert sorted((r.left[0], r.right[0]) for r in links if r.pair_id == 1) == [(f"l#{k}", f"r#{k}") for k in range(1, 5)]
    assert {r.locator: r.place for r in got.places.where("side = 'left' AND pair_id = 1").collect()} == {f"l#{k}": k for k in range(1, 5)}


def test_over_budget_is_unmatched_and_highest_tried_says_which_rung_proposed(spark):
    rows = [(p, side, *x) for p in (1, 2) for side in ("left", "right") for x in numbered(ALIGNED)]
    segs = [(p, side, 1, x[0], x[0] + 1, x[1], x[4], None) for p in (1, 2) for side in ("left", "right") for x in numbered(ALIGNED)]
    got = ladder.climb(spark.createDataFrame(rows, STREAM), spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame([(1, 1.0, 2.0, 0.0, 0.0), (2, 2.0, 2.0, 0.0, 0.0)], BUDGETS))
    assert {r.pair_id: r.status for r in got.outcome.collect()} == {1: "unmatched", 2: "published"}
    assert {(r.pair_id, r.tier): r.kind for r in got.trace.collect()}[(1, "t1-structure")] == "over-budget"
    trace = spark.createDataFrame([(1, "t1-structure", "over-budget"), (1, "t2-pattern", "proposed"), (2, "t1-structure", "proposed"), (3, "t1-structure", "over-budget")], "pair_id long, tier string, kind string")
    assert {r.pair_id: r.highest_tier for r in ladder.highest_tried(trace).collect()} == {1: "t2-pattern", 2: "t1-structure", 3: "t3-episode"}
    links = spark.createDataFrame([(1, ["l#1"], ["l#1"]), (2, ["l#4"], ["l#4"])], "pair_id long, left array<string>, right array<string>")
    airing = spark.createDataFrame([(p, side, *x[:3], "airing", *x[4:]) for p, side, *x in rows], STREAM)
    states = spark.createDataFrame([(1, "published"), (2, "published"), (3, "conflict")], "pair_id long, status string")
    assert {r.pair_id: r.complete for r in ladder.complete(airing, links, states).collect()} == {1: False, 2: True}


def test_ladder_over_nothing(spark):
    got = ladder.climb(*(spark.createDataFrame([], s) for s in (STREAM, SEGMENTS, BUDGETS, ORDERS)))
    assert [x.count() for x in got] == [0, 0, 0, 0]


def test_long_streams_take_linear_time(spark):
    """Ten thousand candidates of one pair, all good."""
    import time

    n = 10_000
    found = spark.range(n).selectExpr(
        "1L AS pair_id", "array(concat('l', id)) AS left", "array(concat('r', id)) AS right", "0.9D AS score", "cast(id AS int) AS left_seq", "cast(id AS int) AS right_seq",
        "cast(id AS int) AS l_low", "cast(id AS int) AS l_high", "cast(id AS int) AS r_low", "cast(id AS int) AS r_high",
    )
    start = time.perf_counter()
    assert matcher.greedy_links(found).where("outcome = 'high'").count() == n
    assert time.perf_counter() - start < 30


@pytest.mark.parametrize("seed", [5, 6])
def test_broken_pairs_are_those_with_crossings(spark, seed):
    rng = random.Random(seed)
    rows = []
    for pair in range(60):
        for k in range(rng.randint(1, 5)):
            spans = []
            for _ in range(2):
                low = rng.randint(0, 12)
                spans += [None, None] if rng.random() < 0.2 else [low, low + rng.choice([0, 0, 0, 1])]
            rows.append((pair, k, *spans))
    frame = spark.createDataFrame(rows, "pair_id long, link_id int, l_low int, l_high int, r_low int, r_high int")
    wanted = set()
    for p in range(60):
        own = [r[2:] for r in rows if r[0] == p]
        for x, y in combinations(own, 2):
            sides = [None if x[i] is None or y[i] is None else "overlap" if x[i] <= y[i + 1] and y[i] <= x[i + 1] else x[i] < y[i] for i in (0, 2)]
            if "overlap" in sides or None not in sides and sides[0] != sides[1]:
                wanted.add(p)
    assert {r.pair_id for r in matcher.broken(frame).collect()} == wanted and 5 < len(wanted) < 55
