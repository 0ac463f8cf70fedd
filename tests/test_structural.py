"""Member mapping and structural discovery against plain loops."""

import random

from test_ladder import third

from tessera.operators import structural

TITLES = "ref string, service string, native string, first_air_date string, boundary string"
ROWS = "ref string, pos int, locator string, kind string, air_date string, runtime double, title string"


def make_title(rng, ref, n):
    return [(k, f"{ref}e{k}", "special" if rng.random() < 0.1 else "regular", "complete", f"2024-01-{1 + rng.randint(0, 8):02d}" if rng.random() < 0.9 else None, rng.choice([None, 20.0, 24.0]), f"Part {rng.randint(0, 8)}") for k in range(n)]


def mapped(shared, members):
    """Pairs of each member over what those before it left."""
    out, left = [], shared
    for ordinal, stream in members:
        streams = [[(k, *x[1:]) for k, x in enumerate(left)], stream]
        places = [{x[1]: k for k, x in enumerate(s)} for s in streams]
        regular = [{x[1] for x in s if x[2] == "regular"} for s in streams]
        links = third(streams, [], places, regular)
        out += [(ordinal, a, b, c) for a, b, c in links]
        left = [x for x in left if x[1] not in {y for a, _, _ in links for y in a}]
    return out


def test_discovery_equals_plain_loops(spark):
    rng = random.Random(4)
    requests, found, named, titles, rows, wanted, pairs = [], [], [], [], [], {}, set()
    for g in range(60):
        refs = [f"g{g}t{k}" for k in range(rng.randint(1, 4))]
        shared, budget = refs[0], rng.randint(1, 5)
        requests.append((g, shared, budget))
        streams, info, back = {}, {}, []
        for k, ref in enumerate(refs):
            streams[ref] = make_title(rng, ref, rng.randint(0, 7))
            when, boundary = rng.choice(["2024-01-01", "2024-02-01", None, "soon"]), rng.choice(["complete"] * 7 + ["airing", "truncated", None])
            info[ref] = (when, boundary, f"{9 - k}", rng.choice("ab"))
            found += [(shared, ref)] * rng.randint(1, 2)
            if k and rng.random() < 0.8:
                named.append((ref, shared))
                back.append(ref)
            elif k:
                named.append((ref, "another"))
            if boundary is not None or rng.random() < 0.5:
                titles.append((ref, info[ref][3], info[ref][2], when, boundary))
            else:
                info[ref] = (None, None, "", "")
                if ref != shared:  # an unknown title has no place in an order of its own; keep it out of ties
                    info[ref] = (None, None, "", ref)
            rows += [(ref, x[0], x[1], x[2], *x[4:]) for x in streams[ref]]
        own = [shared, *back]
        time = lambda d: d if d and d != "soon" else "9999"
        known = {t[0] for t in titles}
        if not back:
            wanted[g] = ("no-group", 0, None)
        elif len(own) > budget:
            wanted[g] = ("over-budget", len(back), None)
        elif any(info[r][1] in (None, "truncated") for r in own):
            wanted[g] = ("unmappable-member", len(back), None)
        else:
            assert set(own) <= known
            order = sorted(own, key=lambda r: (time(info[r][0]), info[r][2], info[r][3]))
            wanted[g] = ("discovered", len(back), order.index(shared))
            members = [(k, streams[r]) for k, r in enumerate(order) if r != shared]
            pairs |= {(g, order[k], k, tuple(a), tuple(b), c) for k, a, b, c in mapped(streams[shared], members)}
    got = structural.discover(
        spark.createDataFrame(requests, "group_id long, ref string, budget int"), spark.createDataFrame(found, "ref string, candidate string"), spark.createDataFrame(named, "ref string, names string"),
        spark.createDataFrame(titles, TITLES), spark.createDataFrame(rows, ROWS),
    )
    assert {r.group_id: (r.outcome, r.n_members, r.anchor_ordinal) for r in got.groups.collect()} == wanted
    assert {x[0] for x in wanted.values()} == {"no-group", "over-budget", "unmappable-member", "discovered"}
    assert {(r.group_id, r.ref, r.ordinal, tuple(r.shared), tuple(r.member), r.confidence) for r in got.pairs.collect()} == pairs and len(pairs) > 20


def test_three_members_share_a_title(spark):
    """Members of equal claims: the earlier one takes what it matches, the next owns the rest, and one that finds nothing left maps nothing."""
    days = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
    row = lambda o, k, d: (1, o, k, f"{o}e{k}", "regular", d, None, None)
    rows = [row(0, k, d) for k, d in enumerate(days)] + [row(1, k, d) for k, d in enumerate(days[:2])] + [row(2, k, d) for k, d in enumerate(days[1:])] + [row(3, 0, days[0])]
    titles = [(1, o, o == 0, "complete") for o in range(4)]
    frame = lambda data: spark.createDataFrame(data, "group_id long, ordinal int, pos int, locator string, kind string, air_date string, runtime double, title string")
    named = "group_id long, ordinal int, shared boolean, boundary string"
    got = structural.map_members(spark.createDataFrame(titles, named), frame(rows))
    assert sorted((r.ordinal, r.shared[0], r.member[0]) for r in got.pairs.collect()) == [(1, "0e0", "1e0"), (1, "0e1", "1e1"), (2, "0e2", "2e1"), (2, "0e3", "2e2")]
    assert [tuple(r) for r in got.groups.collect()] == [(1, True)]
    void = structural.map_members(spark.createDataFrame([*titles[:3], (1, 3, False, "truncated")], named), frame(rows))
    assert void.pairs.count() == 0 and [tuple(r) for r in void.groups.collect()] == [(1, False)]
    none = structural.map_members(spark.createDataFrame([], named), frame([]))
    assert none.pairs.count() == 0 and none.groups.count() == 0
