"""Decisions on conflicts against taking them one after another."""

import random

from tessera.operators import moderation

CANDIDATES = "candidate_id long, status string, kind string"
PROPOSALS = "candidate_id long, number int, left_id long, right_id long, confidence string, counterpart_id long"
DECISIONS = "decision_id long, candidate_id long, at int, accept boolean, number int"
ASSERTIONS = "relation string, left_id long, right_id long"


def plain(candidates, proposals, decisions, assertions):
    status, kind = {c: s for c, s, _ in candidates}, {c: k for c, _, k in candidates}
    named = {(c, n): x for c, n, *x in proposals}
    held, outcomes, written, beside = set(assertions), {}, {}, {}
    for d, c, _, accept, number in sorted(decisions, key=lambda x: (x[2], x[0])):
        if c not in status:
            outcomes[d] = "missing"
        elif status[c] != "open":
            outcomes[d] = "not-open"
        elif kind[c] not in moderation.RELATIONS:
            outcomes[d] = "wrong-kind"
        elif not accept:
            outcomes[d], status[c] = "rejected", "rejected"
        else:
            own = named.get((c, (number or 0) if kind[c] == "continuity-conflict" else 0))
            if own is None:
                outcomes[d] = "wrong-kind"
                continue
            a, b, confidence, counterpart = own
            if kind[c] == "title-assertion-conflict":
                a, b = min(a, b), max(a, b)
            key = (moderation.RELATIONS[kind[c]], a, b)
            if key in held:
                outcomes[d] = "collision"
                continue
            held.add(key)
            outcomes[d], status[c] = "settled", "accepted"
            written[key] = "high" if kind[c] == "continuity-conflict" else confidence
            if kind[c] == "instalment-assertion-conflict" and counterpart is not None:
                beside.setdefault((key[0], counterpart, b), confidence)
    return outcomes, status, written | {k: v for k, v in beside.items() if k not in held}


def test_settling_equals_one_after_another(spark):
    rng = random.Random(11)
    kinds = [*moderation.RELATIONS, "fuzzy-group"]
    candidates = [(c, rng.choice(["open"] * 5 + ["accepted"]), rng.choice(kinds)) for c in range(150)]
    proposals = [(c, n, rng.randint(0, 6), 10 + rng.randint(0, 6) if kind != "title-assertion-conflict" else rng.randint(0, 6), rng.choice(["low", "high"]), rng.choice([None, 99]) if kind == "instalment-assertion-conflict" else None)
                 for c, _, kind in candidates for n in range(rng.randint(0, 3) if kind == "continuity-conflict" else 1)]
    decisions = [(d, rng.randint(0, 155), rng.randint(0, 40), rng.random() < 0.8, rng.choice([None, 0, 1, 2])) for d in range(500)]
    assertions = [("relation", a, 10 + a) for a in range(4)] + [("title", 1, 2), ("title", 1, 2), ("instalment", 3, 13)]
    frame = spark.createDataFrame
    got = moderation.settle_conflicts(frame(candidates, CANDIDATES), frame(proposals, PROPOSALS), frame(decisions, DECISIONS), frame(assertions, ASSERTIONS))
    outcomes, status, written = plain(candidates, proposals, decisions, assertions)
    assert {r.decision_id: r.outcome for r in got.outcomes.collect()} == outcomes
    assert set(outcomes.values()) == {"missing", "not-open", "wrong-kind", "collision", "rejected", "settled"}
    assert {r.candidate_id: r.status for r in got.candidates.collect()} == status
    rows = got.written.collect()
    found = {(r.relation, r.left_id, r.right_id): r.confidence for r in rows}
    assert found.keys() == written.keys() and len(rows) == len(found) and all(r.source == "manual" for r in rows)
    assert {k: v for k, v in found.items() if k[1] != 99} == {k: v for k, v in written.items() if k[1] != 99}


def test_nothing_to_settle(spark):
    frame = spark.createDataFrame
    got = moderation.settle_conflicts(frame([(1, "open", "title-assertion-conflict")], CANDIDATES), frame([], PROPOSALS), frame([], DECISIONS), frame([], ASSERTIONS))
    assert [tuple(r) for r in got.candidates.collect()] == [(1, "open", "title-assertion-conflict")] and got.outcomes.count() == 0 and got.written.count() == 0


def test_walks_over_pages(spark):
    from tessera.sources import readers

    u = lambda n, host="a.example": f"https://{host}/l?o={n}"
    pages = [(1, u(0), u(1)), (1, u(1), u(2)), (1, u(2), u(0))]  # a loop
    pages += [(2, u(0), u(1, "b.example")), (2, u(1, "b.example"), None)]  # another origin
    pages += [(3, u(0), u(9))]  # not staged
    pages += [(4, u(k), u(k + 1)) for k in range(250)]
    pages += [(5, u(0), "HTTPS://A.example/l?o=1"), (5, "HTTPS://A.example/l?o=1", "nonsense"), (6, u(3), u(3))]
    starts = [(k, u(0)) for k in (1, 1, 2, 3, 4, 5, 7)] + [(6, u(3))]
    walked = readers.page_walk(spark.createDataFrame(pages, "list_id long, url string, next string"), spark.createDataFrame(starts, "list_id long, url string")).cache()
    found: dict = {}
    for r in sorted(walked.collect(), key=lambda r: r.place):
        assert r.place == len(found.setdefault(r.list_id, []))
        found[r.list_id].append(r.url)
    assert {k: len(v) for k, v in found.items()} == {1: 3, 2: 1, 3: 1, 4: 200, 5: 2, 6: 1} and found[1] == [u(0), u(1), u(2)]
    rows = [(1, u(2), 0, 7, "late"), (1, u(0), 1, 7, "first"), (1, u(0), 0, 8, "x"), (1, u(0), 0, None, "n"), (9, u(0), 0, 7, "lost")]
    got = readers.list_entries(walked, spark.createDataFrame(rows, "list_id long, url string, row int, title_id long, status string"))
    assert sorted((r.title_id or 0, r.status) for r in got.collect()) == [(0, "n"), (7, "first"), (8, "x")]
