"""A group of near copies is linked on pairs in proportion to its size, with the links of all pairs."""

import random

from intentlab.llm import neardup


def _group(members, stragglers):
    """Texts around one of 100 words: members lack 10 of 30 words, stragglers 21 (0.79 like the whole text)."""
    rng = random.Random(5)
    lacking = [rng.sample(range(30), 10) for _ in range(members)] + [rng.sample(range(30), 21) for _ in range(stragglers)]
    sets = [set(range(100)), *(set(range(100)) - set(x) for x in lacking)]
    return [(i, " ".join(f"w{w}" for w in sorted(s))) for i, s in enumerate(sets)], sets


def _components(sets):
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    return root


def test_near_copies_meet_in_proportion(spark, monkeypatch):
    rows, sets = _group(240, 120)
    met, confirm = [], neardup._confirm
    monkeypatch.setattr(neardup, "HUBS", 1)  # mostly the whole text, which is too far from the stragglers
    monkeypatch.setattr(neardup, "_confirm", lambda pairs, *rest: met.append(pairs.count()) or confirm(pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, words=1).collect()}
    assert [got[i] for i in range(len(sets))] == _components(sets)
    assert sum(met) <= 12 * len(rows), met
