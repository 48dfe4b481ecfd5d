"""Near copies in numbers that need hubs and blocks, against brute force over all pairs."""

import random

import pytest

from tallyline.llm import jaccard_join
from tallyline.llm.jaccard_join import jaccard_components, keep_one


def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    distinct = [s for s in sets if s]
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                root[find(a)] = find(b)
    least = {}
    for s in distinct:
        least[find(s)] = min(least.get(find(s), sets[s][0]), *sets[s])
    return sorted((i, len(s), least[find(s)] if s else i) for s, ids in sets.items() for i in ids)


def corpus(seed=4):
    """Copies of a few texts, each with some words exchanged, added or lost, and chains of
    copies of copies; texts that only share passages; exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4_000)}"
    passage = [f"common{i}" for i in range(40)]
    rows = []
    for base, copies in (([word() for _ in range(90)], 1_000), (passage + [word() for _ in range(30)], 250), ([word() for _ in range(7)], 60)):
        last = base
        for c in range(copies):
            text = list(last if c % 3 == 0 else base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [word()] * rng.randrange(2) or [text[at]]
            last = text if c % 40 else base
            rows.append(" ".join(text))
    for _ in range(200):
        at = rng.randrange(20)
        rows.append(" ".join([*passage[at : at + 20], *(word() for _ in range(rng.randrange(60)))]))
    rows += rows[:30] + ["", "one", "one", "a b c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def want(rows):
    return brute_force(rows)


@pytest.mark.parametrize("block, long_list, lists", [(64, 8, 4), (4_096, 32, 1), (500, 5_000, 4)])
def test_near_copies(spark, monkeypatch, rows, want, block, long_list, lists):
    """Small blocks; one list per group; no neighbours and hubs at all."""
    for name, value in (("BLOCK", block), ("LONG_LIST", long_list), ("LISTS_PER_GROUP", lists), ("PAIRS_AT_ONCE", 50 * block)):
        monkeypatch.setattr(jaccard_join, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in jaccard_components(docs).collect())
    assert len({c for _, _, c in want}) < 600  # most texts are copies
    assert got == want


def test_keep_one_of_each(spark, rows, want):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    kept = sorted(r.doc_id for r in keep_one(docs).collect())
    assert kept == sorted(i for i, n, c in want if i == c)
