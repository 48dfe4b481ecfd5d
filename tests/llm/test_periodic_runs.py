"""Periodic runs against brute force over all lags, and the query's planted repeats."""

import hashlib
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm.periodic_runs import collapse, periodic_runs, run_digests, runs_of, with_repeats


def brute_force(words, min_words=6, min_periods=4):
    """Every stretch of every lag; of equal stretches, the one with the least lag."""
    found = {}
    for lag in range(1, len(words) // min_periods + 1):
        i = lag
        while i < len(words):
            end = i
            while end < len(words) and words[end] == words[end - lag]:
                end += 1
            length = end - i + lag
            if end > i and length >= max(min_words, min_periods * lag):
                found.setdefault((i - lag, length), lag)
            i = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


pieces = st.lists(st.sampled_from("abc"), min_size=1, max_size=7)
texts = st.lists(st.tuples(pieces, st.integers(1, 9)), max_size=6).map(
    lambda parts: [w for piece, times in parts for w in piece * times]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(texts, min_size=1, max_size=3))
def test_runs_of_repeats(several):
    for words, runs in zip(several, runs_of(several, 6, 4)):
        assert runs == brute_force(words)
        assert collapse(words, runs) == " ".join(kept(words, runs))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=120), st.integers(3, 6), st.integers(2, 12))
def test_runs_of_two_words(words, periods, least):
    assert runs_of([words], least, periods) == [brute_force(words, least, periods)]


def test_periods_of_all_lengths():
    for period in (*range(1, 70), 127, 128, 129, 1000):
        words = [f"w{i}" for i in range(period)] * 5 + ["end"]
        assert runs_of([["start", *words[1:]], words], 6, 4)[1] == [(0, max(5, 5 * period), period)][: 5 * period >= 6]


def test_very_long_text():
    words = ["the"] * 300_000
    assert runs_of([words], 6, 4) == [[(0, 300_000, 1)]]
    line = [f"w{i % 40}" for i in range(12_345)]
    assert (0, 246_900, 12_345) in runs_of([line * 20], 6, 4)[0]


def contract(doc_id, text):
    """One row of the query in plain Python."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_force(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def rows():
    text = "a b a b a b a b a b é\x0bé é é é é é \x1c中 x y z x y z x y z x y z end"
    # ids 0 to 199: some twenty of them repeat their words
    made = [(i, " ".join(f"w{j * j % (3 + i % 7)}" for j in range(i))) for i in range(200)]
    return [*made, (7, text), (7, text), (None, text), (-1, None), (-2, ""), (-3, " \t\n"), (-4, "one")]


def test_query_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", []) for r in rows], "doc_id long, text string, runs int, n string, words array<int>")
    got = [tuple(r) for r in run_digests(with_repeats(docs)).collect()]
    assert sorted(got, key=repr) == sorted((contract(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    kinds = dict(run_digests(docs).dtypes)
    assert all(kinds[c] == "bigint" for c in ("n_runs", "start", "length", "period", "exponent_milli"))


def test_operator(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "key long, body string, collapsed int")
    got = {(r.key, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(docs, "key", "body").collect()}
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    want = {(i, len(w), tuple(brute_force(w)), " ".join(kept(w, brute_force(w)))) for i, w in words}
    assert got == want
    assert periodic_runs(docs.limit(0), "key", "body").collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, "key", "body", min_periods=2)
