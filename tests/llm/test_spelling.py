"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm.spelling import _Words, letter_runs, spelling_forms, with_misspellings, word_counts

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts, ratio=5):
    forms, rows = {}, []
    for word, n in counts.items():
        found = [w for w in counts if near(word, w)]
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best and counts[best] >= ratio * n else None
        rows.append([word, forms[word], word, n, len(found), forms[word] and counts[forms[word]]])
    for row in rows:
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, rows))


word = st.text("abé", min_size=1, max_size=9)


@settings(max_examples=600, deadline=None)
@given(word, st.integers(0, 9), st.sampled_from("abé"), st.sampled_from(["insert", "delete", "replace"]))
def test_neighbours_meet(a, at, letter, edit):
    at %= len(a)
    b = {"insert": a[:at] + letter + a[at:], "delete": a[:at] + a[at + 1 :], "replace": a[:at] + letter + a[at + 1 :]}[edit]
    if not b or a == b:
        return
    one, other = (_Words(np.array([[ord(c) for c in w]]), 4) for w in (a, b))
    assert np.isin(other.places()[0], one.neighbours(1)[0]).any()
    assert np.isin(one.places()[0], other.neighbours(1)[0]).any()


def vocabulary():
    """Words with edits of edits of their first ones, and some unlike all."""
    rng = np.random.default_rng(3)
    letters = list("abcdeé")
    counts = {}
    for _ in range(40):
        base = "".join(rng.choice(letters, rng.integers(6, 12)))
        for step, n in enumerate((20_000, 3_000, 500, 40, 40, 7, 6, 5)):
            if len(base) >= 6:
                counts[base] = n + int(rng.integers(0, 2))
            at = int(rng.integers(len(base)))
            base = (base[:at] + base[at + 1 :], base[:at] + rng.choice(letters) + base[at + 1 :], base[:at] + rng.choice(letters) + base[at:])[step % 3]
    return counts


def test_forms(spark):
    counts = vocabulary()
    long = "x" * 3_000
    counts |= {long: 50, long + "x": 5, long[1:] + "y": 9, "é" * 6: 5, "é" * 7: 25, "abcdef": 25, "abcdeg": 25, "abcdeh": 5}
    rows = [(w, n, "clash", 1) for w, n in counts.items()]
    words = spark.createDataFrame([*rows, (None, 9, "", 1), ("", 9, "", 1), ("abcdefg", None, "", 1)], "word string, n long, form string, word_id int")
    want = brute_force(counts)
    assert sum(r[1] is not None for r in want) > 60
    assert any(r[1] and r[2] != r[1] for r in want)  # ways of several steps
    for symbols in (2, 4):
        got = spelling_forms(words, symbols=symbols)
        assert got.columns == COLUMNS
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    assert spelling_forms(words.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_forms(words, ratio=1)


def contract(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return brute_force({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_query_rows(spark):
    text = "Ärger ÄRGERLICH ärgerlich colour-Colour's color colours kolour Colours×÷ straße1strasse STRAßE İstanbul end"
    rows = [(i, f"{text} filling{'abcdefgh'[i % 8]} houses") for i in range(1, 3_000)]
    rows += [(None, text), (5, None), (6, ""), (7, "a" * 5_000), (7, "a" * 5_000), (8, text), (8, text)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(5)
    got = spelling_forms(word_counts(with_misspellings(letter_runs(docs))))
    want = contract(rows)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    assert any(r[1] for r in want)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == "bigint" for c in ("n", "n_near", "form_n"))
    assert word_counts(with_misspellings(letter_runs(docs.limit(0)))).collect() == []
