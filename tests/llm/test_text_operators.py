"""Each operator on a small table with nulls, ties, repeats and clashing columns, against brute force."""

import hashlib
import re
from array import array
from itertools import accumulate

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm.byte_bpe import ByteBPE, bpe_decode, bpe_encode, bpe_round_trip, read_ranks
from tallyline.llm.chat_windows import escape, format_chat, read_back, read_turns, unescape
from tallyline.llm.components import connected_components
from tallyline.llm.fingerprints import edited_fingerprints
from tallyline.llm.html_consensus import Page, extract_text
from tallyline.llm.jaccard_join import jaccard_components, keep_one
from tallyline.llm.mixing import mix_documents, mix_plan
from tallyline.llm.pii import replace_pii, surrogate
from tallyline.llm.token_counts import token_counts
from tallyline.llm.toxicity import drop_toxic, toxicity
from tallyline.llm.vector_dedup import vector_dedup

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BASE = "one two three four five six seven eight nine ten " * 3 + " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, BASE, "a", 5.0),
    (2, BASE + " extra", "a", 5.0),
    (3, BASE, "b", None),
    (4, None, "b", 1.0),
    (5, "", None, 1.0),
    (6, " \t\n", None, 1.0),
    (7, "Short  text's <|endoftext|> é\U0001f642\x1c中", "c", 1.0),
    (7, "Short  text's <|endoftext|> é\U0001f642\x1c中", "c", 1.0),
    (8, "x" * 30_000 + " " + "long words here " * 4_000, "a", 1.0),
    (None, BASE, "d", 1.0),
]


@pytest.fixture(scope="module")
def docs(spark):
    # size, score, n and key are also names that operators use
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, size double").withColumns(
        {"score": F.lit(1), "n": F.lit("x"), "key": F.lit(0), "id": F.lit(9), "held_out": F.lit(1)}
    )


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_token_counts(docs):
    library = Tokenizer.from_file(JSON)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON).collect())
    ids = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS]
    want = [(i or -1, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(ROWS, ids)]
    assert got == sorted(want)
    assert token_counts(docs.limit(0), JSON).collect() == []


def spans(text, tokens):
    """Start and end in code points of each token, byte by byte."""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    ends = list(accumulate(map(len, tokens)))
    return [(owner[end - len(t)], owner[end - 1] + 1) for t, end in zip(tokens, ends)]


def test_byte_bpe(docs):
    ranks = read_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        pairs = spans(t or "", list(map(library.decode_single_token_bytes, ids)))
        digested = (array("I", ids), (t or "").encode(), array("I", [x for pair in pairs for x in pair]))
        digests = (hashlib.sha256(bytes(x)).hexdigest() for x in digested)
        want.append((i or -1, len(ids), *digests))
    got = [(r[0] or -1, *r[1:]) for r in bpe_round_trip(docs, RANKS, PATTERN).collect()]
    assert sorted(got) == sorted(want)
    some = docs.where("doc_id = 7").limit(1)
    with_offsets = bpe_encode(some, RANKS, PATTERN, offsets=True)
    row, text = with_offsets.first(), ROWS[6][1]
    assert row.ids == library.encode_ordinary(text)
    assert list(zip(row.starts, row.ends)) == spans(text, list(map(library.decode_single_token_bytes, row.ids)))
    coder = ByteBPE(ranks, PATTERN)
    for piece in coder.pieces.findall(text):  # the library's own offsets of a piece
        found = coder.library.encode(piece, add_special_tokens=False)
        ids = array("I", found.ids).tobytes()
        assert list(zip(*(x.tolist() for x in coder.offsets(piece.encode(), ids)))) == found.offsets
    back = bpe_decode(with_offsets, RANKS, PATTERN).first()
    assert back.text == text and bytes(back.bytes) == text.encode()
    parts = with_offsets.select("doc_id", F.explode(F.transform("ids", lambda x, i: F.slice("ids", 1, i + 1))).alias("ids"))
    found = [r.text for r in bpe_decode(parts, RANKS, PATTERN).collect()]
    assert any(t.endswith("\ufffd") for t in found) and text in found  # ids end inside a character
    assert bpe_round_trip(docs.limit(0), RANKS, PATTERN).collect() == []


def test_mixing(docs):
    rows = mix_plan(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_plan(docs.repartition(5)).collect()), key=str)
    total = sum(r["size"] for r in rows)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum(r.taken for r in rows) <= 1.5 * total
    targets = {(r.target, r.source_size) for r in rows}
    assert all(t <= 2 * s for t, s in targets)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r["size"] for r in rows if r["size"])
    assert mix_plan(docs.limit(0)).collect() == [] and mix_documents(docs.limit(0)).collect() == []


def test_html(spark):
    article = "<div class='entry-{}'><p>Some &amp; <b>bold</b>\n text &eacute;<p>More text<div class=ad>Buy</div></div>"
    page = "<html><body><nav><a href=x>Menu</a></nav>{}<div class='comments'><p>I disagree, at length</p></div><footer>f</footer>"
    rows = [(i, f"http://h.example/{i}", page.format(article.format(i)), 1) for i in range(4)]
    rows += [(4, None, None, 1), (5, "", "", 1), (6, "http://h.example/6", "<p>odd", 1), (6, "http://h.example/6", "<p>odd", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert all(got[i].text == "Some & bold text é\nMore text" for i in range(4))
    assert got[0].n_chars == len(got[0].text) and got[4].text == got[5].text == "" and got[6].text == "odd"
    assert extract_text(pages).count() == len(rows) and extract_text(pages.limit(0)).collect() == []
    assert Page("a < b <!-- x --><script>if (a<b) '</p>'</script> c").text(None) == "a < b c"


def test_chat(spark):
    for text in ("</s>[INST] ok [/INST]", "<\\/s> <\\\\s> \\ <<SYS>> <|end|>", "plain <b>"):
        assert unescape(escape(text)) == text
    assert "[INST]" not in escape("[INST]")
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hi " * 50), (1, 2, "assistant", "</s> yes " * 40), (1, 3, "user", None),
             (1, 4, "assistant", "long " * 400), (1, 5, "assistant", ""), (2, 0, None, "a"), (2, 0, None, "a"), (None, 3, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = format_chat(df, JSON, budget=200, history=60)
    assert windows.where("conv_id = 1").count() > 2
    for w in windows.where("conv_id = 1 and window > 0").collect():
        assert w.formatted.startswith("<|turn|>system") and w.parts[0].repeated
        assert read_turns(w.formatted, [p.asDict() for p in w.parts])
    got = {r.conv_id: r for r in read_back(windows).collect()}
    for conv in (1, 2, None):
        own = sorted((t, r or "", x or "") for c, t, r, x in turns if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for _, r, x in own)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(format_chat(df.limit(0), JSON)).collect() == []


def test_jaccard(docs):
    got = sorted(((r[0] or -1, *r[1:]) for r in jaccard_components(docs).collect()), key=str)
    first = {1: 1, 2: 1, 3: 1}
    want = [(i or -1, len(shingles(t)), None if i is None else first.get(i, i)) for i, t, *_ in ROWS]
    assert got == sorted(want, key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8]
    assert jaccard_components(docs.limit(0)).collect() == [] and keep_one(docs.limit(0)).collect() == []


def test_fingerprints(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {i: t or "" for i, t, *_ in ROWS if i is not None}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in edited_fingerprints(unique).collect()}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, n = texts[i], len(texts[i])
        edited = text[: n - n // 2] + texts[after][: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - likeness(shingles(text), shingles(edited))) < 0.2
        assert abs(got[i].near_next - likeness(shingles(text), shingles(texts[after]))) < 0.2
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert edited_fingerprints(docs).count() == len(ROWS) and edited_fingerprints(docs.limit(0)).collect() == []


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.3], 1), (4, [0.7, 0.7], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1),
            (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(0))
    got = {r.vec_id: tuple(r)[1:] for r in vector_dedup(df).collect()}
    for i in (1, 2, 3, 13):
        assert got[i] == (3, 1, i == 1)
    assert all(got[i] == (0, i, True) for i in range(4, 13))
    assert vector_dedup(df.limit(0)).collect() == []


def test_pii(spark):
    text = "Mail Ann.Lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, +1 (275) 555-5927, 4111 1111 1111 1111, 10.1.2.3. Mrs Anna Lee"
    rows = [(1, text, 0), (2, "call +1 275.555.5927 or +1 (275) 555-5928", 0), (3, None, 0), (4, "", 0), (5, "Version 2.0, 1999", 0), (1, text, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, draw int")
    got = [r for r in replace_pii(df, b"k", count_col="n").orderBy("doc_id").collect()]
    assert got[0] == got[1] and [r.n for r in got] == [6, 6, 2, 0, 0, 0]
    new = got[0].text
    for secret in ("Ann.Lee", "ANN", "555-5927", "4111 1111", "10.1.2.3", "Anna"):
        assert secret not in new
    mails = re.findall(r"\S+@\S+?(?=,|\s)", new)
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper()
    first, second = re.findall(r"\d{3}\D{1,2}\d{3}\D\d{4}", got[2].text)
    assert re.sub(r"\D", "", first) in re.sub(r"\D", "", new) and re.sub(r"\D", "", first) != re.sub(r"\D", "", second)
    assert [r.text for r in got[3:]] == [None, "", "Version 2.0, 1999"]
    assert len({surrogate(b"k", "ssn", f"{i:09}", 0) for i in range(3000)}) == 3000
    assert replace_pii(df.limit(0), b"k").collect() == []


def test_pii_exceptions_by_join(spark, monkeypatch):
    from tallyline.llm import pii

    names = [f"Mr {a}{b}{c}" for a in "BCDFG" for b in "aeiou" for c in "lmnr"]  # more than there are names
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
    few = sorted(map(tuple, replace_pii(df, b"k").collect()))
    assert len({t for _, t in few}) == len(names) and not {t for _, t in few} & set(names)
    monkeypatch.setattr(pii, "MAX_BROADCAST_EXCEPTIONS", -1)
    assert sorted(map(tuple, replace_pii(df, b"k").collect())) == few


def test_toxicity(spark, docs):
    good = ["the cat sat on a warm mat and slept " * k for k in (1, 3, 9)]
    rows = [(i, good[i % 3] + (" you grubby slimeball " if i % 4 == 0 else " fine ") + str(i), i) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, __x int")
    labels = texts.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity(texts, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert len(toxicity(docs, labels).collect()) == len(ROWS)
    assert toxicity(docs.limit(0), labels).collect() == [] and toxicity(docs, labels.limit(0)).count() == len(ROWS)
    kept = drop_toxic(texts, labels)
    assert kept.columns == texts.columns and 250 <= kept.count() <= 330


@pytest.mark.parametrize("chunk", [50, 200_000])
def test_components_of_any_chunk(spark, chunk):
    """A long chain, a hub, repeats, loops and nulls, against a search, over several rounds."""
    import random

    random.seed(3)
    order = random.sample(range(1000, 1060), 60)
    links = list(zip(order, order[1:])) + [(5, i) for i in range(6, 90)] + [(7, 5), (200, 200), (None, 5), (300, 301), (301, 300)]
    random.shuffle(links)
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        waiting = [start] if start not in want else []
        while waiting:
            node = waiting.pop()
            if node not in want:
                want[node] = start
                waiting += near[node]
    found = connected_components(spark.createDataFrame(links, "a long, b long").repartition(5), chunk=chunk)
    assert {r.node: r.component for r in found.collect()} == {n: c for n, c in want.items() if n != c}
