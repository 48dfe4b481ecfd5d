"""What worker processes keep from text to text stays within its bytes."""

import random
import sys

import public_tokenizers
import tiktoken

from tallyline.llm import token_counts
from tallyline.llm.byte_bpe import ByteBPE, read_ranks
from tallyline.llm.token_counts import ENTRY_BYTES, Remembered, TokenCounter


def held(table: Remembered) -> int:
    return sum(sys.getsizeof(k) + sys.getsizeof(v) + ENTRY_BYTES for t in (table, table.before) for k, v in t.items())


def words(n, seed=1):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdeéß中,.", k=rng.randint(1, 9))) for _ in range(50)) for _ in range(n)]


def test_remembered():
    computed = []
    table = Remembered(lambda k: computed.append(k) or len(k), most=20_000)
    for i in range(3_000):
        assert table[f"word {i}"] == len(f"word {i}")
        assert table["often"] == 5  # what is used lately stays
        assert held(table) <= 20_000
    assert computed.count("often") == 1 and len(computed) == 3_001
    assert table["x" * 65] == 65 and "x" * 65 not in table
    assert not table.found_again("word 1") and table["word 1"] == 6


def test_bounded_tables(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_REMEMBERED_BYTES", 40_000)
    ranks = read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = ByteBPE(ranks, public_tokenizers.PATTERN)
    counter = TokenCounter(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    texts = words(300) + [" ".join(words(40, 2)), "y" * 5_000, "  wide  blanks ", ""]
    for at in range(0, len(texts), 16):
        part = texts[at : at + 16]
        want = [library.encode_ordinary(t) for t in part]
        assert [memoryview(x).cast("I").tolist() for x in coder.encode(part)] == want
        assert [counter.count(t) for t in part] == [len(w) for w in want]
        for table in (coder.by_piece, coder.after_space, counter.by_piece, counter.after_space):
            assert held(table) <= table.most <= 80_000
    assert coder.after_space.before  # the tables were full at times
