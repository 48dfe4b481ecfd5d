"""Windows keep their budget as written, and are read back from any order of rows."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm.chat_windows import format_chat, read_back

JSON = public_tokenizers.path("byte_bpe_50k.json")
BUDGET, HISTORY = 300, 90


@pytest.fixture(scope="module")
def turns(spark):
    """Conversations of short and long turns, many of them with control strings to escape."""
    rng = random.Random(9)
    words = ["yes", "so", "</s>", "[INST]", "<|end|>", "<\\|text|>", "naïve", "中文", "\n", "  ", "<b>"]
    rows = []
    for conversation in range(60):
        if conversation % 3:
            rows.append((conversation, -1, "system", "Be brief. " * rng.randrange(1, 9)))
        for turn in range(rng.randrange(1, 30)):
            most = rng.choice((5, 30, 30, 150, 400))
            said = " ".join(rng.choice(words) for _ in range(rng.randrange(most)))
            rows.append((conversation, turn, ("user", "assistant")[turn % 2], said))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.fixture(scope="module")
def windows(turns):
    return format_chat(turns, JSON, BUDGET, HISTORY).collect()


def test_budget_as_written(windows):
    library = Tokenizer.from_file(JSON)
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    seen, over, full, repeats = {}, 0, 0, 0
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window)):
        new = [p for p in w.parts if not p.repeated]
        again = [w.formatted[p.start : p.end] for p in w.parts if p.repeated]
        system = [t for t in again if t.startswith("<|turn|>system")]
        turns = [w.formatted[p.start : p.end] for p in w.parts]
        assert "".join(turns) == w.formatted
        assert count(w.formatted) == sum(map(count, turns))  # sums are exact
        # above the budget only where one turn doesn't fit beside the system turns
        if count(w.formatted) > BUDGET:
            over += 1
            assert len(new) == 1 + (w.window == 0 and turns[0].startswith("<|turn|>system"))
            assert again == system
        else:
            full += len(new) > 1
        assert count("".join(again[len(system) :])) <= HISTORY
        repeats += len(again) > len(system)
        seen.setdefault(w.conv_id, []).extend(p.turn for p in new)
    assert over and full > 20 and repeats > 20
    assert all(own == list(range(len(own))) for own in seen.values())


def test_next_turn_would_not_fit(windows):
    """A window takes as many turns as its budget allows."""
    library = Tokenizer.from_file(JSON)
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    by = {(w.conv_id, w.window): w for w in windows}
    for (conversation, window), w in by.items():
        after = by.get((conversation, window + 1))
        if after:
            first = next(p for p in after.parts if not p.repeated)
            assert count(w.formatted + after.formatted[first.start : first.end]) > BUDGET


def test_read_back_from_any_order(spark, turns, tmp_path):
    made = format_chat(turns, JSON, BUDGET, HISTORY)
    want = sorted(map(tuple, read_back(made, in_order=True).collect()))
    made.repartition(7, F.rand(3)).write.parquet(str(tmp_path / "windows"))
    shuffled = spark.read.parquet(str(tmp_path / "windows")).orderBy(F.desc("window"))
    assert sorted(map(tuple, read_back(shuffled).collect())) == want
    assert sorted(map(tuple, read_back(made).collect())) == want
