"""Token counts by byte-pair merging, without producing tokens.

A text is cut at special strings and then by the pre-tokenizer's pattern; each piece
starts as one symbol per byte and merges the adjacent pair of lowest rank, the leftmost
of equals, until none is left. The pairs wait in a heap, the symbols form a linked
list, so a piece of n bytes takes O(n log n) steps. Its count is its bytes minus its
merges; identifiers are never looked up.

Counts are kept in bounded tables, as words repeat: by piece, and by the stretch from
one space to the next. Where a space has no other white space beside it, every match of
the pattern that reaches it ends before it, so the stretches can be counted separately.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tallyline.llm.common import map_texts, read_vocabulary

#: Fixed value: the byte-level pre-tokenizer's pattern. ``\s`` is spelt out, as Python's
#: also takes the separators U+001C to U+001F, which Unicode doesn't list as white space.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A space beside other white space.
WIDE_SPACE = re.compile(r" \s|\s ")
#: Bytes of memory that a worker process keeps pieces and stretches in, up to twice as many
#: in a table, and the characters of the longest ones kept.
MAX_REMEMBERED_BYTES = 48 << 20
MAX_REMEMBERED_CHARS = 64
#: Bytes of a table's entry besides its key and value, at most.
ENTRY_BYTES = 110
#: Texts beyond this many characters are cut into pieces one by one, not into a list.
STREAMED_CHARS = 1 << 22


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(others)) for b in range(256)]


def merges_needed(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """How many merges byte-pair encoding makes in ``symbols``, numbers under 2^16.

    ``ranks`` has the rank of a pair under ``left << 16 | right``; ``made`` has the
    symbol that the merge of each rank makes.
    """
    n, rank_of = len(symbols), ranks.get
    heap = []  # rank << 32 | position of the left symbol
    for i in range(n - 1):
        if (rank := rank_of(symbols[i] << 16 | symbols[i + 1], -1)) >= 0:
            heap.append(rank << 32 | i)
    if not heap:
        return 0
    heapify(heap)
    right = list(range(1, n + 1))  # the linked list: next and previous live symbol
    left = list(range(-1, n - 1))
    symbols, merges = list(symbols), 0
    while heap:
        best = heappop(heap)
        rank, i = best >> 32, best & 0xFFFFFFFF
        a, j = symbols[i], right[i]
        if a < 0 or j >= n or rank_of(a << 16 | symbols[j], -1) != rank:
            continue  # one of the two has merged with another meanwhile
        symbols[i] = merged = made[rank]
        symbols[j] = -1
        merges += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (rank := rank_of(merged << 16 | symbols[k], -1)) >= 0:
                heappush(heap, rank << 32 | i)
        if (h := left[i]) >= 0 and (rank := rank_of(symbols[h] << 16 | merged, -1)) >= 0:
            heappush(heap, rank << 32 | h)
    return merges


class Remembered(dict):
    """Values by short string, those used lately, in a bounded number of bytes.

    There are two tables: this one, and the one before. When this one holds half of the
    bytes, it becomes the one before, and what was only there is forgotten; a value that
    is found there moves back into this one.
    """

    def __init__(self, compute: Callable[[str], object] | None = None, most: int | None = None):
        super().__init__()
        self.compute = compute
        self.most = MAX_REMEMBERED_BYTES if most is None else most
        self.before: dict[str, object] = {}
        self.held = 0

    def keep(self, key: str, value: object) -> None:
        if len(key) > MAX_REMEMBERED_CHARS:
            return
        size = sys.getsizeof(key) + sys.getsizeof(value) + ENTRY_BYTES
        if 2 * (self.held + size) > self.most:
            self.before = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size

    def found_again(self, key: str) -> bool:
        """Whether the table before has the key; it is then in this one."""
        if key not in self.before:
            return False
        self.keep(key, self.before[key])
        return key in self

    def __missing__(self, key: str):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value


class TokenCounter:
    """Counts tokens as the library would with this vocabulary file (JSON)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if (
            model["type"] != "BPE"
            or before.get("type") != "ByteLevel"
            or before.get("add_prefix_space")
            or not before.get("use_regex", True)
            or spec["normalizer"]
            or model.get("dropout")
            or model.get("ignore_merges")
        ):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        alphabet, numbers = byte_characters(), {}
        number = lambda s: numbers.setdefault(s, len(numbers))
        self.bytes = [number(c) for c in alphabet]
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(number(a) << 16 | number(b), rank)
            self.made.append(number(a + b))
        if len(numbers) >= 1 << 16:
            raise ValueError("vocabularies of 65,536 symbols or more are not supported")
        self.pieces = regex.compile(PIECES)
        self.by_piece = Remembered(self._merged, 2 * MAX_REMEMBERED_BYTES)
        self.after_space = Remembered(lambda stretch: self._cut(" " + stretch), 2 * MAX_REMEMBERED_BYTES)
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None

    def _merged(self, piece: str) -> int:
        data = piece.encode("utf-8")
        return len(data) - merges_needed([self.bytes[b] for b in data], self.ranks, self.made)

    def _cut(self, text: str) -> int:
        return sum(map(self.by_piece.__getitem__, self.pieces.findall(text)))

    def _plain(self, text: str) -> int:
        if len(text) > STREAMED_CHARS:
            return sum(self.by_piece[m.group()] for m in self.pieces.finditer(text))
        if WIDE_SPACE.search(text):
            return self._cut(text)
        first, *rest = text.split(" ")
        return self._cut(first) + sum(map(self.after_space.__getitem__, rest))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += 1 + (self._plain(text[at : m.start()]) if m.start() > at else 0)
            at = m.end()
        return total + self._plain(text[at:])


_counters: dict[int, TokenCounter] = {}


def counter(vocabulary: bytes) -> TokenCounter:
    """The counter of this worker process, kept from task to task."""
    if (key := hash(vocabulary)) not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(vocabulary)
    return _counters[key]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library.
    Returns (id, n_bytes, n_tokens, over_limit), one row per input row: repeated rows
    and ids stay repeated, null and empty texts have 0 bytes and 0 tokens, an empty
    table gives an empty result. Other columns of ``docs`` are ignored, whatever their
    names. Memory is bounded by the table of pieces and one text at a time.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def start():
        count = counter(file.value).count
        return lambda texts: [[len(t.encode("utf-8")) for t in texts], [count(t) for t in texts]]

    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    counted = map_texts(docs, id_col, text_col, fields, start)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
