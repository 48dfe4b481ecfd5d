"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file maps byte strings to ids. The library works on characters, so every byte
gets a printable stand-in (``byte_characters``), and takes pairs to merge, so every
split of a token into two others becomes a merge of the token's rank. Texts are cut by
the pattern; the library encodes all pieces of some rows that it hasn't seen before in
one call, and their ids are remembered, as words repeat (by piece, and by the stretch
between two spaces, see ``token_counts``).
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
)

from tallyline.llm import token_counts
from tallyline.llm.common import map_texts, read_vocabulary, release_memory, trimmed
from tallyline.llm.token_counts import (
    STREAMED_CHARS,
    WIDE_SPACE,
    Remembered,
    byte_characters,
)

#: Pieces taken from a text at a time.
PIECES_AT_ONCE = 100_000


def spelt_out(pattern: str) -> str:
    r"""``pattern`` with ``\s`` and ``\S`` as Unicode's white space.

    Python's ``\s`` also takes the separators U+001C to U+001F.
    """
    inside = regex.sub(r"\[\^\\s", r"[^\\p{White_Space}", pattern)
    return inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class ByteBPE:
    """Encoder and decoder of a rank file. Ids are little-endian uint32 bytes inside."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        alphabet = byte_characters()
        shown = {token: "".join(alphabet[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            splits = ((token[:i], token[i:]) for i in range(1, len(token)))
            known = [(a, b) for a, b in splits if a in ranks and b in ranks]
            known.sort(key=lambda ab: (ranks[ab[0]], ranks[ab[1]]))
            merges += [(shown[a], shown[b]) for a, b in known]
        vocabulary = {shown[token]: rank for token, rank in ranks.items()}
        self.library = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(
            add_prefix_space=False, trim_offsets=False, use_regex=False
        )
        self.pieces = regex.compile(spelt_out(pattern))
        # a piece that starts with a space is remembered as the stretch behind it
        self.by_piece = Remembered(most=token_counts.MAX_REMEMBERED_BYTES // 3)
        self.after_space = Remembered(lambda stretch: self._cut(" " + stretch), 2 * token_counts.MAX_REMEMBERED_BYTES)
        #: the byte table read backwards, over the stand-ins of each token
        byte_of = {ord(c): b for b, c in enumerate(alphabet)}
        self.bytes_of = {rank: text.translate(byte_of).encode("latin-1") for text, rank in vocabulary.items()}
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def _known(self, piece: str) -> bytes | None:
        table, key = (self.after_space, piece[1:]) if piece[0] == " " else (self.by_piece, piece)
        found = table.get(key)
        return table.get(key) if found is None and table.found_again(key) else found

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't remembered, by one call of the library."""
        once: dict[str, bytes] = {}
        if pieces:
            found = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
            ids, words = np.array(found.ids, "<u4"), np.array(found.word_ids)
            cuts = np.searchsorted(words, np.arange(len(pieces) + 1)).tolist()
            data = ids.tobytes()
            for i, piece in enumerate(pieces):
                once[piece] = value = data[4 * cuts[i] : 4 * cuts[i + 1]]
                if piece[0] == " ":
                    self.after_space.keep(piece[1:], value)
                else:
                    self.by_piece.keep(piece, value)
        return once

    def _joined(self, parts: list[str], once: dict[str, bytes]) -> bytes:
        found = (once.get(p) or self._known(p) or self._learn([p])[p] for p in parts)
        return b"".join(found)

    def _cut(self, text: str) -> bytes:
        found = []
        for part in self._parts(text):
            found.append(self._joined(part, self._learn([p for p in set(part) if self._known(p) is None])))
        return b"".join(found)

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, some at a time."""
        part = []
        for m in self.pieces.finditer(text):
            part.append(m.group())
            if len(part) == PIECES_AT_ONCE:
                yield part
                part = []
        yield part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        narrow = [len(t) <= STREAMED_CHARS and not WIDE_SPACE.search(t) for t in texts]
        spaced = [t.split(" ") if ok else [""] for t, ok in zip(texts, narrow)]
        fresh = {s for stretches in spaced for s in stretches[1:]}
        fresh = [s for s in fresh if s not in self.after_space and not self.after_space.found_again(s)]
        cut = [self.pieces.findall(" " + s) for s in fresh]
        new = {p for parts in cut for p in parts}
        once = self._learn([p for p in new if self._known(p) is None])
        for s, parts in zip(fresh, cut):
            if len(parts) > 1 or parts[0][0] != " ":
                self.after_space.keep(s, self._joined(parts, once))
        stretch = self.after_space.__getitem__
        return [
            self._cut(s[0]) + b"".join(map(stretch, s[1:])) if ok else self._cut(t)
            for t, ok, s in zip(texts, narrow, spaced)
        ]

    def offsets(self, text: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the tokens of a text (UTF-8) in code points.

        The tokens' bytes, one after the other, are the text's. Tokens that have bytes of
        the same character all span it.
        """
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # a character's first byte
        character = np.cumsum(first)
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        return character[starts] - 1, character[ends - 1]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; characters split between ids are whole again.

        Each id stands for stand-in characters, and those for bytes by the table.
        """
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


_coders: dict[int, ByteBPE] = {}


def coder(data: bytes, pattern: str) -> ByteBPE:
    """The coder of this worker process, kept from task to task."""
    if (key := hash((data, pattern))) not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(read_ranks(data), pattern)
        release_memory()  # of the many merges that the library was given
    return _coders[key]


def bpe_encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    offsets: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every text's ids: (id, ids), with ``offsets`` also (starts, ends) in code points.

    ``ranks`` is the path of a file of base64 tokens and ranks. Each match of
    ``pattern`` is encoded separately, without special tokens. Null and empty texts
    have no ids; repeated rows stay; an empty table gives an empty result; other
    columns of ``docs`` are ignored.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def start():
        bpe = coder(file.value, pattern)
        def columns(texts):
            encoded = bpe.encode(texts)
            found = [[array("I", ids).tolist() for ids in encoded]]
            if offsets:
                spans = [bpe.offsets(t.encode("utf-8"), ids) for t, ids in zip(texts, encoded)]
                found += [[starts.tolist() for starts, _ in spans], [ends.tolist() for _, ends in spans]]
            return found

        return columns

    names = ("ids", "starts", "ends") if offsets else ("ids",)
    fields = [StructField(name, ArrayType(IntegerType())) for name in names]
    return map_texts(docs, id_col, text_col, fields, start)


def bpe_decode(
    encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """What ids stand for: (id, bytes, text).

    ``text`` reads the bytes as UTF-8, with U+FFFD where ids cut a character apart;
    ``bytes`` is exact. Null ids give empty ones. Unknown ids raise an error.
    """
    file = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))
    id_field = encoded.schema[id_col]

    def run(batches):
        bpe = coder(file.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [bpe.decode(array("I", x or []).tobytes()) for x in part.column(1).to_pylist()]
                texts = [x.decode("utf-8", "replace") for x in found]
                columns = [part.column(0), pa.array(found, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_field.name, "bytes", "text"])

    from pyspark.sql.types import StructType

    schema = StructType([id_field, StructField("bytes", BinaryType()), StructField("text", StringType())])
    return encoded.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(trimmed(run), schema)


def bpe_round_trip(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every text with offsets, decode its ids, and digest all three.

    (id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256): the digests (lower-case hex)
    are of the ids as little-endian unsigned 32-bit integers, of the decoded bytes, and of
    each token's start and end in code points, as such integers one after the other. Rows
    are handled as in ``bpe_encode``.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def start():
        bpe = coder(file.value, pattern)

        def digests(texts):
            encoded = bpe.encode(texts)
            spans = (bpe.offsets(t.encode("utf-8"), ids) for t, ids in zip(texts, encoded))
            return [
                [len(ids) // 4 for ids in encoded],
                [hashlib.sha256(ids).hexdigest() for ids in encoded],
                [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded],
                [hashlib.sha256(np.stack(pair, axis=1).astype("<u4").tobytes()).hexdigest() for pair in spans],
            ]

        return digests

    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
        StructField("offsets_sha256", StringType()),
    ]
    return map_texts(docs, id_col, text_col, fields, start)
