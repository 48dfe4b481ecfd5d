"""Spelling variants of a corpus' words, by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. A word's reduced form has a small full neighbourhood:
every string that is one inserted, deleted or replaced symbol away, and itself, as a
replaced letter may have the same symbol. Neighbourhoods meet the reduced vocabulary in a
join, and pairs that meet are verified on the original words.

What one edit leaves alone narrows the join: an edit in the second half of a neighbour
leaves its first half, letter by letter, and the other way round. So a word is found under
(reduced form, first half) and (reduced form, second half), and a neighbour asks for the
half that its edit didn't touch. Only words that are alike up to the symbols of one half
meet, so no key holds a large share of a vocabulary.

Forms and halves are polynomial hashes, computed for many words of one length at a time;
rows of the join hold two numbers however long a word is. Two keys that are equal by
chance cost a comparison and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyline.llm.common import written

#: Symbols that letters are hashed to.
SYMBOLS = 4
#: Letters of a word, occurrences of a word, and how much more frequent its form is.
MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
#: Letters whose neighbourhoods are held at a time.
LETTERS_AT_ONCE = 1 << 15

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SIDE = np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of numbers modulo 2^64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _SIDE
    return x ^ (x >> np.uint64(31))


class _Words:
    """Hashes of words of one length, and of all their one-edit neighbours."""

    def __init__(self, letters: np.ndarray, symbols: int):
        """``letters`` has a row of code points per word."""
        n = letters.shape[1]
        self.length = n
        self.powers = np.ones(n + 2, np.uint64)
        np.multiply.accumulate(np.full(n + 1, _BASE), out=self.powers[1:])
        # each symbol and each letter has a random number; a string is their polynomial
        codes = letters.astype(np.uint64)
        self.symbol = _mixed(np.arange(1, symbols + 1, dtype=np.uint64))
        self.own = _mixed(codes + np.uint64(1 << 32)) % np.uint64(symbols)
        self.reduced = self._prefixes(self.symbol[self.own.astype(np.int64)])
        self.exact = self._prefixes(_mixed(codes + np.uint64(1 << 33)))

    def _prefixes(self, values: np.ndarray) -> np.ndarray:
        """Column i: sum of the first i values times falling powers, from the left."""
        out = np.zeros((len(values), self.length + 1), np.uint64)
        for i in range(self.length):
            out[:, i + 1] = out[:, i] * _BASE + values[:, i]
        return out

    def _part(self, prefixes: np.ndarray, start: int, end: int) -> np.ndarray:
        return prefixes[:, end] - prefixes[:, start] * self.powers[end - start]

    def _keys(self, form: np.ndarray, length: int, first: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Keys of reduced forms of some length beside the first or second half of the word."""
        side = (np.atleast_1d(first).astype(np.uint64) + np.uint64(2 * length)) * _SIDE
        return _mixed(form ^ _mixed(half + side)).view(np.int64)

    def places(self) -> np.ndarray:
        """The two keys that each word is found under."""
        n, h = self.length, self.length // 2
        form = self.reduced[:, n]
        first = self._keys(form, n, True, self._part(self.exact, 0, h))
        return np.stack([first, self._keys(form, n, False, self._part(self.exact, h, n))], axis=1)

    def neighbours(self, least: int) -> np.ndarray:
        """All keys that a word's neighbours of ``least`` letters or more are found under."""
        n, keys = self.length, []
        for edit, m in (("replace", n), ("insert", n + 1), ("delete", n - 1)):
            if m < least:
                continue
            at = np.arange(n + (edit == "insert"))
            rest = at + (edit != "insert")  # where the unchanged end starts
            left, tail = self.reduced[:, at], self.powers[n - rest]
            right = self.reduced[:, [n]] - self.reduced[:, rest] * tail
            h = m // 2
            behind = {"replace": h, "insert": h - 1, "delete": h + 1}[edit]
            first = self._part(self.exact, 0, h)[:, None]
            second = self._part(self.exact, behind, n)[:, None]
            half = np.where(at >= h, first, second)
            forms = [left * tail + right] if edit == "delete" else [
                (left * _BASE + s) * tail + right for s in self.symbol
            ]
            keys += [self._keys(form, m, at >= h, half) for form in forms]
        return np.concatenate(keys, axis=1)


def _hashed(vocabulary: DataFrame, neighbours: bool, symbols: int, least: int) -> DataFrame:
    """(key, word_id): the keys of each word's places or of its neighbours."""
    schema = StructType([StructField("key", LongType()), StructField("word_id", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            ids = batch.column("word_id").to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                step = max(1, LETTERS_AT_ONCE // n)
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    joined = "".join(words[i] for i in part).encode("utf-32-le")
                    hashed = _Words(np.frombuffer(joined, np.uint32).reshape(len(part), n), symbols)
                    keys = hashed.neighbours(least) if neighbours else hashed.places()
                    found = np.sort(keys, axis=1)  # a neighbour that several edits make asks once
                    fresh = np.ones(found.shape, bool)
                    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                    arrays = [found[fresh], np.repeat(ids[part], fresh.sum(axis=1))]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=schema.names)

    return vocabulary.select("word", "word_id").mapInArrow(run, schema)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, b): ids of each two words, either way round, that one edit turns into each other.

    ``vocabulary`` (word_id, word) is a written table of distinct words that aren't empty.
    """
    least = vocabulary.agg(F.min(F.char_length("word"))).first()[0] or 1
    places = _hashed(vocabulary, False, symbols, least).withColumnRenamed("word_id", "b")
    asked = _hashed(vocabulary, True, symbols, least).withColumnRenamed("word_id", "a")
    met = written(asked.join(places, "key").where("a != b").select("a", "b").distinct(), "met")
    for side in ("a", "b"):
        word = F.col("word").alias(f"{side}_word")
        met = met.join(vocabulary.select(F.col("word_id").alias(side), word), side)
    return met.where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def spelling_forms(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n).

    Words are near if one inserted, deleted or replaced code point makes one the other. A
    word's form is its most frequent near word (of equals, the first in the order of code
    points), if that occurs ``ratio`` times (two or more) as often as the word; else it is
    null. ``root`` is where the forms of forms lead, the word itself if it has none.

    Rows with a null or empty word or a null n are ignored; an empty table gives an empty
    result; other columns are ignored. A word may be of any length; it takes rows
    in proportion to its length, of two numbers each.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    given = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    given = given.where("word != '' and n is not null")
    vocabulary = written(given.withColumn("word_id", F.monotonically_increasing_id()), "vocabulary")
    names = vocabulary.select(F.col("word_id").alias("b"), F.col("word").alias("near"), F.col("n").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("less"), "near", "b"))
    near = near_words(vocabulary, symbols).join(names, "b")
    grouped = near.groupBy(F.col("a").alias("word_id")).agg(F.count("*").alias("n_near"), best.alias("best"))
    found = vocabulary.join(grouped, "word_id", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = found.select(
        "word_id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
        F.when(enough, F.col("best.b")).alias("up"),
    )
    found = written(found, "forms")

    # each step of a way to a root is ``ratio`` times as frequent, which bounds its length;
    # every round doubles the steps taken
    up = found.where("up is not null").select("word_id", "up")
    most = found.agg(F.max("n"), F.min("n")).first()
    longest = math.log(max(2, most[0] / max(1, most[1])), ratio) + 1 if most[0] else 1
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        next_up = up.select(F.col("word_id").alias("up"), F.col("up").alias("further"))
        up = up.join(next_up, "up", "left").select("word_id", F.coalesce("further", "up").alias("up"))
        up = written(up, "ups")
    roots = up.join(vocabulary.select(F.col("word_id").alias("up"), F.col("word").alias("root")), "up")
    out = found.drop("up").join(roots.select("word_id", "root"), "word_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS
) -> DataFrame:
    """(id, run) for each maximal run of letters of ``min_letters`` or more, A-Z in lower case.

    Letters are those of LETTERS. Null and empty texts have none.
    """
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0))
    runs = docs.select(F.col(id_col), F.explode(found).alias("run"))
    # lower() also changes capitals beyond Z, which have to stay
    beyond = F.col("run").rlike("[^A-Za-z]")
    plain = F.when(beyond, F.translate("run", UPPER, UPPER.lower())).otherwise(F.lower("run"))
    return runs.select(id_col, plain.alias("run"))


def with_misspellings(runs: DataFrame, id_col: str = "doc_id", one_in: int = 199) -> DataFrame:
    """(word): the runs, of which one in ``one_in`` has lost a letter.

    With h the CRC-32 of ``<id>:<run>``, a run whose h is divisible loses its code point
    number h modulo its length, counted from 0. Runs of null ids stay as they are.
    """
    marked = F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col("run"))
    h = F.crc32(marked.cast("binary"))
    rows = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return rows.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) for words of ``min_letters`` and more that occur ``min_count`` times or more."""
    long = words.where(F.char_length("word") >= min_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
