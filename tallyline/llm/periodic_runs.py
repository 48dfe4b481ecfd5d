"""Stretches of words that repeat with a period, found online on sparse diagonals.

A lag's diagonal is active while each word equals the word that many places before. Words
come one by one; their earlier occurrences lengthen the active diagonals or start new
ones, and a diagonal that the next word doesn't lengthen ends and emits its run at once
if it is long enough.

Of all earlier occurrences of a word, few can belong to a run, and only those are looked
at. Inside a run with smallest period q, a context of q words or more recurs after q words
and never sooner. So a lag between K / 2 and K, K a power of two, counts where the last K
words occur and the latest earlier occurrence of all K is that lag away. The diagonal then
starts with K matches; a run of three periods or more always has them. A word has one such
lag per power of two at most, so a text of n words takes O(n log n) steps however often its
words repeat, and at most one diagonal per power of two is active.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyline.llm.common import map_texts

#: A run has this many words and this many periods at least.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Words whose contexts are numbered together; a longer text is numbered by itself.
WORDS_AT_ONCE = 1 << 17

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])

Run = tuple[int, int, int]


def recurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of each word that ends a context whose latest occurrence is the lag away.

    Ordered by place. The context of a lag is the least power of two that isn't below it.
    Contexts double in length; only places whose two halves both recur are kept.
    """
    places, contexts = [], []
    at, gram, size = np.arange(len(words)), words, 1
    number = np.empty(len(words), np.int64)
    while len(at) and size <= len(words):
        order = np.argsort(gram, kind="stable")
        same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
        earlier, later = at[order[same]], at[order[same + 1]]
        lag = later - earlier
        fits = (lag <= size) & (2 * lag > size)
        places.append(later[fits])
        contexts.append(lag[fits])
        # number what recurs, and join it with what recurs directly before
        again = np.zeros(len(at), bool)
        again[order[same]] = again[order[same + 1]] = True
        at, (_, gram) = at[again], np.unique(gram[again], return_inverse=True)
        number[:] = -1
        number[at] = gram
        inside = at >= size
        at, gram = at[inside], gram[inside]
        left = number[at - size]
        at, gram = at[left >= 0], gram[left >= 0] + left[left >= 0] * len(words)
        size *= 2
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(contexts)
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def emitted(
    recurring: Iterator[tuple[int, int]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> Iterator[Run]:
    """(start, length, period) of each run, as soon as its diagonal ends."""
    active: dict[int, tuple[int, int]] = {}  # lag: last word, words matched

    def run(lag: int) -> Run | None:
        last, matched = active.pop(lag)
        length = lag + matched
        if length >= max(min_words, min_periods * lag):
            return last - length + 1, length, lag
        return None

    now = None
    for place, lag in recurring:
        if place != now:
            for ended in [k for k, (last, _) in active.items() if last < place - 1]:
                if found := run(ended):
                    yield found
            now = place
        if lag in active:
            active[lag] = place, active[lag][1] + 1
        else:
            active[lag] = place, 1 << (lag - 1).bit_length()
    for ended in list(active):
        if found := run(ended):
            yield found


def runs_of(texts: list[list[str]], min_words: int, min_periods: int) -> list[list[Run]]:
    """The runs of some texts, each by start and period. Equal words of two texts differ."""
    numbers: list[int] = []
    starts = [0]
    for words in texts:
        known: dict[str, int] = {}
        base = len(numbers)
        numbers += [base + known.setdefault(w, len(known)) for w in words]
        starts.append(len(numbers))
    place, lag = recurrences(np.array(numbers, np.int64))
    cuts = np.searchsorted(place, starts)
    found = []
    for i, start in enumerate(starts[:-1]):
        part = slice(cuts[i], cuts[i + 1])
        recurring = zip((place[part] - start).tolist(), lag[part].tolist())
        runs = sorted(emitted(recurring, min_words, min_periods), key=lambda r: (r[0], r[2]))
        found.append(runs)
    return found


def collapse(words: list[str], runs: list[Run]) -> str:
    """The words without those of a run behind its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return " ".join(words)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """(id, n_words, runs, collapsed) per row.

    Words are separated by blanks and the controls U+0009 to U+000D. A run is a stretch
    with a smallest period, of ``min_words`` words and ``min_periods`` periods (three or
    more) at least, that no neighbouring word extends; ``runs`` has (start, length, period)
    of all, by start, then period, with words numbered from 0. Runs may overlap.
    ``collapsed`` has the words that no run contains behind its first period.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows
    that repeat, also with a null id, come out as often as they are; an empty table gives
    an empty result; other columns are ignored. A text is held whole by one task, in memory
    that grows in proportion to its words.
    """
    if min_periods < 3:
        raise ValueError("a run takes three periods or more")

    def start():
        def compute(texts: list[str]) -> list[list]:
            n_words, runs, collapsed = [], [], []
            waiting: list[list[str]] = []
            held = 0

            def done() -> None:
                found = runs_of(waiting, min_words, min_periods)
                n_words.extend(map(len, waiting))
                runs.extend([dict(zip(RUN.names, r)) for r in f] for f in found)
                collapsed.extend(map(collapse, waiting, found))
                waiting.clear()

            for text in texts:
                waiting.append(WORD.findall(text))
                held += len(waiting[-1])
                if held >= WORDS_AT_ONCE:
                    done()
                    held = 0
            done()
            return [n_words, runs, collapsed]

        return compute

    fields = [
        StructField("n_words", LongType()),
        StructField("runs", ArrayType(RUN)),
        StructField("collapsed", StringType()),
    ]
    return map_texts(docs, id_col, text_col, fields, start)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) where every tenth text repeats some of its words up to its end.

    With h the CRC-32 of the id in decimal digits, g = h div 10 and n words, texts with
    h mod 10 = 0 and words repeat the p = 1 + (n - a) div (3 + g mod 8) words from a = g mod n
    on; their words are then joined by one space. Texts of null ids stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    text = F.col(text_col).cast("string")
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    marked = docs.select(F.col(id_col), text.alias("text"), F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    placed = marked.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int"))).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    )
    rest = n - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int")))
    told = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), rest))
    return placed.select(
        id_col, F.when(F.col("a").isNotNull(), F.array_join(told, " ")).otherwise(F.col("text")).alias(text_col)
    )


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``periodic_runs``: number of runs, the strongest one, and digests.

    The strongest has most periods; of equals, the first start, then the least period.
    """
    found = periodic_runs(docs, id_col, text_col)
    stronger = lambda best, x: F.when(x.length * best.period > best.length * x.period, x).otherwise(best)
    best = F.when(F.size("runs") > 0, F.reduce("runs", F.col("runs")[0], stronger))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
