"""Many words found in one reading of a text, by an Aho-Corasick automaton: the time grows with the text and with what is found,
not with the number of words.

Words travel to the tasks within the function that uses them, which Spark broadcasts once it is large; callers bound their bytes. An
automaton is built once in a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Bytes of the words of one automaton; more words are dealt to several, each of which reads the texts.
LIMIT = 64 << 20


def built(entries: Iterable[tuple[str, object]]) -> ahocorasick.Automaton | None:
    """The automaton of words with what it tells at each place where one ends; None if there is no word."""
    found = ahocorasick.Automaton()
    for word, what in entries:
        if word:
            found.add_word(word, what)
    if not len(found):
        return None
    found.make_automaton()
    return found


def counts(words: ahocorasick.Automaton | None, text: str | None) -> Counter:
    """How often each word stands in a text, not overlapping itself (words may overlap each other)."""
    out: Counter = Counter()
    free: dict[str, int] = {}
    for end, word in words.iter(text) if words is not None and text else ():
        at = end - len(word) + 1
        if at >= free.get(word, 0):
            out[word] += 1
            free[word] = end + 1
    return out


def of_words(words: Iterable[str]) -> ahocorasick.Automaton | None:
    return built((w, w) for w in words)


def counts_by_row(rows: DataFrame, words: list[str], key: str = "novel_id", text_col: str = "text") -> DataFrame:
    """(key, name, n) of the words that each row's text holds; null texts hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_words(words)
        for b in slices(batches):
            keys, names, n = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                some = counts(known, text)
                keys += [i] * len(some)
                names += some.keys()
                n += some.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(names, pa.string()), pa.array(n, pa.int64())], names=[key, "name", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, name string, n long")


def totals(texts: DataFrame, words: DataFrame, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(word, n) of the words (word) that the texts hold, not overlapping themselves, over all texts. Each task sums its own texts, so
    only a row for each word that it found is shuffled. Empty and null words count for nothing."""
    words = words.where("word <> ''").select("word").distinct()
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    parts = size // limit + 1
    out = None
    for part in range(parts):
        some = [r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).collect()]  # about limit bytes

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            known, sums = of_words(some), Counter()
            for b in slices(batches):
                for text in b.column(0).to_pylist():
                    sums.update(counts(known, text))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

        found = texts.select(text_col).mapInArrow(run, "word string, n long")
        out = found if out is None else out.union(found)
    return out.groupBy("word").agg(F.sum("n").alias("n"))
