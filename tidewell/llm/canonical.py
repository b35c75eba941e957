"""Free-entered values mapped to a canonical list by a symmetric-delete dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.linking import (
    alike_words, asked_forms, candidate_pairs, decided, listed_forms, reference_names, scored_pairs, spread, stored,
)
from tidewell.llm.names import split_words
from tidewell.operators.bounded import join_bounded

UNMATCHED = "unmatched"


def deletes(word: str, edits: int) -> set[str]:
    """The word with up to ``edits`` letters left out."""
    return {"".join(word[i] for i in range(len(word)) if i not in gone)
            for n in range(min(edits, len(word) - 1) + 1) for gone in map(set, combinations(range(len(word)), n))}


def _edits(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def _batched(rows: Iterator[tuple], first: str, second: str, kind: pa.DataType, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Pairs as batches of a bounded number of rows."""
    while part := list(islice(rows, size)):
        a, b = zip(*part)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, kind)], names=[first, second])


def _delete_rows(words: DataFrame, name: str) -> DataFrame:
    """(``name``, form): each distinct word with the hashes of its deletes."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((word, xxhash.xxh3_64_intdigest(f) >> 1) for batch in batches for word in batch.column(0).to_pylist() for f in deletes(word, _edits(word)))
        return _batched(rows, name, "form", pa.int64())

    return spread(words).mapInArrow(emit, f"{name} string, form long")


def delete_blocked(asked: DataFrame, listed: DataFrame, longest: int, dictionary_rows: int) -> DataFrame:
    """(word, own): typed and registered words that share a form after bounded deletes from both.

    Two words within the edit bound share one.  The dictionary of the
    registered words is broadcast up to ``dictionary_rows`` rows and joined by
    shuffle beyond; a typed word that is too long for the bound has no forms.
    """
    typed = asked.where("parts is not null").select("word").distinct().where(F.length("word") <= longest + 2)
    own = listed.where("parts is not null").select("own").distinct()
    return join_bounded(_delete_rows(typed, "word"), _delete_rows(own, "own"), "form", "inner", max_rows=dictionary_rows).select("word", "own").distinct()


def own_words(values: DataFrame, listed: DataFrame, longest: int) -> DataFrame:
    """(id, value, known): typed values with those of their words, and pieces of words written together, that registered names have as own words.

    A word longer than two registered ones and the known words that may be cut
    off around them has no such piece.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = set()
                for word in split_words(text):
                    n = len(word)
                    if n <= longest:
                        pieces.add(word)
                    if 7 <= n <= 2 * longest + 100:
                        pieces |= {word[a:b] for a in range(n - 3) for b in range(a + 4, min(n, a + longest) + 1) if n > 12 or a == 0 or b == n}
                yield from ((key, piece) for piece in pieces)

    pieces = spread(values.select("id", "value"), "id").mapInArrow(lambda it: _batched(cut(it), "id", "own", pa.string()), "id long, own string")
    stems = listed.where("parts is not null").select("own").distinct()
    known = pieces.join(stems, "own", "left_semi").groupBy("id").agg(F.collect_set("own").alias("known"))
    return values.join(known, "id", "left").select("id", "value", F.coalesce(F.array_sort("known"), F.array().cast("array<string>")).alias("known"))


def ranked_entries(values: DataFrame, reference: DataFrame, *, value: str = "name", key: str = "cik", name: str = "name", ticker: str = "ticker",
                   dictionary_rows: int = 1_000_000) -> DataFrame:
    """(value, entity, rank, score): the entries that each distinct typed value may mean.

    Every entry whose own words lie within the edit bound of those of the
    value, or whose ticker or acronym it gives; scored by the weighted
    Damerau-Levenshtein likeness of the words and by the parts that agree.
    """
    entries = reference.select(F.col(key).cast("string").alias("entity"), F.col(name).cast("string").alias("name"), F.col(ticker).cast("string").alias("ticker"))
    entries = entries.where("entity is not null and trim(name) <> ''")
    tickers = entries.groupBy("entity").agg(F.collect_set(F.when(F.trim("ticker") != "", F.trim("ticker"))).alias("tickers"))
    names = stored(reference_names(entries.select("entity", "name").distinct().join(tickers, "entity")), "names")
    listed = stored(listed_forms(names), "listed")
    longest = listed.where("parts is not null").agg(F.coalesce(F.max(F.length("own")), F.lit(0))).first()[0]
    given = values.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct().withColumn("id", F.xxhash64("value"))
    typed = stored(own_words(given, listed, longest), "typed")
    asked = stored(asked_forms(typed), "asked")
    alike = stored(alike_words(delete_blocked(asked, listed, longest, dictionary_rows), "damerau"), "alike")
    pairs = candidate_pairs(asked, listed, alike, plain_acronyms=False)
    return scored_pairs(pairs, typed, names)


def mapped_values(values: DataFrame, reference: DataFrame, *, value: str = "name", key: str = "cik", name: str = "name",
                  ticker: str = "ticker", dictionary_rows: int = 1_000_000, margin: float = 0.02, least: float = 0.2) -> DataFrame:
    """(value, key): every distinct typed value with the key of the entry it means, or ``unmatched``.

    The best of ``ranked_entries``; a value that fits two keys within
    ``margin`` is unmatched, so a word that several entries share needs further
    evidence.  The dictionary and the forms of the values are written to the
    shared folder when the operator is called; the answer does not depend on
    ``dictionary_rows``.

    Null values give no row; blank ones are unmatched; entries without name or
    key are never found; repeated rows on either side count once.
    """
    found = decided(ranked_entries(values, reference, value=value, key=key, name=name, ticker=ticker, dictionary_rows=dictionary_rows), margin, least)
    typed = values.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct()
    return typed.join(found, "value", "left").select(F.col("value").alias(value), F.coalesce("entity", F.lit(UNMATCHED)).alias(key))
