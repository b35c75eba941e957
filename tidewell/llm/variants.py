"""Variant spellings of typed names linked to the company they mean: suffix blocking and subsequence ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.linking import (
    alike_words, asked_forms, candidate_pairs, decided, listed_forms, reference_names, scored_pairs, spread, stored, typed_values,
)

_ENDS = pa.schema([("word", pa.string()), ("key", pa.string()), ("size", pa.int32()), ("letters", pa.int64())])
_PLACE = {c: 1 << i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def _ends(word: str, lengths: set[int]) -> Iterator[str]:
    """Keys for suffixes of the word and of its mirror image, by length."""
    for mark, text in (("s", word), ("p", word[::-1])):
        for n in lengths:
            if 2 <= n <= len(text):
                yield f"{mark}:{text[-n:]}"


def _least(word: str) -> int:
    return max(2, (len(word) - 2) // 2)


def index_ends(word: str) -> set[str]:
    """Keys of a reference word: all suffixes from the least useful length up."""
    return set(_ends(word, set(range(max(2, _least(word) - 1), len(word) + 1))))


def query_ends(word: str) -> set[str]:
    """Keys of a typed word: one slip leaves a suffix of it or of its mirror image whole."""
    n = len(word)
    return set(_ends(word, {_least(word), _least(word) + 1, (n + _least(word)) // 2, n - 3, n - 2, n - 1, n}))


def _emit_ends(words: DataFrame, ends: Callable[[str], set[str]]) -> DataFrame:
    """(word, key, size, letters) of distinct words: each key with the length of the word and the set of its letters."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                letters = sum(_PLACE[c] for c in set(word))
                out += [(word, key, len(word), letters) for key in ends(word)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENDS)], schema=_ENDS)

    return spread(words).mapInArrow(emit, "word string, key string, size int, letters long")


@dataclass(frozen=True)
class Index:
    """A reference list made ready: its names, their forms, and the suffix keys of their distinct own words."""

    names: DataFrame
    listed: DataFrame
    ends: DataFrame

    @classmethod
    def of(cls, reference: DataFrame) -> Index:
        """From (entity, name, tickers); each part is written to the shared folder once, whatever is asked of it."""
        names = stored(reference_names(reference), "names")
        listed = stored(listed_forms(names), "listed")
        return cls(names, listed, stored(_emit_ends(listed.where("parts is not null").select(F.col("own").alias("word")).distinct(), index_ends), "ends"))

    def plus(self, other: Index) -> Index:
        """Both lists as one; a word of both has its keys twice, which ends where pairs of words are made distinct."""
        return Index(self.names.unionByName(other.names), self.listed.unionByName(other.listed), self.ends.unionByName(other.ends))


def suffix_blocked(asked: DataFrame, index: Index, common: int) -> DataFrame:
    """(word, own): typed and registered words that share a suffix, of themselves or of their mirror images.

    A suffix that more than ``common`` registered words share is refined by the
    other fields of the names (sector, relation, first name): words meet there
    only in names whose fields agree, as ``fit`` asks of them anyway.  Nothing
    is discarded.  Lengths and letters tell most pairs that cannot be alike.
    """
    typed = asked.where("parts is not null").select("word", "parts").distinct()
    known = index.listed.where("parts is not null").select(F.col("own").alias("word"), "parts").distinct()
    mine, theirs = _emit_ends(typed.select("word").distinct(), query_ends), index.ends
    full = theirs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > common).select("key")
    q, r = "q.size - bit_count(q.letters & ~r.letters)", "r.size - bit_count(r.letters & ~q.letters)"
    # No common subsequence has a letter that one of the words lacks; ``lcs_likeness`` wants 2/5 of both lengths.
    near = F.expr(f"q.word = r.word or (least(q.size, r.size) > 3 and least({q}, {r}) * 5 >= (q.size + r.size) * 2)")
    both = [F.col("q.word").alias("word"), F.col("r.word").alias("own")]
    met = lambda left, right, on: left.alias("q").join(right.alias("r"), on & near).select(*both)
    same = F.col("q.key") == F.col("r.key")
    if full.isEmpty():
        return met(mine, theirs, same).distinct()
    refined = met(mine.join(full, "key", "left_semi").join(typed, "word"), theirs.join(full, "key", "left_semi").join(known, "word"), same & (F.col("q.parts") == F.col("r.parts")))
    return met(mine, theirs.join(full, "key", "left_anti"), same).unionByName(refined).distinct()


def linked_names(values: DataFrame, index: Index, *, margin: float = 0.02, least: float = 0.2, common: int = 1_000) -> DataFrame:
    """(value, entity): the entity of the index that each distinct typed ``value`` means.

    Suffixes of the distinct own words of both sides, and of their mirror
    images, are the blocks.  Names meet where words are alike and no sector,
    relation or first name speaks against it, or in a ticker, an acronym or the
    whole name.  Candidate pairs are compared by longest-common-subsequence
    ratio and by the parts that must agree.  A value that fits two entities
    within ``margin`` gives no row, as do nulls, blanks and values that fit
    none.  The words of the values are written to the shared folder when the
    operator is called.
    """
    typed = typed_values(values).withColumn("known", F.lit(None).cast("array<string>"))
    asked = stored(asked_forms(typed), "asked")
    alike = stored(alike_words(suffix_blocked(asked, index, common), "lcs"), "alike")
    pairs = candidate_pairs(asked, index.listed, alike, plain_acronyms=True)
    return decided(scored_pairs(pairs, typed, index.names), margin, least).select("value", "entity")


def linked_to(values: DataFrame, reference: DataFrame, **options) -> DataFrame:
    """``linked_names`` for a reference list of (entity, name, tickers)."""
    return linked_names(values, Index.of(reference), **options)


def linked_answers(answers: DataFrame, answer_key: DataFrame, universe: DataFrame) -> DataFrame:
    """(answer_id, slot, item): the item whose company each filled slot means, whichever was asked.

    Slot 0 is ``company_guess``, slot k the k-th alternate.  The universe tells
    tickers and other listed companies apart: slots are linked to its
    companies, and so are the companies of the key (by ticker, else by name);
    a key company outside the universe is an entity of its own.  Resent answers
    count once; null and blank slots give no row.
    """
    slots = answers.select("answer_id", F.posexplode(F.concat(
        F.array(F.col("company_guess")), F.coalesce(F.col("alternates"), F.array().cast("array<string>")))).alias("slot", "value"))
    slots = slots.where("value is not null and answer_id is not null").distinct()
    companies = universe.where("cik is not null").select(F.col("cik").alias("entity"), "name", "ticker")
    tickers = companies.groupBy("entity").agg(F.collect_set("ticker").alias("tickers"))
    index = Index.of(companies.select("entity", "name").distinct().join(tickers, "entity"))
    key = answer_key.where("item is not null and company is not null").select("item", "company", "ticker").distinct()
    by_ticker = universe.where("ticker is not null").groupBy("ticker").agg(F.min("cik").alias("cik"))
    key = key.join(by_ticker, "ticker", "left")
    named = linked_names(key.where("cik is null").select(F.col("company").alias("value")), index)
    key = key.join(named.withColumnsRenamed({"value": "company", "entity": "named"}), "company", "left")
    key = stored(key.select("item", "company", "ticker", F.coalesce("cik", "named", F.concat(F.lit("item "), "item")).alias("entity")), "key")
    own = key.where(F.col("entity").startswith("item ")).select("entity", F.col("company").alias("name"), F.array_compact(F.array("ticker")).alias("tickers"))
    links = linked_names(slots.select("value"), index.plus(Index.of(own)))
    return slots.join(links, "value").join(key.select("entity", "item"), "entity").select("answer_id", "slot", "item").distinct()
