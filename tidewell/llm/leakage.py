"""Evaluation items leaking into a corpus: one FM-index per shard, then an exact check of each hit."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.fmindex import MAX_SYMBOLS, FMIndex
from tidewell.llm.words import words
from tidewell.session import scratch_path

_SCHEMA = "doc_id long, item_id string, held double, span_start int, span_end int"
#: Altered words between two held runs that count as held.
BRIDGE = 2


def _spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... of ``size[i]`` numbers each, one after another."""
    return np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Phrases:
    """Searchable form of a block of evaluation items; ``width`` words make a phrase."""

    def __init__(self, items: list[tuple[str, str]], width: int, share: float) -> None:
        self.width, self.share = width, share
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[list[str]] = []
        self.codes: list[np.ndarray] = []
        same: dict[tuple, int] = {}
        for name, text in items:
            found = tuple(words(text))
            if not found:
                continue
            if found in same:
                self.names[same[found]].append(name)
                continue
            same[found] = len(self.names)
            self.names.append([name])
            self.codes.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        self.short = [i for i, c in enumerate(self.codes) if len(c) < width]
        sizes = np.array([max(0, len(c) - width + 1) for c in self.codes], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *self.codes])
        starts = np.cumsum([0, *map(len, self.codes)])[:-1].astype(np.int64)
        at = _spread(starts, sizes)
        self.owner = np.repeat(np.arange(len(self.codes)), sizes)
        # Phrases are numbered word by word, so that neither words nor phrases have a bound.
        gram = flat[at]
        for k in range(1, width):
            gram = np.unique(gram * (len(self.vocabulary) + 1) + flat[at + k], return_inverse=True)[1]
        _, first, self.gram = np.unique(gram, return_index=True, return_inverse=True)
        self.rows = np.stack([flat[at[first] + k] for k in range(width)], axis=1)
        self.places = np.split(self.gram, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def plan(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases to locate, given how often each occurs in the shard.

        A phrase holds ``width`` words of its item and at most ``BRIDGE``
        altered ones after it.  The most frequent phrases of an item are left
        out as long as they can hold less than half of the words that a leak
        must hold.  Returns item, place in it and phrase of all places to
        locate, and for each item the words that located places must hold in a
        leak that ``held_share`` sees.
        """
        items, spots, grams = [], [], []
        reach = self.width + BRIDGE
        least = np.zeros(len(self.codes))
        for i, place in enumerate(self.places):
            if not len(place):
                continue
            times, need = size[place], self.share * len(self.codes[i])
            covered, used = np.zeros(len(self.codes[i]), bool), 0
            locate = times > 0
            for at in np.argsort(-times, kind="stable"):
                if times[at] < 4:
                    break
                part = covered[at:at + reach]
                gain = len(part) - int(part.sum())
                if used + gain > need * 0.5:
                    break
                part[:] = True
                used += gain
                locate[at] = False
            chosen = np.flatnonzero(locate)
            items.append(np.full(len(chosen), i))
            spots.append(chosen)
            grams.append(place[chosen])
            least[i] = need - used
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *items]), np.concatenate([none, *spots]), np.concatenate([none, *grams]), least

    def reached(self, pair: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, words of its item) that the given places of each pair can hold, ``BRIDGE`` altered ones included."""
        longest = 1 + max(map(len, self.codes), default=0)
        pair, spot = np.divmod(np.unique(pair * longest + spot), longest)
        if not len(pair):
            return pair, spot
        words_ = np.full(len(pair), self.width + BRIDGE)
        inside = pair[1:] == pair[:-1]
        words_[:-1][inside] = np.minimum(words_[:-1][inside], (spot[1:] - spot[:-1])[inside])
        first = np.flatnonzero(np.append(True, ~inside))
        return pair[first], np.add.reduceat(words_, first)


def _ranks(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 + place in the sorted ``known``, 0 for what is not there."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at + 1, 0)


def phrase_matches(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the document, place in the item) of all equal phrases; codes below 1 equal nothing."""
    if len(doc) < width or len(item) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.unique(item[item > 0])
    a, b = _ranks(doc, known), _ranks(item, known)
    base, x, y = len(known) + 1, a, b
    for k in range(1, width):
        x = np.where((x[:-1] > 0) & (a[k:] > 0), x[:-1] * base + a[k:], 0)
        y = np.where((y[:-1] > 0) & (b[k:] > 0), y[:-1] * base + b[k:], 0)
        known = np.unique(y[y > 0])
        x, y = _ranks(x, known), _ranks(y, known)
    order = np.argsort(y, kind="stable")
    at = np.flatnonzero(x)
    low, high = np.searchsorted(y[order], x[at], "left"), np.searchsorted(y[order], x[at], "right")
    return np.repeat(at, high - low), order[_spread(low, high - low)]


def held_share(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[float, int, int]:
    """(share of the item's words that the document holds in order, first and last word of the span).

    Matching phrases on one diagonal make runs.  One or two altered words
    between runs that go on count as held, also where the document has one to
    three words in their place.  The longest sequence of held words that rises
    in both texts is taken, in n log n steps.
    """
    p, j = phrase_matches(doc, item, width)
    if not len(p):
        return 0.0, 0, 0
    shift = p - j
    order = np.lexsort((p, shift))
    p, shift = p[order], shift[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (shift[1:] != shift[:-1]) | (p[1:] - p[:-1] > width + BRIDGE)
    start = p[fresh]
    stop = p[np.append(np.flatnonzero(fresh)[1:], len(p)) - 1] + width
    shift = shift[fresh]
    # Altered words at the seam of two diagonals.
    size = int(max(len(doc), len(item))) + 8
    heads, left, right = np.sort(start * size + (start - shift)), [], []
    for over in range(1, BRIDGE + 2):
        for under in range(1, BRIDGE + 1):
            key = (stop + over) * size + (stop - shift + under)
            seam = heads[np.minimum(np.searchsorted(heads, key), len(heads) - 1)] == key
            for t in range(min(over, under)):
                left.append(stop[seam] + t)
                right.append(stop[seam] - shift[seam] + t)
    at = _spread(start, stop - start)
    pairs = np.unique(np.concatenate([at, *left]) * size + (size - 1 - np.concatenate([at - np.repeat(shift, stop - start), *right])))
    down = pairs // size
    across = size - 1 - pairs % size
    # Longest strictly rising sequence; of one document word the later item words come first.
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(pairs), -1, np.int64)
    for i, y in enumerate(across.tolist()):
        k = bisect_left(ends, y)
        if k:
            before[i] = last[k - 1]
        if k == len(ends):
            ends.append(y)
            last.append(i)
        else:
            ends[k], last[k] = y, i
    first = last[-1]
    while before[first] >= 0:
        first = before[first]
    return len(ends) / len(item), int(down[first]), int(down[last[-1]]) + 1


class Shard:
    """Whole documents with one FM-index over all their words, whatever is searched in it."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.keys: list[int] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def put(self, key: int, found: list[bytes]) -> None:
        self.keys.append(key)
        self.docs.append(np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found)))
        self.size += len(found) + 1

    def seal(self) -> None:
        self.bounds = np.cumsum([0, *[len(d) + 1 for d in self.docs]])
        flat = np.zeros(self.bounds[-1], np.int64)
        for start, d in zip(self.bounds, self.docs):
            flat[start:start + len(d)] = d
        self.index = FMIndex(flat, len(self.ids))

    def places(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word of it) of suffix rows."""
        at = self.index.locate(_spread(low, size))
        doc = np.searchsorted(self.bounds, at, "right") - 1
        return doc, at - self.bounds[doc]

    def leaks(self, block: Phrases) -> Iterator[tuple[int, str, float, int, int]]:
        """Documents of the shard that hold items of the block."""
        width, many = block.width, max(1, len(block.codes))
        here = np.fromiter(map(self.ids.get, block.vocabulary, repeat(0)), np.int64, len(block.vocabulary))
        coded = here[block.rows]
        known = np.flatnonzero((coded > 0).all(axis=1))
        low, size = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
        low[known], high = self.index.search(coded[known])
        size[known] = high - low[known]
        owner, spot, gram, least = block.plan(size)
        wanted = np.unique(gram)
        doc, _ = self.places(low[wanted], size[wanted])
        seen_doc, seen_gram = np.divmod(np.unique(doc * max(1, len(coded)) + np.repeat(wanted, size[wanted])), max(1, len(coded)))
        by = np.argsort(gram, kind="stable")
        left, right = np.searchsorted(gram[by], seen_gram, "left"), np.searchsorted(gram[by], seen_gram, "right")
        met = by[_spread(left, right - left)]
        pair, reached = block.reached(np.repeat(seen_doc, right - left) * many + owner[met], spot[met])
        for d, i in zip(*np.divmod(pair[reached >= least[pair % many] - 1e-6], many)):
            item = here[block.codes[i]]
            part, start, stop = held_share(self.docs[d], np.where(item > 0, item, -1), width)
            if part >= block.share:
                yield from ((self.keys[d], name, part, start, stop) for name in block.names[i])
        for i in block.short:  # shorter than a phrase: each place of the whole item
            item = here[block.codes[i]]
            if (item > 0).all():
                a, b = self.index.search(item[None, :])
                for d, start in zip(*self.places(a, b - a)):
                    yield from ((self.keys[d], name, 1.0, int(start), int(start) + len(item)) for name in block.names[i])


@lru_cache(2)
def _block(uri: str, width: int, share: float) -> Phrases:
    """A block of items from its file in the shared folder."""
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    table = pq.ParquetFile(system.open_input_file(path)).read(columns=["i", "t"])
    return Phrases(list(zip(table["i"].to_pylist(), table["t"].to_pylist())), width, share)


def _scan(batches: Iterator[pa.RecordBatch], blocks: list[str], width: int, share: float, shard_words: int) -> Iterator[pa.RecordBatch]:
    shard = Shard()

    def search() -> Iterator[pa.RecordBatch]:
        shard.seal()
        for uri in blocks:
            columns = list(zip(*shard.leaks(_block(uri, width, share)))) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "held", "span_start", "span_end"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = words(text)
            if shard.keys and shard.size + len(found) + 1 > shard_words:
                yield from search()
                shard = Shard()
            shard.put(key, found)
    if shard.keys:
        yield from search()


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", share: float = 0.4, width: int = 4,
                 shard_words: int = 1_200_000, block_items: int = 4_000) -> DataFrame:
    """(doc_id, item_id, held, span_start, span_end): documents that hold ``share`` of an item's words in order.

    Items are written to the shared folder in files of at most ``block_items``,
    so that neither the driver nor a broadcast holds them; this write runs when
    the operator is called.  Each task reads its part of the corpus once, turns
    it into FM-indexes of at most ``shard_words`` words (a longer document has
    an index of its own), searches the phrases of every block backwards in
    each, locates the hits and checks each (document, item) pair on the whole
    document.  Nothing of the corpus is shuffled.  The span counts words of
    the folded text; ``removal_spans`` merges overlapping ones.

    Null and blank texts hold nothing; items without a word leak nowhere;
    copies of an item are reported under each name; an item shorter than a
    phrase is found where all of it stands, with one row for each place.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "eval-blocks")
    chosen = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    chosen.write.option("maxRecordsPerFile", block_items).parquet(path)
    blocks = sorted(spark.read.schema("i string, t string").parquet(path).inputFiles())
    corpus = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    limit = min(shard_words, MAX_SYMBOLS)
    found = corpus.mapInArrow(lambda it: _scan(it, blocks, width, share, limit), _SCHEMA)
    return found.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def removal_spans(leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, span_start, span_end, items): overlapping or touching spans of a document merged."""
    order = Window.partitionBy(doc_id).orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("span_start") > reach), 1).otherwise(0)
    numbered = leaks.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(order))
    return numbered.groupBy(doc_id, "__run").agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"),
        F.countDistinct("item_id").alias("items"),
    ).drop("__run")
