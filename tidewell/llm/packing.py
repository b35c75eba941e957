"""Documents of varying length put into containers of fixed capacity."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.bounded import join_bounded

TOKENIZERS = os.environ.get("TIDEWELL_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published splitting pattern of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, made once in a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: str | None, path: str) -> int:
    if not text:
        return 0
    return len(encoder(path).encode_to_numpy(text.encode("utf-8", "replace").decode("utf-8"), disallowed_special=()))


class BestFit:
    """Bounded-space online best fit.

    Open bins hang in lists by their free space; bit f of one integer is set
    while a bin with f units free is open.  The tightest bin that still fits
    is found with two bit operations.  When more than ``open_bins`` would be
    open, the fullest closes first.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.free, self.count, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int):
        bin_ = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def put(self, size: int) -> tuple[int, int, list[tuple[int, int]]]:
        """(bin, place in it, closed bins with their fill) for an item of ``size`` <= capacity."""
        closed: list[tuple[int, int]] = []
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count == self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append((self._take(fullest), self.capacity - fullest))
            bin_, free = self.made, self.capacity
            self.made += 1
        at, left = self.capacity - free, free - size
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        else:
            closed.append((bin_, self.capacity))
        return bin_, at, closed

    def rest(self) -> list[tuple[int, int]]:
        """The bins still open, fullest first."""
        out = [(b, self.capacity - f) for f in range(self.capacity + 1) for b in self.free[f]]
        self.bits, self.free, self.count = 0, [[] for _ in range(self.capacity + 1)], 0
        return out


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int, path: str) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    fit = BestFit(capacity, open_bins)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = token_count(text, path)
            done = 0
            if not total:
                rows.append((doc, 0, 0, 0, None, None))
            for piece in range(-(-total // capacity)):
                size = min(capacity, total - done)
                bin_, at, _ = fit.put(size)
                rows.append((doc, piece, done, size, base + bin_, at))
                done += size
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["doc_id", "piece", "first_token", "n_tokens", "bin", "bin_start"])


def _repack(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    fit = BestFit(capacity, open_bins)
    base, names = TaskContext.get().partitionId() << 32, {}
    for batch in batches:
        rows = []
        for bin_, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            to, at, closed = fit.put(used)
            # A container bears the name of the first bin that went into it.
            name = names.setdefault(to, bin_)
            rows.append((bin_, name, at))
            for gone, _ in closed:
                names.pop(gone, None)
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())],
                                         names=["bin", "container_id", "shift"])


def packed_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048,
                     open_bins: int = 64, tokenizer: str | None = None, loose_share: float = 0.98) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container_id, start): where each document lies.

    Documents of a task are packed as they come, in memory of ``open_bins``
    bins.  Bins left less than ``loose_share`` full are then items of a second
    round of the same algorithm across tasks.  A document is one piece unless
    it alone exceeds ``capacity``; then it is cut into full containers and a
    rest.  Documents without tokens (null, empty) have no container.  Sizes are
    tokens of the rank file ``tokenizer`` below ``TIDEWELL_TOKENIZERS``.
    """
    path = tokenizer or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    documents.sparkSession.sparkContext.addFile(path)  # goes to every executor with the job
    name = os.path.basename(path)
    items = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = items.mapInArrow(
        lambda it: _pack(it, capacity, open_bins, SparkFiles.get(name)),
        "doc_id long, piece int, first_token int, n_tokens int, bin long, bin_start int")
    from tidewell.session import cut_lineage

    placed = cut_lineage(placed)  # bins are named by task: they must not be dealt out again
    fill = placed.where("bin is not null").groupBy("bin").agg(F.sum("n_tokens").cast("int").alias("used"))
    loose = fill.where(F.col("used") < int(capacity * loose_share))
    tasks = max(1, loose.count() // 50_000)
    moved = loose.repartition(tasks, "bin").sortWithinPartitions(F.desc("used"), "bin").mapInArrow(
        lambda it: _repack(it, capacity, open_bins), "bin long, container_id long, shift int")
    return join_bounded(placed, moved, "bin").select(
        F.col("doc_id").alias(doc_id), "piece", "first_token", "n_tokens",
        F.coalesce("container_id", "bin").alias("container_id"),
        (F.col("bin_start") + F.coalesce("shift", F.lit(0))).cast("int").alias("start"))
