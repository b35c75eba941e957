"""Reading level of documents: gradient-boosted regression trees over text distributions."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import folded

_SENTENCE = re.compile(r"[.!?]+[\s\"”’)]+|\n{1,}")
_VOWELS = re.compile(rb"[aeiouy]+")
# Frequent short words of plain English, and words of formal prose.
_PLAIN = frozenset(
    b"the a an and or but if it is was are be you your we they he she his her do did can will get got has had have not no yes of in on at to for "
    b"so up out off one two see tell how what when who them this that with from by as there more make made buy sell money back old new".split())
_FORMAL = frozenset(
    b"pursuant notwithstanding thereof therein whereupon thereby herein accordance subject foregoing insofar aggregate aforementioned hereby "
    b"whereas although however consistent attributable respectively consolidated subsequent absent upon contingent".split())
_LINKS = frozenset(b"because although while which that whereas until unless since though when if once whose whom after before".split())
# Frequent short words of English, and of German, French and Spanish (without accents), that the other languages lack.
_ENGLISH = tuple(b"the of and to that for was are with this from which have has had were would will".split())
_OTHER = tuple(
    b"der die das und den dem ein eine nicht mit sich auf fur von ist wird werden bei nach durch zum zur im le la les des du un une est et pour sur avec "
    b"aux cette que qui pas ses sont dans par el los las una por para con su se del lo como mas".split())
_LONGEST = 24
_UPPER = bytes(range(65, 91))


def measure(text: str) -> np.ndarray | None:
    """Length, vocabulary, syntax and cohesion of a text; None for one without a word."""
    flat = folded(text)
    words = flat.split()
    n = len(words)
    if not n:
        return None
    sizes = list(map(len, words))
    letters = sum(sizes)
    tally = [0] * (_LONGEST + 1)
    for size, times in Counter(sizes).items():
        tally[min(size, _LONGEST)] += times
    per = 1.0 / n
    mean = letters * per
    shape = list(accumulate(tally))
    parts = [p for p in _SENTENCE.split(text) if p and not p.isspace()]
    rows = [p.lower().split() for p in parts]
    lengths = sorted(map(len, rows)) or [n]
    m = len(lengths)
    average = sum(lengths) / m
    sets = list(map(set, rows))
    shared = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:])]
    sound = len(_VOWELS.findall(flat))
    counts = Counter(words)
    among = lambda known: sum(times for word, times in counts.items() if word in known) * per
    count = text.count
    raw = text.encode("ascii", "ignore")
    return np.array([
        math.log1p(n), mean, sound * per, math.sqrt(max(0.0, sum(s * s * t for s, t in enumerate(tally)) * per - mean * mean)),
        *(bisect_left(shape, q * n) for q in (0.5, 0.75, 0.9, 0.97)),
        shape[3] * per, (shape[5] - shape[3]) * per, (shape[8] - shape[5]) * per, (shape[11] - shape[8]) * per, (n - shape[11]) * per,
        average, math.sqrt(sum(k * k for k in lengths) / m - average * average if m > 1 else 0.0),
        lengths[m // 10], lengths[m // 2], lengths[m * 9 // 10], n / m,
        len(counts) * per, len(counts) / math.sqrt(n), among(_PLAIN), among(_FORMAL), among(_LINKS),
        count(",") * per, count(";") * per, (count("(") + count("[")) * per, count("?") * per, count("!") * per, count("-") * per,
        sum(times for word, times in counts.items() if word.isdigit()) * per, (len(raw) - len(raw.translate(None, _UPPER))) / max(1, letters),
        sum(shared) / max(1, len(shared)), max(shared, default=0.0), count("\n") * per, 0.39 * n / m + 11.8 * sound * per - 15.59,
        (sum(map(counts.__getitem__, _ENGLISH)) - sum(map(counts.__getitem__, _OTHER))) * per,  # no feature: which language it is
    ])


@dataclass
class Trees:
    """Regression trees of equal depth as arrays: feature and cut of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, depth: int = 3, rate: float = 0.08, bins: int = 32, least: int = 8,
            seed: int = 11) -> Trees:
    """Least-squares gradient boosting on binned features."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    now = np.full(len(y), y.mean())
    features, cuts, values = [], [], []
    width = bins + 1
    offset = np.arange(x.shape[1]) * width
    for _ in range(rounds):
        take = np.flatnonzero(rng.random(len(y)) < 0.8) if len(y) > 50 else np.arange(len(y))
        rest = (y - now)[take]
        grid = coded[take] + offset
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(take), np.int64)
        for at in range(inner):
            inside = node == at
            if inside.sum() < 2 * least:
                node[inside] = 2 * at + 1
                continue
            flat = grid[inside].ravel()
            r = np.repeat(rest[inside], x.shape[1])
            total = np.bincount(flat, weights=r, minlength=x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
            number = np.bincount(flat, minlength=x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
            all_, m = total[:, -1:], number[:, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = total**2 / number + (all_ - total) ** 2 / (m - number)
            gain[(number < least) | (m - number < least)] = -np.inf
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if not np.isfinite(gain[f, b]) or b >= len(edges[f]):
                node[inside] = 2 * at + 1
                continue
            feature[at], cut[at] = f, edges[f][b]
            node[inside] = 2 * at + 1 + (coded[take][inside, f] > b)
        place = node - inner
        number = np.bincount(place, minlength=leaves)
        leaf = rate * np.bincount(place, weights=rest, minlength=leaves) / (number + 1.0)
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
        one = Trees(0.0, np.array([feature]), np.array([cut]), np.array([leaf]))
        now += one.predict(x)
    return Trees(float(y.mean()), np.array(features), np.array(cuts), np.array(values))


@dataclass
class Grader:
    """Trees, a calibration line (slope, level) for each source, and held-out errors; the line of no source is under ``None``."""

    trees: Trees
    lines: dict[str | None, tuple[float, float]]
    report: dict[str, float]
    graded: dict[str, int]

    def grade(self, x: np.ndarray, sources: list[str]) -> np.ndarray:
        """Grades of measured texts; a source without graded documents has the line of all."""
        line = np.array([self.lines.get(s, self.lines[None]) for s in sources])
        return np.clip(line[:, 1] + line[:, 0] * self.trees.predict(x[:, :-1]), 1.0, 5.0)


def _line(out: np.ndarray, y: np.ndarray, lean: tuple[float, float], weight: float) -> tuple[float, float]:
    """Least-squares slope and level, leaning on another line as if on ``weight`` documents spread as these are."""
    if not len(y):
        return lean
    slope, level = lean
    centre, n = out.mean(), len(y)
    spread = max(float(((out - centre) ** 2).mean()), 0.05)
    cross = float(((out - centre) * (y - y.mean())).mean())
    new = (n * cross + weight * spread * slope) / (n * spread + weight * spread)
    new = min(max(new, 0.5), 2.0)
    middle = (n * y.mean() + weight * (level + slope * centre)) / (n + weight)
    return new, float(middle - new * centre)


def _lines(out: np.ndarray, y: np.ndarray, source: np.ndarray) -> dict[str | None, tuple[float, float]]:
    whole = _line(out, y, (1.0, 0.0), 1.0)
    return {None: whole} | {str(n): _line(out[source == n], y[source == n], whole, 30.0) for n in np.unique(source)}


def trained(x: np.ndarray, y: np.ndarray, source: np.ndarray) -> Grader:
    """Trees on all graded documents; lines from predictions for sources left out in turn; errors from nested folds.

    Each source is predicted by trees that saw none of it.  Its line, and that
    of all, are fitted on four fifths of the documents and the errors measured
    on the fifth left out, in turn.
    """
    x = x[:, :-1]
    out = np.full(len(y), y.mean())
    names = np.unique(source)
    for name in names:
        inside = source == name
        if (~inside).sum() >= 20:
            out[inside] = boosted(x[~inside], y[~inside], rounds=80).predict(x[inside])
    error = np.zeros(len(y))
    fold = np.random.default_rng(5).permutation(len(y)) % 5
    for k in range(5):
        test = fold == k
        lines = _lines(out[~test], y[~test], source[~test])
        line = np.array([lines.get(str(s), lines[None]) for s in source[test]]).reshape(-1, 2)
        error[test] = np.abs(np.clip(line[:, 1] + line[:, 0] * out[test], 1, 5) - y[test])
    report = {str(n): float(error[source == n].mean()) for n in names} | {"all": float(error.mean())}
    return Grader(boosted(x, y), _lines(out, y, source), report, {str(n): int((source == n).sum()) for n in names})


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [(k, m) for k, t in zip(keys, texts) if t and (m := measure(t)) is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.int64()), pa.array([m.tolist() for _, m in found], pa.list_(pa.float64()))], names=["doc_id", "x"])


def _graded(batches: Iterator[pa.RecordBatch], grader: Grader) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows = [measure(t) if t else None for t in texts]
        some = [i for i, r in enumerate(rows) if r is not None]
        grades: list[float | None] = [None] * len(rows)
        english: list[bool | None] = [None] * len(rows)
        if some:
            for i, g in zip(some, grader.grade(np.stack([rows[i] for i in some]), [sources[i] or "" for i in some])):
                grades[i], english[i] = float(g), bool(rows[i][-1] >= 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], pa.array(grades, pa.float64()), pa.array(english, pa.bool_())],
                                         names=["doc_id", "source", "cik", "grade", "english"])


def grader_of(documents: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Grader | None:
    """Fit on graded documents, at most about ``max_labels`` of them chosen by a hash of the id.

    A document's grade is the mean over its raters of the given level less
    the rater's own bias, estimated from the documents that several graded.
    """
    given = labels.where("doc_id is not null and rater is not null and reading_level is not null").groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("level"))
    mean = given.groupBy("doc_id").agg(F.avg("level").alias("mean"), F.count(F.lit(1)).alias("n"))
    both = given.join(mean, "doc_id")
    bias = both.where("n > 1").groupBy("rater").agg((F.sum(F.col("level") - F.col("mean")) / (F.count(F.lit(1)) + F.lit(10.0))).alias("bias"))
    target = given.join(bias, "rater", "left").groupBy("doc_id").agg(F.avg(F.col("level") - F.coalesce("bias", F.lit(0.0))).alias("y"))
    total = target.count()
    if total < 20:
        return None
    if total > max_labels:
        target = target.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_labels / total))
    chosen = documents.select("doc_id", "text", "source").join(F.broadcast(target), "doc_id")  # at most max_labels rows
    measured = chosen.select("doc_id", "text").mapInArrow(_measured, "doc_id long, x array<double>")
    rows = measured.join(F.broadcast(target), "doc_id").join(F.broadcast(chosen.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).distinct()), "doc_id")
    got = rows.select("doc_id", "x", "y", "source").orderBy("doc_id").toPandas()
    if len(got) < 20:
        return None
    return trained(np.stack(got["x"].to_numpy()), got["y"].to_numpy(), got["source"].to_numpy().astype(str))


def reading_levels(documents: DataFrame, labels: DataFrame, grader: Grader | None = None) -> DataFrame:
    """(doc_id, source, cik, grade, level, english): estimated difficulty of every document, 1 (young child) to 5 (specialist).

    ``grade`` is the estimate calibrated for the source and ``level`` its
    nearest whole number.  ``english`` is false where words of other languages
    outnumber English ones: the features are those of English, so such a grade
    says little.  Null, blank and wordless texts have null for all three; so have all
    texts when fewer than 20 documents are graded.  Whole texts are measured.
    """
    grader = grader or grader_of(documents, labels)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "cik")
    if grader is None:
        return base.drop("text").withColumns({"grade": F.lit(None).cast("double"), "level": F.lit(None).cast("int"), "english": F.lit(None).cast("boolean")})
    sent = documents.sparkSession.sparkContext.broadcast(grader)
    graded = base.mapInArrow(lambda it: _graded(it, sent.value), "doc_id long, source string, cik string, grade double, english boolean")
    return graded.select("doc_id", "source", "cik", "grade", F.round("grade").cast("int").alias("level"), "english")
