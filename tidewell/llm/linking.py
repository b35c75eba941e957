"""Typed names against registered ones: distinct words meet first, then names by word and agreeing parts, then pairs are scored.

No step forms all pairs of a group.  Words meet once, however many names hold
them.  A typed name of several own words is led by the one that the fewest
names share; a typed name of one own word meets one class of names that fit it
alike at a time, shown by two entities of the class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.names import (
    _BRACKET, _FORMAL, HEDGES, NOTHING, PLACES, Name, acceptable, acronyms, damerau_likeness, fit, lcs_likeness, parse, plain, spelled, split_words, unglued,
)
from tidewell.operators.bounded import join_bounded
from tidewell.session import scratch_path

_LIKENESS = {"lcs": lcs_likeness, "damerau": damerau_likeness}


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder: made once, read by column, kept when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out for work in Python, whose cost their bytes do not show."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _parts(sectors: set[str], relations: set[str], firsts: set[str]) -> list[str]:
    return [f"{s}|{r}|{f}" for s in sectors for r in relations for f in firsts]


def _formal(firsts: list[str]) -> set[str]:
    return set().union(*(_FORMAL.get(f, {f}) for f in firsts))


def index_forms(words: list[str]) -> set[tuple[str, str, str]]:
    """(own word, parts, class) of a registered name.

    Parts are those that ``fit`` lets a typed name give, or leave out.  Names
    of one class fit a typed name alike that has this own word and no other.
    """
    name = parse(words, exact=True)
    parts = _parts({"", *name.sectors}, {"", *name.relations}, {"", *(_formal(name.firsts) or {"-"})})
    joined = "".join(name.stems)
    alike = "|".join(map(str, (len(name.stems), name.joined, bool(name.relations), *sorted(set(name.firsts)), "/", *sorted(set(name.legal)))))
    return {(w, p, alike if w in name.stems else "joined " + " ".join(name.stems)) for w in {*name.stems, joined} if len(w) > 1 for p in parts}


def index_codes(words: list[str], tickers: list[str]) -> set[str]:
    """Tickers, acronyms and the whole of a registered name."""
    return {f"t:{t}" for t in tickers} | {f"a:{a}" for a in acronyms(words)} | {f"w:{' '.join(words)}"}


def readings(text: str, known: frozenset[str] | None = None) -> tuple[list[Name], str, str]:
    """(readings of a typed name, code it consists of, code in brackets beside it).

    ``known`` are words of it that registered names have as their own; without
    them a name of listed words alone is also read as if they were its own.
    """
    beside, bare = "", text
    if "(" in text or "[" in text:
        beside = next((c for c in (plain(b).strip().lower() for b in _BRACKET.findall(text)) if c.isalnum() and 1 < len(c) < 7), "")
        bare = _BRACKET.sub(lambda m: f" {m.group(1)} " if m.group(1).strip().lower() in PLACES else " ", text)
    every = split_words(bare)
    words = [w for w in every if w not in HEDGES]
    if " ".join(words) in NOTHING:
        return [], "", beside
    own = known or frozenset()
    made = [parse(words, own)]
    if any(len(s) > 9 for s in made[0].stems if s not in own) or not made[0].stems:
        apart = unglued(words, own)
        if apart != words:
            made.append(parse(apart, own))
    if known is None and not made[0].stems and len(words) > 1:
        made.append(parse(words, frozenset(w for w in words if len(w) > 4)))
    return made, spelled(every) or spelled(words), beside


_cache: dict = {}


def _remembered(key, make: Callable):
    if key not in _cache:
        if len(_cache) > 50_000:
            _cache.clear()
        _cache[key] = make()
    return _cache[key]


def _read(text: str, known: list[str] | None) -> tuple[list[Name], str, str]:
    own = None if known is None else frozenset(known)
    return _remembered((text, own), lambda: readings(text, own))


def query_forms(text: str, known: list[str] | None = None) -> set[tuple[int, int, str, str]]:
    """(reading, number of its own words, own word, parts) of a typed name.

    A company without its sector, relation or first name does not fit it; a
    first name also fits a company that has none.
    """
    out = set()
    for r, name in enumerate(_read(text, known)[0]):
        if acceptable(name):
            own = set(name.stems)
            firsts = {"-", *_formal(name.firsts)} if name.firsts else {""}
            parts = _parts(set(name.sectors) or {""}, set(name.relations) or {""}, firsts)
            out |= {(r, len(own), w, p) for w in own for p in parts}
    return out


def query_codes(text: str, known: list[str] | None = None) -> set[str]:
    """Codes that a typed name gives, and the whole of it."""
    _, code, beside = _read(text, known)
    return {f"{kind}:{code}" for kind in "ta" if code} | ({f"t:{beside}"} if beside else set()) | {f"w:{' '.join(split_words(text))}"}


_LISTED = pa.schema([("id", pa.int64()), ("entity", pa.string()), ("own", pa.string()), ("parts", pa.string()), ("class", pa.string())])
_ASKED = pa.schema([("id", pa.int64()), ("reading", pa.int32()), ("size", pa.int32()), ("word", pa.string()), ("parts", pa.string())])


def _emit_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, entity, name, tickers in zip(*[c.to_pylist() for c in batch.columns]):
            words = split_words(name)
            out += [(i, entity, *form) for form in index_forms(words)]
            out += [(i, entity, code, None, None) for code in index_codes(words, tickers)]
        yield _batch(out, _LISTED)


def _emit_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text, known in zip(*[c.to_pylist() for c in batch.columns]):
            out += [(i, *form) for form in query_forms(text, known)]
            out += [(i, 0, 0, code, None) for code in query_codes(text, known)]
        yield _batch(out, _ASKED)


def reference_names(reference: DataFrame) -> DataFrame:
    """(id, entity, name, tickers in lower case) of a reference list, each name of an entity once; null entities and names are left out."""
    rows = reference.where("entity is not null and name is not null").groupBy("entity", "name").agg(F.array_distinct(F.flatten(F.collect_set("tickers"))).alias("t"))
    return rows.select(F.xxhash64("entity", "name").alias("id"), "entity", "name", F.coalesce(F.transform("t", F.lower), F.array().cast("array<string>")).alias("tickers"))


def listed_forms(names: DataFrame) -> DataFrame:
    """(id, entity, own, parts, class) of ``reference_names`` and, with null parts, their codes."""
    return spread(names, "id").mapInArrow(_emit_listed, "id long, entity string, own string, parts string, class string")


def typed_values(values: DataFrame) -> DataFrame:
    """(id, value) of the distinct values that are neither null nor blank."""
    given = values.select(F.col("value").cast("string").alias("value")).where("value is not null and trim(value) <> ''").distinct()
    return given.withColumn("id", F.xxhash64("value")).select("id", "value")


def asked_forms(values: DataFrame) -> DataFrame:
    """(id, reading, size, word, parts) of (id, value, known) and, with null parts, their codes."""
    return spread(values.select("id", "value", "known"), "id").mapInArrow(_emit_asked, "id long, reading int, size int, word string, parts string")


def candidate_pairs(asked: DataFrame, listed: DataFrame, alike: DataFrame, plain_acronyms: bool) -> DataFrame:
    """(id, name_id, acronym): pairs of a typed and a registered name that may fit.

    ``alike`` holds (word, own) of distinct words.  ``acronym`` tells that an
    acronym led there; unless ``plain_acronyms`` only one that stands for a
    single entity and is nobody's own word does.
    """
    words = listed.where("parts is not null")
    forms = asked.where("parts is not null").join(alike, "word")
    # One own word: two entities of each class of names that fit alike.  A tie of the two is a tie of the class.
    ends = words.groupBy("own", "parts", "class").agg(F.min(F.struct("entity", "id")).alias("a"), F.max(F.struct("entity", "id")).alias("b"))
    shown = ends.select("own", "parts", F.explode(F.array_distinct(F.array("a.id", "b.id"))).alias("name_id"))
    single = forms.where("size = 1").select("id", "own", "parts").join(shown, ["own", "parts"]).select("id", "name_id")
    # Several own words: all must be met, and the rarest of them leads.
    held = words.groupBy("own", "parts").agg(F.count(F.lit(1)).alias("n"))
    met = forms.where("size > 1").join(held, ["own", "parts"])
    cost = met.groupBy("id", "reading", "size", "word").agg(F.sum("n").alias("n"))
    lead = cost.groupBy("id", "reading", "size").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "word")).alias("l")).where("met = size")
    led = met.join(lead.select("id", "reading", F.col("l.word").alias("word")), ["id", "reading", "word"]).select("id", "own", "parts").distinct()
    several = led.join(words.select("own", "parts", F.col("id").alias("name_id")), ["own", "parts"]).select("id", "name_id")
    codes = listed.where("parts is null").select("entity", F.col("id").alias("name_id"), F.col("own").alias("word"))
    if not plain_acronyms:
        short = codes.where("word like 'a:%'").join(words.select(F.concat(F.lit("a:"), "own").alias("word")).distinct(), "word", "left_anti")
        one = short.groupBy("word").agg(F.min("entity").alias("e"), F.max("entity").alias("f")).where("e = f").select("word")
        codes = codes.where("word not like 'a:%'").unionByName(short.join(one, "word").select("entity", "name_id", "word"))
    by_code = asked.where("parts is null").join(codes, "word").select("id", "name_id", F.col("word").startswith("a:").alias("acronym"))
    by_word = single.unionByName(several).withColumn("acronym", F.lit(False))
    return by_word.unionByName(by_code).groupBy("id", "name_id").agg(F.max("acronym").alias("acronym"))


def best_fit(text: str, company: str, tickers: list[str], acronym: bool) -> list[tuple[int, float]]:
    """[(rank, score)] of a pair, the best of all readings, or [] if it does not fit: by subsequence ratio."""
    made, code, beside = _read(text, None)
    words, name = _company(company)
    if code and code in tickers:
        return [(0, 9.0)]
    if acronym and not any(code in n.stems and len(code) > 5 for n in made):
        return [(0, 5.0)]
    found = [s for q in made if acceptable(q) and (s := fit(q, name, lcs_likeness)) is not None]
    best = max(found, default=None)
    # A name of listed words alone has no own word to fit; typed whole it is meant.
    if best is None and made and split_words(text) == words:
        best = 8.0
    if beside and beside in tickers:
        best = 4.0 if best is None else best + 1
    return [] if best is None else [(0, best)]


def ranked_fits(text: str, known: list[str], company: str, tickers: list[str], acronym: bool) -> list[tuple[int, float]]:
    """[(rank, score)] of a pair: a ticker before an acronym before the first reading that fits before a ticker in brackets; by edit distance."""
    made, code, beside = _read(text, known)
    words, name = _company(company)
    if code and code in tickers:
        return [(30, 9.0)]
    if acronym:
        return [(20, 9.0)]
    more = 1.0 if beside and beside in tickers else 0.0
    out = [(10 - r, s + more) for r, q in enumerate(made) if acceptable(q) and (s := fit(q, name, damerau_likeness)) is not None]
    if not out and made and split_words(text) == words:
        out = [(10, 8.0)]
    return out or ([(1, 9.0)] if more else [])


def _company(name: str):
    def make():
        words = split_words(name)
        return words, parse(words, exact=True)

    return _remembered((name,), make)


_SCORED = pa.schema([("value", pa.string()), ("entity", pa.string()), ("rank", pa.int32()), ("score", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, known, entity, name, tickers, acronym in zip(*[c.to_pylist() for c in batch.columns]):
            found = best_fit(text, name, tickers, acronym) if known is None else ranked_fits(text, known, name, tickers, acronym)
            out += [(text, entity, *f) for f in found]
        yield _batch(out, _SCORED)


def scored_pairs(pairs: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """(value, entity, rank, score) of candidate pairs; all of one typed value lie together, so that it is read once."""
    company = names.select(F.col("id").alias("name_id"), "entity", "name", "tickers")
    named = spread(join_bounded(pairs, company, "name_id", "inner", max_rows=100_000), "id")
    ready = named.join(values, "id").select("value", "known", "entity", "name", "tickers", "acronym").sortWithinPartitions("value")
    return ready.mapInArrow(_score, "value string, entity string, rank int, score double")


def decided(scored: DataFrame, margin: float, least: float) -> DataFrame:
    """(value, entity, score): the entity of the highest rank and score; a value whose second one lies within ``margin`` gives no row."""
    top = F.max("rank").over(Window.partitionBy("value"))
    best = scored.withColumn("top", top).where("rank = top").groupBy("value", "entity").agg(F.max("score").alias("score"))
    place = Window.partitionBy("value").orderBy(F.desc("score"), "entity")
    ranked = best.withColumn("place", F.row_number().over(place)).withColumn("next", F.lead("score").over(place))
    sure = (F.col("score") > least) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))
    return ranked.where((F.col("place") == 1) & sure).select("value", "entity", "score")


def alike_words(pairs: DataFrame, how: str) -> DataFrame:
    """The (word, own) pairs whose likeness (``lcs`` or ``damerau``) is not nought."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = _LIKENESS[how]
        for batch in batches:
            yield batch.filter(pa.array([likeness(a, b) > 0 for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    return pairs.select("word", "own").mapInArrow(keep, "word string, own string")
