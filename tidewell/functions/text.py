"""Text functions as columns."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal forms that a normalised company name is without.
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "nv", "sa", "ag", "llc", "lp", "holdings", "group", "the")


def normal_name(name: Column) -> Column:
    """Lower case, cut at a slash, ``&`` as ``and``, other signs as blanks, without legal forms."""
    low = F.regexp_replace(F.regexp_replace(F.lower(name), "/.*$", ""), "&", " and ")
    words = F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS) & (w != "")), " ")


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_name(name), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; null when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def grounded(quote: Column, source: Column, least: int = 12) -> Column:
    """The quote, white space folded and in lower case, stands in the source and is long enough."""
    needle = F.lower(compact(quote))
    return (F.length(needle) >= least) & F.lower(compact(source)).contains(needle)


def masked(text: Column, pattern: str, mask: str) -> Column:
    return F.regexp_replace(text, pattern, mask)


def plain_text(html: Column) -> Column:
    """HTML to text: scripts and styles dropped, block ends as line breaks, common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/tr|/h[1-6]|/li)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\u00A0]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def largest_number(text: Column) -> Column:
    """Greatest whole number among those written in a text, thousands separators allowed."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:,\d{3})+|\d+)"), 1)
    return F.array_max(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")))


def around(text: Column, word: str, before: int, after: int) -> Column:
    """The stretch of text around the first place of a word, empty without it."""
    at = F.instr(F.lower(text), F.lit(word)) if not isinstance(word, Column) else F.locate(word, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + after)).otherwise("")


def ladder(text: Column, *rungs: tuple[str, str], other: str = "misc") -> Column:
    """The name of the first rung whose pattern the text holds."""
    out = None
    for pattern, name in rungs:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, no blanks and ASCII escapes; null for what is not JSON.  Key order needs a parser: there is no built-in."""
    def one(value: str | None) -> str | None:
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def embedded_json(text: Column, schema: str) -> Column:
    """The first ``{`` to the last ``}`` of a text, read as JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def cued(text: Column, word: str, cue: str, reach: int) -> Column:
    """A word stands within ``reach`` characters of a cue, on either side."""
    return F.lower(text).rlike(rf"(?s)(?:{cue}).{{0,{reach}}}\b{word}\b|\b{word}\b.{{0,{reach}}}(?:{cue})")


def merged_windows(text: Column, pattern: str, before: int, after: int, gap: int, budget: int) -> Column:
    """Stretches around all places of a pattern, merged where at most ``gap`` characters part them, in order, cut at ``budget``.

    Empty without a place.  Places are counted on the whole text.
    """
    parts = F.split(F.lower(text), pattern)
    # Each part ends where a place begins; what lies between is told by the lengths of parts and places.
    hits = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)
    step = F.transform(F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("p"), hits.alias("h")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["h"]).alias("h")))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("runs"))

    def add(state: Column, x: Column) -> Column:
        place = state["at"] + x["p"]
        a, b = F.greatest(place - before, F.lit(0)), F.least(place + after, F.length(text))
        last = F.try_element_at(state["runs"], F.lit(-1))
        joined = F.concat(F.slice(state["runs"], 1, F.greatest(F.size(state["runs"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
        fresh = F.concat(state["runs"], F.array(F.struct(a.alias("a"), b.alias("b"))))
        return F.struct((place + x["h"]).alias("at"), F.when(a - last["b"] <= gap, joined).otherwise(fresh).alias("runs"))

    runs = F.aggregate(step, start, add)["runs"]
    pieces = F.transform(runs, lambda r: F.substring(text, r["a"] + 1, r["b"] - r["a"]))
    return F.when(F.size(hits) > 0, F.substring(F.array_join(pieces, "\n...\n"), 1, budget)).otherwise("")


def redacted(text: Column, names: Column, mask: str = "[ISSUER]", digits: str = "[ISSUER_ID]") -> Column:
    """The text without the row's own names, the longest first.

    A name of digits is masked as an identifier; one of at most six letters
    only as a whole word; another also by its first word if that has seven
    letters or more.  Letters match in either case.
    """
    ordered = F.array_sort(F.filter(names, lambda n: F.length(F.trim(n)) > 1), lambda a, b: F.length(b) - F.length(a))
    quoted = lambda n: F.concat(F.lit("\\Q"), F.replace(F.trim(n), F.lit("\\E"), F.lit("")), F.lit("\\E"))

    def step(out: Column, name: Column) -> Column:
        core = F.split(F.trim(name), "[^A-Za-z0-9]+")[0]
        short = F.length(F.trim(name)) <= 6
        bound = F.concat(F.lit("(?i)\\b"), quoted(name), F.lit("\\b"))
        loose = F.concat(F.lit("(?i)"), quoted(name), F.when(F.length(core) >= 7, F.concat(F.lit("|\\b"), quoted(core), F.lit("\\b"))).otherwise(""))
        return F.when(F.trim(name).rlike("^[0-9]+$"), F.regexp_replace(out, bound, F.lit(digits))).otherwise(F.regexp_replace(out, F.when(short, bound).otherwise(loose), F.lit(mask)))

    return F.aggregate(ordered, text, step)


def capital_phrases(text: Column) -> Column:
    """Runs of two to five capitalised words."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+){1,4})\b"), 1)


def surviving(text: Column, name: Column, ticker: Column) -> Column:
    """How often the first word of a name (seven letters or more) or the ticker as a whole word stands in a text."""
    core = F.lower(F.split(F.trim(name), "[^A-Za-z0-9]+")[0])
    long = F.when(F.length(core) >= 7, (F.length(text) - F.length(F.replace(F.lower(text), core, F.lit("")))) / F.length(core)).otherwise(0)
    code = F.when(F.length(F.trim(ticker)) > 1, F.size(F.split(text, F.concat(F.lit("\\b\\Q"), F.trim(ticker), F.lit("\\E\\b")), -1)) - 1).otherwise(0)
    return (F.coalesce(long, F.lit(0)) + F.coalesce(code, F.lit(0))).cast("int")


def firm_of_title(title: Column) -> Column:
    """What stands before the verb of a notice title, without a town after it."""
    head = F.split(title, r"(?i)\b(?:recalls?|announces?|issues?|expands?)\b", 2)[0]
    return F.trim(F.regexp_replace(head, r",\s+of\s+.*$", ""))
