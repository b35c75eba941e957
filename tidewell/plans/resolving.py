"""Names resolved to an index, redaction by row, phrases, excerpts; samples, sweeps and files."""

from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions import text as T
from tidewell.operators import resolve as V
from tidewell.operators import topk as K
from tidewell.plans.registry import Registry
from tidewell.sources import files, load

plans = Registry()

_NORM = "trim(regexp_replace(' ' || trim(regexp_replace(replace(regexp_replace(lower({0}), '/.*$', ''), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ', ' +', '  ', 'g'))"
_LEGAL = "[" + ", ".join(f"'{w}'" for w in T.LEGAL_WORDS) + "]"
_TOKENS = "list_filter(string_split(trim(regexp_replace(replace(regexp_replace(lower({0}), '/.*$', ''), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains(" + _LEGAL + ", w))"
_RAW = "list_has_any(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), " + _LEGAL + ")"
_UNIQUE = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


@plans.query("name_resolution", f"""
    WITH q0 AS (SELECT DISTINCT name AS q, {_TOKENS.format('name')} AS l, {_RAW.format('name')} AS legal, regexp_matches(lower(name), '\\b(fund|funds|etf|trust)\\b') AS fund FROM alias_golden WHERE name IS NOT NULL),
    q AS (SELECT q, array_to_string(l, ' ') AS norm, {_UNIQUE.format('l')} AS qt, legal, fund, len({_UNIQUE.format('l')}) AS n FROM q0),
    i0 AS (SELECT DISTINCT cik AS k, name, {_TOKENS.format('name')} AS l FROM universe), i AS (SELECT k, name, array_to_string(l, ' ') AS norm, {_UNIQUE.format('l')} AS it FROM i0),
    o AS (SELECT t, count(*) AS owners FROM (SELECT DISTINCT k, unnest(it) AS t FROM i) GROUP BY t), e AS (SELECT norm, min(k) AS exact FROM i GROUP BY norm),
    p AS (SELECT q, k, name, len(list_intersect(qt, it)) AS s, len(qt) AS a, len(it) AS b, qt[1] = it[1] AS same FROM q, i WHERE list_has_any(qt, it)), j AS (SELECT *, s / (a + b - s)::DOUBLE AS j FROM p),
    c AS (SELECT q, count(DISTINCT k) AS many, arg_min(k, {{'j': -j, 'k': k}}) AS ck, max(j) AS cj FROM j WHERE s = a OR s = b GROUP BY q),
    f AS (SELECT q, same, arg_min({{'k': k, 'j': j}}, {{'j': -j, 'n': name, 'k': k}}) AS f FROM j WHERE j >= 0.6::DOUBLE GROUP BY q, same),
    m AS (SELECT q.*, exact, coalesce(owners, 0) AS sole, many, ck, cj, x.f AS inside, y.f AS outside, qt[1] IN (SELECT it[1] FROM i WHERE len(it) > 0) AS bucket FROM q LEFT JOIN e ON e.norm = q.norm AND q.norm <> '' LEFT JOIN o ON o.t = qt[1] LEFT JOIN c USING (q)
      LEFT JOIN f x ON x.q = q.q AND x.same LEFT JOIN f y ON y.q = q.q AND NOT y.same),
    r AS (SELECT q, n, legal, CASE WHEN exact IS NOT NULL THEN CASE WHEN NOT (n = 1 AND NOT legal AND sole >= 2) THEN {{'k': exact, 'label': 'exact'}} END WHEN fund OR (n = 1 AND NOT legal AND sole <> 1) OR n = 0 THEN NULL
      WHEN many IS NOT NULL THEN CASE WHEN many = 1 OR n > 1 THEN {{'k': ck, 'label': 'containment_' || format('{{:.2f}}', cj)}} END WHEN n = 2 AND NOT legal THEN NULL
      WHEN bucket AND inside IS NOT NULL THEN {{'k': inside.k, 'label': 'fuzzy_' || format('{{:.2f}}', inside.j)}} WHEN NOT coalesce(bucket, false) AND (n > 2 OR legal) AND outside IS NOT NULL THEN {{'k': outside.k, 'label': 'fuzzy_' || format('{{:.2f}}', outside.j)}} END AS f FROM m)
    SELECT q AS name, f.k AS cik, f.label AS label FROM r""")
def name_resolution(spark, folder):
    return V.resolved(load(spark, folder, "alias_golden"), load(spark, folder, "universe"), name="name", index_name="name", key="cik")


@plans.query("merged_excerpts")
def merged_excerpts(spark, folder):
    """Stretches around ``shares`` and ``notice``, merged and cut to a budget; tested against a plain walk."""
    docs = load(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", T.merged_windows(F.col("text"), "shares|notice", 60, 140, 25, 2_000).alias("excerpt"))


@plans.query("redacted_by_row")
def redacted_by_row(spark, folder):
    """Documents without their own issuer's names and cik; tested by row."""
    names = load(spark, folder, "universe").where("cik is not null").groupBy("cik").agg(F.collect_set("name").alias("n"), F.collect_set("ticker").alias("t"))
    docs = load(spark, folder, "documents").where("text is not null").select("doc_id", "cik", "text").join(names, "cik", "left")
    mine = F.concat(F.coalesce("n", F.array().cast("array<string>")), F.coalesce("t", F.array().cast("array<string>")), F.array_compact(F.array("cik")))
    return docs.select("doc_id", T.redacted(F.col("text"), mine).alias("text"))


@plans.query("frequent_phrases", r"""
    WITH p AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+(?: [A-Z][a-z]+){1,4})\b', 1)) AS phrase FROM documents WHERE text IS NOT NULL), c AS (SELECT source, phrase, count(*) AS n, count(DISTINCT doc_id) AS documents FROM p GROUP BY 1, 2)
    SELECT source, phrase, n, documents FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, phrase) AS k FROM c) WHERE k <= 240""".replace("\\\\b", "\\b"))
def frequent_phrases(spark, folder):
    """The 240 most frequent capitalised phrases of each source."""
    docs = load(spark, folder, "documents").where("text is not null")
    counts = docs.select("source", "doc_id", F.explode(T.capital_phrases(F.col("text"))).alias("phrase")).groupBy("source", "phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))
    return K.top_per_group(counts, group="source", order=[F.desc("n"), "phrase"], k=240)


@plans.query("surviving_identifiers", r"""
    WITH u AS (SELECT cik, min(name) AS name, min(ticker) AS ticker FROM universe GROUP BY cik), d AS (SELECT doc_id, text, lower(string_split_regex(trim(name), '[^A-Za-z0-9]+')[1]) AS core, ticker FROM documents JOIN u USING (cik) WHERE text IS NOT NULL)
    SELECT doc_id, (CASE WHEN length(core) >= 7 THEN (length(text) - length(replace(lower(text), core, ''))) // length(core) ELSE 0 END + len(string_split_regex(text, '\b' || ticker || '\b')) - 1)::INTEGER AS identifiers FROM d""".replace("\\\\b", "\\b"))
def surviving_identifiers(spark, folder):
    names = load(spark, folder, "universe").groupBy("cik").agg(F.min("name").alias("name"), F.min("ticker").alias("ticker"))
    docs = load(spark, folder, "documents").where("text is not null").select("doc_id", "cik", "text").join(names, "cik")
    return docs.select("doc_id", T.surviving(F.col("text"), F.col("name"), F.col("ticker")).alias("identifiers"))


@plans.query("hash_sample", "SELECT DISTINCT case_id FROM experiment_cases WHERE md5_number(case_id) % 15 = 0")
def hash_sample(spark, folder):
    """Every fifteenth case by the remainder of its MD5, taken digit by digit (the sample is the operator)."""
    return K.hash_sample(load(spark, folder, "experiment_cases").select("case_id").distinct(), ident="case_id", modulus=15)


@plans.query("round_robin_sample", """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || doc_id), doc_id) AS k FROM documents), o AS (SELECT doc_id, source, row_number() OVER (ORDER BY k, source) AS n FROM r) SELECT doc_id, source FROM o WHERE n <= 100""")
def round_robin_sample(spark, folder):
    """A hundred documents, one of each source in turn (the limit is the operator)."""
    return K.round_robin(load(spark, folder, "documents").select("doc_id", "source"), stratum="source", ident="doc_id", k=100, seed=5)


@plans.query("basket_sweep", """
    WITH s AS (SELECT DISTINCT signal_id, downside_probability AS p, stock_return AS y FROM p_plus20_current WHERE downside_probability IS NOT NULL AND stock_return IS NOT NULL AND NOT isnan(stock_return)), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, signal_id) AS k FROM s),
    z AS (SELECT unnest([5, 10, 20, 50]) AS size), b AS (SELECT size, max(p) FILTER (k = size) AS edge FROM z, r GROUP BY size)
    SELECT size::INTEGER AS size, round(avg(y) FILTER (k <= size), 6) AS mean, count(*) FILTER (p = edge) AS tied, count(*) FILTER (p = edge AND k > size) AS left_out FROM r, b GROUP BY size""")
def basket_sweep(spark, folder):
    """Baskets of several sizes, with the ties at their edge that are in and out."""
    rows = load(spark, folder, "p_plus20_current").where("downside_probability is not null and stock_return is not null and not isnan(stock_return)").select("signal_id", "downside_probability", "stock_return").distinct()
    return K.sweep(rows, score="downside_probability", ident="signal_id", value="stock_return", sizes=[5, 10, 20, 50]).withColumn("mean", F.round("mean", 6))


@plans.query("exploded_maps", "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) SELECT event_id, key, (props ->> ('$.' || key))::DOUBLE AS value FROM k")
def exploded_maps(spark, folder):
    """JSON objects as rows of key and value."""
    rows = load(spark, folder, "events").select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "value"))
    return rows.select("event_id", "key", "value")


@plans.query("kept_last", """
    SELECT signal_id, epoch_us(loaded_at) AS loaded, round(score, 6) AS score FROM (SELECT signal_id, loaded_at, score, row_number() OVER (PARTITION BY signal_id ORDER BY loaded_at DESC) AS k FROM p_plus20_current) WHERE k = 1""")
def kept_last(spark, folder):
    """The last load of each signal: one aggregation, no window; a NaN stays NaN, and of loads at one time the highest score stands.

    Scores are scaled and rounded as doubles, as the SQL does: halves of their decimals may fall otherwise.
    """
    rows = load(spark, folder, "p_plus20_current").groupBy("signal_id").agg(F.max(F.struct("loaded_at", "score")).alias("v"))
    score = F.col("v.score")
    rounded = F.when(F.abs(score * 1e6) < float("inf"), F.round(score * 1e6) / 1e6).otherwise(score)
    return rows.select("signal_id", F.unix_micros("v.loaded_at").alias("loaded"), rounded.alias("score"))


@plans.query("coerced_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, sum(l_extendedprice::DECIMAL(12, 2))::DOUBLE AS price FROM lineitem GROUP BY ALL")
def coerced_numbers(spark, folder):
    """Numbers written with thousands separators, read back."""
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.format_number("l_extendedprice", 2).alias("written"))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum(files.coerced(F.col("written")).cast("decimal(12,2)")).cast("double").alias("price"))


@plans.query("url_paths", "SELECT DISTINCT filing_id, regexp_extract(source_url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path, starts_with(source_url, 'archive:') AS archived FROM filing_records WHERE source_url IS NOT NULL")
def url_paths(spark, folder):
    rows = load(spark, folder, "filing_records").where("source_url is not null").select("filing_id", "source_url").distinct()
    return rows.select("filing_id", F.coalesce(F.regexp_extract("source_url", "^[a-z]+://[^/?#]+(/[^?#]*)", 1), F.lit("")).alias("path"), F.col("source_url").startswith("archive:").alias("archived"))


@plans.query("yearly_spread", "SELECT l_orderkey, l_linenumber, l_partkey, round(min(pow(1 + l_discount, 365.0::DOUBLE / (l_quantity + 30)) - 1), 6) AS annual FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL")
def yearly_spread(spark, folder):
    rows = load(spark, folder, "lineitem").where("l_quantity is not null")
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.round(F.min(N.annualised(F.col("l_discount"), F.col("l_quantity") + 30)), 6).alias("annual"))


@plans.query("vapour_deficit", "SELECT event_id, round(0.6108::DOUBLE * exp(17.27::DOUBLE * value / (value + 237.3::DOUBLE)), 4) AS kpa FROM events WHERE value BETWEEN -40 AND 60")
def vapour_deficit(spark, folder):
    return load(spark, folder, "events").where("value between -40 and 60").select("event_id", F.round(N.vapour_pressure(F.col("value")), 4).alias("kpa"))
