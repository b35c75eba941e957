"""Scalar functions on names, texts, JSON and numbers."""

from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions import text as T
from tidewell.plans.registry import Registry
from tidewell.sources import load

plans = Registry()

_LEGAL = "(" + ", ".join(f"'{w}'" for w in (*T.LEGAL_WORDS, "")) + ")"


def _normal(column: str) -> str:
    return f"string_split(trim(regexp_replace(replace(regexp_replace(lower({column}), '/.*$', ''), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ')"


@plans.query("name_norm", f"""
    WITH n AS (SELECT DISTINCT name FROM universe), w AS (SELECT name, unnest({_normal('name')}) AS w, generate_subscripts({_normal('name')}, 1) AS i FROM n)
    SELECT n.name, coalesce(string_agg(w.w, ' ' ORDER BY w.i) FILTER (w.w NOT IN {_LEGAL}), '') AS norm FROM n LEFT JOIN w USING (name) GROUP BY n.name""")
def name_norm(spark, folder):
    return load(spark, folder, "universe").select("name").distinct().select("name", T.normal_name(F.col("name")).alias("norm"))


@plans.query("name_jaccard", f"""
    WITH p AS (SELECT item, company, name FROM answer_key JOIN universe USING (ticker)),
    a AS (SELECT DISTINCT item, name, w FROM (SELECT item, name, unnest({_normal('company')}) AS w FROM p) WHERE w NOT IN {_LEGAL}),
    b AS (SELECT DISTINCT item, name, w FROM (SELECT item, name, unnest({_normal('name')}) AS w FROM p) WHERE w NOT IN {_LEGAL})
    SELECT item, name, round(count(*) FILTER (n = 2) / count(*), 6) AS jaccard FROM (SELECT item, name, w, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3) GROUP BY item, name""")
def name_jaccard(spark, folder):
    pairs = load(spark, folder, "answer_key").select("item", "company", "ticker").join(load(spark, folder, "universe").select("ticker", "name"), "ticker")
    return pairs.select("item", "name", F.round(T.jaccard(T.name_tokens(F.col("company")), T.name_tokens(F.col("name"))), 6).alias("jaccard"))


@plans.query("quote_grounding", r"""
    SELECT DISTINCT answer_id, (length(lower(trim(regexp_replace(clue, '\s+', ' ', 'g')))) >= 12 AND contains(lower(trim(regexp_replace(question, '\s+', ' ', 'g'))), lower(trim(regexp_replace(clue, '\s+', ' ', 'g'))))) AS grounded
    FROM answers WHERE clue IS NOT NULL AND question IS NOT NULL""")
def quote_grounding(spark, folder):
    rows = load(spark, folder, "answers").where("clue is not null and question is not null").select("answer_id", T.grounded(F.col("clue"), F.col("question")).alias("grounded"))
    return rows.distinct()


@plans.query("redacted_length", "SELECT doc_id, length(regexp_replace(text, '[0-9]+', '#', 'g')) AS chars FROM documents")
def redacted_length(spark, folder):
    return load(spark, folder, "documents").select("doc_id", F.length(T.masked(F.col("text"), "[0-9]+", "#")).cast("long").alias("chars"))


@plans.query("leak_counts", "SELECT doc_id, len(regexp_extract_all(text, '(?i)page [0-9]+')) AS pages, len(regexp_extract_all(text, '[0-9]{4}')) AS years FROM documents WHERE text IS NOT NULL")
def leak_counts(spark, folder):
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return load(spark, folder, "documents").where("text is not null").select("doc_id", count("(?i)page [0-9]+").alias("pages"), count("[0-9]{4}").alias("years"))


@plans.query("largest_number", """
    SELECT doc_id, max(try_cast(replace(x, ',', '') AS BIGINT)) AS largest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)', 1)) AS x FROM documents) GROUP BY doc_id""")
def largest_number(spark, folder):
    return load(spark, folder, "documents").select("doc_id", T.largest_number(F.col("text")).alias("largest")).where("largest is not null")


@plans.query("title_ladder", r"""
    SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\brecall\b') THEN 'recall' WHEN regexp_matches(lower(text), 'substantial doubt|going concern') THEN 'distress'
      WHEN regexp_matches(lower(text), 'resigned|retired|agreed to separate|terminated') THEN 'departure' WHEN regexp_matches(lower(text), 'purchase price|acquisition') THEN 'deal' ELSE 'misc' END AS rung FROM documents WHERE text IS NOT NULL""")
def title_ladder(spark, folder):
    rung = T.ladder(F.col("text"), (r"\brecall\b", "recall"), ("substantial doubt|going concern", "distress"), ("resigned|retired|agreed to separate|terminated", "departure"), ("purchase price|acquisition", "deal"))
    return load(spark, folder, "documents").where("text is not null").select("doc_id", rung.alias("rung"))


@plans.query("excerpt_around", """
    SELECT doc_id, CASE WHEN p > 0 THEN substring(text, greatest(p - 40, 1), p - greatest(p - 40, 1) + 80) ELSE '' END AS excerpt FROM (SELECT doc_id, text, strpos(lower(text), 'settlement') AS p FROM documents WHERE text IS NOT NULL)""")
def excerpt_around(spark, folder):
    return load(spark, folder, "documents").where("text is not null").select("doc_id", T.around(F.col("text"), "settlement", 40, 80).alias("excerpt"))


@plans.query("cued_words", r"""
    SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(?s)(?:lease|leasing).{0,120}\bfeet\b|\bfeet\b.{0,120}(?:lease|leasing)')""")
def cued_words(spark, folder):
    return load(spark, folder, "documents").where(T.cued(F.col("text"), "feet", "lease|leasing", 120)).select("doc_id")


@plans.query("json_payload", "SELECT event_id, (props::JSON ->> 'k')::INTEGER AS k FROM events")
def json_payload(spark, folder):
    return load(spark, folder, "events").select("event_id", T.embedded_json(F.col("props"), "k int")["k"].alias("k"))


@plans.query("case_payload", "SELECT DISTINCT case_id, selection_json::JSON ->> 'rule' AS rule, selection_json::JSON ->> 'ticker' AS ticker FROM experiment_cases")
def case_payload(spark, folder):
    parsed = T.embedded_json(F.col("selection_json"), "rule string, ticker string")
    return load(spark, folder, "experiment_cases").select("case_id", parsed.alias("p")).select("case_id", "p.rule", "p.ticker").distinct()


_SOFTMAX = " UNION ALL ".join(
    f"SELECT p_partkey, {i} AS i, '{n}' AS name, exp(-abs(p_size - {size}) / 8.0::DOUBLE) + exp(-abs(p_retailprice - {price}) / 200.0::DOUBLE) + CASE WHEN contains(lower(p_name), '{word}') THEN 3.0 ELSE 0 END::DOUBLE AS s FROM part"
    for i, (n, size, price, word) in enumerate((("small", 10, 1000, "5"), ("middle", 25, 1200, "77"), ("large", 40, 1500, "9"))))


@plans.query("softmax_classes", f"""
    WITH s AS ({_SOFTMAX}), e AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS q, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, i) AS k FROM s WINDOW w AS (PARTITION BY p_partkey))
    SELECT p_partkey, CASE WHEN max(q) < 0.5 THEN 'unknown' ELSE min(name) FILTER (k = 1) END AS class, round(max(q), 6) AS confidence, round(max(q) - max(q) FILTER (k = 2), 6) AS margin FROM e GROUP BY p_partkey""")
def softmax_classes(spark, folder):
    parts = load(spark, folder, "part")
    score = lambda size, price, tag: N.closeness(F.col("p_size"), size, 8.0) + N.closeness(F.col("p_retailprice"), price, 200.0) + F.when(F.lower("p_name").contains(tag), 3.0).otherwise(0.0)
    label, confidence, margin = N.softmax_label({"small": score(10, 1000, "5"), "middle": score(25, 1200, "77"), "large": score(40, 1500, "9")}, floor=0.5)
    return parts.select("p_partkey", label.alias("class"), F.round(confidence, 6).alias("confidence"), F.round(margin, 6).alias("margin"))


@plans.query("return_kinds", """
    SELECT DISTINCT signal_id, round(stock_return - 0.05::DOUBLE, 6) AS excess, round((1 + stock_return) / 1.05::DOUBLE - 1, 6) AS relative,
      round(ln(greatest(least(downside_probability / 100, 0.9999::DOUBLE), 0.0001::DOUBLE) / (1 - greatest(least(downside_probability / 100, 0.9999::DOUBLE), 0.0001::DOUBLE))), 6) AS logit FROM p_plus20_current WHERE NOT isnan(stock_return)""")
def return_kinds(spark, folder):
    rows = load(spark, folder, "p_plus20_current").where("stock_return is not null and not isnan(stock_return)")
    bench = F.lit(0.05)
    return rows.select("signal_id", F.round(N.excess(F.col("stock_return"), bench), 6).alias("excess"), F.round(N.relative(F.col("stock_return"), bench), 6).alias("relative"),
                       F.round(N.logit(F.col("downside_probability") / 100), 6).alias("logit")).distinct()


@plans.query("growth_rates", """
    WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(v, 2) OVER (PARTITION BY k ORDER BY year) AS b FROM y)
    SELECT k, year, round(pow(v / b, 0.5) - 1, 6) AS growth FROM l WHERE b IS NOT NULL""")
def growth_rates(spark, folder):
    from pyspark.sql import Window

    yearly = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    rows = yearly.withColumn("b", F.lag("v", 2).over(Window.partitionBy("k").orderBy("year"))).where("b is not null")
    return rows.select("k", "year", F.round(N.growth(F.col("v"), F.col("b"), 2), 6).alias("growth"))
