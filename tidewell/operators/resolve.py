"""Names resolved to an index of companies: exact key, containment of words, shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import LEGAL_WORDS, jaccard, name_tokens, normal_name


def has_legal_word(name: Column) -> Column:
    """A legal form stands in the raw name."""
    return F.arrays_overlap(F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " "), F.array(*[F.lit(w) for w in LEGAL_WORDS]))


def resolved(names: DataFrame, index: DataFrame, *, name: str, index_name: str, key: str, ambiguous: tuple[str, ...] = (), least: float = 0.6) -> DataFrame:
    """(name, key, label) of each distinct name; key and label are null where nothing fits.

    In this order: the same normal form (``exact``; a single word without legal
    form must not be ambiguous nor belong to two keys); funds are nothing; the
    words of one name within those of the other (``containment_`` and the share
    of common words), which a single word without legal form needs an only
    owner for; a share of common words of at least ``least`` among names with
    the same first word, or among all if there are none and the name has more
    than two words or a legal form (``fuzzy_``).  Of equal fits the smallest key
    is taken, for fuzzy ones the first name.

    Every step is an equi-join: contained words are met by the rarest word of
    the contained side, common ones by the rarest words that must be shared.
    """
    typed = names.select(F.col(name).alias("q")).where("q is not null").distinct()
    typed = typed.select("q", normal_name(F.col("q")).alias("norm"), name_tokens(F.col("q")).alias("qt"), has_legal_word(F.col("q")).alias("legal"), F.lower("q").rlike(r"\b(fund|funds|etf|trust)\b").alias("fund"))
    typed = typed.withColumn("n", F.size("qt"))
    known = index.where(F.col(key).isNotNull() & F.col(index_name).isNotNull()).select(F.col(key).alias("k"), F.col(index_name).alias("name"), normal_name(F.col(index_name)).alias("inorm"), name_tokens(F.col(index_name)).alias("it")).distinct()
    tokens = known.select("k", F.explode("it").alias("t")).distinct().groupBy("t").agg(F.count(F.lit(1)).alias("owners"))
    exact = known.groupBy(F.col("inorm").alias("norm")).agg(F.min("k").alias("exact"))
    base = typed.join(exact, "norm", "left").join(tokens.withColumnRenamed("owners", "sole"), F.element_at(F.when(F.size("qt") > 0, F.col("qt")), 1) == F.col("t"), "left").drop("t")
    bare = (F.col("n") == 1) & ~F.col("legal")
    unclear = bare & (F.element_at(F.when(F.col("n") > 0, F.col("qt")), 1).isin(*ambiguous, "") | (F.coalesce("sole", F.lit(0)) >= 2))
    # The rarest words of both sides, by owners.
    def by_rarity(df: DataFrame, words: str, ident: list[str]) -> DataFrame:
        each = df.select(*ident, F.explode(words).alias("t")).join(tokens, "t", "left")
        return each.withColumn("r", F.row_number().over(Window.partitionBy(*ident).orderBy(F.coalesce("owners", F.lit(0)), "t")))

    seek = typed.where("n > 0").select("q", "qt", "n")
    mine, theirs = by_rarity(seek, "qt", ["q"]), by_rarity(known.where(F.size("it") > 0), "it", ["k", "name"])
    plain = known.select("k", "name", "it")
    inside = mine.where("r = 1").select("q", "t").join(theirs.select("t", "k", "name"), "t")  # the typed words within the name
    around = mine.select("q", "t").join(theirs.where("r = 1").select("t", "k", "name"), "t")  # the name within the typed words
    pairs = inside.unionByName(around).select("q", "k", "name").distinct().join(seek, "q").join(plain, ["k", "name"])
    shared = F.size(F.array_intersect("qt", "it"))
    contained = pairs.where((shared == F.size("qt")) | (shared == F.size("it"))).withColumn("j", jaccard(F.col("qt"), F.col("it")))
    held = contained.groupBy("q").agg(F.countDistinct("k").alias("many"), F.min_by("k", F.struct(-F.col("j"), F.col("k"))).alias("ck"), F.max("j").alias("cj"))
    # Names that share enough words with the typed one share one of its rarest.
    prefix = F.col("n") - F.ceil(F.col("n") * least) + 1
    wide = mine.join(seek.select("q", "n"), "q").where(F.col("r") <= prefix).select("q", "t").join(theirs.select("t", "k", "name"), "t").select("q", "k", "name").distinct()
    near = wide.join(seek, "q").join(plain, ["k", "name"]).withColumn("j", jaccard(F.col("qt"), F.col("it"))).withColumn("same", F.element_at("qt", 1) == F.element_at("it", 1))
    first = known.where(F.size("it") > 0).select(F.element_at("it", 1).alias("f")).distinct().withColumn("bucket", F.lit(True))
    scored = near.where(F.col("j") >= least).groupBy("q", "same").agg(F.min_by(F.struct("k", "j"), F.struct(-F.col("j"), F.col("name"), F.col("k"))).alias("b"))
    fuzzy = scored.groupBy("q").agg(F.max(F.when(F.col("same"), F.col("b"))).alias("in_bucket"), F.max(F.when(~F.col("same"), F.col("b"))).alias("outside"))
    met = base.join(held, "q", "left").join(fuzzy, "q", "left").join(first, F.element_at(F.when(F.col("n") > 0, F.col("qt")), 1) == F.col("f"), "left")
    wider = (F.col("n") > 2) | F.col("legal")
    loose = F.when(F.col("bucket"), F.col("in_bucket")).when(wider, F.col("outside"))
    short = F.col("n") <= 2
    found = (
        F.when(F.col("exact").isNotNull() & (F.col("norm") != ""), F.when(~unclear, F.struct(F.col("exact").alias("k"), F.lit("exact").alias("label"))))
        .when(F.col("fund") | (bare & (F.coalesce("sole", F.lit(0)) != 1)) | (F.col("n") == 0), F.lit(None))
        .when(F.col("many").isNotNull(), F.when((F.col("many") == 1) | (F.col("n") > 1), F.struct(F.col("ck").alias("k"), F.format_string("containment_%.2f", F.bround("cj", 2)).alias("label"))))
        .when(short & ~F.col("legal") & (F.col("n") == 2), F.lit(None))
        .when(loose.isNotNull(), F.struct(loose["k"].alias("k"), F.format_string("fuzzy_%.2f", F.bround(loose["j"], 2)).alias("label"))))
    return met.select(F.col("q").alias(name), found.alias("f")).select(name, F.col("f.k").alias(key), F.col("f.label").alias("label"))
