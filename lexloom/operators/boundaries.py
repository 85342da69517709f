"""Sentence boundaries learned from the corpus: abbreviations and frequent starters of sentences by log-likelihood, as aggregates over all texts.

A token ends a sentence if it ends with a closing mark, unless that is a period that belongs to it. Whether it does is learned: a type is an abbreviation if it stands with a period more
often than chance lets periods stand after words, weighed by its length, its inner periods and its occurrences without one. After an abbreviation a sentence still ends if what follows is one of
the words that often begin sentences, and isn't written small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the method: the score from which a type is an abbreviation, the log-likelihood from which a word is a starter, the longest abbreviation.
ABBREVIATION, STARTER, LONGEST = 0.3, 30.0, 20
_MARKS = r"[.!?…][)\]\"'”’]*$"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _type(token: Column) -> Column:
    """A token in lower case without edging marks and its last period."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), r"^[(\[\"'„“]+|[)\]\"'”’,;:!?…]+$", ""), r"\.$", "")


def _bernoulli(k: Column, n: Column, p: Column) -> Column:
    """log of p^k (1 - p)^(n - k)."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def type_counts(texts: DataFrame) -> DataFrame:
    """(type, with_period, without) of the letters-only types, inner periods allowed, in texts (id, text)."""
    # what is equal is counted before it is looked at
    tokens = texts.select(F.explode(_tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rows = tokens.select(_type(F.col("t")).alias("type"), F.col("t").rlike(r"\.[)\]\"'”’]*$").alias("period"), "n").where(F.col("type").rlike(r"^\p{L}[\p{L}.]*$"))
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("type").agg(of(F.col("period")).alias("with_period"), of(~F.col("period")).alias("without"))


def abbreviations(texts: DataFrame) -> DataFrame:
    """(type, score) of the types that are abbreviations."""
    counts = type_counts(texts)
    total = counts.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without")).alias("all"))
    rows = counts.where((F.col("with_period") > 0) & (F.char_length("type") <= LONGEST)).join(F.broadcast(total))
    k, n = F.col("with_period").cast("double"), (F.col("with_period") + F.col("without")).cast("double")
    likelihood = -2 * (_bernoulli(k, n, F.col("periods") / F.col("all")) - _bernoulli(k, n, F.lit(0.99)))
    inner = F.char_length("type") - F.char_length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.char_length("type") - inner).cast("double")
    score = likelihood * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("without").cast("double"))
    return rows.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def starters(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(type, likelihood) of the words that follow a sure end (a mark after no abbreviation) more often than chance; capitalised there."""
    words = _tokens(F.col("text"))
    pair = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(_type(F.col("w")[i - 1]).alias("before"), F.col("w")[i - 1].rlike(_MARKS).alias("mark"), F.col("w")[i].alias("word")))
    rows = texts.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pair).alias("p")).select("p.*").withColumn("type", _type(F.col("word"))).where(F.col("type").rlike(r"^\p{L}+$"))
    rows = rows.withColumn("before", F.when(F.col("mark"), F.col("before")))  # what comes before matters only at a mark
    counts = rows.groupBy("before", "mark", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("word").rlike(r"^[(\[\"'„“]*\p{Lu}")).alias("large"))
    names = found.select(F.col("type").alias("before"), F.lit(True).alias("abbreviation"))
    counts = counts.join(names, "before", "left").withColumn("end", F.col("mark") & F.col("abbreviation").isNull())
    by = counts.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("end"), F.col("large")).otherwise(0)).alias("k"))
    total = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("end"), F.col("n")).otherwise(0)).alias("ends"))
    rows = by.join(F.broadcast(total)).where("k > 0")
    k, n, ends, every = (F.col(c).cast("double") for c in ("k", "n", "ends", "all"))
    # how often the word follows an end, against its share of all words
    p, p1, p2 = n / every, k / ends, (n - k) / F.greatest(every - ends, F.lit(1.0))
    likelihood = -2 * (_bernoulli(k, ends, p) + _bernoulli(n - k, every - ends, p) - _bernoulli(k, ends, p1) - _bernoulli(n - k, every - ends, p2))
    return rows.select("type", likelihood.alias("likelihood"), p1.alias("_p1"), p.alias("_p")).where((F.col("likelihood") >= STARTER) & (F.col("_p1") > F.col("_p"))).select("type", "likelihood")


def learned_sentences(texts: DataFrame, found: DataFrame, begin: DataFrame) -> DataFrame:
    """(id, sentences): texts (id, text), each line split at ends that found (type) and begin (type) leave, trimmed, without empty ones; a null text has none. Each id once.

    Only the tokens with a period that could be an abbreviation's are joined with the learned types; what comes back to a text is the list of places where it isn't to be split.
    """
    rows = texts.select("id", F.col("text")).withColumn("w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+|\n)"), 1))
    period = F.filter(F.transform("w", lambda t, i: F.when(t.rlike(r"\.[)\]\"'”’]*$"), i)), lambda i: i.isNotNull())
    place = F.transform(period, lambda i: F.struct(i.alias("at"), _type(F.get("w", i)).alias("type"), F.get("w", i + 1).alias("next")))
    near = rows.select("id", F.explode(place).alias("p")).select("id", "p.*")
    first = begin.select(F.col("type").alias("_b"), F.lit(True).alias("starts"))
    held = near.join(found.select("type"), "type", "left_semi").withColumn("_n", _type(F.coalesce("next", F.lit("")))).join(first, F.col("_n") == F.col("_b"), "left")
    large = F.col("next").rlike(r"^[(\[\"'„“]*\p{Lu}")
    stay = held.where(~(F.coalesce("starts", F.lit(False)) & F.coalesce(large, F.lit(False)))).groupBy("id").agg(F.collect_set("at").alias("stay"))
    rows = rows.join(stay, "id", "left").withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))
    # lines and ends become breaks; a blank stands between other tokens
    joined = F.array_join(F.transform("w", lambda t, i: F.when(t == "\n", t).when(t.rlike(_MARKS) & ~F.array_contains("stay", i), F.concat(t, F.lit("\n"))).otherwise(F.concat(t, F.lit(" ")))), "")
    return rows.select("id", F.filter(F.transform(F.split(joined, "\n"), lambda s: F.trim(s)), lambda s: s != "").alias("sentences"))
