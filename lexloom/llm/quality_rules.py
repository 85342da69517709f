"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

A point is a rule and one of its fixed cutoffs. In each stratum (language) the points are put in an order, and the verdict after t
steps rejects what any of the first t points rejects, so that verdicts are nested. The order comes from the bad documents and a quarter of
the good ones (the tuning fold): most bad documents first, less PRICE for each good one; points that gain nothing are left out. The other good
documents are the holdout, which the order doesn't depend on. On it the verdicts are tested one after the other: step t holds
if the exact binomial bound shows that it rejects at most `risk` of the good documents, that is if the chance of as few false rejections as
were seen, at a rate of `risk`, is at most `error` divided by the number of strata; the first step that doesn't hold ends the tests.
Testing in a fixed order needs no correction within a stratum, Bonferroni's covers the strata: with confidence 1 - error no stratum loses more
than `risk` of its good documents. Of the steps that hold the one with most gain is taken. A stratum with too few labels to show
anything rejects nothing beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 8
#: Rules: a feature and the fixed cutoffs above which it may reject.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "repeat_share": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.28),
    "chars_per_word": (7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "capital_share": (0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "marks_per_word": (0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0),
}
RISK, ERROR = 0.03, 0.05
#: Falsely rejected good documents that one more rejected bad document is worth, at most.
PRICE = 20
#: Share of good documents that only order the points: those whose digest begins with a digit below this one, of sixteen.
TUNING_DIGIT = "4"
#: Strata up to which the cutoffs are broadcast (some 100 bytes each); a shuffled join beyond it.
BROADCAST_STRATA = 10_000
#: Labelled doc_ids up to which they are broadcast (8 bytes each).
BROADCAST_LABELS = 2_000_000


def features(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), stratum: Column | None = None) -> DataFrame:
    """carry columns, stratum, the base counts and the rules' features of each row; a null text counts as empty, texts of any length are taken whole.

    Columns named in carry may be any of docs; one that has a result's name gets the prefix "in_". The arrays are made in
    steps, and each is used more than once, so that the optimiser does not merge the steps and make them again for every element. Filter the
    result only after it is written, or by judge().
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if stratum is None else stratum
    taken = {"stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", *RULES}
    named = {c: f"in_{c}" if c in taken else c for c in carry}
    base, carry = docs.select(*(F.col(c).alias(n) for c, n in named.items()), stratum.alias("stratum"), text.alias("_t")), tuple(named.values())
    step = base.select("*", F.filter(F.split("_t", f"{SPACES}+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    size = F.size("_w")
    hashes = F.transform("_w", lambda w: F.xxhash64(w))
    step = step.select(
        *carry, "stratum", size.cast("long").alias("n_words"), (F.char_length("_t") - F.regexp_count("_t", F.lit(SPACES))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_upper"), F.regexp_count("_t", F.lit("[!?.,;:]")).alias("_marks"), F.when(size >= REPEAT_WINDOW, hashes).alias("_h"),
    )
    starts = F.expr(f"sequence(1, size(_h) - {REPEAT_WINDOW - 1})")
    step = step.select("*", F.when(F.size("_h") >= REPEAT_WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_h", i, REPEAT_WINDOW)))).alias("_x")).drop("_h")
    # only rows with a window that occurs twice sort theirs
    twice = F.size(F.array_distinct("_x")) < F.size("_x")
    step = step.select("*", F.when(twice, F.array_sort(F.transform("_x", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s")).drop("_x")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before, after = F.concat(none, F.slice("_s", F.lit(1), F.size("_s") - 1)), F.concat(F.slice("_s", F.lit(2), F.size("_s") - 1), none)
    same = F.zip_with(F.zip_with("_s", before, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), after, lambda x, c: F.when((x["a"]["h"] == x["b"]["h"]) | (x["a"]["h"] == c["h"]), x["a"]["i"]))
    covered = F.aggregate(
        F.array_sort(F.filter(same, lambda i: i.isNotNull())), F.struct(F.lit(-REPEAT_WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(REPEAT_WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"],
    )
    step = step.select("*", F.when(F.col("_s").isNotNull() & (F.size("_s") > 0), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")).drop("_s")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return step.select(
        *carry, "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbols_per_word"), (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("chars_per_word"), (F.col("_upper") / chars).alias("capital_share"), (F.col("_marks") / words).alias("marks_per_word"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly: the terms follow from one another in logarithms."""
    first = n * F.log(F.lit(1 - p))
    odds = p / (1 - p)
    zero = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i * odds)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(steps, zero, add, lambda acc: acc["sum"]))


#: The points, in natural order.
POINTS = [(rule, float(cut)) for rule, cuts in RULES.items() for cut in cuts]


def tuning(doc_id: Column) -> Column:
    """Whether a good document belongs to the tuning fold."""
    return F.coalesce(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1) < TUNING_DIGIT, F.lit(False))


def ordered_points(labelled: DataFrame) -> DataFrame:
    """(o_stratum, ranks): for each point its place in the stratum's order, from 1; null where it gains nothing.

    labelled: stratum, the features, good, tune. One pass of partial sums, then some tens of rows a stratum.
    """
    sums = []
    for j, (rule, cut) in enumerate(POINTS):
        hit = F.col(rule) > cut
        sums.append((F.count_if(hit & ~F.col("good")) - PRICE * F.count_if(hit & F.col("good") & F.col("tune"))).alias(f"g{j}"))
    wide = labelled.groupBy("stratum").agg(*sums)
    long = wide.select("stratum", F.posexplode(F.array(*(f"g{j}" for j in range(len(POINTS))))).alias("j", "gain"))
    # at equal gain the earlier rule, and of one rule the higher cutoff, which rejects less
    place = {rule: i for i, rule in enumerate(RULES)}
    keys = F.array(*(F.lit(1000 * place[rule] + len(RULES[rule]) - RULES[rule].index(cut)) for rule, cut in POINTS))
    order = Window.partitionBy("stratum").orderBy(F.desc("gain"), F.get(keys, F.col("j")))
    ranked = long.where("gain > 0").select("stratum", "j", F.row_number().over(order).alias("place"))
    picks = [F.max(F.when(F.col("j") == j, F.col("place"))) for j in range(len(POINTS))]
    return ranked.groupBy(F.col("stratum").alias("o_stratum")).agg(F.array(*picks).alias("ranks"))


def steps(labelled: DataFrame, order: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, step, n_good, false_rejects, true_rejects, holds) for each verdict; false rejections are those of the holdout.

    labelled: stratum, the features, good, tune; order: that of ordered_points(), written.
    """
    order = F.broadcast(order) if order.count() <= BROADCAST_STRATA else order
    strata = labelled.agg(F.count_distinct("stratum").alias("n_strata"))  # one row
    rows = labelled.where(~(F.col("good") & F.col("tune"))).join(order, F.col("stratum") == F.col("o_stratum"), "left")
    first = F.least(*(F.when(F.col(rule) > cut, F.get("ranks", F.lit(j))) for j, (rule, cut) in enumerate(POINTS)))
    size = F.coalesce(F.array_max("ranks"), F.lit(0))
    counts = rows.select("stratum", "good", first.alias("first"), size.alias("size")).groupBy("stratum", "first").agg(F.max("size").alias("size"), F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    counts = materialize(counts, "quality-steps")  # some tens of rows a stratum
    whole = counts.groupBy("stratum").agg(F.sum("g").alias("n_good"), F.max("size").alias("size"))
    whole = whole.where("size > 0").select("stratum", "n_good", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("step"))
    seen = counts.where("first is not null").select(F.col("stratum").alias("s"), "first", "g", "b")
    along = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    each = whole.join(seen, (F.col("stratum") == F.col("s")) & (F.col("step") == F.col("first")), "left")
    each = each.select("stratum", "step", "n_good", F.sum(F.coalesce("g", F.lit(0))).over(along).alias("false_rejects"), F.sum(F.coalesce("b", F.lit(0))).over(along).alias("true_rejects"))
    possible = (F.col("n_good") > 0) & (F.col("false_rejects") <= F.col("n_good") * risk)
    alone = each.join(F.broadcast(strata)).withColumn("alone", F.when(possible, binomial_cdf(F.col("false_rejects"), F.col("n_good"), risk) <= error / F.col("n_strata")).otherwise(F.lit(False)))
    return alone.withColumn("holds", F.min("alone").over(along)).drop("alone", "n_strata")


def cutoffs(tested: DataFrame, order: DataFrame) -> DataFrame:
    """(cut_stratum, one column for each rule): the lowest cutoff of each rule in the verdict that is taken: of those that hold the one that rejects most
    bad documents, less PRICE times the good ones of the holdout; ties go to the earlier step. Strata without one have no row."""
    gain = F.col("true_rejects") - PRICE * F.col("false_rejects")
    best = tested.where(F.col("holds") & (gain > 0)).groupBy("stratum").agg(F.max_by("step", F.struct(gain, -F.col("step"))).alias("taken"))
    picks = []
    for rule, cuts in RULES.items():
        inside = [F.when(F.get("ranks", F.lit(POINTS.index((rule, float(cut))))) <= F.col("taken"), F.lit(float(cut))) for cut in cuts]
        picks.append(F.least(*inside).alias(f"cut_{rule}"))
    return best.join(order, F.col("stratum") == F.col("o_stratum")).select(F.col("stratum").alias("cut_stratum"), *picks)


def judge(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with kept: false if a base rule or an admissible cutoff of the row's stratum rejects it."""
    cuts = materialize(cuts, "quality-cutoffs")
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    joined = rows.join(cuts, rows["stratum"] == cuts["cut_stratum"], "left")
    # one expression, so that no part of it is pushed below the steps of features(), which would make their arrays again for each element
    rejected = F.greatest(F.col("base_failed"), *(F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in RULES))
    return joined.withColumn("kept", ~rejected).drop("cut_stratum", *(f"cut_{rule}" for rule in RULES))


def label_of(labels: DataFrame) -> DataFrame:
    """(label_id, good): a document is good if all its labels say quality 1; null labels are left out."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min(F.col("quality") == 1).alias("good"))


def calibrate(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The cutoffs from rows (features with doc_id) and labels (doc_id, quality). Documents that the base rules reject don't count."""
    known = label_of(labels)
    labelled = rows.where(~F.col("base_failed")).join(known.where("good is not null"), rows["doc_id"] == known["label_id"])
    labelled = materialize(labelled.select("stratum", *RULES, "good", tuning(rows["doc_id"]).alias("tune")), "quality-labelled")
    order = materialize(ordered_points(labelled), "quality-points")
    return cutoffs(steps(labelled, order, risk, error), order)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Features and verdict of every row of docs (doc_id, text, lang; other columns are ignored).

    Null texts count as empty and fail the base rules; a null lang is a stratum of its own; texts of any length are taken whole; repeated rows and
    doc_ids are judged one by one; a document with several labels is good if all say so, labels without doc_id or quality are left out; without
    labels only the base rules reject; empty tables give no rows.
    """
    rows = materialize(features(docs), "quality-features")
    return judge(rows, calibrate(rows, labels, risk, error))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that the verdict keeps, with all their columns, whatever these are named; all else as quality_rules().

    The features are computed for the cutoffs, of labelled documents, and again for the verdict: that moves no text, while a join of the
    verdict would.
    """
    known = materialize(label_of(labels), "quality-labels")
    labelled = docs
    if known.count() <= BROADCAST_LABELS:  # beyond it the features of all documents are joined instead of their texts
        labelled = docs.join(F.broadcast(known.select(F.col("label_id").alias("_label_id"))), F.col("doc_id") == F.col("_label_id"), "left_semi")
    cuts = calibrate(materialize(features(labelled), "quality-features"), labels, risk, error)
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    return judge(features(packed, carry=("_row",)), cuts).where("kept").select("_row.*")
