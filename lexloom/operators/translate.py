"""Rules that translate English answers by the type of their entity, as column expressions.

Each rule gives an array of strings from the answer and a supplied translation of it; rules of a type are tried in order. The
dispatcher lower-cases the results and drops empty and repeated ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import let


def lookup(table: dict, key: Column) -> Column:
    """The value of a key in a small fixed table, null where it has none."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def replaced(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strings(*options: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*options)))


def without_article(text: Column, articles=("the ", "a ", "an ")) -> Column:
    for a in articles:
        text = F.regexp_replace(text, f"^{a}", "")
    return text


def grouped(n: Column) -> Column:
    """An integer with blanks between thousands."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def ordinal_word(n: Column) -> Column:
    one = lookup(L.POLISH_ORDINALS, n)
    return F.coalesce(one, F.concat_ws(" ", lookup(L.POLISH_ORDINALS, F.floor(n / 10).cast("int") * 10), lookup(L.POLISH_ORDINALS, n % 10)))


def number_word_value(text: Column) -> Column:
    """The value of a number in English words: up to three words, or two such parts with "and"; null otherwise."""

    def values(t: Column) -> Column:
        """The value of each word, null for others."""
        return F.transform(F.split(F.replace(F.lower(F.trim(t)), F.lit("-"), F.lit(" ")), " "), lambda w: lookup(L.ENGLISH_NUMBERS, w).cast("long"))

    def total(v: Column) -> Column:
        a, b, c = (F.get(v, F.lit(i)) for i in range(3))
        return (
            F.when(F.size(v) == 1, a)
            .when((F.size(v) == 2) & b.isin(100, 1000, 1000000), a * b)
            .when(F.size(v) == 2, a + b)
            .when((F.size(v) == 3) & (b == 100), a * 100 + c)
            .when((F.size(v) == 3) & (a < 20), a * 100 + b + c)
        )

    plain = lambda t: let(values(t), total)
    return let(F.split(text, "and"), lambda h: F.coalesce(plain(F.array_join(h, "and")), F.when(F.size(h) == 2, plain(h[0]) + plain(F.get(h, F.lit(1))))))


def spoken_number(n: Column) -> Column:
    """The ways to say an integer in Polish: words below 100, and multiples of thousands, millions and more with their word."""
    return let(n, _spoken)


def _spoken(n: Column) -> Column:
    small = F.coalesce(lookup(L.POLISH_NUMBERS, n.cast("int")), F.concat_ws(" ", lookup(L.POLISH_NUMBERS, (F.floor(n / 10) * 10).cast("int")), lookup(L.POLISH_NUMBERS, (n % 10).cast("int"))))

    def scaled(unit: int, name: str) -> Column:
        value = (n.cast("decimal(20,0)") / F.lit(unit)).cast("decimal(20,1)").cast("string")
        return F.concat(F.regexp_replace(F.replace(value, F.lit("."), F.lit(",")), ",0$", ""), F.lit(f" {name}"))

    thousand = (n / 1000).cast("int")
    in_words = F.when((n % 1000 == 0) & lookup(L.POLISH_NUMBERS, thousand).isNotNull(), F.concat(lookup(L.POLISH_NUMBERS, thousand), F.lit(" tysiąc"))).when(
        (n % 1000 == 0) & (thousand < 100), F.concat_ws(" ", lookup(L.POLISH_NUMBERS, F.floor(thousand / 10).cast("int") * 10), lookup(L.POLISH_NUMBERS, thousand % 10), F.lit("tysiąc"))
    )
    big = lambda unit: (n >= unit) & (n < unit * 1000) & (n % (unit // 10) == 0)
    hundreds = n.isin(*[k for k in L.POLISH_NUMBERS if k >= 100])
    return (
        F.when((n < 100) | hundreds, strings(small))
        .when(big(1000), strings(scaled(1000, "tysiąc"), in_words))
        .when(big(10**6), strings(scaled(10**6, "milion")))
        .when(big(10**9), strings(scaled(10**9, "miliard")))
        .when(big(10**12), strings(scaled(10**12, "trylion")))
        .otherwise(F.array().cast("array<string>"))
    )


def roman_numeral(n: Column) -> Column:
    return lookup({i: L.roman(i) for i in range(1, L.MOST_ROMAN + 1)}, n)


def time_answer(text: Column) -> Column:
    t = replaced(text, (("the ", ""), ("a ", "")))
    word, parts = lookup(L.TIME_WORDS, t), F.split(t, " ")
    hour = parts[0]
    h = F.regexp_extract(hour, r"^(\d+):", 1)
    # noon's hour stays as it is
    later = F.concat_ws(":", F.when(h.try_cast("int") < 12, h.try_cast("int") + 12).otherwise(h.try_cast("int")).cast("string"), F.split_part(hour, F.lit(":"), F.lit(2)))
    return F.when(word.isNotNull(), strings(word)).when(F.size(parts) == 1, strings(t)).when(F.get(parts, F.lit(1)).isin("p.m.", "pm", "p.m"), strings(later, hour)).otherwise(strings(hour))


def ordinal_answer(text: Column, given: Column) -> Column:
    t = replaced(F.lower(text), (("the ", ""), ("a ", "")))
    n = F.coalesce(lookup({w: i for i, w in enumerate(L.ENGLISH_ORDINALS, 1)}, t), F.regexp_extract(t, r"^(\d+)(st|nd|rd|th)$", 1).try_cast("int"))
    return F.when(n.isNull(), strings(given)).otherwise(strings(F.when(n < 100, ordinal_word(n)), n.cast("string"), F.when(n > 1, roman_numeral(n))))


def percent_answer(text: Column) -> Column:
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    number = F.regexp_extract(text, r"^(.+) percent$", 1)
    word = number_word_value(number)
    return (
        F.when(text.rlike(r"^\d+([.,]\d+)?%$"), strings(comma(text)))
        .when(text.rlike(r"^\d+([.,]\d+)? percent$"), strings(F.concat(comma(number), F.lit("%"))))
        .when(text.rlike(r"^\D+ percent$") & word.isNotNull(), strings(F.concat(word.cast("string"), F.lit("%"))))
        .when(text.rlike(r"^\d+\.\d+$"), strings(comma(F.regexp_replace(text, r"\.0+$", ""))))
        .when(number_word_value(text).isNotNull(), strings(number_word_value(text).cast("string")))
        .otherwise(strings(text))
    )


_SCALE = "thousand|million|billion|bn|b|trillion"


def number_value(text: Column) -> Column:
    """The value of plain digits, digits or words with a scale, or words, as a decimal; null for anything else."""
    return let(replaced(text, ((",", ""), ("a ", ""), ("the ", ""))), _value)


def _value(t: Column) -> Column:
    plain = F.when(t.rlike(r"^[\d. ]+$"), F.replace(t, F.lit(" "), F.lit("")).try_cast("decimal(30,6)"))
    scale = lookup({k: v for k, v in L.ENGLISH_NUMBERS.items() if v >= 1000}, F.regexp_extract(t, f"({_SCALE})$", 1))
    before = F.rtrim(F.regexp_replace(t, f"({_SCALE})$", ""))
    scaled = F.when(t.rlike(rf"^(\D+|[\d.]+) *({_SCALE})$"), (F.coalesce(F.when(before.rlike(r"^[\d.]+$"), before.try_cast("decimal(14,6)")), number_word_value(before).cast("decimal(14,6)")) * scale.cast("decimal(14,0)")).cast("decimal(30,6)"))
    return F.coalesce(plain, scaled, number_word_value(t).cast("decimal(30,6)"))


def number_forms(value: Column) -> Column:
    """A value with a comma for its point, and an integer also with blanks and in words."""
    return let(value, _forms)


def _forms(value: Column) -> Column:
    whole = value == F.floor(value)
    n = value.try_cast("long")
    plain = F.replace(F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("."), F.lit(","))
    return F.when(whole, F.array_distinct(F.concat(F.array(n.cast("string"), grouped(n)), spoken_number(n)))).otherwise(F.array(plain))


def number_answer(text: Column, given: Column) -> Column:
    return let(replaced(text, ((",", ""), ("a ", ""), ("the ", ""))), lambda t: let(_value(t), lambda value: _number(t, value, given)))


def _number(t: Column, value: Column, given: Column) -> Column:
    pair = lambda word, joined: F.when(t.rlike(rf"^\d+ {word} \d+$"), strings(F.concat_ws(f" {joined} ", *(F.regexp_extract(t, rf"^(\d+) {word} (\d+)$", i).cast("long").cast("string") for i in (1, 2)))))
    return F.coalesce(
        F.when(value.isNotNull(), number_forms(value)),
        F.when(t.rlike("^[IVXLCDM]+$"), strings(t)),
        pair("to", "do"),
        pair("and", "i"),
        F.when(t.rlike(r"^(\d\d)?\d\ds$"), strings(F.concat(F.lit("lata "), F.substring(t, -3, 2)))),
        F.when(t.rlike("[a-z]"), strings(given)),
        strings(t),
    )


def split_currency(text: Column) -> Column:
    """The struct (currency, rest): a currency at the beginning or the end, in the order of the table."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in L.CURRENCIES.items()))

    def parted(t: Column, hit: Column) -> Column:
        n = F.char_length(hit["k"])
        rest = F.when(F.startswith(t, hit["k"]), F.ltrim(F.substring(t, n + 1, F.char_length(t)))).otherwise(F.rtrim(F.substring(t, F.lit(1), F.char_length(t) - n)))
        return F.struct(F.coalesce(hit["v"], F.lit("")).alias("currency"), F.coalesce(rest, t).alias("rest"))

    first = lambda t: F.get(F.filter(table, lambda c: F.startswith(t, c["k"]) | F.endswith(t, c["k"])), F.lit(0))
    return let(F.lower(text), lambda t: let(first(t), lambda hit: parted(t, hit)))


def money_answer(text: Column, given: Column) -> Column:
    return let(split_currency(F.replace(text, F.lit(","), F.lit(""))), lambda parts: _money(parts["currency"], parts["rest"], given))


def _money(currency: Column, rest: Column, given: Column) -> Column:
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    with_currency = lambda c: strings(F.rtrim(F.concat_ws(" ", c, currency)), c)
    plain = trimmed(rest)
    spaced = F.concat(grouped(F.split_part(plain, F.lit("."), F.lit(1)).try_cast("long")), F.regexp_extract(comma(plain), "(,.*)$", 1))
    scales = "hundred|thousand|million|m|billion|b|bn|trillion"
    unit = F.regexp_extract(rest, f"({scales})$", 1)
    amount = F.rtrim(F.regexp_replace(rest, f"({scales})$", ""))
    number = let(amount, lambda a: F.coalesce(F.when(a.rlike(r"^[\d.]+$"), trimmed(a)), number_word_value(a).cast("string")))
    hundreds = lambda n: (n.try_cast("decimal(20,2)") * 100).cast("decimal(20,0)").cast("string")
    blanks = lambda n: F.concat(grouped(F.split_part(n, F.lit("."), F.lit(1)).try_cast("long")), F.regexp_extract(comma(n), "(,.*)$", 1))
    said = lambda n: F.concat_ws(" ", n, lookup(L.SCALES, unit))
    whole = lambda n: F.array_distinct(F.concat(with_currency(said(comma(n))), with_currency(said(F.coalesce(blanks(n), comma(n))))))
    bare = lambda n: F.array_distinct(F.array(said(comma(n)), said(F.coalesce(blanks(n), comma(n)))))
    scaled = let(number, lambda n: F.when(n.isNotNull(), F.when(unit == "hundred", with_currency(hundreds(n))).when(unit == "trillion", bare(n)).otherwise(whole(n))))
    return F.coalesce(
        F.when(rest.rlike(r"^[\d.]+$"), F.array_distinct(F.concat(with_currency(comma(plain)), with_currency(spaced)))),
        F.when(rest.rlike(rf"^(\D+|[\d.]+) *({scales})$"), scaled),
        F.when(rest == "ten", F.array(F.lit("10"), F.lit("dziesięć"))),
        strings(given),
    )


def date_word(word: Column, of_date: bool = False) -> Column:
    pl = F.coalesce(lookup(L.DATE_WORDS, F.lower(word)), lookup({w: str(i) for i, w in enumerate(L.ENGLISH_ORDINALS, 1)}, F.lower(word)))
    return F.coalesce(lookup(L.MONTHS_OF_DATES, pl), pl) if of_date else pl


def date_answer(text: Column, given: Column) -> Column:
    """Words and numbers of dates in Polish order. Where a word has no translation the supplied one stands alone."""
    plain = F.regexp_replace(F.lower(F.replace(given, F.lit(","), F.lit(""))), r"(\d{1,4}) r$", "$1")
    return let(plain, lambda g: let(replaced(F.lower(F.replace(text, F.lit(","), F.lit(""))), L.DATE_PHRASES), lambda t: _date(t, g)))


def _date(t: Column, given: Column) -> Column:
    def core(t: Column) -> Column:
        return let(t, lambda x: let(F.split(x, " "), lambda w: of(x, w)))

    def of(t: Column, w: Column) -> Column:
        a, b, c = (F.get(w, F.lit(i)) for i in range(3))
        # a word without a translation leaves the answer to what comes later
        said = lambda *parts: F.when(F.forall(F.array(*parts), lambda x: x.isNotNull()), strings(F.concat_ws(" ", *parts), given))
        century = F.coalesce(F.regexp_extract(t, r"^(\d+)(st|nd|rd|th) century$", 1).try_cast("int"), lookup({x: i for i, x in enumerate(L.ENGLISH_ORDINALS, 1)}, F.regexp_extract(t, r"^(\w+) century$", 1)))
        both = F.split(t, "[–-]")
        return F.coalesce(
            F.when(t.rlike("^[a-z]+$"), strings(date_word(t), given)),
            F.when(t.rlike(r"^(\d\d)?\d\ds$"), strings(F.concat(F.lit("lata "), F.substring(t, -3, 2)))),
            F.when(t.rlike(r"^\d+(st|nd|rd|th)$"), strings(F.regexp_extract(t, r"^(\d+)", 1).cast("int").cast("string"))),
            F.when(t.rlike(r"^[^\d ]+[–-][^\d ]+$"), strings(F.concat_ws("-", date_word(both[0]), date_word(F.get(both, F.lit(1)))))),
            F.when(~t.contains(" "), strings(t)),
            F.when(t.rlike(r"^\d+ \D+ \d+$") & (F.size(w) == 3), said(a, date_word(b, True), c)),
            F.when(t.rlike(r"^\D+ \d+ \d+$") & (F.size(w) == 3), said(b, date_word(a, True), c)),
            F.when(t.rlike(r"^\d+ \D+$") & (F.size(w) == 2), said(a, date_word(b, True))),
            F.when(t.rlike(r"^\D+ \d+$") & (F.size(w) == 2) & (b.try_cast("int") > 31), said(date_word(a), b)),
            F.when(t.rlike(r"^\D+ \d+$") & (F.size(w) == 2), said(b, date_word(a, True))),
            F.when(century.isNotNull(), strings(F.concat(roman_numeral(century), F.lit(" wiek")))),
            F.when(t.rlike(r"^\w+ to \w+$"), said(date_word(a), F.lit("do"), date_word(c))),
            F.when(t.rlike(r"^\d+ or \d+$"), strings(F.regexp_replace(t, r"^(\d+) or (\d+)$", "$1 lub $2"))),
            F.when(t.rlike(r"^\d+ until \d+$"), strings(F.regexp_replace(t, r"^(\d+) until (\d+)$", "$1 do $2"))),
            strings(given),
        )

    start = F.split_part(given, F.lit(" "), F.lit(1))
    with_in = t.rlike(r"^in [\w ]+$")
    found = core(F.when(with_in, F.substr(t, F.lit(4))).otherwise(t))
    return let(found, lambda inner: F.when(with_in, F.array_distinct(F.concat(inner, F.transform(inner, lambda x: F.concat_ws(" ", start, x)), F.array(given)))).otherwise(inner))


def titled_answer(text: Column, given: Column, title: Column, articles=("the ", "a ", "an "), clean: bool = False) -> Column:
    """Names: a title's translation joins the supplied one and the text, if it isn't much longer (or, with clean, without marks and another text)."""
    t = without_article(text, articles)
    good = ~title.rlike("[:/,]") & (title != t) if clean else F.char_length(title) <= 2 * F.char_length(t)
    return F.when(title.isNotNull() & good, strings(title, given, t)).otherwise(strings(given, t))


def person_answer(text: Column, given: Column, title: Column) -> Column:
    good = title.isNotNull() & ~title.rlike("[:/,]") & (F.char_length(title) <= 2 * F.char_length(text))
    return F.when(good, strings(title, given, text)).otherwise(strings(given, text))


def duration_answer(text: Column, given: Column) -> Column:
    t = replaced(text, (("the ", ""), ("a ", ""), (",", "")))
    unit = F.substring_index(t, " ", -1).rlike("^(second|minute|hour|day|night|week|month|season|year|decade|century|centurie|semester)s?$")
    before, end = F.regexp_replace(t, r" \S+$", ""), F.substring_index(given, " ", -1)
    return F.when(unit, F.transform(number_answer(before, given), lambda x: F.concat_ws(" ", x, end))).otherwise(number_answer(t, given))


def other_answer(text: Column, given: Column, ner: Column) -> Column:
    plain = F.when(ner.contains("|"), F.regexp_replace(given, r"(\d{1,4}) r$", "$1")).otherwise(given)
    return strings(plain, without_article(text))


def translate(answers: DataFrame, given: DataFrame, titles: DataFrame) -> DataFrame:
    """(qid, answer, ner, translations) of answers (qid, answer, ner), with supplied translations (answer, given) and titles (answer, title).

    Translations are lower-cased, distinct and not empty; a missing supplied translation counts as empty.
    """
    g, t = given.select(F.col("answer").alias("_g"), "given"), titles.select(F.col("answer").alias("_t"), "title")
    rows = answers.join(g, F.col("answer") == F.col("_g"), "left").join(t, F.col("answer") == F.col("_t"), "left").withColumn("given", F.coalesce("given", F.lit("")))
    a, s, title, ner = F.col("answer"), F.col("given"), F.col("title"), F.col("ner")
    found = (
        F.when(ner == "PERSON", person_answer(a, s, title))
        .when(ner == "TIME", time_answer(a))
        .when(ner == "MISC", titled_answer(a, s, title, clean=True))
        .when(ner == "ORDINAL", ordinal_answer(a, s))
        .when(ner == "ORGANIZATION", titled_answer(a, s, title))
        .when(ner == "DATE", F.array_except(date_answer(a, s), F.array(F.lit("może"), F.lit("marsz"))))
        .when(ner == "PERCENT", percent_answer(a))
        .when(ner == "LOCATION", titled_answer(a, s, title, ("the ",)))
        .when(ner == "NUMBER", number_answer(a, s))
        .when(ner == "MONEY", money_answer(a, s))
        .when(ner == "DURATION", duration_answer(a, s))
        .otherwise(other_answer(a, s, ner))
    )
    return rows.select("qid", "answer", "ner", F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: x != "")).alias("translations"))


def normalized_entity(label: Column) -> Column:
    """Composite and plain labels as OTHER, a model's labels by their table."""
    return F.when((label == "O") | label.contains("|"), "OTHER").otherwise(F.coalesce(lookup(L.ENTITY_LABELS, label), label))


def entity_of(tokens: Column, entities: Column) -> Column:
    """The type of an answer from its tokens' labels: a single label other than O, or a number, a year, capitalised names, or all labels."""
    kinds = F.array_distinct(entities)
    text = F.array_join(tokens, " ")
    return (
        F.when((F.size(kinds) == 1) & (kinds[0] != "O"), kinds[0])
        .when((F.size(tokens) <= 9) & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.when(text.rlike(r"^\d{4}$"), "DATE").otherwise("NUMBER"))
        .when(F.lower(text).rlike(r"^(in )?((january|february|march|april|may|june|july|august|september|october|november|december|spring|summer|autumn|fall|winter) )?\d{4}$"), "DATE")
        .when(F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike(r"^\p{Lu}\p{Ll}+$|^[IVX]+$")), "PERSON")
        .otherwise(F.array_join(entities, "|"))
    )


def last_known(rows: DataFrame) -> DataFrame:
    """(answer, ner): the last label that isn't composite of each answer text, by ordinal."""
    return rows.where(~F.col("ner").contains("|")).groupBy("answer").agg(F.max_by("ner", "ordinal").alias("ner"))


def request_batches(rows: DataFrame, limit: int) -> DataFrame:
    """(group_id, ordinal, size, batch): greedy batches of a group's texts (group_id, ordinal, size), flushed once the sum reaches the limit.

    A group's sorted rows run through a task that keeps one sum, however many they are. Null sizes count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, number, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for g, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or g != group:
                    group, total, number, begun = g, 0, 0, True
                out.append(number)
                total += size or 0
                if total >= limit:
                    total, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], ["group_id", "ordinal", "size", "batch"])

    kind = rows.schema["group_id"].dataType.simpleString()
    rows = rows.select("group_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("size").cast("long").alias("size"))
    return rows.repartition("group_id").sortWithinPartitions("group_id", "ordinal", "size").mapInArrow(run, f"group_id {kind}, ordinal long, size long, batch int")


def translated_questions(answers: DataFrame, questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, question, answer, en_answer, ner): a row for each translation of answers (qid, en_answer, translations) whose question (qid, question) is known and of valid form."""
    from ..functions.text import is_valid_question

    rows = answers.where(F.size("translations") > 0).join(questions.where(is_valid_question(F.col("question"))), "qid").join(entities, ["qid", "en_answer"], "left")
    return rows.select("qid", "question", F.explode("translations").alias("answer"), "en_answer", "ner")


def annotated_answers(articles: DataFrame) -> DataFrame:
    """(qid, answer, tokens, entities, context_tokens, context_entities) of annotated articles; the context's sentences are one sequence."""
    flat = lambda doc, field: F.flatten(F.transform(doc["sentence"], lambda s: F.transform(s["token"], lambda t: t[field])))
    rows = articles.select(F.explode("paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q")).select("context", "q.id", F.explode("q.answers").alias("a"))
    a, c = F.col("a"), F.col("context")
    return rows.where(F.size("a.sentence") > 0).select(F.col("id").alias("qid"), F.col("a.text").alias("answer"), flat(a, "word").alias("tokens"), flat(a, "ner").alias("entities"), flat(c, "word").alias("context_tokens"), flat(c, "ner").alias("context_entities"))


def entity_in_context(tokens: Column, entities: Column, context_tokens: Column, context_entities: Column) -> Column:
    """The type of an answer; if its last occurrence in the context has one label other than O, that one."""
    from ..functions.arrays import last_sublist_position

    def of(at: Column) -> Column:
        kinds = F.array_distinct(F.slice(context_entities, at + 1, F.size(tokens)))
        return F.when((at >= 0) & (F.size(kinds) == 1) & (kinds[0] != "O"), kinds[0]).otherwise(entity_of(tokens, entities))

    return let(last_sublist_position(tokens, context_tokens), of)


def with_known(rows: DataFrame) -> DataFrame:
    """rows (answer, ner, ordinal) whose composite label is replaced by the last plain one of the same answer, where there is one."""
    known = last_known(rows).select(F.col("answer").alias("_k"), F.col("ner").alias("_known"))
    return rows.join(known, F.col("answer") == F.col("_k"), "left").withColumn("ner", F.when(F.col("ner").contains("|"), F.coalesce("_known", "ner")).otherwise(F.col("ner"))).drop("_k", "_known")
