"""Queries on the translation and augmentation rules, over English text made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as X
from ..operators import augment, match
from ..operators import translate as T
from .tables import table


def _joined(values):
    return F.array_join(F.array_sort(values), "|")


def rule_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    month, day, year = F.date_format("o_orderdate", "MMMM"), F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(month, F.lit(" "), day, F.lit(", "), year)).when(k == 1, F.concat_ws(" ", day, month)).when(k == 2, F.concat_ws(" ", month, year)).when(k == 3, F.concat(year, F.lit("s"))).otherwise(F.concat(F.lit("the "), day, F.lit("th century")))
    return o.select("o_orderkey", _joined(T.date_answer(text, F.lit(""))).alias("translations"))


def rule_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    text = F.concat(F.lit("the "), F.col("p_size").cast("string"), F.lit("th"))
    return p.select("p_partkey", _joined(T.ordinal_answer(text, F.lit(""))).alias("translations"))


def rule_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    number = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("."), (F.round(F.col("l_discount") * 100)).cast("int").cast("string"))
    text = F.when(F.col("l_orderkey") % 2 == 0, F.concat(number, F.lit("%"))).otherwise(F.concat(number, F.lit(" percent")))
    return li.select("l_orderkey", "l_linenumber", _joined(T.percent_answer(text)).alias("translations"))


def rule_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands and millions with their scale, and plain numbers with commas."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    k = F.col("l_orderkey") % 3
    text = F.when(k == 0, F.concat(F.col("q").cast("string"), F.lit(" million"))).when(k == 1, F.concat(F.col("q").cast("string"), F.lit(",500"))).otherwise(F.col("q").cast("string"))
    return li.select("l_orderkey", "l_linenumber", _joined(T.number_answer(text, F.lit(""))).alias("translations"))


def rule_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"))
    k = F.col("l_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("£"), F.col("q"), F.lit(" million"))).when(k == 1, F.concat(F.col("q"), F.lit(",250 dollars"))).otherwise(F.concat(F.col("q"), F.lit(" billion euros")))
    return li.select("l_orderkey", "l_linenumber", _joined(T.money_answer(text, F.lit(""))).alias("translations"))


def rule_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    text = F.concat((F.hour("ts") % 12 + 1).cast("string"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0"), F.when(F.col("event_id") % 2 == 0, " pm").otherwise(" am"))
    return e.select("event_id", _joined(T.time_answer(text)).alias("translations"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens = F.array(*(F.lit(x) for x in ("twenty", "thirty", "forty", "fifty")))
    ones = F.array(*(F.lit(x) for x in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(tens, (F.col("p_partkey") % 4 + 1).cast("int")).alias("t"), F.element_at(ones, (F.col("p_partkey") % 9 + 1).cast("int")).alias("o"))
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat_ws("-", "t", "o")).when(k == 1, F.concat_ws(" ", "o", F.lit("hundred and"), "t")).otherwise(F.concat_ws(" ", F.lit("nineteen"), "t", "o"))
    return p.select("p_partkey", T.number_word_value(text).alias("value"))


def translate_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as answers of changing types, with supplied translations and titles for some."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = F.array(*(F.lit(x) for x in ("PERSON", "MISC", "ORGANIZATION", "LOCATION", "O")))
    answers = c.select(F.col("c_custkey").alias("qid"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "the ").otherwise(""), F.col("n_name")).alias("answer"), F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int")).alias("ner"))
    n = table(spark, sf_dir, "nation")
    given = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("answer"), F.concat("n_name", F.lit(" 1999 r")).alias("given"))
    titles = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("answer"), F.concat(F.lit("Kraj"), F.col("n_regionkey").cast("string")).alias("title"))
    return T.translate(answers, given, titles).select("qid", "ner", _joined(F.col("translations")).alias("translations"))


def ner_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    k = F.col("event_id") % 4
    tokens = F.when(k == 0, F.array(F.floor("value").cast("string"))).when(k == 1, F.array(F.lit("1999"))).when(k == 2, F.array(F.initcap("event_type"), F.lit("Smith"))).otherwise(F.array("event_type", F.lit("x")))
    labels = F.when((k == 3) & (F.col("event_id") % 8 == 3), F.array(F.lit("ORG"), F.lit("ORG"))).when(F.size(tokens) == 1, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("MISC")))
    return e.select("event_id", T.entity_of(tokens, labels).alias("ner"), T.normalized_entity(T.entity_of(tokens, labels)).alias("kind"))


def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("answer"), F.when(F.col("event_id") % 3 == 0, "O|DATE").otherwise(F.col("event_type")).alias("ner"), F.col("event_id").alias("ordinal"))
    return T.last_known(rows)


def augment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    year = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    question = F.when(k == 0, "W którym roku to było").when(k == 1, "Kiedy to było").when(k == 2, "Ile ich było").otherwise("Gdzie to było")
    tokens = F.split(question, " ")
    lemmas = F.when(k == 0, F.array(F.lit("w"), F.lit("który"), F.lit("rok"), F.lit("to"))).otherwise(F.transform(tokens, F.lower))
    rows = o.select(
        "o_orderkey", question.alias("question"), F.when(k == 2, "12").when(k == 3, "Paris").otherwise(year).alias("answer"), F.lit(10).alias("answer_start"),
        F.when(k == 2, "NUMBER").when(k == 3, "LOCATION").otherwise("DATE").alias("answer_ne"), tokens.alias("q_tokens"), lemmas.alias("q_lemmas"),
        F.array(F.struct(F.concat(F.lit("7 maja "), year).alias("text"), F.lit("date").alias("label"))).alias("entities"), ((F.col("o_orderkey") % 10) / 10).alias("similarity"),
    )
    found = augment.extended(rows, [*augment.date_rules(), *augment.person_rules(), *augment.location_rules(F.col("answer") == "Paris"), *augment.number_rules()])
    return found.select("o_orderkey", "question", "answer", "answer_start", "extended")


def _asked(rows: DataFrame, question: Column, ne: str, entities: Column, *more: Column) -> DataFrame:
    """Rows as the rules take them, from key, answer and answer_start."""
    tokens = F.split(question, " ")
    return rows.select("key", question.alias("question"), "answer", F.col("answer_start").cast("int").alias("answer_start"), F.lit(ne).alias("answer_ne"), tokens.alias("q_tokens"), F.transform(tokens, F.lower).alias("q_lemmas"), entities.alias("entities"), F.lit(-1.0).alias("similarity"), *more)


def _entity(text: Column, label: str) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(label).alias("label")))


_NO_ENTITIES = "cast(array() as array<struct<text:string,label:string>>)"
_OUT = ("key", "question", "answer", "answer_start", "extended")


def augment_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons: first names by a table; a title around each third name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.initcap(F.lower("c_mktsegment"))).otherwise(F.concat_ws(" ", F.initcap(F.lower("c_mktsegment")), F.when(F.col("c_custkey") % 5 == 0, "XIV").otherwise("Kowalski"))).alias("answer"), F.lit(12).alias("answer_start"))
    rows = _asked(c, F.lit("Kto to był ?"), "PERSON", F.when(F.col("key") % 3 == 0, _entity(F.concat(F.lit("Sir "), "answer"), "persName")).otherwise(F.expr(_NO_ENTITIES)))
    names = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0 and c_mktsegment < 'H'").select(F.initcap(F.lower("c_mktsegment")).alias("name"))
    rows = augment.flagged(rows, names, names.select(F.col("name").alias("city")))
    return augment.extended(rows, augment.person_rules(F.col("first_name_known"))).select(*_OUT)


def augment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers as answers, those with an even number as known cities."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("answer"), F.lit(0).alias("answer_start"))
    rows = _asked(s, F.when(F.col("key") % 2 == 0, "Gdzie to jest ?").otherwise("W jakim mieście to jest ?"), "LOCATION", F.expr(_NO_ENTITIES))
    rows = augment.flagged(rows, n.select(F.col("n_name").alias("name")), n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("city")))
    return augment.extended(rows, augment.location_rules(F.col("city_known"))).select(*_OUT)


def augment_full_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full date as the answer to "when" also answers "in which year"."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.lit("maja"), F.year("o_orderdate").cast("string")).alias("answer"), (F.col("o_orderkey") % 50).alias("answer_start"))
    return augment.extended(_asked(o, F.lit("Kiedy to było ?"), "DATE", F.expr(_NO_ENTITIES)), augment.date_rules()).select(*_OUT)


def augment_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with the noun that is counted, and parts' names of two words asked with their second word or by a similar question word."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_name", F.lit(7).alias("answer_start"))
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    tagged = lambda x, pos: F.struct(x.alias("text"), x.alias("lemma"), F.lit(pos).alias("pos"))
    none = F.expr("cast(array() as array<struct<text:string,lemma:string,pos:string>>)")
    counted = _asked(p.withColumn("answer", F.col("p_size").cast("string")), F.concat(F.lit("Ile "), second, F.lit(" ?")), "NUMBER", F.expr(_NO_ENTITIES), F.array(F.lit("ADV"), F.lit("NOUN")).alias("q_poss"), second.alias("next_word"), F.when(F.col("key") % 2 == 0, second).otherwise("x").alias("next_lemma"), F.lit("NOUN").alias("next_pos"), none.alias("answer_words"))
    words = F.array(tagged(F.split_part("p_name", F.lit(" "), F.lit(1)), "ADJ"), tagged(second, "NOUN"))
    asked = _asked(p.withColumn("answer", F.col("p_name")), F.concat(F.when(F.col("key") % 3 == 0, "Który ").otherwise("Jaki "), second), "OTHER", F.expr(_NO_ENTITIES), F.array(F.lit("DET"), F.when(F.col("key") % 2 == 0, "NOUN").otherwise("VERB")).alias("q_poss"), F.lit(None).cast("string").alias("next_word"), F.lit(None).cast("string").alias("next_lemma"), F.lit(None).cast("string").alias("next_pos"), words.alias("answer_words"))
    return augment.extended(counted.unionByName(asked), augment.noun_rules()).select(*_OUT)


def rule_money_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled amounts above a thousand are said with and without blanks, trillions without the currency."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") + 1000).cast("string").alias("n"))
    text = F.concat(F.lit("£"), "n", F.when(F.col("l_orderkey") % 2 == 0, " million").otherwise(" trillion"))
    return li.select("l_orderkey", "l_linenumber", _joined(T.money_answer(text, F.lit(""))).alias("translations"))


def answer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names and sizes as tokenised answers, put together again by the original, with a repaired unit."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("( "), "p_name", F.lit(" , "), F.col("p_size").cast("string"), F.lit(" km / h )")).alias("a"), F.concat(F.lit("("), "p_name", F.lit(", "), F.col("p_size").cast("string"), F.lit(" km / h)")).alias("o"))
    return p.select("p_partkey", X.detokenized(F.col("a"), F.col("o")).alias("answer"))


def entity_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as entities (type, number of the event); of a repeated type the last counts."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    m = X.entity_map(F.transform("e", lambda x: F.struct(x["event_type"].alias("text"), x["event_id"].cast("string").alias("label"))))
    return e.select("user_id", m.alias("m")).select("user_id", F.explode("m").alias("event_type", "event_id"))


def translation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a nation's name among two lists of answers: equal, or one part of the other."""
    n = table(spark, sf_dir, "nation")
    kind = lambda ner, *answers: F.struct(F.lit(ner).alias("ner"), F.array(*answers).alias("answers"))
    types = F.when(F.col("n_nationkey") % 3 == 0, F.array(kind("ONLY", F.lit("zzz")))).otherwise(F.array(kind("FIRST", F.concat(F.lit("the "), "n_name"), F.lit("NATION_7")), kind("SECOND", F.lit("NATION_4"), F.lit("ATION_1"))))
    rows = n.select("n_nationkey", F.when(F.col("n_nationkey") == 4, F.col("n_name")).when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("x"))).otherwise(F.col("n_name")).alias("answer"), types.alias("types"))
    return match.ner_of_translation(rows).select("n_nationkey", "answer", "ner")


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("ordinal"), F.col("n_chars").alias("size"))
    return T.request_batches(rows, 29_500)


def _case(table_: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in table_.items()) + " END"


_MONTHS = {m.capitalize(): L.DATE_WORDS[m] for m in ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")}
_OF_DATES = {m: L.MONTHS_OF_DATES[w] for m, w in _MONTHS.items()}
_ROMAN = {i: L.roman(i) for i in range(1, 22)}
_ORD = {n: L.POLISH_ORDINALS.get(n) or f"{L.POLISH_ORDINALS[n // 10 * 10]} {L.POLISH_ORDINALS[n % 10]}" for n in range(1, 100)}
_NUM = {n: L.POLISH_NUMBERS.get(n) or f"{L.POLISH_NUMBERS[n // 10 * 10]} {L.POLISH_NUMBERS[n % 10]}" for n in range(0, 100)}
_SORTED = "array_to_string(list_sort(list_distinct(list_filter([{0}], lambda x: x IS NOT NULL))), '|')"
_THE = "CASE WHEN starts_with(a, 'the ') THEN substr(a, 5) ELSE a END"

QUERIES = {f.__name__: f for f in (rule_date, rule_ordinal, rule_percent, rule_number, rule_money, rule_time, number_words, translate_dispatch, ner_categorise, known_entities, augment_rules, request_batches, augment_people, augment_places, augment_full_dates, augment_nouns, rule_money_scaled, answer_repair, entity_maps, translation_types)}
ORACLE = {
    "rule_date": f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, monthname(o_orderdate) AS m, day(o_orderdate) AS d, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '|' || d || ' ' || {_case(_OF_DATES, 'm')} || ' ' || y WHEN 1 THEN '|' || d || ' ' || {_case(_OF_DATES, 'm')} WHEN 2 THEN '|' || {_case(_MONTHS, 'm')} || ' ' || y
  WHEN 3 THEN 'lata ' || substr(y, 3, 2) ELSE coalesce({_case(_ROMAN, 'd')} || ' wiek', '') END AS translations FROM o""",
    "rule_ordinal": f"SELECT p_partkey, {_SORTED.format(f'{_case(_ORD, 'p_size')}, CAST(p_size AS VARCHAR), CASE WHEN p_size > 1 THEN {_case(_ROMAN, 'p_size')} END')} AS translations FROM part",
    "rule_percent": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) || ',' || CAST(round(l_discount * 100) AS INT) || '%' AS translations FROM lineitem",
    "rule_number": f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS k, CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN {_SORTED.format("q || '000000', q || ' 000 000', q || ' milion'")}
  WHEN 1 THEN {_SORTED.format("q || '500', q || ' 500', q || ',5 tysiąc'")} ELSE {_SORTED.format(f"CAST(q AS VARCHAR), {_case(_NUM, 'q')}")} END AS translations FROM l""",
    "rule_money": f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS k, CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN {_SORTED.format("q || ' milion', q || ' milion funt'")} WHEN 1 THEN {_SORTED.format("q || '250', q || ' 250', q || '250 dolar', q || ' 250 dolar'")}
  ELSE {_SORTED.format("q || ' miliard', q || ' miliard euro'")} END AS translations FROM l""",
    "rule_time": f"""
WITH e AS (SELECT event_id, hour(ts) % 12 + 1 AS h, lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS m FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_SORTED.format("h || ':' || m, CASE WHEN h < 12 THEN h + 12 ELSE h END || ':' || m")} ELSE h || ':' || m END AS translations FROM e""",
    "number_words": """
WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, p_partkey % 4 * 10 + 20 AS t, p_partkey % 9 + 1 AS o FROM part)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN t + o WHEN 1 THEN o * 100 + t ELSE 1900 + t + o END AS BIGINT) AS value FROM p""",
    "translate_dispatch": f"""
WITH c AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN 'the ' ELSE '' END || n_name AS a, ['PERSON', 'MISC', 'ORGANIZATION', 'LOCATION', 'O'][c_custkey % 5 + 1] AS ner FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT qid, ner, a, coalesce(g.n_name || ' 1999 r', '') AS given, 'Kraj' || t.n_regionkey AS title FROM c LEFT JOIN nation g ON g.n_name = a AND g.n_nationkey % 2 = 0 LEFT JOIN nation t ON t.n_name = a AND t.n_nationkey % 3 = 0),
x AS (SELECT qid, ner, [given, CASE WHEN ner = 'PERSON' THEN a ELSE {_THE} END, CASE WHEN ner = 'O' THEN NULL WHEN ner = 'MISC' OR length(title) <= 2 * length(CASE WHEN ner = 'PERSON' THEN a ELSE {_THE} END) THEN title END] AS v FROM r)
SELECT qid, ner, array_to_string(list_sort(list_distinct(list_filter(list_transform(v, lambda x: lower(x)), lambda x: x IS NOT NULL AND x <> ''))), '|') AS translations FROM x""",
    "ner_categorise": """
WITH e AS (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS v, event_id % 4 AS k FROM events),
n AS (SELECT event_id, CASE k WHEN 0 THEN CASE WHEN length(CAST(v AS VARCHAR)) = 4 AND v >= 0 THEN 'DATE' ELSE 'NUMBER' END WHEN 1 THEN 'DATE' WHEN 2 THEN 'PERSON' ELSE CASE WHEN event_id % 8 = 3 THEN 'ORG' ELSE 'O|MISC' END END AS ner FROM e)
SELECT event_id, ner, CASE WHEN ner = 'O|MISC' THEN 'OTHER' ELSE ner END AS kind FROM n""",
    "known_entities": "SELECT CAST(user_id AS VARCHAR) AS answer, arg_max(event_type, event_id) AS ner FROM events WHERE event_id % 3 <> 0 GROUP BY user_id",
    "augment_rules": """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 10 >= 8 AS g, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'W którym roku to było' WHEN 1 THEN 'Kiedy to było' WHEN 2 THEN 'Ile ich było' ELSE 'Gdzie to było' END AS question, CASE k WHEN 2 THEN '12' WHEN 3 THEN 'Paris' ELSE y END AS answer, CAST(10 AS INT) AS answer_start, false AS extended FROM o
UNION ALL SELECT o_orderkey, CASE k WHEN 0 THEN 'Kiedy to było' WHEN 1 THEN 'W którym roku to było' WHEN 2 THEN 'Jak wiele ich było' ELSE 'W jakim mieście to było' END, CASE k WHEN 2 THEN '12' WHEN 3 THEN 'Paris' ELSE y END, 10, true FROM o WHERE g
UNION ALL SELECT o_orderkey, 'Kiedy to było', '7 maja ' || y, 3, true FROM o WHERE g AND k < 2""",
    "augment_people": """
WITH c AS (SELECT c_custkey AS key, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS f, c_mktsegment < 'H' AS known FROM customer),
a AS (SELECT key, known, CASE WHEN key % 3 = 0 THEN f WHEN key % 5 = 0 THEN f || ' XIV' ELSE f || ' Kowalski' END AS answer, 'Kto to był ?' AS question FROM c)
SELECT key, question, answer, CAST(12 AS INT) AS answer_start, false AS extended FROM a
UNION ALL SELECT key, question, 'Sir ' || answer, 8, true FROM a WHERE key % 3 = 0
UNION ALL SELECT key, question, 'Kowalski', CAST(12 + length(answer) - 8 AS INT), true FROM a WHERE key % 3 <> 0 AND key % 5 <> 0 AND known""",
    "augment_places": """
WITH s AS (SELECT s_suppkey AS key, n_name AS answer, n_nationkey % 2 = 0 AS known FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT key, CASE WHEN key % 2 = 0 THEN 'Gdzie to jest ?' ELSE 'W jakim mieście to jest ?' END AS question, answer, CAST(0 AS INT) AS answer_start, false AS extended FROM s
UNION ALL SELECT key, CASE WHEN key % 2 = 1 THEN 'Gdzie to jest ?' ELSE 'W jakim mieście to jest ?' END, answer, 0, true FROM s WHERE known""",
    "augment_full_dates": """
WITH o AS (SELECT o_orderkey AS key, day(o_orderdate) || ' maja ' || year(o_orderdate) AS answer, o_orderkey % 50 AS pos, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT key, 'Kiedy to było ?' AS question, answer, CAST(pos AS INT) AS answer_start, false AS extended FROM o
UNION ALL SELECT key, 'W którym roku to było ?', y, CAST(pos + length(answer) - 4 AS INT), true FROM o""",
    "augment_nouns": """
WITH p AS (SELECT p_partkey AS key, p_name, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part),
q AS (SELECT *, CASE WHEN key % 3 = 0 THEN 'Który ' ELSE 'Jaki ' END || n AS question, CASE WHEN key % 3 = 0 THEN 'Jaki ' ELSE 'Który ' END || n AS other FROM p)
SELECT key, 'Ile ' || n || ' ?' AS question, CAST(p_size AS VARCHAR) AS answer, CAST(7 AS INT) AS answer_start, false AS extended FROM p
UNION ALL SELECT key, 'Ile ' || n || ' ?', p_size || ' ' || n, 7, true FROM p WHERE key % 2 = 0
UNION ALL SELECT key, question, p_name, 7, false FROM q
UNION ALL SELECT key, question, a, CAST(6 + instr(p_name, a) AS INT), true FROM q WHERE a <> n
UNION ALL SELECT key, other, p_name, 7, true FROM q WHERE key % 2 = 0""",
    "rule_money_scaled": f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 2 = 0 AS m, CAST(l_quantity AS INT) + 1000 AS n FROM lineitem),
s AS (SELECT *, n // 1000 || ' ' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') AS b FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN m THEN {_SORTED.format("n || ' milion', n || ' milion funt', b || ' milion', b || ' milion funt'")} ELSE {_SORTED.format("n || ' trylion', b || ' trylion'")} END AS translations FROM s""",
    "answer_repair": "SELECT p_partkey, '(' || p_name || ', ' || p_size || ' km/h)' AS answer FROM part",
    "entity_maps": "SELECT user_id, event_type, CAST(max(event_id) AS VARCHAR) AS event_id FROM events GROUP BY user_id, event_type",
    "translation_types": """
WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey <> 4 AND n_nationkey % 2 = 0 THEN n_name || 'x' ELSE n_name END AS answer, n_name FROM nation)
SELECT n_nationkey, answer, CASE WHEN n_nationkey % 3 = 0 THEN 'ONLY' WHEN answer IN ('the ' || n_name, 'NATION_7') THEN 'FIRST' WHEN answer IN ('NATION_4', 'ATION_1') THEN 'SECOND'
  WHEN contains('the ' || n_name, answer) OR contains('NATION_7', answer) OR contains(answer, 'NATION_7') THEN 'FIRST' WHEN contains(answer, 'NATION_4') OR contains(answer, 'ATION_1') THEN 'SECOND' END AS ner FROM n""",
    "request_batches": """
WITH RECURSIVE d AS (SELECT source AS g, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT g, doc_id, n_chars, n, CASE WHEN n_chars >= 29500 THEN 0 ELSE n_chars END AS s, 0 AS batch, CASE WHEN n_chars >= 29500 THEN 1 ELSE 0 END AS nxt FROM d WHERE n = 1
  UNION ALL SELECT d.g, d.doc_id, d.n_chars, d.n, CASE WHEN r.s + d.n_chars >= 29500 THEN 0 ELSE r.s + d.n_chars END, r.nxt, CASE WHEN r.s + d.n_chars >= 29500 THEN r.nxt + 1 ELSE r.nxt END FROM r JOIN d ON d.g = r.g AND d.n = r.n + 1)
SELECT g AS group_id, doc_id AS ordinal, n_chars AS size, CAST(batch AS INT) AS batch FROM r""",
}
