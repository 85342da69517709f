import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.operators import augment, evaluate, link, match, nest, report, retrieve, sentences, spans
from lexloom.operators import translate as T
from lexloom.sources import delimited, devset, files
from lexloom.streaming import incremental


def applied(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    found = row.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x
    return set(found) if isinstance(found, list) else found


@pytest.mark.parametrize(
    "make, text, wanted",
    [
        (T.percent_answer, "12.3%", {"12,3%"}),
        (T.percent_answer, "45 percent", {"45%"}),
        (T.percent_answer, "ten percent", {"10%"}),
        (T.percent_answer, "10-45%", {"10-45%"}),
        (T.percent_answer, "eighty-seven", {"87"}),
        (T.time_answer, "5:30 pm", {"17:30", "5:30"}),
        (T.time_answer, "12:15 pm", {"12:15"}),
        (T.time_answer, "the night", {"noc"}),
        (T.time_answer, "9:00", {"9:00"}),
    ],
)
def test_rules_of_text(spark, make, text, wanted):
    assert applied(spark, make, text) == wanted


@pytest.mark.parametrize(
    "make, text, wanted",
    [
        (T.ordinal_answer, "first", {"pierwszy", "1"}),
        (T.ordinal_answer, "16th", {"szesnasty", "16", "XVI"}),
        (T.ordinal_answer, "21st", {"dwudziesty pierwszy", "21", "XXI"}),
        (T.ordinal_answer, "17th-18th", {"given"}),
        (T.date_answer, "1980s", {"lata 80"}),
        (T.date_answer, "December 7, 1941", {"7 grudnia 1941", "given"}),
        (T.date_answer, "16th century", {"XVI wiek"}),
        (T.date_answer, "the early second century", {"II wiek"}),
        (T.date_answer, "June 1994", {"czerwiec 1994", "given"}),
        (T.date_answer, "19 November", {"19 listopada", "given"}),
        (T.date_answer, "1994 or 1999", {"1994 lub 1999"}),
        (T.date_answer, "1398–1402", {"1398–1402"}),
        (T.date_answer, "march–june", {"marzec-czerwiec"}),
        (T.date_answer, "in June 1994", {"czerwiec 1994", "given", "given czerwiec 1994", "given given"}),
        (T.number_answer, "5,000,000", {"5000000", "5 000 000", "5 milion"}),
        (T.number_answer, "2.5 million", {"2500000", "2 500 000", "2,5 milion"}),
        (T.number_answer, "three", {"3", "trzy"}),
        (T.number_answer, "one hundred and fifty-seven", {"157"}),
        (T.number_answer, "nineteen eighty four", {"1984", "1 984"}),
        (T.number_answer, "XIV", {"XIV"}),
        (T.number_answer, "3 to 5", {"3 do 5"}),
        (T.number_answer, "90°", {"90°"}),
        (T.money_answer, "£5 million", {"5 milion funt", "5 milion"}),
        (T.money_answer, "1,500 dollars", {"1500 dolar", "1500", "1 500 dolar", "1 500"}),
        (T.money_answer, "two hundred pounds", {"200 funt", "200"}),
        (T.money_answer, "ten", {"10", "dziesięć"}),
        (T.duration_answer, "three years", {"3 given", "trzy given"}),
    ],
)
def test_rules_with_given(spark, make, text, wanted):
    assert applied(spark, make, text, "given") == wanted


def test_dispatch(spark):
    answers = spark.createDataFrame([(1, "the Nile", "LOCATION"), (2, "may", "DATE"), (3, "It", "O|DATE"), (4, "Jan", "PERSON")], "qid long, answer string, ner string")
    given = spark.createDataFrame([("the Nile", "Nil"), ("may", "może"), ("It", "To 1970 r")], "answer string, given string")
    titles = spark.createDataFrame([("Jan", "Jan: x")], "answer string, title string")
    rows = {r.qid: set(r.translations) for r in T.translate(answers, given, titles).collect()}
    assert rows == {1: {"nil", "nile"}, 2: {"maj"}, 3: {"to 1970", "it"}, 4: {"jan"}}


@pytest.mark.parametrize("label, wanted", [("geogName", "LOCATION"), ("O|DATE", "OTHER"), ("O", "OTHER"), ("MISC", "MISC")])
def test_entities(spark, label, wanted):
    assert applied(spark, T.normalized_entity, label) == wanted


def test_roman():
    assert [lexicon.roman(n) for n in (1, 4, 9, 14, 21)] == ["I", "IV", "IX", "XIV", "XXI"]


def test_score(spark):
    q = spark.createDataFrame([("1", ["Warsaw", "the city"]), ("2", ["x"]), ("3", ["a b"])], "id string, answers array<string>")
    p = spark.createDataFrame([("1", "City"), ("3", "b c")], "id string, prediction string")
    rows = {r.id: (r.exact_match, round(r.f1, 4)) for r in evaluate.score(q, p).collect()}
    assert rows == {"1": (1, 1.0), "2": (0, 0.0), "3": (0, 0.6667)}
    s = evaluate.summary(evaluate.score(q, p)).first()
    assert (s.total, round(s.exact_match, 3)) == (3, 33.333)


def test_pairs(spark):
    df = spark.createDataFrame([(1, i, "t", [str(i)], f"r{i}") for i in range(3)] + [(2, 0, "u", ["x"], "only")], "page_id long, sent_no int, title string, tokens array<string>, raw_text string")
    rows = {(r.page_id, tuple(r.sentence_nums)): r.raw_text for r in sentences.sentence_pairs(df).collect()}
    assert rows == {(1, (0, 1)): "r0 r1", (1, (1, 2)): "r1 r2", (2, (0,)): "only"}
    assert sentences.both_modes(df).count() == 4 + 3


def test_paragraphs(spark):
    text = "== List ==\n* a\n\n* b\n\nEnd. \nmore\n\n\nx:\n\n* c"
    p = sentences.paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.text for r in p.orderBy("pos").collect()] == ["List:", "* a", "* b", "End. more", "x:", "* c"]
    merged = sentences.merged_list_paragraphs(p, F.col("text").rlike(r"^\s?\*"), F.rtrim("text").endswith(":"))
    assert [r.text for r in merged.orderBy("island").collect()] == ["List: * a * b", "End. more", "x: * c"]


def test_matches(spark):
    rows = spark.createDataFrame([("k", 0.7, 0), ("k", 0.9, 1), ("k", 0.9, 2)], "key string, sim double, no int")
    assert match.best_per_key(rows, ["key"], "sim", ["no"]).first().no == 1
    other = rows.select("key", "sim", (F.col("no") + 10).alias("no"))
    assert match.merge_best(other, rows, ["key"], "sim", ["no"]).first().no == 11
    types = spark.createDataFrame([("Nil", [("RIVER", ["nile", "Nil"]), ("LOC", ["Ni"])]), ("il", [("A", ["Nil"]), ("B", ["il"])]), ("q", [("C", ["x"])])], "answer string, types array<struct<ner:string,answers:array<string>>>")
    assert [r.ner for r in match.ner_of_translation(types).orderBy("answer").collect()] == ["RIVER", "B", "C"]


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<float>")
    found = retrieve.nearest(v, v.where("id = 1"), 2)
    assert [(r.place, r.id) for r in found.orderBy("place").collect()] == [(0, 1), (1, 2)]
    pages = spark.createDataFrame([(1, 3)], "query_id long, id long")
    assert retrieve.on_pages(found, pages).count() == 0
    assert [(r["rank"], r.n) for r in retrieve.self_ranks(v).collect()] == [(0, 3)]


def test_spans(spark):
    p = spark.createDataFrame([(1, 0, "One. Two is here."), (1, 1, "Three. Four."), (2, 0, "Two")], "page_id long, pos int, text string")
    m = spark.createDataFrame([(1, "Two is here.", "is"), (1, "here. Three.", "Three"), (2, "absent", "x")], "page_id long, sentence string, answer string")
    rows = spans.locate(m, p).collect()
    assert {(r.sentence, r.context[r.answer_start :][: len(r.answer)]) for r in rows} == {("Two is here.", "is"), ("here. Three.", "Three")}


def test_links(spark):
    g = link.edges(spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (4, 4)], "src long, dst long"))
    assert g.count() == 3
    assert {r.id for r in link.within(g, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1, 2, 3}
    rows = spark.createDataFrame([("a#x",), ("b",), ("c",)], "t string")
    found = link.section_fallback(rows, "t", spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "v")
    assert {r.t: r.v for r in found.collect()} == {"a#x": 1, "b": 2, "c": None}


def test_nesting(spark, tmp_path):
    corpus = {"version": "1", "data": [{"title": "T", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a", "answer_start": 0}, {"text": "b", "answer_start": 2}]}, {"id": "2", "question": "r", "answers": [], "is_impossible": True}]}]}]}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(corpus, indent=1))
    flat = nest.flatten(files.read_corpus(spark, str(path)))
    assert [(r.id, r.answer, r.is_impossible) for r in flat.orderBy("qa_ix", "ans_ix").collect()] == [("1", "a", False), ("1", "b", False), ("2", None, True)]
    nested = nest.nest(flat.where("answer is not null").withColumn("ordinal", F.col("ans_ix")))
    files.write_corpus(nested, str(tmp_path / "out"))
    back = nest.flatten(files.read_corpus(spark, str(tmp_path / "out")))
    assert [(r.title, r.id, r.answer) for r in back.orderBy("ans_ix").collect()] == [("T", "1", "a"), ("T", "1", "b")]
    (tmp_path / "p.json").write_text(json.dumps({"1": "x", "2": ""}))
    assert {r.id: r.prediction for r in files.read_predictions(spark, str(tmp_path / "p.json")).collect()} == {"1": "x", "2": ""}


def test_report(spark):
    rows = spark.createDataFrame([("A", False), ("A", True), (None, False)], "c string, x boolean")
    found = report.by_category(rows, F.col("c"), F.col("x"))
    assert {r.category: (r.n_all, r.n_original, r.n_extended) for r in found.collect()} == {"A": (2, 1, 1), "OTHER": (1, 1, 0), "ALL": (3, 2, 1)}
    assert report.text_of(found, "all") == "all:\n    ALL: 3\n    A: 2\n    OTHER: 1\n"


def test_augment(spark):
    row = ("Kto pisze", "Adam Mickiewicz", 4, "PERSON", ["Kto", "pisze"], ["kto", "pisać"], [("Adam Mickiewicz herbu Poraj", "persName")], 0.9)
    df = spark.createDataFrame([row, row[:-1] + (0.5,)], "question string, answer string, answer_start int, answer_ne string, q_tokens array<string>, q_lemmas array<string>, entities array<struct<text:string,label:string>>, similarity double")
    rows = augment.extended(df, augment.person_rules()).where("extended").collect()
    assert {(r.answer, r.answer_start) for r in rows} == {("Mickiewicz", 9), ("Adam Mickiewicz herbu Poraj", 4)}


def test_devset(spark):
    text = "# x\n\nT: title\nC: context\nQ: one?\nA: a; b\nS: s\nA_NE: DATE\n====\nQ: two?\nA: c"
    rows = devset.parse(spark.createDataFrame([(1, text), (2, "T: u\nC: d\nQ: three?\nA: e")], "file_id long, text string")).orderBy("id").collect()
    assert [(r.id, r.title, r.question, r.answers, r.answer_ne) for r in rows] == [(1000001, "title", "one?", ["a", "b"], "DATE"), (1000002, "title", "two?", ["c"], None), (1000003, "u", "three?", ["e"], None)]


def test_files(spark, tmp_path):
    (tmp_path / "wiki.xml").write_text("<mediawiki><page><title>2001</title><ns>0</ns><id>7</id><revision><text>Ala</text></revision></page><page><title>x</title><ns>0</ns><id>8</id><revision><text>#REDIRECT [[y]]</text></revision></page><page><title>z</title><ns>4</ns><id>9</id><revision><text>t</text></revision></page></mediawiki>")
    assert [(r.page_id, r.title, r.text) for r in files.read_wiki(spark, str(tmp_path / "wiki.xml")).collect()] == [(7, "2001", "Ala")]
    (tmp_path / "titles.txt").write_text("pl1 ||| en\npl2 ||| en\nbroken\nb ||| c\n")
    assert {r.en: r.pl for r in files.read_titles(spark, str(tmp_path / "titles.txt")).collect()} == {"en": "pl2", "c": "b"}
    (tmp_path / "index.txt").write_text("12:3:A: b\n")
    assert files.read_index(spark, str(tmp_path / "index.txt")).first().title == "A: b"
    (tmp_path / "links.sql").write_text("x\nINSERT INTO `langlinks` VALUES (1,'pl','O\\'Hara'),(2,'de','x');\n")
    assert [(r.page_id, r.title) for r in files.read_langlinks_dump(spark, str(tmp_path / "links.sql")).collect()] == [(1, "O'Hara")]
    df = spark.createDataFrame([(1, 'a "b" c')], "id int, title string")
    files.write_pairs(df, str(tmp_path / "pairs"))
    assert files.read_pairs(spark, str(tmp_path / "pairs"), "id int, title string").collect() == df.collect()
    os.makedirs(tmp_path / "stream")
    doc = {"text": "t", "sentence": []}
    (tmp_path / "stream/a.bin").write_bytes(delimited.write_frames([{"title": "T", "paragraphs": [{"context": doc, "qas": [{"id": "1", "question": doc, "answers": [doc], "answerOffsets": [5]}]}]}]))
    assert delimited.read_annotated(spark, str(tmp_path / "stream")).selectExpr("paragraphs[0].qas[0].answerOffsets[0] as o").first().o == 5


def test_resume(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "text string, n int").write.parquet(source)
    seen = []

    def work(rows):
        seen.append(rows.count())
        return rows

    for _ in range(2):
        stream = spark.readStream.schema("text string, n int").parquet(source)
        incremental.resume(stream, out, "text", work, str(tmp_path / f"check{len(seen)}")).awaitTermination()
    assert seen == [2, 0] and spark.read.parquet(out).count() == 2


def test_noun_rules(spark):
    schema = "question string, answer string, answer_start int, answer_ne string, q_tokens array<string>, q_lemmas array<string>, q_poss array<string>, next_word string, next_lemma string, next_pos string, answer_words array<struct<text:string,lemma:string,pos:string>>, similarity double"
    rows = [
        ("Ile osób", "12", 3, "NUMBER", ["Ile", "osób"], ["ile", "osoba"], ["X", "NOUN"], "osób", "osoba", "NOUN", [], -1.0),
        ("Jaki port", "port morski", 5, "OTHER", ["Jaki", "port"], ["jaki", "port"], ["DET", "NOUN"], None, None, None, [("port", "port", "NOUN"), ("morski", "morski", "ADJ")], -1.0),
    ]
    found = augment.extended(spark.createDataFrame(rows, schema), augment.noun_rules()).where("extended").collect()
    assert {(r.question, r.answer, r.answer_start) for r in found} == {("Ile osób", "12 osób", 3), ("Jaki port", "morski", 10), ("Który port", "port morski", 5)}


def test_more_links(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, title string")
    links = spark.createDataFrame([(1, "b"), (1, "b"), (1, "zz"), (9, "a"), (2, "b")], "src long, dst_title string")
    assert [tuple(r) for r in link.resolve_links(links, pages).collect()] == [(1, 2)]
    assert link.related_pages(pages, None, 0).count() == 2
    with pytest.raises(ValueError):
        link.related_pages(pages, None, 2)
    assert link.one_to_one(pages, pages.select("page_id", F.lit(1).alias("x")), "page_id").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        link.one_to_one(pages.union(pages), pages.select("page_id", F.lit(1).alias("x")), "page_id").collect()


def test_annotated(spark):
    doc = lambda *words: {"text": " ".join(w for w, _ in words), "sentence": [{"token": [{"word": w, "pos": None, "originalText": w, "ner": n, "lemma": None} for w, n in words]}] if words else []}
    from lexloom.sources.schemas import ARTICLE

    article = {"title": "T", "paragraphs": [{"context": doc(("In", "O"), ("Paris", "LOCATION")), "qas": [{"id": "1", "question": doc(("q", "O")), "answers": [doc(("Paris", "O")), doc()], "answerOffsets": [3, 0]}]}]}
    rows = T.annotated_answers(spark.createDataFrame([article], ARTICLE))
    found = rows.select("qid", "answer", T.entity_in_context(F.col("tokens"), F.col("entities"), F.col("context_tokens"), F.col("context_entities")).alias("ner")).collect()
    assert [tuple(r) for r in found] == [("1", "Paris", "LOCATION")]
    known = spark.createDataFrame([("x", "A", 1), ("x", "O|B", 2), ("y", "O|B", 3)], "answer string, ner string, ordinal int")
    assert sorted((r.ordinal, r.ner) for r in T.with_known(known).collect()) == [(1, "A"), (2, "A"), (3, "O|B")]


def test_detokenized(spark):
    from lexloom.functions import text

    rows = spark.createDataFrame([("a , b", "a, b"), ("lata 80 s temu", "lata 80s temu"), ("( x )", "(x)"), ("same , one", "same , one")], "a string, o string")
    got = [r.x for r in rows.select(text.detokenized(F.col("a"), F.col("o"), (",", "(", ")")).alias("x")).collect()]
    assert got == ["a, b", "lata 80s temu", "(x)", "same , one"]
    m = spark.createDataFrame([([("a", "X"), ("b", "Y"), ("a", "Z")],)], "e array<struct<text:string,label:string>>").select(text.entity_map(F.col("e")).alias("m")).first().m
    assert m == {"a": "Z", "b": "Y"}


def test_composites(spark):
    from lexloom.operators import dataset

    texts = spark.createDataFrame([("g", 1, "one"), ("g", 2, "two"), ("g", 3, "one")], "group_id string, ordinal long, text string")
    done = spark.createDataFrame([("two",)], "text string")
    assert [r.text for r in dataset.work_off(texts, done, lambda df: df, 3).collect()] == ["one"]
    assert sorted(r.text for r in dataset.shuffled(texts, 3).collect()) == ["one", "one", "two"]
    answers = spark.createDataFrame([("1", "a", ["x", "y"]), ("2", "b", [])], "qid string, en_answer string, translations array<string>")
    questions = spark.createDataFrame([("1", "Kto to jest?"), ("2", "Kto to jest?")], "qid string, question string")
    ner = spark.createDataFrame([("1", "a", "O")], "qid string, en_answer string, ner string")
    assert {(r.answer, r.ner) for r in T.translated_questions(answers, questions, ner).collect()} == {("x", "O"), ("y", "O")}


def _vectors(spark, n=1500, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[:20] = x[20:40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)


def test_nearest_by_brute_force(spark, monkeypatch):
    from lexloom.operators import retrieve

    monkeypatch.setattr(retrieve, "ROWS", 100)
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    x, df = _vectors(spark, 400)
    odd = spark.createDataFrame([(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0] * 3), (1004, [None] * 24), (1005, [2.0] * 3)], "id long, vector array<double>")
    for most in (1 << 20, 0):
        monkeypatch.setattr(retrieve, "BROADCAST_BYTES", most)
        found = retrieve.nearest(df.unionByName(odd), df.where("id % 10 = 0").unionByName(odd), 6, 6).collect()
        got = {}
        for r in found:
            got.setdefault(r.query_id, []).append((r.place, r.id, r.similarity))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for q in range(0, 400, 10):
            cos = np.round(u[q] @ u.T, 6)
            want = sorted(range(400), key=lambda i: (-cos[i], i))[:6]
            assert [i for _, i, _ in sorted(got[q])] == want
        assert set(got) == {*range(0, 400, 10), 1003, 1005} and [i for _, i, _ in sorted(got[1003])] == [1003, 1005]


def test_recall_of_the_nearest_cells(spark):
    from lexloom.operators import cells, retrieve

    _, df = _vectors(spark)
    queries = df.where("id % 50 = 0")
    exact = {(r.query_id, r.id) for r in retrieve.nearest(df, queries, 20).collect()}
    index = cells.build(df)
    found = {(r.query_id, r.id) for r in cells.search(index, queries, 20, probes=2 * len(index.centroids) // 3, exact=False).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_containing_by_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("ab"), " ".join(rng.choices(["x", "y", "z", "xy", "Z"], k=rng.randrange(0, 30)))) for i in range(80)]
    asked = [(k, a) for k in "ab" for a in ("x", "x y", "z z", "y xy x", "", "Q", "x y z x y")]
    d = spark.createDataFrame(docs, "doc_id long, key string, text string").withColumn("tokens", F.filter(F.split(F.lower("text"), " "), lambda t: t != ""))
    a = spark.createDataFrame(asked, "key string, answer string").withColumn("answer_tokens", F.filter(F.split(F.lower("answer"), " "), lambda t: t != ""))
    want = set()
    for i, k, t in docs:
        words = [w for w in t.lower().split(" ") if w]
        for j, s in asked:
            n = [w for w in s.lower().split(" ") if w]
            if j == k and s.lower() in t.lower() and any(words[p : p + len(n)] == n for p in range(max(1, len(words) - len(n) + 1))):
                want.add((i, s))
    assert {(r.doc_id, r.answer) for r in match.containing(d, a, "key", ["doc_id"]).collect()} == want


def test_batches(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([None, 0, 3, 50, 200])) for g in ("a", "b", None) for i in range(60)]
    got = {(r.group_id, r.ordinal): r.batch for r in T.request_batches(spark.createDataFrame(rows, "group_id string, ordinal long, size long"), 100).collect()}
    for g in ("a", "b", None):
        total = number = 0
        for _, i, size in [x for x in rows if x[0] == g]:
            assert got[g, i] == number
            total += size or 0
            if total >= 100:
                total, number = 0, number + 1


def test_long_inputs_are_whole(spark):
    from lexloom.functions.arrays import overlap_count

    words = [f"w{i % 977}" for i in range(12_000)]
    row = ("Ile " + " ".join(words), "12", 4, "NUMBER", ["Ile", *words], ["ile", *words], [], -1.0)
    df = spark.createDataFrame([row], "question string, answer string, answer_start int, answer_ne string, q_tokens array<string>, q_lemmas array<string>, entities array<struct<text:string,label:string>>, similarity double")
    made = augment.extended(df, augment.number_rules()).where("extended").first()
    assert made.question == "Jak wiele " + " ".join(words)
    other = [f"w{i % 1500}" for i in range(9_000)]
    common = sum((Counter(words) & Counter(other)).values())
    assert spark.createDataFrame([(words, [*other, None])], "a array<string>, b array<string>").select(overlap_count(F.col("a"), F.col("b")).alias("n")).first().n == common
