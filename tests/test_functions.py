import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import arrays as A
from lexloom.functions import markup, metrics
from lexloom.functions import text as T
from lexloom.sources import delimited as D


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("needle, hay, first, last", [(["b", "c"], ["a", "b", "c"], 1, 1), ([], ["a"], 0, 1), (["a", "b", "c"], ["a"], -1, -1), (["z"], ["a"], -1, -1), (["a"], ["a", "b", "a"], 0, 2), ([], [], 0, 0)])
def test_sublists(spark, needle, hay, first, last):
    assert one(spark, A.sublist_position(F.col("n"), F.col("h")), n=needle, h=hay) == first
    assert one(spark, A.last_sublist_position(F.col("n"), F.col("h")), n=needle, h=hay) == last
    assert one(spark, A.contains_sublist(F.col("n"), F.col("h")), n=needle, h=hay) == (first >= 0)


def test_scores(spark):
    p, t = "x b b c".split(), "y b b b d".split()
    assert one(spark, A.overlap_count(F.col("p"), F.col("t")), p=p, t=t) == 2
    assert one(spark, metrics.f1(F.col("p"), F.col("t")), p=p, t=t) == pytest.approx(4 / 9)
    assert one(spark, metrics.f1(F.col("t"), F.col("p")), p=p, t=t) == pytest.approx(4 / 9)
    empty = [T.answer_tokens(F.col(c)) for c in ("a", "b")]
    assert one(spark, metrics.exact_match(*empty), a="a", b="the") == 1
    assert one(spark, metrics.f1(*empty), a="a", b="the") == 0


@pytest.mark.parametrize(
    "make, value, wanted",
    [
        (T.normalized_answer, "The Eiffel-Tower, a!", "eiffeltower"),
        (T.is_valid_question, "Kto to jest?", True),
        (T.is_valid_question, "Kto to?", False),
        (T.cleaned_answer, "(25,700 km", "25,700 km"),
        (T.cleaned_answer, "250,000 feet (", "250,000 feet"),
        (T.formatted_numbers, "{{formatnum:710231}}", "710231"),
        (T.without_headers, "a ===b=== c ==d==", "a  c "),
        (T.before_appendix, "x\n== Przypisy ==\ny", "x\n"),
        (T.before_appendix, "x", "x"),
        (T.normalized_title, "A_(b%20c)+%zz", "ab%20c+%zz"),
        (T.normalized_title, "A_(b%20c)+", "ab c+"),
        (T.plain_title, "Jan Nowak (sentence_1)", "Jan_Nowak"),
        (T.is_redirect, "  #REDIRECT [[x]]", True),
        (T.single_blanks, "a   b  c", "a b c"),
        (T.sentences, "Ala ma. Kota!\n\n x ", ["Ala ma.", "Kota!", "x"]),
        (T.tokens, "Łódź , - 12% it's", ["łódź", "12%", "it's"]),
    ],
)
def test_text(spark, make, value, wanted):
    assert one(spark, make(F.col("v")), v=value) == wanted


def test_affirmative(spark):
    assert one(spark, T.affirmative(F.col("q"), F.col("a")), q="Kto to jest?", a="Jan") == "jan kto to jest"


def test_tags(spark):
    parts = one(spark, T.tag_parts(F.col("v")), v="12_3;4_Jan_Kowalski")
    assert (parts.page_id, parts.sentence_nums, parts.title) == (12, [3, 4], "Jan_Kowalski")
    assert one(spark, T.tag(F.lit(12), F.array(F.lit(3), F.lit(4)), F.col("v")), v="Jan_Kowalski") == "12_3;4_Jan_Kowalski"


@pytest.mark.parametrize("hay, n, wanted", [("a.b a.b a.b", 0, 0), ("a.b a.b a.b", 2, 8), ("a.b", 1, -1), ("axb a.b", 0, 4)])
def test_nth(spark, hay, n, wanted):
    assert one(spark, T.nth_position(F.col("h"), F.lit("a.b"), F.col("n")), h=hay, n=n) == wanted


@settings(max_examples=200, deadline=None)
@given(st.text("[]F:x", max_size=30))
def test_nested_removal_ends_and_keeps_the_rest(text):
    text = text.replace("F:", "File:")
    left = markup.without_nested(text)
    assert len(left) <= len(text) and markup.without_nested(left.replace("[[File:", "")) == left.replace("[[File:", "")


def test_nested_removal():
    assert markup.without_nested("a[[File:x|[[y]] z]]b[[c]]") == "ab[[c]]"
    assert markup.without_nested("a[[File:x") == "a[[File:x"
    assert markup.without_nested(None) is None


def test_frames():
    rng = random.Random(1)
    doc = lambda: {"text": "é" * rng.randrange(200), "sentence": [{"token": [{"word": "w", "pos": None, "originalText": "W", "ner": "O", "lemma": None}]}]}
    articles = [{"title": f"t{i}", "paragraphs": [{"context": doc(), "qas": [{"id": "1", "question": doc(), "answers": [doc(), doc()], "answerOffsets": [3, -1]}]}]} for i in range(4)]
    data = D.write_frames(articles)
    assert [D.decode(f, D.ARTICLE_FIELDS) for f in D.frames(data)] == articles
    with pytest.raises(ValueError):
        list(D.frames(data[:-1]))
