"""Column expressions over text: answers, questions, titles, tags and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Articles that answers are compared without.
ARTICLES = ("a", "an", "the")
#: Marks that a token must not be.
TOKEN_MARKS = (",", ".", ":", ";", "%", "-", "'")
TOKEN = r"(?U)^[\w%,.:;'\-‐−]+$"


def answer_tokens(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, split at white space."""
    parts = F.split(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"\s+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*ARTICLES))


def normalized_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def tokens(text: Column) -> Column:
    """Lower-cased words of token characters that aren't single marks; the stand-in for a model's tokenizer."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t.rlike(TOKEN) & ~t.isin(*TOKEN_MARKS))


def without_stop_words(words: Column, stop: tuple[str, ...]) -> Column:
    """Keeps order and repeats, which a set difference would not."""
    return F.filter(words, lambda t: ~t.isin(*stop))


def affirmative(question: Column, answer: Column) -> Column:
    """The answer before the question without one closing mark, in lower case."""
    return F.concat_ws(" ", F.lower(answer), F.lower(F.regexp_replace(question, r"[?.]$", "")))


def is_valid_question(question: Column) -> Column:
    """More than five characters and more than one blank."""
    return (F.char_length(question) > 5) & (F.char_length(question) - F.char_length(F.replace(question, F.lit(" "), F.lit(""))) > 1)


def cleaned_answer(text: Column) -> Column:
    """Without one leading bracket or star and one closing bracket, and the blanks beside them."""
    return F.regexp_replace(F.regexp_replace(text, r"^[()*]\s*", ""), r"\s*[()]$", "")


def tag(page_id: Column, sentence_nums: Column, title: Column) -> Column:
    """The key of a sentence or run of sentences: id, numbers, title."""
    return F.concat_ws("_", page_id.cast("string"), F.array_join(F.transform(sentence_nums, lambda n: n.cast("string")), ";"), title)


def tag_parts(value: Column) -> Column:
    """The struct (page_id, sentence_nums, title) of a tag; the title may hold the separator."""
    parts = F.split(value, "_", 3)
    return F.struct(parts[0].cast("long").alias("page_id"), F.transform(F.split(parts[1], ";"), lambda n: n.cast("int")).alias("sentence_nums"), parts[2].alias("title"))


def normalized_title(title: Column, blanks_too: bool = False) -> Column:
    """Unquoted, lower case, without joining marks."""
    return F.regexp_replace(F.lower(unquoted(title)), "[ _,():&']" if blanks_too else "[_,():&']", "")


def unquoted(title: Column) -> Column:
    """%XX decoded, + kept; a title with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title)


def plain_title(title: Column) -> Column:
    """Blanks as underscores, without the mark of the sentence mode."""
    return F.regexp_replace(F.replace(title, F.lit(" "), F.lit("_")), r"_\(sentence_[12]\)", "")


def without_headers(text: Column) -> Column:
    """Headings between two and six equal signs removed, the deepest first."""
    for n in range(6, 1, -1):
        text = F.regexp_replace(text, "={%d}.+?={%d}" % (n, n), "")
    return text


def formatted_numbers(text: Column) -> Column:
    """A number template gives its number."""
    return F.regexp_replace(text, r"\{\{formatnum:(.*?)\}\}", "$1")


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def before_appendix(text: Column, headings: tuple[str, ...] = ("Przypisy", "Zobacz też", "Linki zewnętrzne")) -> Column:
    """The text up to the first heading of an appendix."""
    return F.regexp_extract(text, r"(?s)^(.*?)(?:== ?(?:%s) ?==.*)?$" % "|".join(headings), 1)


def without_quotes_of_markup(text: Column) -> Column:
    """Bold and italic marks, double and hard blanks."""
    text = F.replace(F.replace(text, F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))
    return F.replace(F.replace(text, F.lit("  "), F.lit(" ")), F.lit(" "), F.lit(" "))


def is_redirect(text: Column) -> Column:
    return F.ltrim(F.lower(text)).startswith("#redirect")


def sentences(text: Column) -> Column:
    """Lines, each split after its closing marks, trimmed, without empty ones."""
    lines = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.split(x, r"(?<=[.!?…])\s+")))
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def is_prose(sentence: Column) -> Column:
    """Neither a category nor a picture."""
    return ~sentence.startswith("Kategoria:") & ~sentence.contains(".jpg")


def stripped_edges(text: Column) -> Column:
    """The struct (text, removed): without marks at the edges, and how many were before it."""
    left = F.regexp_replace(text, r"^[ .,!:;?`'$\"]+", "")
    return F.struct(F.regexp_replace(left, r"[ .,!:;?`'$\"]+$", "").alias("text"), (F.char_length(text) - F.char_length(left)).alias("removed"))


def nth_position(hay: Column, needle: Column, n: Column) -> Column:
    """Where the n-th occurrence (from 0, overlaps not counted) of needle begins, 0-based, or -1."""
    parts = F.split(hay, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")))
    gone = F.aggregate(F.slice(parts, F.lit(1), n + 1), F.lit(0), lambda acc, x: acc + F.char_length(x)) + n * F.char_length(needle)
    return F.when(F.size(parts) > n + 1, gone).otherwise(F.lit(-1))


# Marks that tokenizers set apart, in this order, and spellings that they part.
TIGHT_MARKS = (",", ".", ":", ";", "'", "-", "‐", "−", "–", "%", "’", "°", "(", ")", "/", "„", "”", "+")
REPAIRS = (
    ("° C", "°C"),
    ("/ t /", "/t/"),
    ("AC / DC", "AC/DC"),
    ("12 terabajtów / miesiąc", "12 terabajtów/miesiąc"),
    ("George’a H. W. Busha", "George’a H.W. Busha"),
    ("3: 4, 3: 5, 4: 7 i 2: 5", "3:4, 3:5, 4:7 i 2:5"),
    ("rezonans 2: 3", "rezonans 2:3"),
    ("rezonansem 2: 3", "rezonansem 2:3"),
    ("nie przeszkadzać ”", "nie przeszkadzać"),
    ("Macintosha 128 K", "Macintosha 128K"),
    ("soli miedzi (II", "soli miedzi(II)"),
    ("sole miedzi (II", "sole miedzi(II)"),
    ("tlenek ołowiu (II", "tlenek ołowiu(II)"),
    ("km / h", "km/h"),
    ("720 p", "720p"),
    ("90 ° względem siebie", "90° względem siebie"),
    ("subject–verb–object", "subject – verb – object"),
    ("Alzacja - Lotaryngia", "Alzacja-Lotaryngia"),
    ("La Isla Bonita ”", "La Isla Bonita"),
    ("HIV / AIDS", "HIV/AIDS"),
    ("urządzenia wejścia / wyjścia", "urządzenia wejścia/wyjścia"),
    ('" Into the Groove "', '"Into the Groove"'),
)


# Spellings of original answers that are repaired alike.
ORIGINAL_REPAIRS = (
    ("nie przeszkadzać ”", "nie przeszkadzać"),
    ("soli miedzi (II", "soli miedzi(II)"),
    ("sole miedzi (II", "sole miedzi(II)"),
    ("La Isla Bonita ”", "La Isla Bonita"),
    ('" Into the Groove "', '"Into the Groove"'),
)


def _folded(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """text after replacements in their order."""
    entries = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in pairs))
    return F.aggregate(entries, text, lambda out, p: F.replace(out, p["old"], p["new"])) if pairs else text


def repaired_original(original: Column, repairs: tuple[tuple[str, str], ...] = ORIGINAL_REPAIRS) -> Column:
    """An original answer with repaired spellings, as it is compared with a detokenized one."""
    return _folded(original, repairs)


def detokenized(answer: Column, original: Column, marks: tuple[str, ...] = TIGHT_MARKS, repairs: tuple[tuple[str, str], ...] = REPAIRS) -> Column:
    """The answer without blanks before and after marks (in their order) where the original has none, and with repaired spellings."""
    blank = F.lit(" ")
    # a fold over the marks and then the repairs: each step stands once in the plan
    sides = F.array(*(F.struct(a.alias("old"), F.lit(m).alias("new")) for m in marks for a in (F.concat(blank, F.lit(m)), F.concat(F.lit(m), blank))))
    tight = F.aggregate(sides, answer, lambda out, m: F.when(original.contains(m["old"]), out).otherwise(F.replace(out, m["old"], m["new"])))
    out = F.when(F.lower(answer) != F.lower(original), F.replace(tight, F.lit(" s "), F.lit("s "))).otherwise(answer)
    return _folded(out, repairs)


def is_letters(word: Column) -> Column:
    return word.rlike("^[A-Za-z ]+$")


def is_roman(word: Column) -> Column:
    return word.rlike("^[IVXLCDM]+$")


def entity_map(entities: Column) -> Column:
    """The map of an array of (text, label); of a repeated text the last label."""
    texts = F.array_distinct(F.transform(entities, lambda e: e["text"]))
    return F.map_from_entries(F.transform(texts, lambda t: F.struct(t, F.element_at(F.filter(entities, lambda e: e["text"] == t), -1)["label"])))
