"""Secret scans: candidate strings, and a random forest that removes the false positives, in DataFrame and ML expressions only.

Candidates are of two kinds:

* runs of key characters of at least 12, with a digit and a letter, wherever they stand;
* values of any length and of any characters but white space that stand after a name such as password, token or api_key: assigned to it
  within a word or across words, or just beside it.

Nothing else is judged before the forest. Its features are the candidate's length and kinds of characters, how its characters follow one another (by
the corpus's own letter pairs), how much of it a dictionary of the corpus covers (its most frequent letter triples), signs of a path, and the
neighbouring words. The dictionary and the pairs count every document; the tables that are kept have a fixed size. The forest is
trained from labelled findings; without any given, from findings that a rule makes (a bounded number).
"""

from __future__ import annotations

import json
import math
import random
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

SPACES, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
KEY_CHARS = r"A-Za-z0-9_+/\-"
RUN = rf"[{KEY_CHARS}]{{12,}}={{0,2}}"
#: Names of what is secret, and how they may go on; not within a longer word, so that "passage" is none.
NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:[_-]?(?:key|token))?|private[_-]?key|credentials?|bearer)(?:[_\-0-9][A-Za-z0-9_\-]*|s)?"
NAMED = rf"(?i)(?:^|[^A-Za-z]){NAMES}[\"'`)\]]*"
#: A word that assigns a value itself; what stands before a value in the words before it; a word that only assigns.
INLINE, CONTEXT, OPERATOR = rf"{NAMED}(?:[:=]+>?)[\"'`(\[{{<]*(?=[^\"'`(\[{{<])", rf"{NAMED}(?:[:=]+>?[\"'`]?| [:=]+>?| is)?$", r"(?i)^(?:[:=]+>?|is)?$"
#: A value without its quotes and what follows them, or without the punctuation at its end.
VALUE = r"(?s)^[\"'`(\[{<]*(.*?)(?:[\"'`].*|[,;.)\]}>]*)$"
#: A document without this holds no candidate.
MAYBE = rf"(?i)[{KEY_CHARS}]{{12}}|(?:^|[^A-Za-z]){NAMES}(?![A-Za-z])"
#: Labelled findings that are made where none are given; trees, their depth and the seed.
MADE, TREES, DEPTH, SEED = 8_000, 32, 9, 11
#: Letter triples of the dictionary, and words of the corpus that made findings are built from.
TRIPLES, WORDS = 2_048, 256
SECRET_WORDS = "pass|pwd|secret|token|api|auth|key|cred|private|bearer|access"
PLAIN_WORDS = "uuid|guid|commit|sha|hash|md5|checksum|digest|revision|build|version|isbn|order|ticket|serial|doi|http|href|src|file|path|id\\b|ref|date|tel"
PLACEHOLDERS = r"(?i)\*{3}|x{4}|\.{3}|your|example|change.?me|placeholder|dummy|sample|redacted|none$|null$|true$|false$|undefined|^string$|env|config|getpass|input|prompt|self\.|[<{$%]|\(\)"
FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "symbol_share", "kinds", "kind_changes", "case_changes", "hex_share", "hex_only", "distinct_share", "vowel_follows", "consonant_runs", "pair_score", "dictionary_share",
    "separators", "slashes", "in_path", "assigned", "named", "quoted", "secret_words", "plain_words", "known_prefix", "placeholder",
)


class Profile(NamedTuple):
    """What the features know of the corpus: scores of the 729 pairs of letters and others, the triples of the dictionary, and frequent words."""

    pairs: tuple[float, ...]
    triples: tuple[str, ...]
    words: tuple[str, ...]


class Scanner(NamedTuple):
    forest: RandomForestClassificationModel
    profile: Profile


def profile(docs: DataFrame, text_col: str = "text") -> Profile:
    """The profile of all texts: words are counted in partial aggregates, and pairs and triples of letters once for each distinct word. At most 676 rows, TRIPLES and
    WORDS reach the driver. Without words the scores are equal and the dictionary is empty."""
    text = F.lower(F.col(text_col).cast("string"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("([a-z]{2,24})"), F.lit(1))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words, "secret-words")
    parts = lambda k: words.where(F.char_length("w") >= k).select(F.explode(F.expr(f"transform(sequence(1, char_length(w) - {k - 1}), i -> substring(w, i, {k}))")).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    pairs = {r["p"]: r["n"] for r in parts(2).collect()}
    triples = tuple(sorted(r["p"] for r in parts(3).orderBy(F.desc("n"), "p").limit(TRIPLES).collect()))
    common = tuple(r["w"] for r in words.where("char_length(w) between 3 and 12").orderBy(F.desc("n"), "w").limit(WORDS).collect())
    discard(words)
    letters = "abcdefghijklmnopqrstuvwxyz"
    scores = []
    for a in letters:
        total = sum(pairs.get(a + b, 0) for b in letters)
        scores += [math.log((pairs.get(a + b, 0) + 1) / (total + 26)) + math.log(26) for b in letters]
    return Profile(tuple(round(x, 6) for x in scores), triples, common)


def candidates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """carry columns, word_no, run_no (from 0), word, candidate, before (the two words before), after: one row a candidate.

    The value after a name comes first, then the runs of the word that differ from it.
    """
    text = F.col(text_col).cast("string")
    base = docs.where(text.rlike(MAYBE)).select(*carry, text.rlike(f"(?i){NAMES}").alias("_n"), F.split(text, f"{SPACES}+").alias("_w"))
    # the words are used often, so that the optimiser keeps them as a column
    near = lambda i: F.coalesce(F.get("_w", i), F.lit(""))
    before = lambda i: F.concat_ws(" ", near(i - 2), near(i - 1))
    value = lambda w, i: F.col("_n") & (w.rlike(INLINE) | (~w.rlike(OPERATOR) & before(i).rlike(CONTEXT)))
    hits = F.transform("_w", lambda w, i: F.when((w.rlike(RUN) & w.rlike("[0-9]")) | value(w, i), F.struct(i.alias("word_no"), w.alias("word"))))
    hits = base.select("*", F.filter(hits, lambda x: x.isNotNull()).alias("_x"))
    # outer, so that the optimiser infers no condition that it would push below the words, which it would then make again for each of them
    rows = hits.select(*carry, "_w", F.inline_outer("_x")).where("word_no is not null")
    rows = rows.select(*carry, "word_no", "word", before(F.col("word_no")).alias("before"), near(F.col("word_no") + 1).alias("after"))
    inline = F.when(F.col("word").rlike(INLINE), F.regexp_extract(F.regexp_replace("word", rf"(?is)^.*?{INLINE.removeprefix('(?i)')}", ""), VALUE, 1))
    beside = F.when(~F.col("word").rlike(OPERATOR) & F.col("before").rlike(CONTEXT), F.regexp_extract("word", VALUE, 1))
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({RUN})"), F.lit(1)), lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
    found = F.array_distinct(F.filter(F.concat(F.array(inline, beside), runs), lambda c: c.isNotNull() & (c != "")))
    return rows.select("*", F.posexplode(found).alias("run_no", "candidate"))


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.char_length(of), F.lit(1))


def _code(parts: Column, i: int) -> Column:
    return F.ascii(F.substring(parts, i, 1)) - 97


def with_features(rows: DataFrame, known: Profile) -> DataFrame:
    """rows (word, candidate, before, after) with the columns of FEATURES."""
    c, context = F.col("candidate"), F.lower(F.concat_ws(" ", "before", "word"))
    length, low = F.greatest(F.char_length("candidate"), F.lit(1)), F.lower("candidate")
    parts = lambda k: F.filter(F.transform(F.when(F.char_length("candidate") >= k, F.sequence(F.lit(1), F.char_length("candidate") - (k - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(low, i, F.lit(k))), lambda x: x.rlike(f"^[a-z]{{{k}}}$"))
    scores = F.split(F.lit(",".join(map(str, known.pairs))), ",").cast("array<double>")  # a constant for the optimiser
    bits = [0] * 275
    for t in known.triples:
        code = (ord(t[0]) - 97) * 676 + (ord(t[1]) - 97) * 26 + ord(t[2]) - 97
        bits[code // 64] |= 1 << code % 64
    table = F.split(F.lit(",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)), ",").cast("array<bigint>")
    triple = lambda x: _code(x, 1) * 676 + _code(x, 2) * 26 + _code(x, 3)
    bit = F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")  # a constant too
    listed = lambda x: F.get(table, F.floor(triple(x) / 64).cast("int")).bitwiseAND(F.get(bit, F.pmod(triple(x), F.lit(64)))) != 0
    pairs, triples = F.col("_pairs"), F.col("_triples")
    values = {
        "length": F.char_length(c), "digit_share": _share("[0-9]", c), "upper_share": _share("[A-Z]", c), "lower_share": _share("[a-z]", c), "symbol_share": _share("[^A-Za-z0-9]", c),
        "kinds": sum((c.rlike(x).cast("int") for x in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]")), F.lit(0)),
        "kind_changes": _share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]", c), "case_changes": _share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]", c),
        "hex_share": _share("[0-9a-f]", c), "hex_only": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / length,
        "vowel_follows": _share("(?i)(?<=[b-df-hj-np-tv-z])[aeiou]|(?<=[aeiou])[b-df-hj-np-tv-z]", c), "consonant_runs": _share("(?i)[b-df-hj-np-tv-z]{4}", c),
        "pair_score": F.aggregate(pairs, F.lit(0.0), lambda n, x: n + F.get(scores, _code(x, 1) * 26 + _code(x, 2))) / F.greatest(F.size(pairs), F.lit(1)),
        "dictionary_share": 3 * F.size(F.filter(triples, listed)) / F.greatest(length, F.lit(3)),
        "separators": F.regexp_count(c, F.lit(r"[_\-]")), "slashes": F.regexp_count("word", F.lit("/")),
        "in_path": F.col("word").rlike(r"(?i)://|\.(com|org|net|html?|php|pdf|png|jpe?g|txt|py|js|csv|gz)\b|^\.{0,2}/|^[A-Z]:\\").cast("int"),
        "assigned": F.concat_ws(" ", "before", "word").rlike(r"[=:]\s*[\"']?[^\s=:\"']").cast("int"), "named": (F.col("before").rlike(CONTEXT) | F.col("word").rlike(INLINE)).cast("int"),
        "quoted": F.col("word").rlike("[\"'`]").cast("int"),
        "secret_words": F.regexp_count(context, F.lit(SECRET_WORDS)), "plain_words": F.regexp_count(F.concat_ws(" ", context, F.lower("after")), F.lit(PLAIN_WORDS)),
        "known_prefix": c.rlike(r"^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk-|sk_live_|pk_live_|rk_live_|SG|eyJ)").cast("int"), "placeholder": c.rlike(PLACEHOLDERS).cast("int"),
    }
    rows = rows.select("*", parts(2).alias("_pairs"), parts(3).alias("_triples"))
    return rows.withColumns({name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in values.items()}).drop("_pairs", "_triples")


def made_findings(spark: SparkSession, words: tuple[str, ...] = (), n: int = MADE, seed: int = SEED) -> DataFrame:
    """(word, candidate, before, after, label): n labelled findings by a rule, half of them secrets; plain words are those given.

    Secrets: access key ids, passwords and pass phrases of letters, digits and signs, digits alone and letters alone that something assigns, hexadecimal and mixed tokens. Others:
    identifiers, commits and digests, paths and addresses, long names, dates and numbers in prose; and beside the names of secrets: placeholders, variables,
    calls, types and plain words. The rows are written out as one JSON constant, n is their bound.
    """
    rng = random.Random(seed)
    known = [w for w in words if 3 <= len(w) <= 12] or ["and", "the", "reason", "thing", "inside", "after", "under", "people", "which", "about", "other", "water"]
    pick, word = rng.choice, lambda: rng.choice(known)
    chars = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    upper, hexes = lower.upper(), "0123456789abcdef"
    every = lower + upper + digits
    long_word = lambda: word() + word() + word()
    name = lambda: pick(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "access_key", "PASSWORD", "db_password", "Token", "passphrase"))

    def beside(x: str) -> tuple[str, str, str]:
        """A value after a name: within its word, after a word that assigns, or just beside it."""
        q, form, sign = pick(('"', "'", "")), rng.randrange(4), pick(("=", "=", ":"))
        if form == 0:
            return x, f"{name()}{sign}{q}{x}{q}", f"{word()} {word()}"
        before = (f"{name()} {sign}", f"{word()} {name()}:", f"{name()} is")[form - 1]
        return x, q + x + q + pick(("", "", ",", ";", ".")), before

    def alone(x: str) -> tuple[str, str, str]:
        return x, x + pick(("", "", ".", ",")), f"{word()} {word()}"

    def after(x: str, *names: str) -> tuple[str, str, str]:
        return x, x, f"{word()} {pick(names)}"

    uuid = lambda: "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))
    path = lambda: f"/{word()}/{word()}-{long_word()}-{pick(('2019', '2021', 'page2', 'v2', 'part3'))}-{word()}"
    prose = lambda: pick(("password", "secret", "token", "credentials", "pass", "bearer", "passwords", "tokens", "secrets", "auth"))

    def within(x: str, start: str, end: str = "") -> tuple[str, str, str]:
        return x, start + x + end, f"{word()} {word()}"

    secrets = (
        lambda: alone("AKIA" + chars(upper + digits, 16)),
        lambda: beside("AKIA" + chars(upper + digits, 16)),
        lambda: beside(chars(hexes, pick((16, 18, 20, 24)))),
        lambda: beside(chars(hexes, pick((32, 40, 48, 64)))),
        lambda: beside(chars(hexes.upper(), pick((32, 40)))),
        lambda: beside(chars(every + "+/", pick((22, 32, 40, 44)))),
        lambda: beside(word() + chars(digits, pick((2, 3, 4)))),
        lambda: beside(word().title() + chars("!@#%-._", 1) + chars(digits, 2) + pick(("!", "?", "&", ""))),
        lambda: beside(chars(every, pick((8, 10, 12, 14)))),
        lambda: beside(chars(digits, pick((6, 8, 10)))),
        lambda: beside("".join(word().title() for _ in range(pick((2, 3, 4))))),
        lambda: beside(chars(every, 5) + chars("!@#:%^&*", 1) + chars(every, 5)),
        lambda: beside("-".join(word() for _ in range(4))),
        lambda: alone(pick(("ghp_", "sk-", "xoxb-", "glpat-", "sk_live_", "AIza")) + chars(every, 36)),
        lambda: after(chars(every, 24), "bearer", "Bearer", "token", "passphrase"),
    )
    others = (
        lambda: after(uuid(), "id", "uuid", "guid:", "request"),
        lambda: after(chars(hexes, 40), "commit", "sha1", "revision", "checksum", "hash:"),
        lambda: within(chars(hexes, pick((32, 40, 64))), pick(("md5", "checksum", "etag", "digest", "sha256")) + pick(("=", ":"))),
        lambda: within(path(), f"https://www.{word()}.com"),
        lambda: after(path(), "file", "in", "see", "path"),
        lambda: alone(f"{word()}_{long_word()}_{pick(('1', 'v2', '2024', 'x86'))}"),
        lambda: alone(f"20{chars(digits, 2)}-0{chars('123456789', 1)}-1{chars(digits, 1)}T1{chars(digits, 1)}"),
        lambda: after(pick(("ISBN", "DE", "EUR", "No")) + chars(digits, 12), "order", "number", "tel", "serial"),
        lambda: alone(long_word() + pick(("1", "2", "15"))),
        lambda: beside(pick(("None", "null", "true", "False", "undefined", "string", "str", "required", "optional", "********", "xxxxxxxx", "<password>", "changeme", "your-password-here", "YOUR_API_KEY", "..."))),
        lambda: beside(pick(("self.", "config.", "settings.", "os.environ.", "args.", "${", "process.env.")) + pick(("password", "token", "api_key", "secret"))),
        lambda: beside(pick(("get_", "read_", "load_", "make_")) + pick(("password", "token", "secret")) + "()"),
        lambda: after(word(), prose(), prose()),
        lambda: (x := word(), x + pick(("", ".", ",")), f"{pick(('the', 'a', 'this', 'un', 'der'))} {prose()}"),
        lambda: (x := word(), x, f"{name()} is"),
    )
    kinds = ("candidate", "word", "before")
    rows = [dict(zip(kinds, pick((others, secrets)[i % 2])()), after=word(), label=float(i % 2)) for i in range(n)]
    schema = "array<struct<word: string, candidate: string, before: string, after: string, label: double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def train(findings: DataFrame, known: Profile) -> Scanner:
    """The forest from labelled findings (word, candidate, before, after, label 0 or 1); rows with a null label or candidate are left out."""
    rows = with_features(findings.where("label is not null and candidate is not null"), known).select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = materialize(rows, "secret-findings")  # each step of the training reads them again
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="_features", labelCol="label").fit(_assembled(rows))
    discard(rows)
    return Scanner(forest, known)


def scanner(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text") -> Scanner:
    """A scanner for docs, trained on labelled findings (of any number; fit on a sample of them beyond some millions), or on MADE ones where none are given."""
    known = profile(docs, text_col)
    return train(made_findings(docs.sparkSession, known.words) if findings is None else findings, known)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep").transform(rows)


def _judged(rows: DataFrame, model: Scanner, keep: list[str]) -> DataFrame:
    rows = model.forest.transform(_assembled(with_features(rows, model.profile)))
    return rows.select(*keep, (F.col("prediction") == 1).alias("is_secret"))


def scan(docs: DataFrame, model: Scanner | None = None, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """carry columns, word_no, run_no, candidate, is_secret for every candidate of every row of docs.

    Null and empty texts have none; texts of any length are taken whole; repeated rows are scanned one by one; a column of carry that is named as one of the
    result gets the prefix "in_"; other columns are ignored; an empty table gives no rows. Beyond the profile nothing is shuffled: the forest is applied where the text is read.
    """
    model = model or scanner(docs, text_col=text_col)
    taken = {"word_no", "run_no", "candidate", "is_secret"}
    packed = docs.select(F.struct(*(F.col(c).alias(f"in_{c}" if c in taken else c) for c in carry)).alias("_carry"), F.col(text_col).alias("_text"))
    rows = _judged(candidates(packed, ("_carry",), "_text"), model, ["_carry", "word_no", "run_no", "candidate"])
    return rows.select("_carry.*", "word_no", "run_no", "candidate", "is_secret")


def _quoted(x: Column) -> Column:
    """A pattern for the string itself."""
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _places() -> Column:
    """A pattern for where a finding is replaced, the text before it as its first group: a run wherever it stands whole, any other value only in its word, after the same word."""
    run = F.col("candidate").rlike(f"^{RUN}$") & F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    head, tail = F.expr("substring(word, 1, locate(candidate, word) - 1)"), F.expr("substring(word, locate(candidate, word) + char_length(candidate))")
    previous = F.substring_index("before", " ", -1)
    inside = F.when(F.col("word").rlike(INLINE), F.lit("")).otherwise(F.concat(_quoted(previous), F.lit(rf"{SPACES}+")))
    value = F.concat(F.lit(rf"((?<!{WORD})"), inside, _quoted(head), F.lit(")"), _quoted(F.col("candidate")), F.lit("(?="), _quoted(tail), F.lit(rf"(?!{WORD}))"))
    return F.when(run, F.concat(F.lit(rf"((?<![{KEY_CHARS}]))"), _quoted(F.col("candidate")), F.lit(rf"(?![{KEY_CHARS}=])"))).otherwise(value)


def redact(docs: DataFrame, model: Scanner | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each secret in its text replaced by mark; all rows and columns stay, whatever they are named.

    A run of key characters is replaced wherever it stands whole in its document, but not within a longer run; any other value only in the word, after the
    word, in which it was found. Null, empty and very long texts, repeated rows and empty tables as in scan(). Only texts with a candidate are joined
    with their secrets; all others pass as they are.
    """
    model = model or scanner(docs, text_col=text_col)
    text = F.col(text_col).cast("string")
    maybe = F.coalesce(text.rlike(MAYBE), F.lit(False))
    keyed = docs.where(maybe).select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    rows = _judged(candidates(keyed, ("_id", "_th"), "_text"), model, ["_id", "_th", "word", "before", "candidate"]).where("is_secret")
    # longest first, so that a value goes before a run that is part of it
    order = F.array_sort(F.collect_set(F.struct((-F.char_length("candidate")).alias("n"), _places().alias("p"))))
    found = rows.groupBy(F.col("_id").alias("_f_id"), F.col("_th").alias("_f_th")).agg(order.alias("_found"))
    joined = keyed.join(found, keyed["_id"].eqNullSafe(found["_f_id"]) & (keyed["_th"] == found["_f_th"]), "left")
    by = F.lit("$1" + mark.replace("\\", "\\\\").replace("$", "\\$"))
    clean = F.when(F.col("_found").isNull(), F.col("_text")).otherwise(F.aggregate("_found", F.col("_text"), lambda t, x: F.regexp_replace(t, x["p"], by)))
    changed = joined.select("_row", clean.alias("_clean")).select(*(F.col("_clean").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns))
    return docs.where(~maybe).unionByName(changed)
