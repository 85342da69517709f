import hashlib
import itertools
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lexloom.llm import transducer as T  # noqa: E402

from test_bpe import texts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(PATH)


def automaton(tmp_path, entries) -> T.Lexicon:
    path = tmp_path / "lexicon"
    path.write_bytes(T.compiled(entries))
    return T.Lexicon(str(path))


def test_merges_and_decoding_equal_the_public_library(reference):
    own = T.Tokenizer(PATH)
    special = "<|endoftext|>"
    for text in itertools.chain(texts(), [special, f"a{special} b", f"{special}{special}", f" {special}'s <|endoftext|", "<|endoftext|" * 50]):
        ids = [i for w in own.words(text) for i in own.merge(w)]
        assert ids == reference.encode(text, add_special_tokens=False).ids, repr(text[:60])
        assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False) == text
    rng = random.Random(4)
    for _ in range(2000):  # any ids, also those whose bytes aren't UTF-8
        ids = [rng.choice([*range(256), rng.randrange(50257)]) for _ in range(rng.randrange(1, 9))]
        assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_transducer_is_minimal_and_gives_the_ids(tmp_path):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(400)})
    entries = [(w, tuple(rng.choices(range(5), k=rng.randrange(0, 4)))) for w in words]
    found = automaton(tmp_path, entries)
    every = ["".join(p) for n in range(1, 7) for p in itertools.product("abc", repeat=n)]
    wanted = dict(entries)
    assert found.look_up(every) == [wanted.get(w) for w in every]
    # suffixes are shared: as many states as there are different functions from what is left of a word to the ids still to come
    functions = set()
    for prefix in {w[:i].encode() for w in words for i in range(len(w) + 1)}:
        rest = {w.encode()[len(prefix) :]: ids for w, ids in entries if w.encode().startswith(prefix)}
        n = len(common(list(rest.values())))
        functions.add((not prefix, frozenset((r, ids[n if prefix else 0 :]) for r, ids in rest.items())))
    assert len(found.end) == len(functions)


def test_words_are_merged_together_as_alone():
    own, rng = T.Tokenizer(PATH), random.Random(6)
    words = ["a", "é", "aaaaaaa", "hello" * 4, *("".join(rng.choices(kind, k=rng.randrange(1, 30))) for kind in ("ab", " etaoin", "żółć€𝄞", "0123456789", "\n\t x") for _ in range(300))]
    ids, count = own.merge_all(*T.flat([w.encode() for w in words]))
    assert [tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1])] == [own.merge(w) for w in words]
    assert [len(x) for x in own.merge_all(*T.flat([]))] == [0, 0]


def test_digests_wherever_a_slice_of_words_ends(reference, tmp_path, monkeypatch):
    own, held = T.Tokenizer(PATH), automaton(tmp_path, [(" the", tuple(T.Tokenizer(PATH).merge(" the")))])
    rows = ["", None, *(t[:40] for t in texts()), None, "x" * 300, "a<|endoftext|> the<|endoftext|>", "żółw the 𝄞 it's\u2003 the", ""]
    encoded = [reference.encode(t or "", add_special_tokens=False).ids for t in rows]
    want = [(len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for x, t in zip(encoded, rows)]
    for size in (3, 1000, T.WORDS):
        monkeypatch.setattr(T, "WORDS", size)
        words = T.Words(own, rows)
        assert list(zip(*(list(x) for x in T._digests(own, words, *words.ids(own, held))))) == want
    # a word is held once a slice, however often it occurs
    assert len(T.Words(own, ["the the the"] * 50).distinct) == 2
    none = T.Words(own, ["", None])
    assert [list(x) for x in T._digests(own, none, *none.ids(own, held))][0] == [0, 0]


def common(ids):
    n = 0
    while all(len(x) > n for x in ids) and len({x[n] for x in ids}) == 1:
        n += 1
    return ids[0][:n]


def test_look_up_at_the_edges(tmp_path):
    found = automaton(tmp_path, [("é", (1,)), ("ab", (2, 3)), ("a" * T.WORD_BYTES, (4,))])
    assert found.look_up(["é", "a", "ab", "abc", "", "a" * T.WORD_BYTES, "a" * (T.WORD_BYTES + 1), "\xc3"]) == [(1,), None, (2, 3), None, None, (4,), None, None]
    assert automaton(tmp_path, []).look_up(["a"]) == [None]
    assert found.look_up([]) == []
    with pytest.raises(ValueError):
        T.compiled([("a", (1,)), ("a", (1,))])


def test_table(spark, reference):
    many = [(10 + i, t, None) for i, t in enumerate(["the cat and the hat"] * 5 + ["the dog 123 " * 4000, "x" * 20000])]
    docs = spark.createDataFrame([(1, "it's", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x"), (3, "a<|endoftext|>b", "x"), *many], "doc_id long, text string, ids string")
    name = T.compile_lexicon(docs, PATH)
    rows = T.encode(docs, PATH, name)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows.collect():
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids
        for start, end, a, b in zip(r.word_start, [*r.word_start[1:], len(texts[r.doc_id])], r.word_ids, [*r.word_ids[1:], len(ids)]):
            assert reference.decode(ids[a:b], skip_special_tokens=False) == texts[r.doc_id][start:end]
    assert sorted((r.doc_id or 0, r.text) for r in T.decode(rows, PATH).collect()) == sorted((i or 0, t) for i, t in [*texts.items(), (2, "")])
    # the words of the repeated texts are in the lexicon, words that occur once aren't
    whole = {r.word: r.n for r in T.word_counts(docs, PATH).collect()}
    assert whole[" the"] == 5 + 3999 and whole["the"] == 6 and whole[None] == sum(n for w, n in whole.items() if w)
    digests = T.round_trip_digests(docs, PATH).collect()
    assert len(digests) == docs.count()
    for r in digests:
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert T.round_trip_digests(docs.limit(0), PATH).count() == 0


def test_lexicon_holds_frequent_words_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"often often w{i}") for i in range(200)], "doc_id long, text string")
    from pyspark import SparkFiles

    held = T.Lexicon(SparkFiles.get(T.compile_lexicon(docs, PATH, share=0.01)))
    assert [x is not None for x in held.look_up(["often", " often", " w", "1", "7"])] == [True, True, True, False, False]


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * (T.TEXT_BYTES // 2)] * 5 + ["b" * (3 * T.TEXT_BYTES), None, ""] + ["c"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(T.slices(iter([batch])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= T.ROWS and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= T.TEXT_BYTES) for p in parts)
