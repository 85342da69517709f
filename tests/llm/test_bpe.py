import base64
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from lexloom.llm import bpe as B  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", " ", "\n", "\t", " ", "1", "½", "é", "ß", "中", "!", ".", "\U0001f600", "́", "\x1c", "S", " "]
    yield from ["", " ", "  ", "\n\n", "a", "'s", "''s", " 's", "\n's", "it's's we'll'd", "x'", "'", "' s", "a  b", "a \n b ", "don't've", "12'3s're", "a" * 3000, "ab" * 400 + "!" * 500]
    for _ in range(3000):
        yield "".join(rng.choices(alphabet, k=rng.randrange(1, 14)))
    for lo in range(0, 0x30000, 0x800):
        if not 0xD800 <= lo < 0xE000:
            yield "".join(map(chr, range(lo, lo + 0x800)))
            yield "a" + "1 ".join(map(chr, range(lo, lo + 0x800)))
    for _ in range(60):
        yield "".join(rng.choices("thealonsr", k=rng.randrange(90, 400)))


def test_equals_the_public_library(reference):
    bpe = B.Bpe(PATH)
    for text in texts():
        ids, starts, found = bpe.encode(text)
        assert ids == reference.encode_ordinary(text), repr(text[:60])
        assert bpe.decode(ids) == text.encode()
        for a, b, own in zip(starts, [*starts[1:], len(text)], found):
            assert bpe.decode(own) == text[a:b].encode()


def test_table(spark):
    docs = spark.createDataFrame([(1, "it's", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, ids string")
    rows = B.encode(docs, PATH)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in rows.collect()) == [(0, 0), (1, 2), (2, 0), (2, 0)]
    assert sorted(r.text for r in B.decode(rows, PATH).collect()) == ["", "", "", "it's"]
    assert B.round_trip_digests(docs.limit(0), PATH).count() == 0
    assert {r.n_tokens for r in B.round_trip_digests(docs, PATH).collect()} == {0, 2}
