import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lexloom.llm import packing as P  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    """Pieces cover each document's ids once, sequences are gapless, no sequence is too long. Returns their padding."""
    own = tokenizers.Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding


def test_brute_force(spark):
    words = ["Straße", "don't", "x..", "..", "it's,", "ΟΔΟΣ", "é", "é", "<|endoftext|>", "a<|endoftext|>b", "12,5", "中文.", " x", "\x1cy", "!?.", "A.", ".", ","]
    rng = np.random.default_rng(3)
    docs = [(i, " \n".join(rng.choice(words, rng.integers(0, 400)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "hello " * 5000), (1003, "x" * 9000)]
    docs += [(2000 + i, "same text here, twice. " * 7) for i in range(150)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int")
    for window in (4096, 256):
        rows = P.pack(df, PATH, 2, window).collect()
        assert check(rows, docs, window) < window


def test_edges(spark):
    schema = "doc_id long, text string"
    assert P.pack(spark.createDataFrame([], schema), PATH, 2).count() == 0
    rows = P.pack(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, None), (None, "c " * 300)], schema), PATH, 2, 64).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1 + 301
    seen = {(r.sequence_id, r.offset) for r in rows}
    assert len(seen) == len(rows)


@pytest.mark.parametrize("kind", ["uniform", "one length", "long", "few"])
def test_plan(kind):
    rng = np.random.default_rng(1)
    lengths = {"uniform": rng.integers(1, 4096, 100_000), "one length": np.full(50_000, 3000), "long": rng.integers(2049, 4096, 50_000), "few": np.array([7, 4089, 12])}[kind]
    counts = np.bincount(lengths, minlength=4096)
    plan = P.make_plan(counts)
    planned = sum(a * k for a, k in plan.taken.items())
    assert planned == plan.n_sequences * 4096
    assert planned + plan.tail_tokens == lengths.sum()
    assert all(k <= counts[a] for a, k in plan.taken.items())
    if kind == "uniform":
        assert plan.tail_tokens < 0.1 * lengths.sum()


def test_least_squares_is_near_optimal():
    combos = [(3, 1), (2, 2), (2, 1, 1), (1, 1, 1, 1)]
    truth = np.array([5.0, 3.0, 0.0, 2.0])
    counts = np.zeros(4)
    for c, x in zip(combos, truth):
        for a in c:
            counts[a] += x
    x = P.least_squares(combos, counts, 3000)
    got = np.zeros(4)
    for c, k in zip(combos, x):
        for a in c:
            got[a] += k
    assert (x >= 0).all() and np.allclose(got, counts, atol=0.05)
