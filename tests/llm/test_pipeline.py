from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from lexloom.llm.common import materialize  # noqa: E402


def test_stages(spark):
    good = lambda i: " ".join(f"word{(i * 37 + j * j) % 9973} and" for j in range(60))
    passage = " ".join(f"shared{j}" for j in range(60))
    docs = [(i, good(i), "en", "src0", 0) for i in range(30)]
    docs += [(100, good(0), "en", "src1", 0), (101, good(1).replace("word", "Word", 1), "en", "src1", 0)]  # an exact and a near copy
    docs += [(200, good(200) + " " + passage + " " + good(201), "en", "src2", 0), (201, good(202) + " " + passage + " " + good(203), None, None, None)]
    docs += [(300, good(300) + ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" ' + good(301), "en", "src3", 0)]
    docs += [(400, "too short", "en", "src4", 0), (401, None, "en", "src4", 0), (None, good(401), "en", "src4", 0)]
    now = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    now.createOrReplaceTempView("documents_in")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = {}
    original, P.table = P.table, lambda *_: labels
    try:
        for name, stage in P.STAGES:
            now = materialize(stage(spark, now, ""), "test")
            kept[name] = now.collect()
            if name != "packing":
                assert now.columns == list(P.COLUMNS)
    finally:
        P.table = original
    ids = lambda name: {r.doc_id for r in kept[name]}
    everything = {d[0] for d in docs}
    assert ids("quality rules") == everything - {400, 401}
    assert ids("SimHash near-dedup") == everything - {400, 401, 100, 101}
    text = {r.doc_id: r.text for r in kept["suffix-array dedup"]}
    assert set(text) == ids("SimHash near-dedup")
    assert all("shared30" not in t for t in text.values()) and good(200)[:80] in text[200] and text[5] == good(5)
    last = {r.doc_id: r for r in kept["secret scan"]}
    assert "1beb58" not in last[300].text and "[SECRET]" in last[300].text and last[300].n_chars == len(last[300].text)
    pieces = defaultdict(int)
    for r in kept["packing"]:
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(last) and Counter(pieces)[None] > 0


def test_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one " * 30, "en", "s", 120)], "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        folder = str(tmp_path / str(empty))
        (docs.limit(0) if empty else docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert P.run(spark, folder).count() == 0  # thirty equal words are repeated windows


def test_stages_with_repeated_rows_and_long_texts(spark):
    """Each stage takes rows that repeat, texts that are null, empty or very long, and columns of its own names."""
    long_ = " ".join(f"w{i * 7919 % 100_003}x" for i in range(90_000))
    good = " ".join(f"word{i * i % 9973} and" for i in range(60))
    docs = [(1, good, "en", "s", 0), (1, good, "en", "s", 0), (2, good, None, None, None), (3, long_, "en", "s", 0), (4, "", "en", "s", 0), (5, None, "en", "s", 0), (None, None, None, None, None)]
    df = spark.createDataFrame([(*d, "a", 7, "b") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, th string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    original, P.table = P.table, lambda *_: labels
    try:
        rows = {name: stage(spark, df, "").collect() for name, stage in P.STAGES}
    finally:
        P.table = original
    assert sorted(r.doc_id for r in rows["quality rules"]) == [1, 1, 2, 3]
    assert sorted((r.doc_id, r.text == long_) for r in rows["SimHash near-dedup"]) == [(1, False), (3, True), (4, False)]
    cut = {}
    for r in rows["suffix-array dedup"]:
        cut.setdefault(r.doc_id, []).append(r.text)
    assert len(cut[1]) == 2 and cut[3] == [long_] and all(len(t) < 200 for t in cut[1] + cut[2]) and cut[4] == cut[5] == cut[None] == [""]
    assert len(rows["secret scan"]) == len(docs) and [r.text for r in rows["secret scan"] if r.doc_id == 3] == [long_]
    pieces = rows["packing"]
    assert sum(r.length for r in pieces if r.doc_id == 3) > 90_000 and sum(r.length for r in pieces if r.doc_id in (4, 5)) == 2 and len({r.sequence_id for r in pieces if r.doc_id == 3}) > 20
