import random
import re

import pytest

from lexloom.llm import line_dedup as L


def split(text, pattern):
    at, out = 0, []
    for piece in re.findall(pattern, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", piece.lower())
        if words:
            out.append((at, at + len(piece), words))
        at += len(piece)
    assert at == len(text)
    return out


def brute(docs, least, pattern):
    """In the order of the rows, which is that of the ids: every unit against all earlier ones."""
    seen, out = {}, []
    for d, text in docs:
        text = text or ""
        own, gone = split(text, pattern), set()
        found = []
        for i in range(len(own)):
            n = 0
            for j in range(i, len(own)):
                n += len(own[j][2])
                if n >= least:
                    found.append((i, j + 1))
                    break
        if found and found[-1][1] < len(own):
            found.append((found[-1][0], len(own)))
        for a, b in found:
            unit = " ".join(w for p in own[a:b] for w in p[2])
            if unit not in seen:
                seen[unit] = (d, a, b)
                continue
            first = seen[unit]
            a = max(a, first[2]) if first[0] == d else a
            if a < b:
                gone.add((a, b))
        chars = {c for a, b in gone for c in range(own[a][0], own[b - 1][1])}
        spans = [(c, next(e for e in range(c, len(text) + 1) if e not in chars)) for c in sorted(chars) if c - 1 not in chars]
        out.append((d, len(own), len({k for a, b in gone for k in range(a, b)}), spans, "".join(c for k, c in enumerate(text) if k not in chars)))
    return out


@pytest.mark.parametrize("least, pattern", [(6, L.SENTENCES), (1, L.LINES), (3, L.LINES), (2, L.PARAGRAPHS), (25, L.SENTENCES)])
def test_brute_force(spark, least, pattern):
    rng = random.Random(3)
    lines = ["", " ", "a", "A ", "a  b.", "A\tb! c", "é Ü", "é ü", "long " * 40, "\x0bx", "\U0001f600", "same", "same", "three small words. and four more words? ", "one two three. four five six! seven"]
    docs = [(i, "\n".join(rng.choice(lines) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "same\n" * 300), (203, "x y. " * 200), (204, "\n\n..\n"), (205, "x y. " * 200)]
    df = spark.createDataFrame([(d, t, "x", 4) for d, t in docs], "doc_id long, text string, kept string, th int").repartition(6)
    rows = sorted((r.doc_id, r.n_units, r.n_removed, [(x.start, x.end) for x in r.removed], r.kept) for r in L.remove_repeats(df, least, pattern).collect())
    assert rows == brute(docs, least, pattern)


def test_passages_go_and_short_lines_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9)))
    prose = lambda n: " ".join(" ".join(word() for _ in range(rng.randrange(4, 11))) + "." for _ in range(n))
    passage = prose(9)
    notice = "All rights reserved by their owners."
    docs = [(i, f"{prose(12)} {word()} {passage} {word()} {prose(5)}\n{notice}") for i in range(40)] + [(100 + i, f"{notice}\n{prose(15)}\n{notice}") for i in range(40)]
    docs.append((200, prose(40_000)))  # a very long text
    rows = {r.doc_id: r for r in L.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    inner = passage.split(".")[2]
    assert inner in rows[0].kept and all(inner not in rows[i].kept and rows[i].n_removed for i in range(1, 40))
    assert all(rows[i].n_removed == 0 for i in range(100, 140)) and rows[200].n_removed == 0
    assert all(dict(docs)[i] == rows[i].kept for i in range(100, 140))


def test_edges(spark):
    schema = "doc_id long, text string"
    assert L.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = L.remove_repeats(spark.createDataFrame([(3, "x\ny"), (3, "x\ny"), (None, "y"), (3, "x")], schema), 1, L.LINES).collect()
    assert sum(r.n_removed for r in rows) == 4 and sorted((r.doc_id or 0, r.kept) for r in rows if r.kept) == [(0, "y"), (3, "x\n")]
    few = L.remove_repeats(spark.createDataFrame([(3, "x y"), (3, "x y"), (None, None)], schema)).collect()
    assert [r.n_removed for r in few] == [0, 0, 0]
