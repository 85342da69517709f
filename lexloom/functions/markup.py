"""Nested markup, which expressions can't match: links to files are removed with the brackets inside them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import before_appendix, formatted_numbers, single_blanks, without_quotes_of_markup

#: Texts that a worker unpacks at a time.
SLICE = 128
FILE_LINKS = ("[[File:", "[[Image:", "[[Plik:", "[[Media:", "[[Grafika:")


def without_nested(text: str | None, openings: tuple[str, ...] = FILE_LINKS, pair: tuple[str, str] = ("[[", "]]")) -> str | None:
    """text without each span that begins with an opening, up to the close that balances it; one that is never closed stays."""
    if text is None:
        return None
    out, at = [], 0
    while True:
        hits = [i for o in openings if (i := text.find(o, at)) >= 0]
        if not hits:
            break
        start = min(hits)
        depth, i = 0, start
        while i < len(text):
            if text.startswith(pair[0], i):
                depth, i = depth + 1, i + 2
            elif text.startswith(pair[1], i):
                depth, i = depth - 1, i + 2
                if not depth:
                    break
            else:
                i += 1
        if depth:
            out.append(text[at : start + 2])
            at = start + 2
            continue
        out.append(text[at:start])
        at = i
    return "".join(out) + text[at:]


def _few(one: Callable[[str | None], str | None]) -> Callable[[pa.Array], pa.Array]:
    """one for each text of a batch, a few texts at a time: a batch may be as large as Spark sends it."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array(map(one, texts.slice(i, SLICE).to_pylist()), texts.type) for i in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else texts

    return run


def _once(one: Callable[[str | None], str | None]):
    """one as a function of columns that is worked out once where a filter and a projection both have it, by one worker of a task."""
    return F.arrow_udf(_few(one), "string").asNondeterministic()


def _bare(t: str | None) -> str | None:
    """Templates and tables gone, links as their labels, tags gone, entities decoded."""
    import html
    import re

    if t is None:
        return None
    t = without_nested(t, ("{{",), ("{{", "}}"))
    t = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", t)
    t = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", t, flags=re.S)
    return html.unescape(re.sub(r"<[^>]+>", "", t))


def _unescaped(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Named and numbered entities as the characters they stand for."""
    return F.pandas_udf(_unescaped, "string")(text)


def without_file_links(text: Column) -> Column:
    return _once(without_nested)(text)


def clean(text: Column) -> Column:
    """Wiki text to plain text: up to the appendix, without file links, templates, link marks and quotes."""
    tables = F.replace(F.replace(before_appendix(text), F.lit("{|"), F.lit("{{")), F.lit("|}"), F.lit("}}"))
    bare = _once(_bare)(formatted_numbers(without_file_links(tables)))
    return single_blanks(without_quotes_of_markup(bare))
