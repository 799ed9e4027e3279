"""Tokens of fields or sections: whole texts encoded once, spans joined to the parts.

A document's text is encoded once, as a whole; its tokens' character spans are joined to
the sections' intervals.  A token that crosses a boundary belongs to the section that holds
most of its characters, the earlier one if two hold as many.  Sections are the lines of a
text, each with its line end, and tile it; the general form takes any rising boundaries.

Null text is an empty text; an empty text has one empty section without tokens.  Repeated
rows each give their sections.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, portions
from .tokens import PORTION, encoder

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long"


def lines(text: str) -> np.ndarray:
    """Where the lines of a text begin."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(raw[:-1] == 10) + 1 if len(raw) else raw
    return np.concatenate([[0], starts]).astype(np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> np.ndarray:
    """The section of each token [starts, ends); sections: their begins, 0 first, rising."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    edges = np.append(sections, length)
    for i in np.flatnonzero(first != last):
        held = range(first[i], last[i] + 1)
        first[i] = max(held, key=lambda s: (min(ends[i], edges[s + 1]) - max(starts[i], edges[s]), -s))
    return first


def attribute(docs: DataFrame, tokenizer: str, sections: Callable[[str], np.ndarray] = lines) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA, one row a section."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
        doc, number, begin, end, count, total = [], [], [], [], [], []
        e = encoder(tokenizer, True)
        for a, b in portions(texts, PORTION):
            for d, text, ids in zip(docs[a:b], texts[a:b], e.ids(texts[a:b]), strict=True):
                cuts = sections(text)
                owner = allocate(*e.spans(text, ids), cuts, len(text)) if ids else np.empty(0, np.int64)
                doc += [d] * len(cuts)
                number.append(np.arange(len(cuts)))
                begin.append(cuts)
                end.append(np.append(cuts[1:], len(text)))
                count.append(np.bincount(owner, minlength=len(cuts)))
                total.append(np.full(len(cuts), len(ids) // 4))
        whole = [np.concatenate(x) if x else np.empty(0) for x in (number, begin, end, count, total)]
        out = [pa.array(doc, pa.int64()), pa.array(whole[0].astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in whole[1:]]]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return arrow_pass(docs.select("doc_id", "text"), each, SCHEMA, keeps=True)
