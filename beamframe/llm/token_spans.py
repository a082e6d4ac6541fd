"""Token counts of fields and sections: whole documents are encoded once, and token spans are joined to section spans.

A document is the concatenation of its fields (null: empty), joined by `joint`; a field ends before the joint, which
counts as part of the field before it. Each field is cut into sections after each `section` string. A token whose
character span crosses a boundary goes to one section by `rule`: "first" (where its first character is), "last" (where
its last one is) or "most" (where most of its characters are, of equal ones the first).

Every document gives one row a section, an empty one too, so the counts of a document add up to its number of tokens.
Texts of any length are whole; repeated rows and equal or null doc_ids are counted one by one; an empty table gives no
rows; other columns may have any name, those of the result too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.encode import Encoder

RULES = ("first", "last", "most")


def section_starts(text: str, section: str) -> list[int]:
    starts, at = [0], text.find(section)
    while at >= 0:
        at += len(section)
        if at < len(text):
            starts.append(at)
        at = text.find(section, at)
    return starts


def owners(spans: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary); starts: of the sections, ascending."""
    a, b = spans[:, 0], np.maximum(spans[:, 1] - 1, spans[:, 0])
    first, last = (np.searchsorted(starts, x, "right") - 1 for x in (a, b))
    crosses = first != last
    if rule == "first" or not crosses.any():
        return first, crosses
    if rule == "last":
        return last, crosses
    own = first.copy()
    bounds = np.append(starts, np.iinfo(np.int64).max)
    for t in np.flatnonzero(crosses):
        over = [min(b[t] + 1, bounds[s + 1]) - max(a[t], bounds[s]) for s in range(first[t], last[t] + 1)]
        own[t] = first[t] + int(np.argmax(over))
    return own, crosses


def attribute_tokens(docs: DataFrame, tokenizer: str, fields: list[str], section: str = "\n", joint: str = "\n", rule: str = "first") -> DataFrame:
    """doc_id, field, section (from 0 in its field), start, end (characters of the whole document), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            doc_ids, columns = batch.column(0).to_pylist(), [batch.column(1 + i).to_pylist() for i in range(len(fields))]
            for at in range(0, len(doc_ids), 256):
                parts = [[(c[i] or "") + (joint if k + 1 < len(columns) else "") for k, c in enumerate(columns)] for i in range(at, min(at + 256, len(doc_ids)))]
                out: list[list] = [[] for _ in schema]
                for doc_id, part, spans in zip(doc_ids[at : at + 256], parts, encoder.offsets(["".join(p) for p in parts]), strict=True):
                    starts, names, numbers, base = [], [], [], 0
                    for name, text in zip(fields, part, strict=True):
                        own = section_starts(text, section)
                        starts += [base + s for s in own]
                        names += [name] * len(own)
                        numbers += range(len(own))
                        base += len(text)
                    bounds = np.array(starts, np.int64)
                    own, crosses = owners(spans, bounds, rule)
                    rows = ([doc_id] * len(starts), names, numbers, starts, [*starts[1:], base], np.bincount(own, minlength=len(starts)).tolist(), np.bincount(own[crosses], minlength=len(starts)).tolist())
                    for to, new in zip(out, rows, strict=True):
                        to += new
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, out, strict=True)), schema=schema)

    return df.mapInArrow(count, "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long")
