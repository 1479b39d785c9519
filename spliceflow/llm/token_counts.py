"""Token counts of sections: whole documents are encoded once, and token character spans meet the sections they overlap.

A token's span is the characters that its bytes touch. A token within one section counts there. A token that crosses a boundary goes to
one section by the rule: "start" (the section of its first character), "most" (the section with most of its characters, the earlier of
equals) or "end" (the section of its last character). Characters outside all sections belong to section -1, which the rules treat like
any other. So the sections' counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import frame
from spliceflow.llm.tokens import Encoder, encoder

RULES = ("start", "most", "end")
COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sections that line breaks end; they tile the text. None for an empty text."""
    out, start = [], 0
    while start < len(text):
        end = text.find("\n", start) + 1 or len(text)
        out.append((start, end))
        start = end
    return out


def token_spans(text: str, enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token."""
    ids = np.frombuffer(enc.ids(text), dtype="<u4")
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    after = np.cumsum(enc.byte_lengths[ids])
    return char[after - enc.byte_lengths[ids]], char[after - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str, length: int) -> list[tuple[int, int, int, int, int]]:
    """(section, start, end, tokens, those of them that cross a boundary) for each section, and for -1 if it has any."""
    cuts, owner, at = [0], [], 0
    for k, (a, b) in enumerate(sections):
        if a > at:
            owner.append(-1)
            cuts.append(a)
        owner.append(k)
        cuts.append(b)
        at = b
    if at < length or not owner:
        owner.append(-1)
        cuts.append(max(length, at))
    edges, own = np.array(cuts), np.array(owner)
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, ends - 1, side="right") - 1
    take = {"start": first, "end": last, "most": first.copy()}[rule]
    crossing = first != last
    if rule == "most":
        for k in np.nonzero(crossing)[0]:
            inside = [min(edges[p + 1], ends[k]) - max(edges[p], starts[k]) for p in range(first[k], last[k] + 1)]
            take[k] = first[k] + int(np.argmax(inside))
    n, over = np.bincount(take, minlength=len(own)), np.bincount(take[crossing], minlength=len(own))
    out = [(int(k), cuts[p], cuts[p + 1], int(n[p]), int(over[p])) for p, k in enumerate(own) if k >= 0]
    if n[own < 0].sum():
        out.append((-1, -1, -1, int(n[own < 0].sum()), int(over[own < 0].sum())))
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): a row for each section of each row of docs.

    sections_col holds array<struct<start, end>>, ordered and without overlaps, in characters; without it the sections are the
    paragraphs. Null and empty texts have no sections, so no rows; null sections are none (all tokens go to section -1); empty
    sections get a row with no tokens. Null ids stay null, repeated rows are counted each, an empty table gives an empty one, other
    columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            given = batch["sections"] if sections_col else [None] * len(batch)
            for id_, text, own in zip(batch["doc_id"].array, batch["text"], given, strict=True):
                if not isinstance(text, str) or not text:
                    continue
                parts = ([(s["start"], s["end"]) for s in own] if own is not None else []) if sections_col else paragraphs(text)
                doc_id = None if pd.isna(id_) else int(id_)
                out += [(doc_id, *row) for row in attribute(*token_spans(text, enc), parts, rule, len(text))]
                if len(out) > 50_000:
                    yield frame(out, COUNTS)
                    out = []
            yield frame(out, COUNTS)

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    return docs.select(*columns, *([F.col(sections_col).alias("sections")] if sections_col else [])).mapInPandas(count, COUNTS)
