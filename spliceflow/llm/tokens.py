"""Token ids of a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
from array import array
from functools import lru_cache

import numpy as np


class Encoder:
    """Ids of whole texts. None are added; a special token's string in a text gives its id, as the tokenizer file has it by default.

    The vocabulary's ranks give the same ids as its tokenizer file.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        special = special or {}
        self._own = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)
        lengths = {**{rank: len(token) for token, rank in ranks.items()}, **{rank: len(token.encode()) for token, rank in special.items()}}
        self.byte_lengths = np.zeros(max(lengths) + 1, dtype=np.int64)
        for rank, n in lengths.items():
            self.byte_lengths[rank] = n

    def ids(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers. A lone surrogate counts as U+FFFD."""
        if any(token in text for token in self._special):
            return array("I", self._own.encode(text, allowed_special="all")).tobytes()
        return array("I", self._own.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder in each Python worker. The default files are those installed with the public tokenizers, with the special tokens of
    the tokenizer file; a rank file of one's own has none."""
    import public_tokenizers

    if ranks_path:
        return Encoder(ranks_path, pattern or public_tokenizers.PATTERN)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, special)
