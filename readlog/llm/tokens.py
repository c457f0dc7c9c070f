"""The ids that ``tokenizers`` gives for a public byte-level BPE, special tokens included.

``tokenizers`` itself takes three to five times the processor time of ``tiktoken``, which has the same vocabulary as a
file of ranks. So ordinary texts go to the faster library, and those that hold the string of one of the tokenizer's
special tokens, which it cuts out of a text before all else, to ``tokenizers``. Equality of both ways is tested.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np


def default_paths() -> tuple[str, str]:
    """The tokenizer's own file, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, paths: tuple[str, str]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(paths[0])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ordinary.encode_ordinary(text), "<u4").tobytes()


@lru_cache(1)
def encoder(paths: tuple[str, str] | None = None) -> Encoder:
    return Encoder(paths or default_paths())
