"""Ids and counts of a byte-level BPE vocabulary, as the `tokenizers` library gives them.

The same vocabulary comes as a table of ranks for `tiktoken`, which is several times faster. The
two agree on texts made of :data:`SAFE` characters (tests compare every code point); any other
text, and a text that holds a special string, goes through `tokenizers` itself.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re

import numpy as np

# Blocks whose letters, digits and spaces both libraries class alike.
SAFE = re.compile("[\u0000-ʯͰ-ͳΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞₠-₿℀-⅏←-⏿─-➿　-〩ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]*").fullmatch


class ByteBpe:
    """``json_path`` for `tokenizers`, ``ranks_path`` for `tiktoken` (None: `tokenizers` alone)."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and SAFE(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def id_array(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def load(json_path: str, ranks_path: str | None, pattern: str | None) -> ByteBpe:
    return ByteBpe(json_path, ranks_path, pattern)


def public(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Arguments of :func:`load` for one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def version(json_path: str) -> str:
    """Digest of the vocabulary file and of the library's version: a cache key."""
    import tokenizers

    with open(json_path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
