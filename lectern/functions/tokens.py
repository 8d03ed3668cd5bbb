"""Counting tokens as an embedding model does: by a vocabulary file, or roughly without one."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

#: Tokens of a text.
Counter = Callable[[str], int]

#: Fixed value: the pieces that byte-level vocabularies never join across.
PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def rough(text: str) -> int:
    """About what a byte-level vocabulary needs: a token for every four bytes of a word, number or run of signs."""
    return sum(-(-len(p.strip().encode("utf-8", "surrogatepass") or b" ") // 4) for p in PIECES.findall(text))


@lru_cache
def from_file(path: str) -> Counter:
    """Exact counts by a tokenizer file of the ``tokenizers`` library; loaded once per process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def counter(path: str | None = None) -> Counter:
    """Counts by ``path``, else by the file that ``LECTERN_TOKENIZER`` names, else ``rough``."""
    path = path or os.environ.get("LECTERN_TOKENIZER")
    return from_file(path) if path else rough
