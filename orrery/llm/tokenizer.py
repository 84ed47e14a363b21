"""Public tokenizers by path.  The folder is a parameter (environment ORRERY_TOKENIZERS); files are never copied here."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

FOLDER = os.environ.get("ORRERY_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the split pattern that the byte-level vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None):
    """A tiktoken encoding, made once per worker process."""
    import tiktoken

    with open(os.path.join(folder or FOLDER, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
