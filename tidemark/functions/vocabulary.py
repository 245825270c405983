"""Tokens of a vocabulary file of ranks, whose path and pattern are parameters."""

from __future__ import annotations

import base64
from functools import lru_cache

#: What splits a text before the merges, where the vocabulary's makers say nothing else.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str, pattern: str = PATTERN):
    """The library's encoding; one a worker process, read where the task runs."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, path: str, size: int = 4000, overlap: int = 200) -> list[str]:
    """Pieces of at most ``size`` tokens, cut at the last sentence end of a piece's last fifth and stripped; each begins ``overlap`` tokens before the end of the one before. A text within one
    piece is returned as it is. Tokens that a cut leaves incomplete are read as U+FFFD."""
    own = encoding(path)
    ids = own.encode_ordinary(text)
    if len(ids) <= size:
        return [text]
    out, start = [], 0
    while start < len(ids):
        end = min(start + size, len(ids))
        piece = own.decode(ids[start:end])
        if end < len(ids):
            dot = piece.rfind(". ", int(len(piece) * 0.8))
            if dot > 0:
                piece = piece[: dot + 1]
                end = start + len(own.encode_ordinary(piece))
        out.append(piece.strip())
        start = max(end - overlap, start + 1)
        if start >= len(ids) - overlap:
            break
    return out
