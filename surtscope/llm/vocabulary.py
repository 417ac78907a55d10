"""Token ids of whole texts from public vocabulary files, with a per-process memo.

The pre-tokeniser of these vocabularies never joins what stands before and after
a single space between two other characters, so a text may be cut there, and each
distinct chunk is encoded once and then looked up.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

_MEMO_CHUNKS = 400_000
_SPACES_MEET = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._memo: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        import numpy as np

        if len(self._memo) > _MEMO_CHUNKS:
            self._memo.clear()
        for chunk, found in zip(chunks, self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)):
            self._memo[chunk] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPACES_MEET.search(text):
            chunks = _CUT.split(text)
        else:
            chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CUT.split(text)
        memo = self._memo
        missing = {c for c in chunks if c not in memo}
        if missing:
            self._learn(list(missing))
            memo = self._memo
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:  # the memo was emptied meanwhile
            self._learn(list(set(chunks)))
            return b"".join([self._memo[c] for c in chunks])


class LatinEncoder:
    """The same ids from the vocabulary's rank file for texts in Latin-1, on whose
    characters all libraries agree; other texts go to the chunk encoder."""

    def __init__(self, path: str, ranks: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self._fast = tiktoken.Encoding("latin", pat_str=pattern, mergeable_ranks=known, special_tokens=special)
        self._special = set(special)
        self._exact = ChunkEncoder(path)

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._exact.encode(text)
        return self._fast.encode_to_numpy(text, allowed_special=self._special).astype("<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None, pattern: str = "", special: tuple = ()) -> ChunkEncoder | LatinEncoder:
    """One encoder for each vocabulary and process; ``ranks`` makes Latin texts faster."""
    return LatinEncoder(path, ranks, pattern, dict(special)) if ranks else ChunkEncoder(path)
