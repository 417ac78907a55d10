"""Token counts of whole texts by the whole-token shortcut.

The vocabulary is one of words: BPE that runs inside each pre-token, the last symbol
of a pre-token carrying a word end. Before the job, the driver proves which strings
of the vocabulary the model encodes alone as one token, by letting it merge each of
them; that table, bounded by the vocabulary, goes to every task. There, a pre-token in
the table counts one without any merging, and only the rest is merged.

Texts are cut at the strings of special tokens, which count one each. What lies in
between is cut into pre-tokens: characters of Latin-1 by an equal pattern, on which
normaliser and character classes are known to agree; others by the library's own
normaliser and pre-tokenizer. Both kinds meet the same table and the same model.

Defined results: NULL and empty texts have no bytes and no tokens, nor has white
space; repeated rows repeat their result; an empty table gives no rows; texts of any
length are counted whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.token_align import byte_symbols

#: Tokens above which a text is over the limit.
LIMIT = 2048
_MEMO = 400_000
_MEMO_CHARS = 100
_WORD_END = "</w>"

# The vocabulary's pre-token pattern, with the letters, numbers and white
# space of Latin-1 in place of Unicode classes.
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")

_SYMBOL_OF = {b: c for c, b in byte_symbols().items()}


def symbols(pre_token: str) -> str:
    """The characters by which a byte-level vocabulary writes a pre-token's bytes."""
    return "".join([_SYMBOL_OF[b] for b in pre_token.encode()])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens, in symbols, that the model encodes as one token, each one tried."""
    tokenizer = _tokenizer(path)
    ending = (t.removesuffix(_WORD_END) for t in tokenizer.get_vocab(with_added_tokens=False) if t.endswith(_WORD_END))
    return frozenset(t for t in ending if t and len(tokenizer.model.tokenize(t)) == 1)


def special_strings(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


class TokenCounter:
    """Counts of one vocabulary; remembers the sizes of pre-tokens it has merged."""

    def __init__(self, path: str, whole: frozenset[str], special: list[str]):
        self._tokenizer, self._whole = _tokenizer(path), whole
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._sizes: dict[str, int] = {}  # by symbols
        self._latin: dict[str, int] = {}  # by characters
        self.merged = 0

    def _size(self, written: str) -> int:
        """Tokens of one pre-token in symbols."""
        if written in self._whole:
            return 1
        size = self._sizes.get(written)
        if size is None:
            size = len(self._tokenizer.model.tokenize(written))
            self.merged += 1
            if len(written) < _MEMO_CHARS:
                if len(self._sizes) >= _MEMO:
                    self._sizes.clear()
                self._sizes[written] = size
        return size

    def _learn(self, pre_token: str) -> int:
        size = self._size(symbols(pre_token))
        if len(pre_token) < _MEMO_CHARS:
            self._latin[pre_token] = size
        return size

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if _BEYOND_LATIN.search(text):
            normal = self._tokenizer.normalizer.normalize_str(text)
            return sum(self._size(p) for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        known, total = self._latin, 0
        if len(known) >= _MEMO:
            known.clear()
        found = _PRE_TOKEN.findall(text.lower())
        try:
            return sum(map(known.__getitem__, found))
        except KeyError:
            for p in found:
                size = known.get(p)
                total += self._learn(p) if size is None else size
            return total

    def count(self, text: str) -> int:
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts = self._special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    table = docs.sparkSession.sparkContext.broadcast((whole_tokens(path), special_strings(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, *table.value)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    counted = docs.select(F.col("doc_id").cast("long"), "text", n_bytes).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
