"""Token counts of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Where the vocabulary of the default tokenizer lies, on every machine that runs tasks.
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges of a rank file (as published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """encode(text) -> token ids; starts(text) -> the character at which each token begins, and which tokens begin with a whole one."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = own.encode_ordinary
            self._length = np.zeros(max(ranks.values()) + 1, np.int64)
            for raw, i in ranks.items():
                self._length[i] = len(raw)
        elif path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = own.encode
            self._length = None
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids
            self._length = None

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0

    def bytes_before(self, ids: list[int]) -> np.ndarray:
        """The byte of the text at which each token begins, and the text's length; for byte-level vocabularies."""
        if self._length is None:
            raise ValueError("cutting needs a byte-level vocabulary (.tiktoken)")
        return np.concatenate([[0], np.cumsum(self._length[np.asarray(ids, np.int64)])]).astype(np.int64)


@lru_cache(maxsize=4)
def tokens(path: str = DEFAULT) -> Tokens:
    return Tokens(path)


def count_column(texts: pa.Array, path: str) -> pa.Array:
    """Tokens of each text; 0 for null."""
    t = tokens(path)
    return pa.array([t.count(x) for x in texts.to_pylist()], pa.int64())
