"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

A pre-token here is a run of bytes without ASCII white space. The tokenizer drops white space and never merges across
it, so a document has exactly as many tokens as its pre-tokens have together. No list of ids is kept anywhere.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.weighing import weigh

#: A pre-token in one of so many documents of a block is counted there, once a task, and not dealt out.
COMMON_SHARE = 64


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_LOADED: dict = {}


def _pieces(path: str) -> Callable[[list[bytes], np.ndarray], np.ndarray]:
    """Pieces of each word."""
    if path not in _LOADED:
        _LOADED[path] = _tokenizer(path)

    def pieces(words: list[bytes], _: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), 2000):
            part = [w.decode("utf-8", "replace") for w in words[at : at + 2000]]
            out[at : at + 2000] = [len(e) for e in _LOADED[path].encode_batch_fast(part, add_special_tokens=False)]
        return out

    return pieces


def _common(path: str) -> Callable[[bytes, float], list[float] | None]:
    pieces, counted = _pieces(path), {}

    def known(word: bytes, share: float) -> list[float] | None:
        if share * COMMON_SHARE < 1:
            return None
        if word not in counted:
            if len(counted) > 100_000:
                counted.clear()
            counted[word] = pieces([word]).tolist()
        return counted[word]

    return known


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs.

    tokenizer: path of a tokenizers file that drops white space and merges nothing across it. Null texts count as
    empty and have no tokens; a null id stays null; repeated rows each give their row; other columns don't matter.
    Special strings inside a text are one token each, as the library has it by default.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    sizes = lambda block: np.array([[len(t)] for t in block.texts])
    found = weigh(rows, 1, bytes.split, sizes, lambda: _pieces(tokenizer), lambda: _common(tokenizer))
    return found.select("doc_id", F.col("own")[0].cast("long").alias("n_bytes"), F.col("sums")[0].cast("long").alias("n_tokens"))
