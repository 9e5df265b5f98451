"""Sizes of texts in tokens of a public tokenizer; its files stay where they are installed."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(name: str, folder: str = TOKENIZERS):
    """A function from a text to its number of tokens, for a .tiktoken, .json or .model file."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text.encode("utf-8", "replace").decode()))
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        return lambda text: len(coder.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(coder.encode(text, num_threads=1))


def with_tokens(df: DataFrame, columns: list[str], text_col: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """columns and n_tokens of every row with a text; the text itself is left behind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = encoder(tokenizer, folder)
        for b in batches:
            yield b[columns].assign(n_tokens=[size(t) for t in b[text_col]])

    kinds = dict(df.dtypes)
    need = df.where(F.col(text_col).isNotNull()).select(*columns, text_col)
    return need.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_tokens bigint")
