"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.common import plain, spread

#: Where the vocabulary lies on every executor; a parameter of all functions that need it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core to a task
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sizes = [len(e) for e in t.encode_batch_fast(part["_text"].tolist(), add_special_tokens=False)]
                yield plain(part.drop(columns="_text").assign(tokens=pd.array(sizes, dtype="int64")))

    return run


def with_token_counts(df: DataFrame, text: str | Column, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the whole text's size; a null or empty text has 0 tokens."""
    col = F.col(text) if isinstance(text, str) else text
    rows = spread(df.select(*keep, F.coalesce(col, F.lit("")).alias("_text")))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(_counter(path), f"{fields}, tokens bigint")
