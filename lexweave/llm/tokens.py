"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

The vocabulary file is a parameter and stays where it is; each worker loads it
once.  Null and empty texts have size 0; strings that look like special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.sources.tables import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how this vocabulary's tokenizer cuts text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("text-sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of every document with ``n_tokens``; one pass, no shuffle."""
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for pdf in batches:
            sizes = [len(encode(t)) if t else 0 for t in pdf["text"]]
            yield pdf[keep].assign(n_tokens=pd.Series(sizes, dtype="int64", index=pdf.index))

    return documents.select(*keep, "text").mapInPandas(run, f"{fields}, n_tokens long")


def staged_sizes(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``token_sizes`` written once, with a ``row_key`` unique to every row."""
    return stage(token_sizes(documents, keep, vocabulary).withColumn("row_key", F.monotonically_increasing_id()), "token-sizes")
