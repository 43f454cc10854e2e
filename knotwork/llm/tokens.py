"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, columns: list[str], path: str = RANKS) -> DataFrame:
    """doc_id, the columns and `tokens`; one row a doc_id. Null and empty texts have 0 tokens."""
    kinds = dict(documents.dtypes)
    schema = "doc_id bigint, " + "".join(f"`{c}` {kinds[c]}, " for c in columns) + "tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            batch["tokens"] = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield batch.drop(columns="text")

    return documents.where("doc_id is not null").select("doc_id", *columns, "text").mapInPandas(run, schema).dropDuplicates(["doc_id"])
