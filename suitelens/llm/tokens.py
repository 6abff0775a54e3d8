"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is read where the session's settings say."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from suitelens.operators.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens; null and empty texts have 0.

    The vocabulary file must be readable on every executor.
    """
    at = df.columns.index(text)
    names = [name if c == text else c for c in df.columns]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            sizes = [len(coder.encode_ordinary(x)) if x else 0 for x in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array(sizes, pa.int64()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(name, T.LongType()) if f.name == text else f for f in df.schema]
    return spread(df).mapInArrow(count, T.StructType(fields))
