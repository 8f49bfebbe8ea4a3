"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a text; special tokens are ordinary text; NULL counts none."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def with_token_counts(df: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole text, by the rank file at ``path`` (on every worker). NULL and empty texts have 0. No shuffle."""
    x = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t, path) for t in b.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    schema = "".join(f"k{i} {x.schema[i].dataType.simpleString()}, " for i in range(len(keep))) + "n_tokens bigint"
    y = x.mapInArrow(run, schema)
    return y.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
