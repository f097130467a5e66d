"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: how the vocabulary's makers split text before merging (fixed value)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, *keep: str, vocabulary: str) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the tokens of the whole ``text``; null and empty texts
    have 0. Texts are counted one by one inside the tasks. ``vocabulary`` has the ranks of a public byte-level
    vocabulary and must be at this path on every executor."""
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text_to_count"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = pa.array([len(encode(t.as_py())) for t in b.column("text_to_count")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), sizes], [*keep, "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(count, StructType([*(rows.schema[c] for c in keep), StructField("n_tokens", LongType())]))
