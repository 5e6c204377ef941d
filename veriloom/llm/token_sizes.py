"""Sizes of texts in tokens of a public byte-pair tokenizer."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Where the vocabulary files lie; a parameter everywhere, never copied.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once. Longer texts are counted in stretches of at least so many, cut before a single space
#: between two other signs: a piece of the pattern always begins there, so the count is that of the whole text.
STRETCH = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=2)
def encoding(folder: str, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, folder: str = TOKENIZER_DIR) -> int:
    if not text:
        return 0
    e = encoding(folder)
    if len(text) <= STRETCH:
        return len(e.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        cut = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = cut.start() if cut else len(text)
        total += len(e.encode_ordinary(text[at:end]))
        at = end
    return total


def with_sizes(df: DataFrame, text: str, size: str = "n_tokens", folder: str = TOKENIZER_DIR) -> DataFrame:
    """df without its text, with the text's size; 0 for null and empty texts."""
    kept = [c for c in df.columns if c not in (text, size)]
    schema = StructType([*[df.schema[c] for c in kept], StructField(size, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, folder) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sizes, pa.int64())], names=[*kept, size])

    return df.select(*kept, text).mapInArrow(run, schema)
