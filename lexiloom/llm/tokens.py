"""A public byte-level BPE tokenizer in Arrow partitions.

The vocabulary file's path, on the driver, is a parameter; the file is sent to the
executors.  Long texts are
encoded in segments cut before a blank that follows a non-blank, where the split
pattern always parts words, so the tokens are those of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once.
SEGMENT = 100_000

_SEAM = re.compile(r"(?<=\S)(?=\s)")


def ship(spark: SparkSession, path: str) -> str:
    """Send the vocabulary along, once a session; gives the path back."""
    sc = spark.sparkContext
    if os.path.exists(path) and not any(f.endswith("/" + os.path.basename(path)) for f in sc.listFiles):
        sc.addFile(path)
    return path


def arrived(path: str) -> str:
    """Where a task finds a file that was sent, or the path itself."""
    try:
        sent = SparkFiles.get(os.path.basename(path))
    except Exception:  # no session here
        return path
    return sent if os.path.exists(sent) else path


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> list[int]:
    if len(text) <= SEGMENT:
        return enc.encode_ordinary(text)
    out, start = [], 0
    while start < len(text):
        seam = _SEAM.search(text, start + SEGMENT)
        end = seam.start() if seam else len(text)
        out += enc.encode_ordinary(text[start:end])
        start = end
    return out


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and the number of tokens of each text; null counts as 0."""
    narrow = df.select(*keep, text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(arrived(path))
        for b in batches:
            counts = [len(encode(enc, t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*b.schema.names[:-1], out])

    return narrow.mapInArrow(run, f"{ddl}, `{out}` bigint")
