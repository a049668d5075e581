"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary file is looked for unless a path is given: this variable, then the installed package, then the folder.
PATH_VARIABLE = "TOKENIZER_PATH"
FILE = "byte_bpe_50k.tiktoken"
FOLDER = "/opt/tokenizers"
#: Fixed value: how the vocabulary's tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    if os.environ.get(PATH_VARIABLE):
        return os.environ[PATH_VARIABLE]
    try:
        import public_tokenizers

        return public_tokenizers.path(FILE)
    except ImportError:
        return f"{FOLDER}/{FILE}"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str | None = None) -> int:
    """Tokens of a text; 0 for NULL and empty texts. Names of special tokens are ordinary text."""
    return len(_encoding(path or vocabulary_path()).encode_ordinary(text)) if text else 0


def with_token_counts(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_tokens`` (bigint) of its ``text``; the text itself goes no further.

    One pass without a shuffle. Whole texts are counted, however long.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or _encoding(where).encode_ordinary
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    picked = docs.select(*keep, "text")
    schema = T.StructType([*picked.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())])
    return picked.mapInArrow(run, schema)
