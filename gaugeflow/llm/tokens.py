"""Public tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .textkit import as_array, words

#: Where the vocabulary files lie; a parameter of every operator that needs one.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into pieces before byte pairs are merged (the published pattern of this vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts the words of ``textkit`` instead of the ids of a vocabulary.
WORDS = "words"


#: Longer texts are counted in parts of about so many characters.
PART = 1 << 20
#: No piece runs over such a place: only its beginning can be a blank.
_BREAK = re.compile(r"(?<=\w) (?=\w)")


def ship(spark: SparkSession, *paths: str) -> None:
    """Send the vocabulary files that the driver has to the workers, for those that don't."""
    for path in paths:
        if path != WORDS and os.path.exists(path):
            spark.sparkContext.addFile(path)


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts, tokenizer: str) -> np.ndarray:
    """Tokens of each text; 0 for a null or empty one."""
    texts = as_array(texts)
    if tokenizer == WORDS:
        return words(texts).counts
    encode = encoder(tokenizer).encode_ordinary
    return np.fromiter((sum(len(encode(p)) for p in _parts(t)) if t else 0 for t in texts.to_pylist()), dtype=np.int64, count=len(texts))


def _parts(text: str):
    at = 0
    while len(text) - at > 2 * PART and (m := _BREAK.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def with_counts(batch: pa.RecordBatch, tokenizers: list[str]) -> list[pa.Array]:
    return [pa.array(token_counts(batch["text"], t)) for t in tokenizers]
