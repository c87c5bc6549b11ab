"""Lengths of texts in tokens of a public tokenizer, and a weight for how varied a text is."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.session import spread

#: Vocabulary file (ranks); a parameter of every operator that measures texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the public splitting pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A text of fewer tokens than this gets a proportionally smaller weight.
FULL_WEIGHT_TOKENS = 64
LEAST_WEIGHT = 0.05


@cache
def encoder(path: str):
    """The tokenizer of a vocabulary file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def weight(ids: list[int]) -> float:
    """Share of distinct tokens (its root), less for very short texts; between LEAST_WEIGHT and 1."""
    if not ids:
        return LEAST_WEIGHT
    return max(LEAST_WEIGHT, (len(set(ids)) / len(ids)) ** 0.5 * min(1.0, len(ids) / FULL_WEIGHT_TOKENS))


def measured(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, weight) of every document, whole texts. A NULL or empty text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n, w = [], []
            for text in batch.column("text"):
                ids = enc.encode_ordinary(text.as_py() or "")
                n.append(len(ids))
                w.append(weight(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "source", "n_tokens", "weight"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, weight double")
