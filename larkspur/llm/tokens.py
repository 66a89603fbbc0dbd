"""Token counts by a public tokenizer whose file is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(path)
        for batch in batches:
            n = pa.array([len(enc.encode_ordinary(x)) if x else 0 for x in batch.column("text").to_pylist()], pa.int64())
            rest = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), n], [*(batch.schema.names[k] for k in rest), "n_tokens"])

    return of


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with an id and a text that isn't blank; repeated rows count once
    (an id with several texts takes its longest)."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S")).select("doc_id", "source", "text")
    return rows.mapInArrow(_counter(ranks), "doc_id long, source string, n_tokens long").groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
