"""Token ids and token counts of whole tables by a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.bpe import byte_bpe
from gleanery.llm.canonical import sliced

#: Bytes of text that a worker encodes at once; it changes no result.
AT_ONCE = 600_000


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [t or "" for t in piece.column(1).to_pylist()]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text by ``tokenizer``, without special tokens.

    Null and empty texts have the empty list.  The strings of special tokens are ordinary
    text.  Nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder = byte_bpe(tokenizer, folder)
        for batch in batches:
            for piece in sliced(batch, text, AT_ONCE):
                ids, counts = coder.encode(_texts(piece))
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str = "text", name: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``keys`` and the number of tokens of each text; 0 for null and empty texts."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder = byte_bpe(tokenizer, folder)
        for batch in batches:
            for piece in sliced(batch, text, AT_ONCE):
                counts = coder.count([t or "" for t in piece.column(len(keys)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keys)], pa.array(counts.astype(np.int64))], [*keys, name])

    return df.select(*keys, text).mapInArrow(run, f"{schema}, {name} bigint")
