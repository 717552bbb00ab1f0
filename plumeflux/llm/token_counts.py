"""Token counts of whole texts (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.llm.pieces import token_chunks

TOKEN_LIMIT = 512


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``path`` names a byte-level BPE file of the tokenizers library without normalizer. Counts equal the
    library's for the whole text without added special tokens; special strings inside a text count as
    its default has it. Only lengths leave the Python workers. Work goes in chunks of about equal bytes,
    long texts cut where a token always ends. Null text: 0 bytes, 0 tokens. Null keys, repeated rows and
    equal texts each keep a row of their own; other columns are not read. One scan, no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            for of, inverse, at, _, sizes in token_chunks(batch.column(1), path, spaces=True):
                np.add.at(totals, of, np.diff(at)[inverse])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals), pa.array(totals > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key), F.col(text))
    return slim.mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
