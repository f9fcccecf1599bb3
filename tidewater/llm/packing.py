"""Texts compressed one by one before they are shuffled."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import tidied


def packed(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Columns `keep` and binary column packed: the text's bytes under zstd. Null texts stay null."""
    columns = [*keep, text]

    def run(batches):
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([small.compress(x.as_buffer()) if x.is_valid else None for x in texts], pa.binary())], names=[*keep, "packed"])

    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keep).schema}
    return df.select(*columns).mapInArrow(tidied(run), ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "packed binary"]))


def unpacked(column) -> list:
    """The bytes of each packed value; None for null."""
    import zstandard

    large = zstandard.ZstdDecompressor()
    return [large.decompress(x.as_buffer()) if x.is_valid else None for x in column]
