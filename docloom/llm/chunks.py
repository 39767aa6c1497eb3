"""Rows of a table packed into chunks of a few megabytes of text.

A chunk is a row (chunk, size, keys, body): what the corpus tells a chunk comes back by
its number, so texts travel compressed and a hot text, word or key is met once a chunk.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes of text of a chunk; a longer text is a chunk of its own
CHUNK_BYTES = 2 << 20


def pack(docs: DataFrame, keep: list[str], text: str, *, chunk_bytes: int = CHUNK_BYTES, key: Column | None = None) -> DataFrame:
    """(chunk, size, keys, body) with all rows of ``docs``.

    A body has the ``keep`` columns by place and then the text, a null one as empty; its
    columns have names of their own.  keys: values of ``key``, a long, of each row.
    """
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    key = F.lit(None).cast("long") if key is None else key
    source = docs.select(key.alias("k"), *columns, F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0
        packer = zstandard.ZstdCompressor(level=1)

        def packed():
            nonlocal n
            out, table = io.BytesIO(), pa.Table.from_batches(held).combine_chunks()
            body = table.drop_columns(["k"])
            with pa.ipc.new_stream(out, body.schema) as writer:
                writer.write_table(body)
            n += 1
            keys = pa.array([table["k"].to_pylist()], type=pa.list_(pa.int64()))
            arrays = [pa.array([task << 33 | n]), pa.array([size]), keys, pa.array([packer.compress(out.getvalue())], type=pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "size", "keys", "body"])

        for batch in batches:
            for part, own in K.slices(batch, "t"):
                if held and size + len(own.data) > chunk_bytes:
                    yield packed()
                    held, size = [], 0
                held.append(part)
                size += len(own.data)
        if held:
            yield packed()

    return source.mapInArrow(run, "chunk long, size long, keys array<long>, body binary")


def opened(body: bytes) -> tuple[pa.RecordBatch, K.Text]:
    """The rows of a chunk, and their texts."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    table = pa.ipc.open_stream(raw).read_all().combine_chunks()
    batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
    return batch, K.as_text(batch.column(batch.num_columns - 1))


def each(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Arrow values of one row, a chunk, at a time."""
    at = [batch.schema.get_field_index(c) for c in columns]
    for i in range(batch.num_rows):
        yield tuple(batch.column(j)[i] for j in at)
