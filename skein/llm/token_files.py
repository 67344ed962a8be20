"""Token-id output: Arrow files of fixed-size-list batches, and random access to them.

A file holds sequences of equal length: ``ids`` (fixed-size list of the narrowest unsigned integers
that hold the vocabulary) and ``mask`` (fixed-size list of booleans, false in the padding of the
last sequence). Documents follow one another without a gap, in order of their key, over sequence
ends; an index file beside it has each document's key, start and length. Read by memory map, a
sequence or its mask is a view of the file.

Documents are dealt to tasks by ranges of the key, so files are in order, one for each range. A task
writes under a name of its own and reports it when both files are whole; the manifest of reported
files is the output, so a retried or doubled task leaves at most a file that nothing names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import documents, settle, shared_dir, slices, tokenizer_path, whole_text
from .tokens import encoder

SEQUENCE = 2048
#: Sequences in a batch.
BATCH = 256
END = 2


def _open(uri: str, mode: str):
    """A file of any store that pyarrow knows; a local one is mapped for reading."""
    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        return store.open_output_stream(path)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


class TokenWriter:
    """Appends documents to one token file and its index."""

    def __init__(self, uri: str, width: int, key: pa.DataType, length: int = SEQUENCE):
        self._value, self._width, self._length = (pa.uint16() if width == 2 else pa.uint32()), width, length
        self._schema = pa.schema([("ids", pa.list_(self._value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self._key = pa.schema([("key", key), ("start", pa.int64()), ("length", pa.int64())])
        self._sinks = [_open(uri, "w"), _open(uri + ".index", "w")]
        self._files = [pa.ipc.new_file(sink, schema) for sink, schema in zip(self._sinks, (self._schema, self._key))]
        self._buffer, self._rows, self.tokens, self.documents = bytearray(), [], 0, 0

    def add(self, key, packed: bytes) -> None:
        n = len(packed) // self._width
        self._rows.append((key, self.tokens, n))
        self.tokens, self.documents = self.tokens + n, self.documents + 1
        self._buffer += packed
        size = BATCH * self._length * self._width
        while len(self._buffer) >= size:
            self._write(bytes(self._buffer[:size]))
            del self._buffer[:size]
        if len(self._rows) >= 10_000:
            self._index()

    def _write(self, packed: bytes) -> None:
        n = len(packed) // self._width
        rows = -(-n // self._length)
        ids = packed + bytes((rows * self._length - n) * self._width)
        mask = np.arange(rows * self._length) < n
        arrays = [pa.Array.from_buffers(self._value, rows * self._length, [None, pa.py_buffer(ids)]), pa.array(mask)]
        self._files[0].write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(a, self._length) for a in arrays], schema=self._schema))

    def _index(self) -> None:
        if self._rows:
            self._files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self._rows), self._key.types)], schema=self._key))
            self._rows = []

    def close(self) -> None:
        if self._buffer:
            self._write(bytes(self._buffer))
        self._index()
        for x in (*self._files, *self._sinks):
            x.close()


class TokenFile:
    """Random access to a token file: sequences, masks and documents by number."""

    def __init__(self, uri: str):
        reader = pa.ipc.open_file(_open(uri, "r"))
        batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
        self.length = reader.schema.field("ids").type.list_size
        self._ids = [b.column(0).values.to_numpy(zero_copy_only=True) for b in batches]
        self._masks = [b.column(1) for b in batches]
        self._per = len(self._ids[0]) if batches else 1
        self._rows = self._per // self.length or 1
        self.index = pa.ipc.open_file(_open(uri + ".index", "r")).read_all()

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence ``i``, a view of the file."""
        at = i % self._rows * self.length
        return self._ids[i // self._rows][at : at + self.length]

    def mask(self, i: int) -> pa.Array:
        return self._masks[i // self._rows].slice(i % self._rows, 1).flatten()

    def ids(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from place ``start`` of the file on."""
        parts, end = [], start + length
        while start < end:
            k, at = divmod(start, self._per)
            parts.append(self._ids[k][at : at + end - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self._ids[0].dtype if self._ids else "u2")


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end: int, spaced: bool = True, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, special: bool = False) -> DataFrame:
    """Write all documents' ids in order of ``key`` below ``to``; the manifest: a row for each file, in order.

    Columns: file, first_key, n_documents, n_tokens, start (tokens of the files before it). A null
    text is empty: its document is the end id alone. Null keys come first; rows of one key lie together,
    shorter texts first. An empty table has an empty manifest. Other columns are ignored, whatever their
    names. A document of any length is one row of a task's memory and goes on over sequences; only its
    ids are kept beside it.
    """
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("key")).sortWithinPartitions("key", F.length("text"), "text")
    kind = StructType([StructField("file", StringType()), rows.schema["key"], StructField("n_documents", LongType()), StructField("n_tokens", LongType())])
    kind.fields[1] = StructField("first_key", rows.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(tokenizer, spaced, special), None
        for batch in batches:
            for part in slices(batch, 1):
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if writer is None:
                        first, uri = name, f"{to}/{uuid.uuid4().hex}.arrow"
                        writer = TokenWriter(uri, encode.width, part.schema.field(0).type, length)
                    writer.add(name, encode.packed(value, end))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "first_key": pa.array([first], batch.schema.field(0).type), "n_documents": [writer.documents], "n_tokens": [writer.tokens]})

    manifest = settle(ordered.mapInArrow(run, kind))
    before = Window.orderBy(F.col("first_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_documents(manifest: DataFrame) -> DataFrame:
    """A row for each document in the files of ``manifest``: key, start, n_tokens, ids_crc32, each file read by one task."""
    files = settle(manifest.select("file", "start"))
    key = manifest.schema["first_key"].dataType
    kind = StructType([StructField("key", key), *[StructField(n, LongType()) for n in ("start", "n_tokens", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(uri)
                for rows in file.index.to_batches():
                    starts, lengths = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                    sums = [zlib.crc32(file.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(starts + base), pa.array(lengths), pa.array(sums, pa.int64())], names=kind.names)

    return files.repartition(max(1, files.count())).mapInArrow(run, kind)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to token files in ascending order of doc_id, and what is read back from them."""
    manifest = write_tokens(documents(spark, sf_dir), shared_dir(spark), tokenizer_path("byte_bpe_50k.json"), END, special=True)
    return read_documents(manifest).withColumnRenamed("key", "doc_id")


QUERIES = {"op3_token_files": op3_token_files}
