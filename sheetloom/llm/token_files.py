"""Token ids in Arrow files of equal-length sequences (operator 7).

A shard is one Arrow IPC file whose record batches hold two fixed-size-list columns: ``ids``
(unsigned 16 or 32 bits, whichever holds the vocabulary) and ``mask`` (one bit a position, false
only after the shard's last id). Batches are not compressed, so a memory-mapped reader gets any
sequence of any batch without copying.

Documents go to shards in ascending order of doc_id (null first; equal doc_ids in order of a hash
of their texts). Each shard is written by one task under a name of that attempt; the manifest, a
Parquet table with one row per document, is what commits it, so a task that ran twice leaves an
unread file and nothing else.

Defined cases: null text is empty and has the end id alone; an empty table gives no shards and no
rows; repeated rows are each written; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, materialize, new_path, partitions, released, texts_of
from .wordpieces import encode_words, piece_ids

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH_SEQUENCES = 64
MANIFEST = "shard int, path string, width int, doc_id long, at long, n_tokens long"


def open_store(uri: str) -> tuple:
    """pyarrow's filesystem for a path of Spark's, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def shard_schema(width: int, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Takes ids in any portions and writes them as sequences of one length."""

    def __init__(self, uri: str, width: int, length: int = SEQUENCE) -> None:
        store, path = open_store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.kind = np.uint16 if width == 2 else np.uint32
        self.schema = shard_schema(width, length)
        self.length, self.held, self.n_held = length, [], 0
        self.out = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        if self.n_held >= self.length * BATCH_SEQUENCES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        """Every batch but the last is full, so a position tells its batch."""
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        step = self.length * BATCH_SEQUENCES
        n = len(ids) if last else len(ids) // step * step
        rest = ids[n:]
        for a in range(0, n, step):
            part = ids[a : min(n, a + step)]
            rows = -(-len(part) // self.length)
            mask = np.arange(rows * self.length) < len(part)
            full = np.zeros(rows * self.length, self.kind)
            full[: len(part)] = part
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        self._flush(last=True)
        self.file.close()
        self.out.close()


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        store, path = open_store(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.cached: tuple[int, np.ndarray, np.ndarray] | None = None

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file's memory) and mask of batch k."""
        if self.cached is None or self.cached[0] != k:
            batch = self.file.get_batch(k)
            self.cached = (k, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self.cached[1:]

    def ids(self, at: int, n: int) -> np.ndarray:
        """n ids from position at on."""
        step, parts = self.length * BATCH_SEQUENCES, []
        while n > 0:
            part = self.batch(at // step)[0][at % step : at % step + n]
            if not len(part):
                raise ValueError("the shard is shorter than its manifest says")
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def close(self) -> None:
        self.cached = None
        self.source.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 1, length: int = SEQUENCE, shards: int | None = None) -> DataFrame:
    """Encode documents, write them to shards and return the manifest.

    The one shuffle deals texts out by ranges of doc_id, since files follow that order. The
    manifest is (shard, path, width, doc_id, at: position in the shard, n_tokens).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out_dir = out_dir or new_path(spark, "token-files")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        path = f"{out_dir}/shard-{shard:07d}-{task.taskAttemptId()}.arrow"
        writer, at = None, 0
        with released():
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    width = 2 if piece_ids(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else 4
                    writer = ShardWriter(path, width, length)
                ids, counts = encode_words(texts_of(batch.column("text")), tokenizer_path, end_id)
                writer.add(ids)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                n = batch.num_rows
                yield pa.record_batch([pa.array(np.full(n, shard, np.int32)), pa.array([path] * n), pa.array(np.full(n, width, np.int32)), batch.column("doc_id"), pa.array(starts), pa.array(counts.astype(np.int64))], names=["shard", "path", "width", "doc_id", "at", "n_tokens"])
            if writer is not None:
                writer.close()

    dealt = id_and_text(docs).repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. What goes to the driver is one row per shard."""
    sizes = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    base, total = {}, 0
    for row in sizes:
        base[row["shard"]] = total
        total += row["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("shard", "path", "at", "n_tokens")}
            crcs = []
            for p, at, n in zip(columns["path"], columns["at"], columns["n_tokens"], strict=True):
                if p != path:
                    if reader is not None:
                        reader.close()
                    reader, path = ShardReader(p), p
                crcs.append(zlib.crc32(reader.ids(at, n).astype("<u4")))
            starts = [base[s] + at for s, at in zip(columns["shard"], columns["at"], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(starts, pa.int64()), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
