"""Shortest-pack-first over the length histogram (operator 1).

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. There, lengths
are placed longest first; each goes to the packs that have most room left, and packs with the same
content are one *pattern* with a count, so the work depends on the number of lengths and not on
the number of documents. Each placement is a *slot*: ranks r0..r1 of a length lie at one offset of
the sequences from seq0 on. Every piece then finds its slot by its rank among the pieces of its
length. Ranks are made in two steps (within a hashed bucket, then over buckets), so that a length
that a third of all pieces have is still many tasks' work.

Defined cases: null text is empty and has the end id alone; an empty table gives no rows; repeated
rows are separate pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, materialize, partitions, released, texts_of
from .wordpieces import encode_words

CAPACITY = 2048
#: Slots beyond which they are joined by a shuffle; at 40 bytes each, fewer can be broadcast.
BROADCAST_SLOTS = 400_000


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, r0, r1, seq0, offset): the piece of that length and rank r, r0 <= r < r1,
    lies in sequence seq0 + r - r0 at offset.

    A pattern is a run of sequences with the same lengths so far; putting a length on part of a
    pattern splits the run, so sequence numbers never change.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths lie between 1 and the capacity")
    by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (seq0, count)
    rooms: list[int] = []  # rooms in use, ascending
    slots, n_seqs = [], 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room:
            if not by_room[room]:
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            by_room[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                seq0, count = by_room[room].pop()
                n = min(left, count)
                if n < count:
                    by_room[room].append((seq0 + n, count - n))
                if not by_room[room]:
                    rooms.pop()
            else:
                room, n, seq0 = capacity, left, n_seqs
                n_seqs += n
            slots.append((length, rank, rank + n, seq0, capacity - room))
            put(room - length, (seq0, n))
            left, rank = left - n, rank + n
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """pieces (with a long column length, 1 to capacity) with sequence_id and offset.

    pieces is read three times (histogram, bucket counts, result), so it should be a written table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = shortest_pack_first(histogram, capacity)
    columns = [np.array(x, np.int64) for x in zip(*slots, strict=True)] if slots else [np.empty(0, np.int64)] * 5
    slot_table = spark.createDataFrame(pa.table(columns, names=["_length", "_r0", "_r1", "_seq0", "_offset"]))

    buckets = max(256, 4 * partitions(spark))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    ranked = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    placed = ranked.join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_n") - 1)
    if len(slots) <= BROADCAST_SLOTS:
        slot_table = F.broadcast(slot_table)
    found = placed.join(slot_table, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_r0")) & (F.col("_rank") < F.col("_r1")))
    return found.select(*pieces.columns, (F.col("_seq0") + F.col("_rank") - F.col("_r0")).alias("sequence_id"), F.col("_offset").alias("offset"))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents encoded and cut at every multiple of capacity; with_ids adds the ids as
    little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                ids, counts = encode_words(texts_of(batch.column("text")), tokenizer_path, end_id)
                held = memoryview(ids.astype("<u4")).cast("B")
                n_pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = (np.cumsum(counts) - counts)[doc] + start
                parts = [held[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(counts[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    return id_and_text(docs).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: PIECES, sequence_id and offset (and ids)."""
    return pack(materialize(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """From pack_documents(with_ids=True), the training sequences: sequence_id, ids (binary, not
    padded), doc_ids and offsets of its pieces. A group is one sequence, so it is small."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.offset").alias("offsets"))
