"""SimHash near-dedup with vantage-point trees (operator 3).

Fingerprints: A-Z lower-cased, words parted by ASCII white space, shingles of words with repeats,
XXH64 with seed 42, majority of each bit. Equal fingerprints are one class; distinct ones are dealt
to leaves of a vantage-point tree, each leaf is searched by itself, and the links found are joined
to components. The tree is fitted on at most ``SAMPLE`` fingerprints, which is all that the driver
sees; which fingerprints go to which leaf, and every link, is exact whatever the sample.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like
any other; fewer words than a shingle has are one shingle; repeated rows come back once each;
component_id is null only where no document reachable has a doc_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, bound_batches, id_and_text, materialize, partitions, texts_of
from .components import components
from .vantage import grow, spanning_links

SHINGLE, BITS, SEED = 3, 2, 42
#: Fingerprints that the tree is fitted on, 8 bytes each.
SAMPLE = 100_000
#: Distinct fingerprints that a leaf should hold, without copies.
LEAF = 4096
_PORTION = 1 << 16


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(size, len(words)) - 1 :], strict=False)], np.uint64)


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _PORTION):
        ones += np.unpackbits(hashes[a : a + _PORTION].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (XXH64) and print, the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: Texts = texts_of(batch.column("text"))
            prints = np.array([simhash(t, size) for t in texts], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "print"])

    hashed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(compute, "doc_id long, text_hash long, print long")


def print_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``bits`` of each other.

    prints: a table with one row per distinct fingerprint, column print.
    """
    spark = prints.sparkSession
    n = prints.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    picked = prints.where(F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < int(share * (1 << 20))).select("print").limit(SAMPLE)
    sample = np.array([r[0] for r in picked.collect()], np.int64).view(np.uint64)
    tree = grow(sample, bits, LEAF / max(n, 1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("print").to_numpy().view(np.uint64)
            for leaf, at in tree.route(held):
                yield pa.record_batch([pa.array(np.full(len(at), leaf, np.int64)), pa.array(held[at].view(np.int64))], names=["leaf", "print"])

    def search(found: pa.Table) -> pa.Table:
        a, b = spanning_links(found.column("print").to_numpy().view(np.uint64), bits)
        return pa.table([a.view(np.int64), b.view(np.int64)], names=["a", "b"])

    leaves = prints.select("print").mapInArrow(route, "leaf long, print long")
    return leaves.groupBy("leaf").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash, print, and of the component its least print and component_id, the least
    doc_id that links reach (the row's own included)."""
    spark = docs.sparkSession
    own = materialize(fingerprints(docs, size), "fingerprints")
    first = materialize(own.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    joined = materialize(components(print_links(first.repartition(partitions(spark)), bits)), "print-components")
    members = joined.join(first, F.col("node") == F.col("print")).select("print", "component", "least")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "component").select("print", "component", "component_id")
    classes = first.join(linked, "print", "left").select("print", F.coalesce("component", "print").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    classes = materialize(classes, "print-classes")  # then the join below is one that Spark can split where a print is hot
    return own.join(classes, "print").select("doc_id", "text_hash", "print", "component", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs, all columns, with one row of every component: that of the least doc_id (null ids come
    last; equal ids are ordered by a hash of their texts)."""
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    found = near_duplicates(docs, size, bits).groupBy("component").agg(F.min(first).alias("first"))
    kept = found.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    row = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"), F.struct(*docs.columns).alias("row"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return row.join(kept, same, "left_semi").dropDuplicates(["_doc", "_text"]).select("row.*")


def hexadecimal(column: str) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
