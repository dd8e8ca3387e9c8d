"""Groups of near copies: SimHash links and, beside them, texts of a five-word similarity of 0.8.

Fingerprints within two bits miss most pairs of that similarity, and no radius that would find them
leaves a vantage-point tree anything to prune. So candidates for them come from min-hashes in bands
(20 of 5: a pair of similarity 0.8 meets in one with probability 0.9996), and every candidate pair
whose texts no link joins yet is compared by its whole shingle sets.

* Equal texts and equal sets are one node each. A band's group of one component (of SimHash links
  and equal sets) has nothing left to tell; of groups with the same members one is kept.
* Groups of over ``BLOCK`` members are first compared with their least member alone, each member
  once over all bands. Copies of one text are then one component, however many they are.
* The other groups are compared in their own tasks, only across components, and give spanning
  links. A group of over ``BLOCK`` members is dealt to blocks that the tasks take two at a time;
  two blocks of its largest component need none. So a large group costs what lies outside its
  largest component, times its size, and no task ever holds more than two blocks.
* Shingle sets are made where the texts are read, for the texts in groups alone (a bitmap of fixed
  size tells most of them before, a join all of them after); texts are not shuffled.

Defined cases: as for :mod:`simhash`; a text of fewer words than a shingle has is one shingle; a
text without words has none and links to texts of fingerprint zero only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, id_and_text, materialize, partitions, texts_of
from .components import components
from .simhash import BITS, SHINGLE, print_links, shingle_hashes, simhash

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Members of a band's group in a block.
BLOCK = 256
#: Bits of the map that tells texts in groups from others (2 MB whatever the input).
MAP_BITS = 1 << 24
#: 64-bit words of the bit sets compared at once.
_PORTION = 1 << 20
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band; the same for two sets if all of the band's least hashes are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        least = np.minimum(least, _mix(part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + least.reshape(BANDS, ROWS)[:, k])
    return keys


def are_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Have two sorted sets at least that similarity?"""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def alike(sets: list[np.ndarray], similarity: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join whatever pairs of at least that similarity do. Members of the same ``known``
    component are not compared, and count as joined."""
    n = len(sets)
    known = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    parent = list(range(int(known.max()) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []

    def join(i: int, j: int) -> None:
        if (p := root(known[i])) != (q := root(known[j])):
            parent[max(p, q)] = min(p, q)
            links.append((i, j))

    if n <= 8:
        for i in range(1, n):
            for j in range(i):
                if root(known[i]) != root(known[j]) and are_alike(sets[i], sets[j], similarity):
                    join(i, j)
        return links
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    several = times[at] > 1  # what one set alone has is in no intersection
    number = np.cumsum(times > 1) - 1
    row, at = row[several], number[at[several]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((n, n), np.int32)
    width = 64 * max(1, _PORTION // n)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [a, a + width])
        bit, held = at[lo:hi] - a, np.zeros((n, (min(width, int(at[-1]) + 1 - a) + 63) // 64), np.uint64)
        np.bitwise_or.at(held, (row[lo:hi], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        for i in range(1, n):
            other = np.flatnonzero(known[:i] != known[i])
            if len(other):
                shared[i, other] += np.bitwise_count(held[other] & held[i]).sum(1, dtype=np.int32)
    for i in range(1, n):
        whole = sizes[:i] + sizes[i] - shared[i, :i]
        for j in np.flatnonzero((known[:i] != known[i]) & (shared[i, :i] >= similarity * whole - 1e-9)).tolist():
            join(i, j)
    return links


def groups_of(texts: DataFrame) -> DataFrame:
    """Members of bands' groups: key, text_hash and members (how many the group has)."""
    sets = texts.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min_by(F.struct("text_hash", "bands"), "text_hash").alias("r"))
    banded = sets.select("r.text_hash", F.explode("r.bands").alias("key"))
    # groups of the same members have the same two sums of hashes, which are made before rows move
    sums = [F.bit_xor(F.xxhash64("text_hash", F.lit(k))).alias(f"sum_{k}") for k in (1, 2)]
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *sums).where("members > 1")
    first = shared.groupBy("members", "sum_1", "sum_2").agg(F.min("key").alias("key")).select("key", "members")
    return banded.join(first, "key")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """text_hash and shingles of wanted texts (pick, a hash of text_hash and the doc_id of one row)."""
    bit = F.pmod("pick", F.lit(MAP_BITS))
    words = wanted.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(pick, 64)))")).alias("bits"))
    rows = words.toArrow()
    held = np.zeros(MAP_BITS // 64, np.uint64)
    held[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("pick").to_numpy() % MAP_BITS
            hit = np.flatnonzero(held[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            part = batch.take(pa.array(hit))
            found = [shingle_set(t, size).tobytes() for t in texts_of(part.column("text"))]
            yield pa.record_batch([part.column("pick"), part.column("text_hash"), pa.array(found, pa.binary())], names=["pick", "text_hash", "shingles"])

    own = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    picked = own.select(_pick().alias("pick"), "text_hash", "text").mapInArrow(shingles, "pick long, text_hash long, shingles binary")
    return picked.join(wanted, "pick", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", "shingles")


def _pick() -> Column:
    return F.xxhash64("text_hash", "doc_id")


def pivot_links(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of members of groups of over BLOCK members with the least member of any of
    their groups. One comparison a member; the pivots' sets are dealt out by salt."""
    large = found.where(f"members > {BLOCK}")
    least = large.groupBy("key").agg(F.min("text_hash").alias("pivot"))
    pairs = large.join(least, "key").groupBy("text_hash").agg(F.min("pivot").alias("pivot")).where("pivot <> text_hash")
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    pivots = salts.join(sets, F.col("pivot") == F.col("text_hash")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("others"))
    dealt = pairs.join(salts, "pivot").withColumn("salt", F.pmod(F.xxhash64("text_hash"), "salts").cast("int"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("shingles").to_pylist(), batch.column("others").to_pylist(), strict=True)
            near = pa.array([are_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in both], pa.bool_())
            yield pa.record_batch([batch.column("text_hash").filter(near), batch.column("pivot").filter(near)], names=["a", "b"])

    joined = dealt.join(sets, "text_hash").join(pivots, ["pivot", "salt"]).select("text_hash", "pivot", "shingles", "others")
    return joined.mapInArrow(compare, "a long, b long")


def group_links(found: DataFrame, sets: DataFrame, component: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within groups, across the components (text_hash, component) known so far."""
    member = found.join(component, "text_hash", "left").withColumn("component", F.coalesce("component", "text_hash"))
    part = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.first("members").alias("members"))
    # the largest component of every group, where it has several
    open_ = part.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"), F.first("members").alias("all")).where("n < all")
    split = open_.select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("n")) / BLOCK).cast("int").alias("rests"))
    at = F.xxhash64("text_hash", "key")
    block = F.when(F.col("component") == F.col("main"), F.pmod(at, "mains")).otherwise(F.col("mains") + F.pmod(at, "rests")).cast("int")
    numbered = member.join(split, "key").withColumn("block", block)
    # a block meets every block of the rest; so one of the rest meets all, itself included. Where one
    # block of each is all there is, they are one task.
    last = F.col("mains") + F.col("rests") - 1
    single = (F.col("mains") == 1) & (F.col("rests") == 1)
    met = F.when(single, F.array(1 - F.col("block"))).when(F.col("block") < F.col("mains"), F.sequence("mains", last)).otherwise(F.sequence(F.lit(0), last))
    dealt = numbered.withColumn("other", F.explode(met)).select("text_hash", "component", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(group: pa.Table) -> pa.Table:
        names = group.column("text_hash")
        held = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        links = alike(held, similarity, group.column("component").to_numpy()) if len(held) > 1 else []
        return pa.table([names.take(pa.array([i for i, _ in links], pa.int64())), names.take(pa.array([j for _, j in links], pa.int64()))], names=["a", "b"])

    return dealt.join(sets, "text_hash").groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, print_size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash and component (a text hash) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, names, bands = [], [], []
            for text in texts_of(batch.column("text")):
                prints.append(simhash(text, print_size))
                own = shingle_set(text, size)
                names.append(int(_mix(own * np.uint64(len(own)) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(own) else None)
                bands.append(band_keys(own).view(np.int64) if len(own) else None)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(names, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "print", "set_hash", "bands"])

    hashed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    sketches = materialize(hashed.mapInArrow(compute, "doc_id long, text_hash long, print long, set_hash long, bands array<long>"), "text-sketches")
    firsts = [F.first(c).alias(c) for c in ("print", "set_hash", "bands")]
    texts = materialize(sketches.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), *firsts), "texts")

    def stars(key: str) -> DataFrame:
        """Texts of equal key, as links to the least of them."""
        least = texts.where(f"{key} IS NOT NULL").groupBy(key).agg(F.min("text_hash").alias("b"))
        return texts.select(F.col("text_hash").alias("a"), key).join(least, key).where("a <> b").select("a", "b")

    of_print = materialize(texts.groupBy("print").agg(F.min("text_hash").alias("least")), "prints")
    a, b = (of_print.select(F.col("print").alias(c), F.col("least").alias(f"_{c}")) for c in "ab")
    close = print_links(of_print.repartition(partitions(spark)), bits).join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))

    found = materialize(groups_of(texts), "band-members")
    wanted = texts.join(found.select("text_hash").distinct(), "text_hash", "left_semi").select(_pick().alias("pick"))
    sets = materialize(sets_of(docs, wanted, size), "shingle-sets")
    near = materialize(stars("print").union(stars("set_hash")).union(close).union(pivot_links(found, sets, similarity)), "links-so-far")
    known = components(near)
    so_far = known.select(F.col("node").alias("text_hash"), "component")
    links = materialize(near.union(group_links(found, sets, so_far, similarity)), "all-links")
    discard(texts, of_print, found, sets, near)
    joined = materialize(components(links), "text-components")
    discard(links)
    own = sketches.select("doc_id", "text_hash")
    return own.join(joined, F.col("text_hash") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("component"))


def one_of_each(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, with one row of every group: that of the least doc_id (null ids come
    last; equal ids are ordered by a hash of their texts)."""
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "again")
    rows_ = near_groups(docs, size, similarity).groupBy("doc_id", "text_hash").agg(F.first("component").alias("component"), (F.count(F.lit(1)) > 1).alias("again"))
    found = rows_.groupBy("component").agg(F.min(first).alias("first"))
    kept = materialize(found.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), F.col("first.again").alias("_again")), "kept")
    row = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"), F.struct(*docs.columns).alias("row"))

    def rows(again: bool) -> DataFrame:
        same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
        return row.join(kept.where(F.col("_again") == again), same, "left_semi")

    return rows(False).select("row.*").union(rows(True).dropDuplicates(["_doc", "_text"]).select("row.*"))
