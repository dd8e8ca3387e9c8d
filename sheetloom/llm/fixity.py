"""WARC archives and their fixity by Merkle trees (operator 10).

A page becomes a WARC/1.0 resource record. Records are ordered by page_id and lie in segments, one
for SPAN consecutive ids, each with its own byte offsets. A record's digest is the SHA-256 of its
bytes. The tree is addressed by record key: records of one id (and of the same first hex digits of
their digests) make a leaf, leaves of FANOUT consecutive ids a node, FANOUT such nodes the next one,
and so on to the root. A node's hash covers its children's keys, byte lengths and hashes in order,
and so the byte ranges that they have within it; where a record is missing, only the nodes above it
differ. Two replicas are compared from the root down: a level's nodes are looked at only under nodes
that differ one level above. Everything is DataFrame operations.

Records of one id are at most split by PARTS: leaves count equal rows instead of holding them, and a
segment's offsets are made from its leaves, so that an id with a very large share of all rows is no
single task's. What is broadcast, the differing nodes of a level, is counted first; over BROADCAST of
them are joined by sorting.

Defined cases: null url or html is empty; null page_ids are spread over SPAN segments
below zero, ordered by content, and have a branch of the tree for themselves; rows of equal page_id
are ordered by content, equal rows are separate records; a record that one replica lacks is "missing"
or "extra"; an empty archive has no root and equals only an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ids in a segment; bits of a key that a level takes off (64 children a node).
SPAN, FANOUT_BITS = 1024, 6
FANOUT = 1 << FANOUT_BITS
#: Hex digits of a digest that part the records of one id.
PARTS = 4
#: Differing nodes of a level that are broadcast (some 50 bytes each); copies of a row made together.
BROADCAST, COPIES = 100_000, 4096
KEY = ["none", "key"]


def record(page_id: Column, url: Column, content: Column) -> Column:
    """The bytes of a WARC record."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content.cast("binary"), F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame) -> DataFrame:
    """page_id, segment and record of every page."""
    page_id = F.col("page_id").cast("long")
    url, content = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    segment = F.when(page_id.isNotNull(), F.shiftright(page_id, SPAN.bit_length() - 1)).otherwise(-1 - F.pmod(F.xxhash64(url, content), F.lit(SPAN)))
    return pages.select(page_id.alias("page_id"), segment.cast("long").alias("segment"), record(page_id, url, content).alias("record"))


def _keyed(records: DataFrame) -> DataFrame:
    """With the address of each record: none (it has no id), key, part."""
    key = F.coalesce("page_id", F.col("segment"))
    return records.withColumns({"none": F.col("page_id").isNull(), "key": key, "part": F.substring("digest", 1, PARTS)})


def leaves(records: DataFrame) -> DataFrame:
    """page_id, segment, position, start and length (bytes in the segment), digest of each record.

    Written to the shared folder: records are read and hashed once, and every level above starts
    from digests. Equal rows move as one with their count; a segment's order is made over its ids.
    """
    hashed = _keyed(records.select("page_id", "segment", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")))
    counted = hashed.groupBy("segment", *KEY, "part", "digest").agg(F.first("page_id").alias("page_id"), F.first("length").alias("length"), F.count(F.lit(1)).alias("copies"))
    total = F.sum(F.col("copies") * F.col("length"))
    group = ["segment", *KEY, "part"]
    within = Window.partitionBy(*group).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("segment").orderBy(F.col("none").desc(), "key", "part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    places = counted.groupBy(*group).agg(F.sum("copies").alias("n"), total.alias("bytes"))
    places = places.select(*group, zero(F.sum("n").over(before)).alias("position"), zero(F.sum("bytes").over(before)).alias("start"))
    placed = counted.withColumns({"ahead": zero(F.sum("copies").over(within)), "bytes_ahead": zero(F.sum(F.col("copies") * F.col("length")).over(within))})
    joined = placed.join(places.hint("merge"), group)
    many = joined.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = many.withColumn("copy", F.explode(F.sequence("batch", F.least(F.col("batch") + COPIES, "copies") - 1)))
    position, start = F.col("position") + F.col("ahead") + F.col("copy"), F.col("start") + F.col("bytes_ahead") + F.col("copy") * F.col("length")
    return materialize(each.select("page_id", "segment", position.alias("position"), start.alias("start"), "length", "digest"), "leaves")


def _hash(children: Column, *fields: str) -> Column:
    return F.sha2(F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(",", *(c[f].cast("string") for f in fields)))), 256)


def _bottom(leaf: DataFrame, replica: int) -> DataFrame:
    """The tree's leaves: one node per id and part, over its distinct records and their counts."""
    counted = _keyed(leaf).groupBy(*KEY, "part", "digest").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("copies"))
    nodes = counted.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.struct("digest", "copies"))).alias("children"), F.sum(F.col("copies") * F.col("length")).alias("length"))
    return nodes.select(F.lit(replica).alias("replica"), *KEY, "part", _hash(F.col("children"), "digest", "copies").alias("digest"), "length")


def _up(nodes: DataFrame, top: bool = False) -> DataFrame:
    """The next level: FANOUT keys in order make one node (at the top, all that are left)."""
    child = F.array_sort(F.collect_list(F.struct("none", "key", "part", "digest", "length"))).alias("children")
    address = [F.lit(False).alias("none"), F.lit(0).cast("long").alias("key")] if top else ["none", F.shiftright("key", FANOUT_BITS).alias("key")]
    grouped = nodes.groupBy("replica", *address).agg(child, F.sum("length").alias("length"))
    return grouped.select("replica", *KEY, F.lit("").alias("part"), _hash(F.col("children"), "none", "key", "part", "length", "digest").alias("digest"), "length")


def trees(*leaves_: DataFrame) -> list[DataFrame]:
    """Levels from leaves to roots of all replicas together: replica, none, key, part, digest,
    length. Each is written: the descent reads it again. How many there are follows from the least
    and the greatest key."""
    whole = _bottom(leaves_[0], 0)
    for k, leaf in enumerate(leaves_[1:], 1):
        whole = whole.union(_bottom(leaf, k))
    levels = [materialize(whole, "tree")]
    low, high = levels[0].agg(F.min("key"), F.max("key")).first()
    if low is not None:
        shift = 0
        while shift == 0 or low >> shift != high >> shift and shift < 60:
            levels.append(materialize(_up(levels[-1]), "tree"))
            shift += FANOUT_BITS
    return [*levels, materialize(_up(levels[-1], top=True), "tree")]


def root(leaf: DataFrame) -> DataFrame:
    """The archive's root: one row, or none for an empty archive."""
    return trees(leaf)[-1].select("digest", "length")


def _only(nodes: DataFrame, found: DataFrame, on: Column) -> DataFrame:
    """The nodes that some row of found is for."""
    small = F.broadcast(found) if found.limit(BROADCAST + 1).count() <= BROADCAST else found.hint("merge")
    return nodes.join(small, on, "left_semi")


def _compared(nodes: DataFrame) -> DataFrame:
    """Addresses of one level, and whether both replicas have the same there."""
    same = (F.count(F.lit(1)) == 2) & (F.min("digest") == F.max("digest")) & (F.min("length") == F.max("length"))
    return materialize(nodes.groupBy(*KEY, "part").agg(same.alias("same")), "compared")


def descent(first: DataFrame, second: DataFrame) -> list[DataFrame]:
    """For each level from the root down, the nodes that were compared (none, key, part, same): those
    under a node that is not the same one level above."""
    levels = trees(first, second)
    steps = [_compared(levels[-1])]
    for k in range(len(levels) - 2, -1, -1):
        above = steps[-1].where("NOT same").select(F.col("none").alias("_none"), F.col("key").alias("_key"))
        if k == len(levels) - 2:
            under = F.col("_key") == 0  # the root is above all
        else:
            under = (F.col("none") == F.col("_none")) & (F.shiftright("key", FANOUT_BITS) == F.col("_key"))
        steps.append(_compared(_only(levels[k], above, under)))
    return steps


def differing_leaves(first: DataFrame, second: DataFrame) -> DataFrame:
    """(none, key, part) of the leaves that differ in two replicas' ``leaves``, by descent."""
    return descent(first, second)[-1].where("NOT same").select(*KEY, "part")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of the first replica's ``leaves`` with its status: ok, damaged (the other has
    other bytes under this page_id) or missing; and records that only the second has, extra.

    Only records of leaves that differ are compared one by one.
    """
    suspect = differing_leaves(first, second).select(F.col("none").alias("_none"), F.col("key").alias("_key")).distinct()
    place = (F.col("none") == F.col("_none")) & (F.col("key") == F.col("_key"))
    again = Window.partitionBy(*KEY, "digest").orderBy("position")
    key = [*KEY, "digest", "again"]
    ours, theirs = (materialize(_only(_keyed(x), suspect, place).withColumn("again", F.row_number().over(again)), "suspects") for x in (first, second))
    lost = ours.join(theirs.hint("merge"), key, "left_anti")
    new = theirs.join(ours.hint("merge"), key, "left_anti")
    there = new.select(*KEY).distinct().withColumn("there", F.lit(True))
    verdict = F.when(F.col("there"), "damaged").otherwise("missing")
    status = lost.join(there.hint("merge"), KEY, "left").select("segment", "position", verdict.alias("status"))
    columns = ["page_id", "segment", "position", "start", "length", "digest"]
    whole = first.join(status.hint("merge"), ["segment", "position"], "left").select(*columns, F.coalesce("status", F.lit("ok")).alias("status"))
    extra = new.join(lost.select(*KEY).hint("merge"), KEY, "left_anti")
    return whole.union(extra.select(*columns, F.lit("extra").alias("status")))


def damaged_replica(pages: DataFrame, damage: int = 97, loss: int = 389) -> DataFrame:
    """A second copy of pages with planted faults: of every ``damage`` ids one has its first
    character changed, of every ``loss`` one is lost."""
    lost = F.coalesce(F.col("page_id") % loss == 7, F.lit(False))
    hit = F.coalesce(F.col("page_id") % damage == 13, F.lit(False))
    return pages.where(~lost).withColumn("html", F.when(hit, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
