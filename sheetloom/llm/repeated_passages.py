"""Removal of repeated passages by distributed prefix doubling (operator 4).

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Ranking every position of the corpus by prefixes of 1, 2, 4 ... LENGTH bytes would sort
sixteen bytes a position several times over. Three things keep the method and drop that cost:

* Ranks are names: a hash of the prefix, made from the two names of its halves (in closed form, as
  a prefix sum), so that equal prefixes have equal names on every machine. "Sort and rerank" is
  then a sort of the names by range, which finds names that other documents have too.
* The first rank, of GRAM bytes, is sorted only for *anchors*: of every LENGTH-byte window, the
  GRAM-byte prefix in it with the least hash. Windows that are equal have the same anchor at the
  same place, so a window whose anchor no other document has is unique: it is dropped, with no
  other position sorted. About 2 in LENGTH - GRAM positions are anchors.
* Consecutive windows with the same anchor are a *phrase*. The next rank names the whole phrase
  (LENGTH bytes and more): a phrase that a smaller document has too goes in one piece. Only where
  phrases with equal anchors differ, at the edges of repeated passages, does the last round rank
  single windows of LENGTH bytes. For that a shard sends such a phrase's bytes to its anchor's
  bucket; of an anchor with over HOT_PHRASES different phrases it sends the names of the windows,
  which spread over all buckets.

Rounds are messages between *shards* (groups of documents, dealt out once; Spark reuses that
exchange in every round) and *buckets* (ranges of names). A message packs all names that a shard
has in a bucket, each once, so a passage that a third of all documents hold is one entry a shard.
Answers are bits: whether a shard's first holder of a name is the first of all. Every stage is
deterministic, so a lost executor's tasks run again with the same outcome. Names that decide have
128 bits (first and second rank together, or both hashes of a window).

Defined cases: null text is empty; texts under LENGTH bytes are kept whole; matches within a
document or between rows of equal doc_id do not count; a null doc_id is smaller than any other;
repeated rows come back once each; an empty table gives no rows; other columns pass through
unchanged in ``without_repeats`` and are ignored in ``repeat_digests``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, bound_batches, partitions, released, texts_of

LENGTH, GRAM = 50, 20
#: Bytes of text in a shard and names in a bucket, about; and bytes looked at together.
SHARD_BYTES, BUCKET_NAMES, PORTION = 8 << 20, 1 << 19, 1 << 18
HOT_PHRASES = 4096
MESSAGE = "at long, sender long, kind int, body binary"
#: Kinds of messages: anchors, phrases, bytes of phrases, names of windows.
ANCHORS, PHRASES, BYTES, WINDOWS = range(4)
KEPT = 4  # a shard's mail so far, in one message to itself
_ONE = (1 << 64) - 1


def _table(seed: int) -> np.ndarray:
    """256 spread-out odd 64-bit numbers (splitmix64)."""
    out, x = [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & _ONE
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ONE
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _ONE
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Names of substrings by prefix sums: name(i, n) = sum of letter(i + j) * base**j, j < n."""

    def __init__(self, seed: int, base: int) -> None:
        self.letters, self.base = _table(seed), base
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PORTION + LENGTH)
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, self.base, np.uint64))])
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, pow(self.base, -1, 1 << 64), np.uint64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=out[1:])
        return out

    def windows(self, data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Names of data[p:p + n] for given p."""
        self._reach(n)
        out = np.empty(len(at), np.uint64)
        for a in range(0, len(at), 1 << 14):
            p = at[a : a + (1 << 14)]
            out[a : a + len(p)] = (self.letters[data[p[:, None] + np.arange(n)]] * self.powers[:n]).sum(1, dtype=np.uint64)
        return mix(out)


FIRST, SECOND = Rolling(1, 0x8F1BBCDCCA62C1D7), Rolling(2, 0x2545F4914F6CDD1D)


@dataclass
class Phrases:
    """Runs of windows with one anchor: the text each is in, its first window, how many windows,
    the anchor's name and the phrase's."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    name: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Phrases:
        return Phrases(*(getattr(self, f)[which] for f in self.__dataclass_fields__))


def _portions(texts: Texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, starts and ends of texts in it, their numbers); a longer text comes in pieces
    that overlap by a window less a byte, so that every window is in exactly one."""
    starts = texts.starts
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PORTION, "right")) - 1)
        if j == i + 1:
            for a in range(int(starts[i]), max(int(starts[j]) - LENGTH + 1, int(starts[i]) + 1), PORTION):
                b = min(a + PORTION + LENGTH - 1, int(starts[j]))
                yield a, b, np.array([[a, b]]), np.array([i])
        else:
            yield int(starts[i]), int(starts[j]), np.stack([starts[i:j], starts[i + 1 : j + 1]], 1), np.arange(i, j)
        i = j


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


#: Anchors are least hashes, so their hashes crowd at zero; names spread them evenly over buckets.
_SPREAD = np.uint64(0x5851F42D4C957F2D)


def phrases(texts: Texts) -> Phrases:
    found: list[Phrases] = []
    for lo, hi, spans, numbers in _portions(texts):
        long_enough = spans[:, 1] - spans[:, 0] >= LENGTH
        spans, numbers = spans[long_enough] - lo, numbers[long_enough]
        if not len(spans):
            continue
        data = texts.data[lo:hi]
        n = len(data)
        sums = FIRST.sums(data)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * FIRST.inverse[: n - GRAM + 1])
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # ties: the first
        best = _least(keys, LENGTH - GRAM + 1)  # by window
        edge = np.zeros(len(best) + 1, np.int8)
        edge[spans[:, 0]] += 1
        edge[spans[:, 1] - LENGTH + 1] -= 1
        valid = np.cumsum(edge[:-1]) > 0
        new = valid.copy()
        new[1:] &= (best[1:] != best[:-1]) | ~valid[:-1]
        new[spans[:, 0]] = True
        start = np.flatnonzero(new)
        own = np.searchsorted(spans[:, 0], start, "right") - 1
        stop = np.append(start[1:], len(best))
        count = np.minimum(stop, spans[own, 1] - LENGTH + 1) - start
        anchor = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        second = SECOND.sums(data)
        whole = (second[start + count - 1 + LENGTH] - second[start]) * SECOND.inverse[start]
        shape = ((anchor - start) * (LENGTH + 1) + count).astype(np.uint64)
        found.append(Phrases(numbers[own], start + lo, count, mix(grams[anchor] ^ _SPREAD), mix(whole ^ mix(shape))))
    if not found:
        return Phrases(*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    return Phrases(*(np.concatenate([getattr(p, f) for p in found]) for f in Phrases.__dataclass_fields__))


def _dump(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, 5)


def _load(body: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(body)


def _gaps(names: np.ndarray) -> np.ndarray:
    """Ascending names as differences, in four bytes where they fit."""
    d = np.diff(names, prepend=np.uint64(0))
    return d.astype(np.uint32) if len(d) and d[1:].max(initial=0) < 1 << 32 and d[0] < 1 << 32 else d


def _names(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.uint64))


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    at, sender, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(at, pa.int64()), pa.array(sender, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=["at", "sender", "kind", "body"])


def _cut(names: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the ranges of ascending names that hold any."""
    if not len(names):
        return []
    bucket = ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(names)], strict=True))


def _first_of_each(order_by: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order: index of a holder in the least document, that document,
    and each row's key number."""
    order = np.lexsort([doc, *order_by[::-1]])
    new = np.zeros(len(order), bool)
    for key in order_by:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    edges = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[edges], doc[order[edges]], number


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... start[k] + count[k] - 1 for every k."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


#: Names are compared by their upper 48 bits in the first round.
_COARSE = np.uint64(16)


def _ids(shard: pa.Table) -> np.ndarray:
    return shard.column("doc_id").fill_null(-(1 << 63)).to_numpy()


class Shard:
    """A shard's phrases that other documents may share, the distinct ones in order, and the
    answers so far."""

    def __init__(self, shard: pa.Table, mail: pa.Table) -> None:
        self.texts = texts_of(shard.column("text"))
        self.ids = _ids(shard)
        self.mail: dict[int, dict[int, bytes]] = {k: {} for k in range(4)}
        for sender, kind, body in _opened(mail):
            self.mail[kind][sender] = body
        parts = [_names(*_load(body)) for body in self.mail[ANCHORS].values()]
        shared = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        found = phrases(self.texts)
        coarse = found.anchor >> _COARSE
        at = np.searchsorted(shared, coarse)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == coarse[hit]
        self.phrases = found[hit]
        self.doc = self.ids[self.phrases.text]
        self.holder, self.least, self.number = _first_of_each([self.phrases.anchor, self.phrases.name], self.doc)

    def answers(self, kind: int, n: int) -> list[np.ndarray]:
        """The buckets' answers about n names, in the order in which they were asked."""
        parts = [_load(self.mail[kind][k]) for k in sorted(self.mail[kind])]
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, bool)] * 3
        if any(len(x) != n for x in whole[:1]):
            raise ValueError("a bucket's answer does not fit what was asked")
        return whole

    def sort_out(self) -> None:
        """From the second round: which phrases came before, and which need their windows ranked
        (by their bytes, or by names where the anchor is hot)."""
        self.first, several, hot = self.answers(PHRASES, len(self.holder))
        self.by_bytes, self.by_names = self.first & several & ~hot, self.first & several & hot
        self.in_least = self.doc == self.least[self.number]

    def held(self) -> Phrases:
        """The phrases sent as bytes, one holder each."""
        return self.phrases[self.holder[self.by_bytes]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and documents of the windows that are sent as names."""
        which = self.by_names[self.number] & self.in_least
        p = self.phrases[which]
        return _runs(p.start, p.count), np.repeat(self.doc[which], p.count)

    def covered(self) -> np.ndarray:
        """Which bytes of the shard's texts go."""
        self.sort_out()
        depth = np.zeros(len(self.texts.data) + 1, np.int32)
        p = self.phrases[~self.first[self.number] | ~self.in_least]
        np.add.at(depth, p.start, 1)
        np.add.at(depth, p.start + p.count - 1 + LENGTH, -1)
        gone = []
        if self.by_bytes.any():
            counts = self.held().count
            (first,) = self.answers(BYTES, int(counts.sum()))[:1]
            begin = np.zeros(len(self.holder), np.int64)
            begin[self.by_bytes] = np.cumsum(counts) - counts
            which = self.by_bytes[self.number] & self.in_least
            p = self.phrases[which]
            at = _runs(p.start, p.count)
            gone.append(at[~first[_runs(begin[self.number[which]], p.count)]])
        if self.by_names.any():
            at, doc = self.windows()
            _, least, number = _first_of_each(list(window_names(self.texts.data, at)), doc)
            (first,) = self.answers(WINDOWS, len(least))[:1]
            gone.append(at[~first[number] | (doc > least[number])])
        for at in gone:
            np.add.at(depth, at, 1)
            np.add.at(depth, at + LENGTH, -1)
        np.cumsum(depth, out=depth)
        return depth[:-1] > 0


def window_names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return FIRST.windows(data, at, LENGTH), SECOND.windows(data, at, LENGTH)


def _windows_of(data: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all windows of phrases that lie one after another in data."""
    sizes = counts + LENGTH - 1
    upto = np.concatenate([[0], np.cumsum(sizes)])
    parts = []
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PORTION, "right")) - 1)
        part = data[upto[i] : upto[j]]
        at = _runs(upto[i:j] - upto[i], counts[i:j])
        sums = [(r, r.sums(part)) for r in (FIRST, SECOND)]
        parts.append([mix((x[at + LENGTH] - x[at]) * r.inverse[at]) for r, x in sums])
        i = j
    one, two = zip(*parts, strict=True) if parts else ([np.empty(0, np.uint64)],) * 2
    return np.concatenate(one), np.concatenate(two)


def _ask_anchors(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(shard: pa.Table) -> pa.Table:
        found = phrases(texts_of(shard.column("text")))
        coarse, doc = found.anchor >> _COARSE, _ids(shard)[found.text]
        holder, least, number = _first_of_each([coarse], doc)
        several = np.zeros(len(holder), bool)
        several[number[doc > least[number]]] = True
        names, me = coarse[holder], shard.column("shard")[0].as_py()
        return _messages([(b, me, ANCHORS, _dump(_gaps(names[i:j]), np.packbits(several[i:j]))) for b, i, j in _cut(names << _COARSE, buckets)])

    return ask


def _tell_anchors(mail: pa.Table) -> pa.Table:
    """For each shard, which of its anchors other documents have too."""
    senders, parts, several = [], [], []
    bucket = mail.column("at")[0].as_py()
    for row in mail.to_pylist():
        gaps, bits = _load(row["body"])
        senders.append(row["sender"])
        parts.append(_names(gaps))
        several.append(np.unpackbits(bits, count=len(gaps)).astype(bool))
    names = np.concatenate(parts)
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    shared = np.zeros(len(names), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared |= np.concatenate(several)
    rows, a = [], 0
    for sender, part in zip(senders, parts, strict=True):
        if len(own := part[shared[a : a + len(part)]]):
            rows.append((sender, bucket, ANCHORS, _dump(_gaps(own))))
        a += len(part)
    return _messages(rows)


def _ask_phrases(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(shard: pa.Table, mail: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return _messages([])
        me, own = shard.column("shard")[0].as_py(), Shard(shard, mail)
        anchor, name = own.phrases.anchor[own.holder], own.phrases.name[own.holder]
        rows = [(b, me, PHRASES, _dump(anchor[i:j], name[i:j], own.least[i:j])) for b, i, j in _cut(anchor, buckets)]
        return _messages(rows + _kept(me, mail))

    return ask


def _ask_windows(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(shard: pa.Table, mail: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return _messages([])
        me, own = shard.column("shard")[0].as_py(), Shard(shard, mail)
        own.sort_out()
        rows, p, least = _kept(me, mail), own.held(), own.least[own.by_bytes]
        for b, i, j in _cut(p.anchor, buckets):
            held = own.texts.data[_runs(p.start[i:j], p.count[i:j] + LENGTH - 1)]
            rows.append((b, me, BYTES, _dump(held, p.count[i:j].astype(np.int32), least[i:j])))
        if own.by_names.any():
            at, doc = own.windows()
            one, two = window_names(own.texts.data, at)
            holder, least, _ = _first_of_each([one, two], doc)
            rows += [(b, me, WINDOWS, _dump(one[holder][i:j], two[holder][i:j], least[i:j])) for b, i, j in _cut(one[holder], buckets)]
        return _messages(rows)

    return ask


def _opened(mail: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(sender, kind, body) of a shard's mail, what it kept included."""
    for row in mail.to_pylist():
        if row["kind"] == KEPT:
            yield from _load(row["body"])
        else:
            yield row["sender"], row["kind"], row["body"]


def _kept(me: int, mail: pa.Table) -> list[tuple[int, int, int, bytes]]:
    """A shard's mail as one message to itself, for the next round."""
    return [(-1 - me, me, KEPT, pickle.dumps(list(_opened(mail)), 5))]


def _rank_phrases(asked: list[dict]) -> Iterator[bytes]:
    """For each name a shard asked about: is its least document the least of all, does its anchor
    have other phrases, does it have very many?"""
    parts = [_load(r["body"]) for r in asked]
    anchor, name, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    holder, least, number = _first_of_each([anchor, name], doc)
    _, kinds, n = np.unique(anchor[holder], return_inverse=True, return_counts=True)
    first, several, hot = doc == least[number], (n > 1)[kinds][number], (n > HOT_PHRASES)[kinds][number]
    ends = np.cumsum([len(p[0]) for p in parts]).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        yield _dump(first[a:b], several[a:b], hot[a:b])


def _rank_windows(asked: list[dict]) -> Iterator[bytes]:
    """For each window a shard asked about: is its least document the least of all?"""
    names, docs = [], []
    for row in asked:
        one, two, doc = _load(row["body"])
        if row["kind"] == BYTES:
            counts = two.astype(np.int64)
            one, two = _windows_of(one, counts)
            doc = np.repeat(doc, counts)
        names.append((one, two))
        docs.append(doc)
    _, least, number = _first_of_each([np.concatenate(x) for x in zip(*names, strict=True)], np.concatenate(docs))
    first = np.concatenate(docs) == least[number]
    ends = np.cumsum([len(d) for d in docs]).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        yield _dump(first[a:b])


def _tell(mail: pa.Table) -> pa.Table:
    """Answers of a bucket; kept messages go back to their shard."""
    held = mail.to_pylist()
    rows = [(-1 - r["at"], r["sender"], r["kind"], r["body"]) for r in held if r["at"] < 0]
    for kind, rank in ((PHRASES, _rank_phrases), (BYTES, _rank_windows), (WINDOWS, _rank_windows)):
        if asked := [r for r in held if r["at"] >= 0 and r["kind"] == kind]:
            rows += [(r["sender"], r["at"], kind, body) for r, body in zip(asked, rank(asked), strict=True)]
    return _messages(rows)


def _removal(docs: DataFrame, finish: Callable[[pa.Table, Texts, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """docs (doc_id, text, ...) in shards; finish gets a shard, its texts and which bytes go."""
    spark = docs.sparkSession
    bound_batches(spark)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(partitions(spark), -(-n_bytes // SHARD_BYTES))
    n_buckets = max(8, -(-2 * n_bytes // ((LENGTH - GRAM + 2) * BUCKET_NAMES)))
    shards = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)))

    def end(shard: pa.Table, mail: pa.Table) -> pa.Table:
        own = Shard(shard, mail) if shard.num_rows else None
        return finish(shard, own.texts if own else texts_of(pa.array([], pa.string())), own.covered() if own else np.empty(0, bool))

    def alone(table: DataFrame, key: str, do: Callable[[pa.Table], pa.Table]) -> DataFrame:
        def run(group: pa.Table) -> pa.Table:
            with released():
                return do(group)

        return table.groupBy(key).applyInArrow(run, MESSAGE)

    def bucketed(mail: DataFrame, tell: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return alone(mail, "at", tell)

    def to_shards(mail: DataFrame, do: Callable[[pa.Table, pa.Table], pa.Table], out: str) -> DataFrame:
        def run(shard: pa.Table, mail: pa.Table) -> pa.Table:
            with released():
                return do(shard, mail)

        return shards.groupBy("shard").cogroup(mail.withColumnRenamed("at", "shard").groupBy("shard")).applyInArrow(run, out)

    anchors = bucketed(alone(shards, "shard", _ask_anchors(n_buckets)), _tell_anchors)
    known = bucketed(to_shards(anchors, _ask_phrases(n_buckets), MESSAGE), _tell)
    windows = bucketed(to_shards(known, _ask_windows(n_buckets), MESSAGE), _tell)
    return to_shards(windows, end, schema)


def _spans(gone: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs; no run goes over the end of a text."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[starts] = True
    begins = gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))
    stops = gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def repeat_digests(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with spans also the removed
    byte ranges (array of struct start, end)."""

    def finish(shard: pa.Table, texts: Texts, gone: np.ndarray) -> pa.Table:
        starts = texts.starts
        begins, stops = _spans(gone, starts)
        upto = np.searchsorted(begins, starts)
        removed = np.concatenate([[0], np.cumsum(gone)])[starts] if len(gone) else np.zeros(len(starts), np.int64)
        kept = [texts.data[a:b][~gone[a:b]].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        columns = [shard.column("doc_id"), pa.array(np.diff(starts)), pa.array(np.diff(removed)), pa.array(np.diff(upto), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if spans:
            own = starts[np.searchsorted(starts, begins, "right") - 1] if len(begins) else begins
            pairs = pa.StructArray.from_arrays([pa.array(begins - own, pa.int64()), pa.array(stops - own, pa.int64())], names=["start", "end"])
            columns, names = [*columns, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pairs)], [*names, "spans"]
        return pa.table(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start: long, end: long>>" if spans else "")
    return _removal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), finish, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character that is cut in two goes whole.
    Every row and every other column stays."""
    names = docs.columns
    others = F.struct(*(n for n in names if n != "text"))  # a text that is sent twice is held twice
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), others.alias("_row"))

    def finish(shard: pa.Table, texts: Texts, gone: np.ndarray) -> pa.Table:
        at = zip(texts.starts[:-1].tolist(), texts.starts[1:].tolist(), strict=True)
        kept = [texts.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in at]
        rows = shard.column("_row")
        return pa.table([rows, pa.array(kept, pa.string())], names=["_row", "_kept"])

    found = _removal(inner, finish, f"_row {inner.schema['_row'].dataType.simpleString()}, _kept string")
    return found.select(*(F.col("_kept").alias("text") if n == "text" else F.col("_row")[n].alias(n) for n in names))
