"""Document fingerprints from invertible Bloom lookup sketches (operator 9).

A text is a set of paragraph digests (a repeated paragraph has a digest for each time). A sketch
of m cells adds each digest to three cells: a count, a sum of digests and a sum of check values, all
of fixed width, so that they wrap. Sketches of two versions subtract cell by cell, which leaves the
digests that differ; *peeling* takes a cell that holds one digest, notes it, and removes it from its
other cells until nothing is left. The fingerprint is the sketch of CELLS cells, whole: likeness is
told by subtracting and peeling two fingerprints. Where cells stay, they were too small, and both
texts' sketches of GROWTH times the cells are tried, and so on. Likeness is the share of digests
that two texts have in common: shared / (shared + differing), with the texts' digest counts, which
the fingerprints hold too.

A paragraph ends with a line or sentence, and wherever a rolling hash of the last bytes says so: often
near the text's beginning, seldom further on (ZONES), and at latest a zone's longest piece behind
another end. The rule is the same for any text. So an edit changes the paragraphs around it, short
texts have paragraphs to compare, and a long line is no single one.

Many pairs are peeled at once: the cells of many pairs lie in one array.

Defined cases: null text is empty, an empty text has no digests, two texts without digests are
alike (1.0); equal texts have equal fingerprints; one document alone is its own next one; equal
doc_ids are ordered by a hash of their texts, null doc_ids come first; repeated rows come back once
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, materialize, partitions
from .repeated_passages import Rolling, mix

#: Cells of the fingerprint itself, hash functions, and growth where peeling fails.
CELLS, HASHES, GROWTH = 9, 3, 8
#: Up to this byte of a text, one place in so many is a paragraph's end, and a paragraph has at most so many bytes.
ZONES = ((16, 2, 2), (64, 4, 6), (512, 16, 32), (1 << 62, 64, 256))
#: A cell as it is written.
CELL = np.dtype([("n", "<i2"), ("k", "<u8"), ("c", "<u4")])
#: Bytes and cells looked at together.
_PORTION, _TOGETHER = 1 << 18, 1 << 20
_ROLL = 6
_FACTORS = [np.uint32(pow(0x01000193, k + 1, 1 << 32)) for k in range(_ROLL)]
_NEAR = max(z for z, _, _ in ZONES[:-1])
#: By byte, up to the last zone: the bits of the rolling hash that are zero at an end.
_MASKS = np.concatenate([np.full(b - a, one_in - 1, np.uint32) for a, (b, one_in, _) in zip([0, *(z[0] for z in ZONES)], ZONES[:-1], strict=False)])
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_STOP, _BLANK = (np.isin(np.arange(256), list(c)) for c in (b".!?", b" \t\r\n"))
_PIECES = Rolling(9, 0x8F1BBCDCCA62C1D7)


def ends_of(data: np.ndarray) -> np.ndarray:
    """Where paragraphs end, the text's end included, ascending."""
    found = []
    for a in range(0, len(data), _PORTION):
        lead = min(a, _ROLL)  # bytes before the portion that its first hashes need
        part = data[a - lead : a + _PORTION + 1]
        wide = part.astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for k in range(min(_ROLL, len(part))):
            h[k:] += wide[: len(part) - k] * _FACTORS[k]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
        masks = np.full(len(part), ZONES[-1][1] - 1, np.uint32)
        near = max(0, min(len(part), _NEAR - (a - lead)))
        masks[:near] = _MASKS[a - lead : a - lead + near]
        end = (h & masks) == 0
        blank = _BLANK[part]
        line = blank.copy()  # white space that a line or sentence end is in, before what follows it
        line[1:] &= _STOP[part[:-1]] | (part[1:] == 0x0A)
        line[:-1] &= ~blank[1:]
        end |= line & (np.arange(len(part)) > 0)
        stop = min(len(part), lead + _PORTION)
        found.append(np.flatnonzero(end[lead:stop]) + a + 1)
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.unique(np.append(np.concatenate(found), len(data)))
    begins = np.concatenate([[0], ends[:-1]])
    longest = np.array([z[2] for z in ZONES])[np.searchsorted([z[0] for z in ZONES], begins, "right")]
    if (far := np.flatnonzero(ends - begins > longest)).size:
        ends = np.sort(np.concatenate([ends, *(_forced(begins[k], ends[k]) for k in far.tolist())]))
    return ends


def _forced(begin: int, end: int) -> np.ndarray:
    """Ends inside a paragraph that has none of its own, each zone's longest piece apart."""
    found = []
    for below, _, longest in ZONES:
        n = max(0, min(-(-(below - begin) // longest), -(-(end - begin) // longest) - 1))
        found.append(begin + longest * np.arange(1, n + 1))
        begin += longest * n
    return np.concatenate(found)


def digests(text: str) -> np.ndarray:
    """One 64-bit digest per paragraph, from its bytes and how often it came before."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = ends_of(data)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keys, i = np.empty(len(ends), np.uint64), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + _PORTION, "right")))
        a, b = begins[i:j] - begins[i], ends[i:j] - begins[i]
        sums = _PIECES.sums(data[begins[i] : ends[j - 1]])
        keys[i:j] = mix(((sums[b] - sums[a]) * _PIECES.inverse[a]) ^ ((b - a).astype(np.uint64) * _SALTS[0]))
        i = j
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    if same.any():
        at = np.arange(len(keys))
        before = at - np.maximum.accumulate(np.where(same, 0, at))
        again = order[same]
        keys[again] = mix(keys[again] + before[same].astype(np.uint64) * _SALTS[2])
    return keys


def _salted(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = (keys ^ salt) * _SALTS[0]
    h ^= h >> np.uint64(32)
    h *= _SALTS[1]
    return h ^ (h >> np.uint64(29))


def _checks(keys: np.ndarray) -> np.ndarray:
    return _salted(keys, _SALTS[3]).astype(np.uint32)


def cells_of(keys: np.ndarray, m: int) -> list[np.ndarray]:
    """The cells of each key, one in each third of the sketch."""
    third = np.uint64(m // HASHES)
    return [(k * int(third) + (_salted(keys, _SALTS[k]) % third)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Sketches:
    """The cells of several sketches of m cells each, one after another: counts modulo 2**16, sums
    of digests modulo 2**64, sums of check values modulo 2**32."""

    m: int
    n: np.ndarray
    k: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray], m: int = CELLS) -> Sketches:
        empty = cls(m, np.zeros(len(sets) * m, np.int16), np.zeros(len(sets) * m, np.uint64), np.zeros(len(sets) * m, np.uint32))
        keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        empty.put(keys, np.ones(len(keys), np.int16), owner)
        return empty

    def put(self, keys: np.ndarray, signs: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Add keys (or take them away); returns the cells touched."""
        k, c = keys * signs.astype(np.uint64), _checks(keys) * signs.astype(np.uint32)
        touched = [owner * self.m + at for at in cells_of(keys, self.m)]
        for at in touched:
            np.add.at(self.n, at, signs)
            np.add.at(self.k, at, k)
            np.add.at(self.c, at, c)
        return np.concatenate(touched)

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches(self.m, self.n - other.n, self.k - other.k, self.c - other.c)

    def __getitem__(self, which: np.ndarray) -> Sketches:
        return Sketches(self.m, *(x.reshape(-1, self.m)[which].ravel() for x in (self.n, self.k, self.c)))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which sketches peel completely; the digests recovered from those, their signs and owners.
        The cells are used up."""
        look = np.arange(len(self.n))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            while len(look):
                look = look[(self.n[look] == 1) | (self.n[look] == -1)]
                sign = self.n[look]
                k = self.k[look] * sign.astype(np.uint64)
                pure = self.c[look] * sign.astype(np.uint32) == _checks(k)
                owner, k, sign = look[pure] // self.m, k[pure], sign[pure]
                if not len(k):
                    break
                order = np.lexsort((k, owner))
                owner, k, sign = owner[order], k[order], sign[order]
                new = np.ones(len(k), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (k[1:] != k[:-1])
                owner, k, sign = owner[new], k[new], sign[new]
                got.append((k, sign, owner))
                look = np.unique(self.put(k, -sign, owner))
        done = ~((self.n != 0) | (self.k != 0) | (self.c != 0)).reshape(-1, self.m).any(1)
        if not got:
            return done, np.empty(0, np.uint64), np.empty(0, np.int16), np.empty(0, np.int64)
        k, sign, owner = (np.concatenate(x) for x in zip(*got, strict=True))
        return done, k[done[owner]], sign[done[owner]], owner[done[owner]]


def written(sketches: Sketches, sizes: list[int]) -> list[str]:
    """Fingerprints: the number of digests, then the cells, as hex."""
    cells = np.empty(len(sketches.n), CELL)
    cells["n"], cells["k"], cells["c"] = sketches.n, sketches.k, sketches.c
    return [f"{size:08x}{row.tobytes().hex()}" for size, row in zip(sizes, cells.reshape(-1, sketches.m), strict=True)]


def read(fingerprints: list[str]) -> tuple[Sketches, list[int]]:
    """Sketches and numbers of digests of written fingerprints."""
    cells = np.frombuffer(b"".join(bytes.fromhex(f[8:]) for f in fingerprints), CELL)
    return Sketches(CELLS, cells["n"].copy(), cells["k"].copy(), cells["c"].copy()), [int(f[:8], 16) for f in fingerprints]


def fingerprint(keys: np.ndarray) -> str:
    return written(Sketches.of([keys]), [len(keys)])[0]


def differing(first: list[np.ndarray], second: list[np.ndarray], ours: Sketches | None = None, theirs: Sketches | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets: the digests of the first alone and of the second alone. ``ours``
    and ``theirs`` are the sets' fingerprints, if they are there already."""
    result: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 2 for _ in first]
    ours, theirs = ours or Sketches.of(first), theirs or Sketches.of(second)
    active, m = np.arange(len(first)), CELLS
    while len(active):
        failed = []
        step = max(1, _TOGETHER // m)
        for a in range(0, len(active), step):
            now = active[a : a + step]
            if m == CELLS:
                rest = ours[now] - theirs[now]
            else:
                rest = Sketches.of([first[i] for i in now], m) - Sketches.of([second[i] for i in now], m)
            done, k, sign, owner = rest.peel()
            order = np.argsort(owner, kind="stable")
            k, sign, owner = k[order], sign[order], owner[order]
            upto = np.searchsorted(owner, np.arange(len(now) + 1))
            for j in range(len(now)):
                own, s = k[upto[j] : upto[j + 1]], sign[upto[j] : upto[j + 1]]
                i = now[j]
                if done[j] and int(s.sum(dtype=np.int64)) == len(first[i]) - len(second[i]):
                    result[i] = (own[s > 0], own[s < 0])
                else:
                    failed.append(i)
        active = np.array(failed, np.int64)
        m *= GROWTH
    return result


def likeness(first: list[np.ndarray], second: list[np.ndarray], ours: Sketches | None = None, theirs: Sketches | None = None) -> list[float]:
    found = []
    for (x, y), a, b in zip(differing(first, second, ours, theirs), first, second, strict=True):
        d = len(x) + len(y)
        shared = (len(a) + len(b) - d) // 2
        found.append(shared / (shared + d) if shared + d else 1.0)
    return found


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of text replaced by as many characters of what follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(ids: list, texts: list[str], following: list[str], own: list[np.ndarray], after: list[np.ndarray]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    theirs = [digests(c) for c in changed]
    ours, new, behind = Sketches.of(own), Sketches.of(theirs), Sketches.of(after)
    return [
        pa.array(ids, pa.int64()),
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(c.encode()).digest() for c in changed], pa.binary()),
        pa.array(written(ours, list(map(len, own))), pa.string()),
        pa.array(written(new, list(map(len, theirs))), pa.string()),
        pa.array(likeness(own, theirs, ours, new), pa.float64()),
        pa.array(likeness(own, after, ours, behind), pa.float64()),
    ]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document, by ascending doc_id.

    Texts are dealt out by ranges of doc_id once. A task compares neighbours in its range; only
    the first and last document of each range are compared in a second, small step.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            values = [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text]), pa.array([doc_id], pa.int64())]
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.record_batch(values + [pa.nulls(1, k) for k in kinds], names=["kind", "part", "text", *_NAMES])

        held: tuple[int | None, str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            keys = [digests(t) for t in texts]
            if held is None:
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts, keys = [held[0], *ids], [held[1], *texts], [held[2], *keys]
            held = (ids[-1], texts[-1], keys[-1])
            if n := len(ids) - 1:
                found = _compare(ids[:-1], texts[:-1], texts[1:], keys[:-1], keys[1:])
                yield pa.record_batch([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string()), *found], names=["kind", "part", "text", *_NAMES])
        if held is not None:
            yield edge(2, held[0], held[1])

    def compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            own, after = [digests(t) for t in texts], [digests(t) for t in following]
            yield pa.record_batch(_compare(batch.column("doc_id").to_pylist(), texts, following, own, after), names=_NAMES)

    dealt = id_and_text(docs).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(compare, f"kind int, part int, text string, {_RESULT}"), "neighbours")
    heads = found.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    parts = sorted(r[0] for r in heads.select("next_part").collect())  # one for each range
    ring = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    edges = found.where("kind = 2").select("part", "doc_id", "text").join(ring, "part").join(heads, "next_part").select("doc_id", "text", "following")
    whole = found.where("kind = 0").select(*_NAMES).union(edges.mapInArrow(compare_edges, _RESULT))
    return whole.withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
