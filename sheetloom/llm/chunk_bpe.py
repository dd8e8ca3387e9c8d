"""Byte-level BPE with content-defined chunks that are encoded once (operator 8).

A rolling hash over 16 bytes cuts texts where its content says so, so documents that share a
passage share its chunks. A chunk's *interior*, from its first to its last certain pre-token cut,
has the same ids wherever the chunk stands; a worker encodes it once and looks it up afterwards.
What lies between two interiors holds the chunk join; it is encoded again as one string, over as
many chunks as it takes until certain cuts bound it on both sides. Then it is checked: the join and
the pieces next to it in both interiors, encoded together as one string, must have the same ids as
apart. Where they do not agree, the whole text is encoded anew.

A cut is certain before a single space that stands between visible characters (the space starts
the next pre-token whatever follows, and no earlier one can hold it), and between a letter or digit
and punctuation that follows it. Characters here are printable ASCII and U+00C0..U+00FF; elsewhere
there is just no certain cut.

Chunks are shared within a Python worker (every task that it runs), not over the cluster: texts
would have to be dealt out by chunk and ids brought back, more bytes than encoding reads.

Defined cases: null text is empty and has no ids; an empty table gives no rows; repeated rows come
back once each; a text without certain cuts is encoded as one string; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import Texts, bound_batches, id_and_text, ragged, texts_of
from .wordpieces import KINDS, PieceIds, ends_letter, piece_ids

#: A chunk ends where this many bits of the rolling hash are zero: 1024 bytes on average.
CUT_BITS = 10
WINDOW = 16
#: Bytes of chunk ids kept by one worker.
KEPT_BYTES = 24 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHUNKS: dict[str, ChunkIds] = {}
_SPELT: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A hash of data[i:i + WINDOW] for every i with a whole window."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    h ^= h >> np.uint64(29)
    step, factor = 1, _MULTIPLIER
    while step < WINDOW:
        h = h[: len(h) - step] * factor + h[step:]
        factor, step = factor * factor, 2 * step
    return h


def chunk_ends(texts: Texts) -> np.ndarray:
    """Ends of all chunks, ascending; every text's end is one (an empty text has no chunk)."""
    data, starts = texts.data, texts.starts
    ends = np.unique(starts[1:][np.diff(starts) > 0])
    if len(data) < WINDOW:
        return ends
    with np.errstate(over="ignore"):
        cuts = np.flatnonzero(rolling_hash(data) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    cuts = cuts[cuts < len(data)]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]  # not inside a character
    own = starts[np.searchsorted(starts, cuts, "right") - 1]
    return np.union1d(ends, cuts[cuts - own >= WINDOW])  # the window lies in one text


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Positions where a pre-token ends in any context: before a single space that stands between
    visible characters, and between a letter or digit and plain punctuation after it."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    visible = (data > 0x20) & (data < 0x7F)
    ends = visible.copy()
    ends[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 0x20) & ends[:-2] & (visible[2:] | (data[2:] == 0xC3))
    cut[1:] |= ends_letter(data)[:-1] & (KINDS[data[1:]] == 2)
    return np.flatnonzero(cut)


class ChunkIds:
    """Encodes texts chunk by chunk; remembers the interiors of chunks."""

    def __init__(self, path: str) -> None:
        self.pieces: PieceIds = piece_ids(path)
        self.known: dict[bytes, np.ndarray] = {}
        self.n_bytes = 0

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        data, starts = texts.data, texts.starts
        whole = data.tobytes()
        ends = chunk_ends(texts)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        cuts = certain_cuts(data)
        # a cut needs both neighbours in its own text; chunks look at the cuts strictly inside them
        first = np.searchsorted(cuts, begins, "right")
        last = np.searchsorted(cuts, ends - 1, "left") - 1
        inner = first < last
        head = cuts[np.minimum(first, len(cuts) - 1)] if len(cuts) else first
        tail = cuts[np.maximum(last, 0)] if len(cuts) else last

        # Spans in order: joins are encoded each time, interiors through the memory of chunks.
        spans: list[tuple[int, int, bytes | None]] = []
        new: dict[bytes, tuple[int, int]] = {}
        stops = set(starts.tolist())
        at = 0
        for b, e, has, h, t in zip(begins.tolist(), ends.tolist(), inner.tolist(), head.tolist(), tail.tolist(), strict=True):
            if has:
                key = xxhash.xxh3_128_digest(whole[h:t])
                if key not in self.known and key not in new:
                    new[key] = (h, t)
                if at < h:
                    spans.append((at, h, None))
                spans.append((h, t, key))
                at = t
            if e in stops:
                if at < e:
                    spans.append((at, e, None))
                at = e
        self._learn(whole, cuts, new)
        joins, wrong = self._joins(whole, starts, cuts, [(a, b) for a, b, key in spans if key is None])
        if wrong:
            spans, joins = self._whole(whole, starts, spans, joins, wrong)
        parts, counts, j = [], np.empty(len(spans), np.int64), 0
        for k, (_, _, key) in enumerate(spans):
            if key is None:
                part = joins[j]
                j += 1
            else:
                part = self.known[key]
            parts.append(part)
            counts[k] = len(part)
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(counts)])
        span_starts = np.array([s[0] for s in spans], np.int64)
        per_text = np.diff(before[np.searchsorted(span_starts, starts)])
        if self.n_bytes > KEPT_BYTES:
            self.known, self.n_bytes = {}, 0
        return ids, per_text

    def _joins(self, whole: bytes, starts: np.ndarray, cuts: np.ndarray, spans: list[tuple[int, int]]) -> tuple[list[np.ndarray], set[int]]:
        """Ids of every join, and the texts in which some join does not agree with its neighbours."""
        if not spans:
            return [], set()
        a, b = np.array(spans, np.int64).T
        # the pieces next to a join are in its text: interiors have a cut at each end
        first, last = np.isin(a, starts), np.isin(b, starts)
        left = np.where(first, a, cuts[np.maximum(np.searchsorted(cuts, a) - 1, 0)]) if len(cuts) else a
        right = np.where(last, b, cuts[np.minimum(np.searchsorted(cuts, b) + 1, len(cuts) - 1)]) if len(cuts) else b
        right = np.where(last, b, np.maximum(right, b))
        apart = [whole[x:y] for row in zip(left.tolist(), a.tolist(), b.tolist(), right.tolist(), strict=True) for x, y in zip(row, row[1:], strict=False)]
        ids, counts = self.pieces.encode(apart)
        upto = np.concatenate([[0], np.cumsum(counts)])
        check = np.flatnonzero((left < a) | (right > b))
        together, sizes = self.pieces.encode_once([whole[x:y] for x, y in zip(left[check].tolist(), right[check].tolist(), strict=True)])
        ends = np.cumsum(sizes).tolist()
        wrong = set()
        for k, x, y in zip(check.tolist(), [0, *ends], ends, strict=False):
            if not np.array_equal(together[x:y], ids[upto[3 * k] : upto[3 * k + 3]]):
                wrong.add(int(np.searchsorted(starts, a[k], "right")) - 1)
        return [ids[upto[k] : upto[k + 1]] for k in range(1, len(apart), 3)], wrong

    def _whole(self, whole: bytes, starts: np.ndarray, spans: list[tuple[int, int, bytes | None]], joins: list[np.ndarray], wrong: set[int]) -> tuple[list[tuple[int, int, bytes | None]], list[np.ndarray]]:
        """spans and joins with one span for each text of ``wrong``, encoded anew."""
        new_spans, new_joins, given, done = [], [], iter(joins), set()
        for a, b, key in spans:
            ids = next(given) if key is None else None
            text = int(np.searchsorted(starts, a, "right")) - 1
            if text not in wrong:
                new_spans.append((a, b, key))
                new_joins += [ids] if key is None else []
            elif text not in done:
                done.add(text)
                lo, hi = int(starts[text]), int(starts[text + 1])
                new_spans.append((lo, hi, None))
                new_joins.append(self.pieces.encode_once([whole[lo:hi]])[0])
        return new_spans, new_joins

    def _learn(self, whole: bytes, cuts: np.ndarray, new: dict[bytes, tuple[int, int]]) -> None:
        """Encode new interiors, piece by piece between certain cuts."""
        if not new:
            return
        pieces: list[bytes] = []
        upto = [0]
        for h, t in new.values():
            at = [*cuts[np.searchsorted(cuts, h) : np.searchsorted(cuts, t)].tolist(), t]
            pieces += [whole[a:b] for a, b in zip(at, at[1:], strict=False)]
            upto.append(len(pieces))
        ids, counts = self.pieces.encode(pieces)
        before = np.concatenate([[0], np.cumsum(counts)])[upto]
        for key, a, b in zip(new, before.tolist(), before[1:].tolist(), strict=False):
            self.known[key] = ids[a:b].astype(np.uint32)
            self.n_bytes += 4 * (b - a) + 150


def chunk_ids(path: str) -> ChunkIds:
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkIds(path)
    return _CHUNKS[path]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where
    it is visible Latin-1, else the next one from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def spellings(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each id: all one after another, starts, lengths."""
    if path not in _SPELT:
        tokenizer = piece_ids(path).tokenizer
        alphabet = byte_alphabet()
        added = {k: t.content for k, t in tokenizer.get_added_tokens_decoder().items()}
        spelt = []
        for k in range(tokenizer.get_vocab_size()):
            token = added[k] if k in added else tokenizer.id_to_token(k)
            whole = k not in added and all(c in alphabet for c in token)
            spelt.append(bytes(alphabet[c] for c in token) if whole else token.encode())
        lengths = np.array(list(map(len, spelt)), np.int64)
        _SPELT[path] = (np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _SPELT[path]


def decode(ids: np.ndarray, counts: np.ndarray, path: str) -> list[str]:
    """Texts of ids, bytes that are not UTF-8 replaced as the library does."""
    pool, starts, lengths = spellings(path)
    data = ragged(pool, starts[ids], lengths[ids]).tobytes()
    before = np.concatenate([[0], np.cumsum(lengths[ids])])
    at = before[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encode_decode(docs: DataFrame, tokenizer_path: str, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids (binary,
    little-endian unsigned 32-bit) and decoded."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = chunk_ids(tokenizer_path).encode(texts_of(batch.column("text")))
            held = memoryview(ids.astype("<u4")).cast("B")
            at = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            parts = [held[a:b] for a, b in zip(at, at[1:], strict=False)]
            decoded = decode(ids, counts, tokenizer_path)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([bytes(p) for p in parts], pa.binary()), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names=names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else ""))
