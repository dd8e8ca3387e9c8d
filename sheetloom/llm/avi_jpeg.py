"""Media columns: motion-JPEG in AVI, its index, its frames and its shots (operator 6).

Frames are 24 x 24 grey samples of 8 bits, coded by the lossless JPEG process (ITU-T T.81 Annex H:
SOF3, one component, predictor 1, Huffman-coded differences), so the samples come back exactly.
Baseline JPEG rounds its coefficients and would not. A file is RIFF "AVI " with an hdrl list (avih,
one vids/MJPG stream), a movi list of 00dc chunks and an idx1 index. Every frame is intra-coded.

Reading parses the RIFF chunks, takes the frames through idx1, decodes them and finds *shots*: a
cut lies before a frame whose histogram (16 levels) differs from the frame's before by more than
the mean plus two deviations of the differences of the last frames, and by a least share of the
samples. Shots are clips with a start and an end in seconds.

All frames of an Arrow batch are coded and decoded in step: bit positions of all codes come from
cumulative sums, and decoding walks one sample of every frame at a time, in arrays.

Defined cases: null text is empty; a payload is padded with bytes 255 to a positive multiple of the
frame size, so an empty text is one frame; equal texts give equal files; an empty table gives no
rows; repeated rows come back once each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Texts, bound_batches, id_and_text, texts_of

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
PAD = 255
#: Frames coded together; bounds memory for texts of any length.
PORTION = 4096
LEVELS, HISTORY, LEAST_CHANGE = 16, 8, 0.25

#: Code lengths of the difference categories 0..8 (bits of the difference), a complete prefix code
#: but for the all-ones word that T.81 reserves: differences of text bytes are mostly large.
CATEGORY_BITS = [4, 5, 5, 4, 3, 3, 2, 2, 5]


def _codes(lengths: list[int]) -> tuple[list[int], list[int]]:
    """Categories in order of their codes, and the codes (T.81 Annex C)."""
    order = sorted(range(len(lengths)), key=lambda k: (lengths[k], k))
    code, last, codes = 0, lengths[order[0]], []
    for k in order:
        code <<= lengths[k] - last
        last = lengths[k]
        codes.append(code)
        code += 1
    return order, codes


_ORDER, _IN_ORDER = _codes(CATEGORY_BITS)
CODE = np.zeros(9, np.uint64)
CODE[_ORDER] = _IN_ORDER
LENGTH = np.array(CATEGORY_BITS, np.int64)
_LONGEST = max(CATEGORY_BITS)
#: The category that the next _LONGEST bits begin with.
LOOK = np.full(1 << _LONGEST, 255, np.uint8)
for _k in range(9):
    _from = int(CODE[_k]) << (_LONGEST - CATEGORY_BITS[_k])
    LOOK[_from : _from + (1 << (_LONGEST - CATEGORY_BITS[_k]))] = _k


def _head() -> bytes:
    """What stands before the coded data of every frame."""
    counts = bytes(sum(n == bits for n in CATEGORY_BITS) for bits in range(1, 17))
    table = b"\x00" + counts + bytes(_ORDER)
    frame = struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    scan = bytes([1, 1, 0x00, 1, 0, 0])  # one component, table 0; predictor 1; no point transform
    return b"\xff\xd8" + b"".join(b"\xff" + m + struct.pack(">H", len(x) + 2) + x for m, x in ((b"\xc3", frame), (b"\xc4", table), (b"\xda", scan)))


HEAD, END = _head(), b"\xff\xd9"


def _differences(frames: np.ndarray) -> np.ndarray:
    """Samples less their predictions: 128 for the first, the one above for others that begin a
    line, the one to the left for the rest."""
    wide = frames.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = wide.copy()
    d[:, :, 1:] -= wide[:, :, :-1]
    d[:, 1:, 0] -= wide[:, :-1, 0]
    d[:, 0, 0] -= 128
    return d.reshape(-1, FRAME)


_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], np.uint8)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG images of frames (n, FRAME) of samples."""
    n = len(frames)
    d = _differences(frames).astype(np.int64)
    category = _CATEGORY[d + 255].astype(np.int64)
    extra = np.where(d < 0, d + (1 << category) - 1, d).astype(np.uint64)
    bits = LENGTH[category] + category
    word = (CODE[category] << category.astype(np.uint64)) | extra
    n_bytes = -(-bits.sum(1) // 8)
    base = np.cumsum(n_bytes) - n_bytes
    at = np.cumsum(bits, axis=1) - bits + 8 * base[:, None]  # first bit of each word
    total = int(n_bytes.sum())
    # A word has at most 13 bits and spans at most three bytes; words do not overlap, so adding is or-ing.
    flat, shift = at.ravel() >> 3, (24 - (at & 7) - bits).ravel().astype(np.uint64)
    spread = word.ravel() << shift
    out = np.zeros(total + 3, np.uint16)
    for k in range(3):
        out[: total + 3] += np.bincount(flat + k, weights=((spread >> np.uint64(16 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=total + 3).astype(np.uint16)
    coded = out[:total].astype(np.uint8)
    spare = 8 * n_bytes - bits.sum(1)  # the last byte is filled with ones
    coded[base + n_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    full = np.flatnonzero(coded == 0xFF)  # and 0 stuffed after every 255
    stuffed = np.insert(coded, full + 1, 0)
    ends = np.cumsum(n_bytes)
    ends = ends + np.searchsorted(full, ends, "left")
    data, cut = stuffed.tobytes(), [0, *ends.tolist()]
    return [HEAD + data[cut[k] : cut[k + 1]] + END for k in range(n)]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """Frames (n, FRAME) of samples from JPEG images."""
    for image in images:
        if image[: len(HEAD)] != HEAD or image[-2:] != END:
            raise ValueError("not an image of this profile")
    n = len(images)
    scans = [image[len(HEAD) : -2].replace(b"\xff\x00", b"\xff") for image in images]
    sizes = np.fromiter(map(len, scans), np.int64, n)
    data = np.frombuffer(b"".join(scans) + bytes(4), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = 8 * (np.cumsum(sizes) - sizes)
    limit = at + 8 * sizes
    d = np.empty((FRAME, n), np.int16)
    most = np.int64(len(window) - 1)
    for k in range(FRAME):
        bits = (window[np.minimum(at >> 3, most)] << (at & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)
        category = LOOK[bits >> np.uint32(32 - _LONGEST)].astype(np.int64)
        length = LENGTH[np.minimum(category, 8)]
        value = ((bits << length.astype(np.uint32)) >> (32 - np.maximum(category, 1)).astype(np.uint32)).astype(np.int64)
        low = value < (1 << np.maximum(category - 1, 0))
        d[k] = np.where(category == 0, 0, np.where(low, value - (1 << category) + 1, value))
        at += length + category
    if (at > limit).any():
        raise ValueError("an image ends within its coded data")
    lines = d.T.reshape(n, SIDE, SIDE).astype(np.int32)
    lines[:, 0, 0] += 128
    lines[:, :, 0] = np.cumsum(lines[:, :, 0], axis=1)
    return np.cumsum(lines, axis=2).astype(np.uint8).reshape(n, FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(images: list[bytes]) -> bytes:
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    at, index, chunks = 4, [], []
    for image in images:
        chunks.append(_chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> list[bytes]:
    """Images of the file's stream 0, in the order of its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    end, at, movi, index = 8 + struct.unpack_from("<I", data, 4)[0], 12, None, b""
    if end > len(data):
        raise ValueError("the file is cut off")
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no movi list")
    images = []
    for name, _, offset, n in struct.iter_unpack("<4sIII", index):
        if name == b"00dc":
            start = movi + offset
            if data[start : start + 8] != name + struct.pack("<I", n):
                raise ValueError("the index does not fit the movi list")
            images.append(data[start + 8 : start + 8 + n])
    return images


def histogram_changes(frames: np.ndarray) -> np.ndarray:
    """For each frame but the first, the share of samples that its histogram moves by."""
    n = len(frames)
    level = (frames >> 4).astype(np.int64) + LEVELS * np.arange(n)[:, None]
    counts = np.bincount(level.ravel(), minlength=LEVELS * n).reshape(n, LEVELS)
    return np.abs(np.diff(counts, axis=0)).sum(1) / (2 * FRAME)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot. The threshold adapts to the changes of
    up to HISTORY frames before."""
    change = histogram_changes(frames)
    upto = np.concatenate([[0.0], np.cumsum(change)])
    squares = np.concatenate([[0.0], np.cumsum(change**2)])
    k = np.arange(len(change))
    since = np.maximum(0, k - HISTORY)
    n = np.maximum(1, k - since)
    mean = (upto[k] - upto[since]) / n
    deviation = np.sqrt(np.maximum(0, (squares[k] - squares[since]) / n - mean**2))
    cuts = (np.flatnonzero((change > mean + 2 * deviation) & (change > LEAST_CHANGE)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(frames)], strict=True))


def payloads(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded to whole frames, as frames, and how many frames each has."""
    sizes = np.diff(texts.starts)
    n_frames = np.maximum(1, -(-sizes // FRAME))
    whole = np.full(int(n_frames.sum()) * FRAME, PAD, np.uint8)
    begins = (np.cumsum(n_frames) - n_frames) * FRAME
    whole[np.arange(len(texts.data)) + np.repeat(begins - texts.starts[:-1], sizes)] = texts.data
    return whole.reshape(-1, FRAME), n_frames


def _in_portions(n: int) -> Iterator[slice]:
    return (slice(a, min(n, a + PORTION)) for a in range(0, n, PORTION))


def encode_texts(texts: Texts) -> list[bytes]:
    """One AVI file per text."""
    frames, n_frames = payloads(texts)
    images = [image for part in _in_portions(len(frames)) for image in encode_frames(frames[part])]
    ends = np.cumsum(n_frames).tolist()
    return [write_avi(images[b - n : b]) for b, n in zip(ends, n_frames.tolist(), strict=True)]


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """Frames of each file."""
    each = [read_avi(f) for f in files]
    images = [image for own in each for image in own]
    parts = [decode_frames(images[part]) for part in _in_portions(len(images))]
    frames = np.concatenate(parts) if parts else np.empty((0, FRAME), np.uint8)
    return np.split(frames, np.cumsum([len(own) for own in each])[:-1]) if each else []


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, and media: its AVI file."""
    bound_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(texts.starts)), pa.array(encode_texts(texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of doc_id, media: doc_id, clip, start_frame, end_frame, start_s, end_s."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, a, b, a / FPS, b / FPS) for d, frames in zip(batch.column("doc_id").to_pylist(), decode_files(batch.column("media").to_pylist()), strict=True) for k, (a, b) in enumerate(shots(frames))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(cut, "doc_id long, clip int, start_frame long, end_frame long, start_s double, end_s double")


def media_digests(media: DataFrame) -> DataFrame:
    """Per file, from its bytes: digests of the payload read back, of the file, and its shots."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            rows = []
            for data, frames in zip(files, decode_files(files), strict=True):
                payload = frames.tobytes()
                found = shots(frames)
                feature = f"frames={len(frames)};shots={len(found)};cuts={','.join(str(a) for a, _ in found[1:])};mean={frames.mean():.3f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
