import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sheetloom.llm.chunk_bpe import chunk_ids, decode, encode_decode
from sheetloom.llm.common import texts_of
from sheetloom.llm.packing import pack, pack_documents, sequences, shortest_pack_first, token_pieces
from sheetloom.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, vocabulary
from sheetloom.llm.token_files import ShardReader, ShardWriter, read_token_files, write_token_files
from sheetloom.llm.wordpieces import encode_words

from .odd import documents, empty, prose, rows, texts

WORD, BYTE = vocabulary(WORD_TOKENIZER), vocabulary(BYTE_TOKENIZER)


def library(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def random_texts(n=150):
    rng = np.random.default_rng(3)
    letters = list("ab é\n \t'sd.1,<|!=") + [" ", "日", "<|endoftext|>", "😀", " the ", "̸", "É", "'LL", "ß", "×", "İ", "Σ", "́", "\x1c"]
    return ["".join(rng.choice(letters, rng.choice([0, 1, 5, 60, 2500]))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    tokenizer = Tokenizer.from_file(path)
    held = [t or "" for _, t in texts()] + random_texts()
    expected = [e.ids for e in tokenizer.encode_batch(held, add_special_tokens=False)]
    for part in (held, held[::-1]):  # the second time through what was remembered
        column = texts_of(pa.array(part))
        ids, counts = encode_words(column, path) if path == WORD else chunk_ids(path).encode(column)
        ends = np.cumsum(counts)
        found = [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
        assert found == (expected if part is held else expected[::-1])


def test_decoding_any_ids():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 50257, 40).tolist() for _ in range(200)]
    expected = Tokenizer.from_file(BYTE).decode_batch(ids, skip_special_tokens=False)
    assert decode(np.array(sum(ids, [])), np.array([40] * 200), BYTE) == expected


def test_encode_decode(spark):
    found = sorted(rows(encode_decode(documents(spark), BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), key=str)
    expected = []
    for d, t in texts():
        ids = library(BYTE, t or "")
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    kept = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in encode_decode(documents(spark), BYTE, keep=True).where("doc_id = 17").collect()}
    assert kept[17] == (library(BYTE, "Éé'S DON'T can't 1,2;3"), "Éé'S DON'T can't 1,2;3")
    assert encode_decode(empty(spark), BYTE).count() == 0


def test_token_files(spark):
    manifest = write_token_files(documents(spark), WORD, shards=3)
    found = rows(read_token_files(manifest), "start", "doc_id", "n_tokens", "ids_crc32")
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for d, t in order:
        ids = [*library(WORD, t or ""), 1]
        expected.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    starts = {}
    found.sort()
    for s, d, n, _ in found:
        assert s == start
        start += n
        starts.setdefault(d, []).append(s)
    assert sorted([f[1:] for f in found], key=str) == sorted(expected, key=str)
    assert [f[1] for f in found] == [d for d, _ in order]
    assert rows(read_token_files(write_token_files(empty(spark), WORD)), "doc_id") == []


def test_shards_are_read_in_place(tmp_path):
    ids = np.arange(300_000) % 49_000
    writer = ShardWriter(str(tmp_path / "s.arrow"), 2, 128)
    for part in np.array_split(ids, 37):
        writer.add(part)
    writer.close()
    reader = ShardReader(str(tmp_path / "s.arrow"))
    for at, n in ((0, 5), (127, 3), (8190, 20_000), (299_990, 10), (5, 0)):
        assert reader.ids(at, n).tolist() == ids[at : at + n].tolist()
    view, mask = reader.batch(reader.file.num_record_batches - 1)
    assert not view.flags.owndata and mask.null_count == 0
    total = sum(reader.batch(k)[1].to_numpy(zero_copy_only=False).sum() for k in range(reader.file.num_record_batches))
    assert total == len(ids)
    with pytest.raises(ValueError):
        reader.ids(299_990, 5000)


def check_packed(found, capacity=2048):
    by_sequence = {}
    for piece in found:
        by_sequence.setdefault(piece["sequence_id"], []).append((piece["offset"], piece["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing(spark):
    found = pack_documents(documents(spark), WORD).collect()
    check_packed(found)
    pieces = sorted(((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in found), key=str)
    expected = []
    for d, t in texts():
        ids = [*library(WORD, t or ""), 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            expected.append((d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert pieces == sorted(expected, key=str)
    assert pack_documents(empty(spark), WORD).count() == 0


def test_packed_sequences(spark):
    packed = pack_documents(documents(spark), WORD, capacity=100, with_ids=True)
    whole = sequences(packed).collect()
    total = token_pieces(documents(spark), WORD, capacity=100).groupBy().sum("length").first()[0]
    assert sum(len(s.ids) // 4 for s in whole) == total and max(len(s.ids) // 4 for s in whole) <= 100


def test_histogram_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 20_000)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    slots = shortest_pack_first(histogram)
    for length, count in histogram.items():
        own = sorted((a, b) for n, a, b, _, _ in slots if n == length)
        assert own[0][0] == 0 and own[-1][1] == count and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    placed = [{"sequence_id": s + k, "offset": o, "length": n} for n, a, b, s, o in slots for k in range(b - a)]
    n_sequences = len(check_packed(placed))
    assert lengths.sum() / (n_sequences * 2048) > 0.97
    with pytest.raises(ValueError):
        shortest_pack_first({0: 1})
    # one length that most pieces have, and ties
    df = spark.range(5000).selectExpr("id AS doc_id", "0L AS start", "IF(id % 3 = 0, 7L, 1000L) AS length", "0L AS ids_crc32")
    check_packed(pack(df).collect())


def test_joins_that_do_not_agree_are_encoded_anew(monkeypatch):
    """Cuts inside words, two a chunk: interiors alone would be wrong at both ends, the check sees it."""
    from tokenizers import Tokenizer

    from sheetloom.llm import chunk_bpe as C

    path = vocabulary(BYTE_TOKENIZER)
    held = C.texts_of(pa.array([prose(3000, 3), "short", "", prose(900, 4)]))
    ends = C.chunk_ends(held)
    wrong = [int(x) for b, e in zip([0, *ends], ends, strict=False) if e - b > 60 for x in (b + 17, e - 19) if held.data[x - 1] > 0x60 and held.data[x] > 0x60]
    assert len(wrong) > 4
    monkeypatch.setattr(C, "certain_cuts", lambda data: np.array(wrong))
    encoder = C.ChunkIds(path)
    anew, plain = [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda *a: anew.append(len(a[-1])) or plain(*a))
    ids, counts = encoder.encode(held)
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    assert ids.tolist() == [k for t in held for k in library.encode(t.decode(), add_special_tokens=False).ids] and len(counts) == 4
    assert anew


def test_words_are_held_by_portions():
    """Encoding a batch takes memory for its ids and one portion's words, not for all its words."""
    rng = np.random.default_rng(11)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(2000)]
    column = texts_of(pa.array([" ".join(rng.choice(words, 40_000)) for _ in range(32)]))
    expected = encode_words(texts_of(pa.array([t.decode() for t in column][:1])), WORD, 1)
    tracemalloc.start()
    ids, counts = encode_words(column, WORD, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids[: counts[0]].tolist() == expected[0].tolist() and counts.sum() == len(ids)
    assert peak - ids.nbytes - counts.nbytes < 10 * len(column.data), peak / len(column.data)
