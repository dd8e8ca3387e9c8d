import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sheetloom.llm import repeated_passages as R
from sheetloom.llm.common import texts_of
from sheetloom.llm.components import components
from sheetloom.llm.repeated_passages import repeat_digests, without_repeats
from sheetloom.llm.similar import alike, near_groups, shingle_set
from sheetloom.llm.simhash import hexadecimal, near_duplicates, one_of_each, simhash
from sheetloom.llm.vantage import grow, spanning_links

from .odd import documents, empty, prose, rows, texts


def plain_simhash(text, k=3):
    words = [w for w in bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()).translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash():
    for _, t in texts():
        if t is None or len(t) < 20_000:
            assert simhash((t or "").encode()) == plain_simhash(t or "")


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    found = dict(rows(components(df), "node", "component"))
    assert found == plain_components(links, {n for link in links for n in link})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(n, seed, bits=2):
    """Prints of which many lie close together."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)
    prints = np.repeat(centres, 10)
    for k in range(len(prints)):
        for b in rng.integers(0, 64, rng.integers(0, 2 * bits)):
            prints[k] ^= np.uint64(1 << int(b))
    return np.unique(prints)


def pairs(prints, bits):
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits)
    return {(int(prints[a]), int(prints[b])) for a, b in zip(i, j, strict=True) if a < b}


def test_leaves_hold_every_close_pair():
    prints = near(3000, 1)
    for sample in (prints[:50], prints, prints[:0]):
        tree = grow(sample, 2, 200 / len(prints))
        held = {}
        for leaf, at in tree.route(prints):
            held.setdefault(leaf, set()).update(prints[at].tolist())
        for a, b in pairs(prints, 2):
            assert any(a in own and b in own for own in held.values())
    assert tree.n_leaves == 1


def test_spanning_links_join_what_pairs_join():
    prints = near(2000, 2)
    a, b = spanning_links(prints, 2, block=64)
    nodes = prints.tolist()
    assert plain_components(zip(a.tolist(), b.tolist(), strict=True), nodes) == plain_components(pairs(prints, 2), nodes)


def test_near_duplicates(spark):
    held = texts()
    found = near_duplicates(documents(spark)).select("doc_id", hexadecimal("print").alias("f"), "component_id").collect()
    prints = [plain_simhash(t or "") if len(t or "") < 20_000 else simhash(t.encode()) for _, t in held]
    n = len(held)
    root = plain_components([(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(n))
    least = {}
    for k, (d, _) in enumerate(held):
        if d is not None:
            least[root[k]] = min(least.get(root[k], d), d)
    expected = sorted(((d, f"{p:016x}", least.get(root[k])) for k, ((d, _), p) in enumerate(zip(held, prints, strict=True))), key=str)
    assert sorted(map(tuple, found), key=str) == expected
    assert near_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_component(spark):
    df = documents(spark)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {r.component for r in near_duplicates(df).collect()}
    assert len(ids) == len(groups) and 0 in ids and 1 not in ids and (1 << 40) not in ids
    assert sum(d == 18 for d in ids) == 2  # the repeated row once, the other text of that id too
    assert one_of_each(empty(spark)).count() == 0


def brute(held, length=50):
    first, out = {}, []
    for d in sorted({x for x, _ in held}):
        own = [t for x, t in held if x == d]
        for t in own:
            cover = np.zeros(len(t), bool)
            for p in range(len(t) - length + 1):
                if first.get(t[p : p + length], d) < d:
                    cover[p : p + length] = True
            edge = np.diff(cover.astype(int), prepend=0, append=0)
            out.append((d, len(t), int(cover.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~cover].tobytes()).hexdigest()))
        for t in own:
            for p in range(len(t) - length + 1):
                first.setdefault(t[p : p + length], d)
    return sorted(out)


def digests(spark, held):
    df = documents(spark, held)
    return sorted(tuple(-(1 << 63) if x is None else x for x in r) for r in repeat_digests(df).collect())


def as_bytes(held):
    return [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in held]


def test_repeats(spark):
    assert digests(spark, texts()) == brute(as_bytes(texts()))
    assert repeat_digests(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_repeats_at_random(spark, seed, monkeypatch):
    """Passages of all lengths around the threshold, at all places, in texts of few letters."""
    if seed >= 2:
        monkeypatch.setattr(R, "HOT_PHRASES", 2)  # ranked by names of windows
    rng = np.random.default_rng(seed)
    letter = lambda n: "".join(rng.choice(list("ab é"), n))
    passages = [letter(n) for n in (49, 50, 51, 60, 90, 200)]
    held = []
    for d in range(40):
        parts = [letter(int(rng.integers(0, 70)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(0, len(passages)))]
            a = int(rng.integers(0, 12))
            parts += [p[a:], letter(int(rng.integers(0, 30)))]
        held.append((int(d // 2 * 3), "".join(parts)))
    held += [(500, "ab" * 400), (501, "ab" * 30), (502, "a" * 300), (503, "a" * 60)]
    assert digests(spark, held) == brute(as_bytes(held))


def test_long_texts_come_in_pieces(monkeypatch):
    import pyarrow as pa

    column = texts_of(pa.array([prose(900, 1), "", prose(40, 2), prose(2000, 3)]))
    whole = R.phrases(column)
    monkeypatch.setattr(R, "PORTION", 1000)
    parts = R.phrases(column)
    for p in (whole, parts):  # every window once
        at = np.sort(R._runs(p.start, p.count))
        assert at.tolist() == [q for a, b in zip(column.starts, column.starts[1:], strict=False) for q in range(a, b - R.LENGTH + 1)]


def test_texts_without_repeats(spark):
    df = documents(spark)
    found = without_repeats(df)
    assert found.columns == df.columns and found.count() == df.count()
    kept = {r.doc_id: r.text for r in found.collect() if r.doc_id not in (None, 18)}
    original = dict(texts())
    assert kept[0] == original[0] and kept[1] == "" and kept[9] != original[9] and prose(70, 99) not in kept[9] and kept[12] == original[12]
    (row,) = [r for r in repeat_digests(df, spans=True).collect() if r.doc_id == 1]
    assert [(s.start, s.end) for s in row.spans] == [(0, row.n_bytes)]


def test_similar_texts(spark):
    """Groups by fingerprints and by five-word similarity, against all pairs."""
    rng = np.random.default_rng(8)
    held = texts()
    for k in range(12):
        words = prose(260, 50 + k).split()
        for c in range(5):  # from one word to a tenth of them changed
            own = list(words)
            for at in rng.choice(len(own), [0, 2, 5, 9, 26][c], replace=False):
                own[at] = f"w{rng.integers(1000)}"
            held.append((100 + 10 * k + c, " ".join(own)))
    n = len(held)
    data = [(t or "").encode() for _, t in held]
    sets, prints = [set(shingle_set(t).tolist()) for t in data], [simhash(t) for t in data]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 or jaccard(sets[i], sets[j]) >= 0.8]
    expected = plain_components(links, range(n))
    ours = {}
    for r in near_groups(documents(spark, held)).collect():
        ours.setdefault(r.component, []).append(str(r.doc_id))
    theirs = {}
    for k, (d, _) in enumerate(held):
        theirs.setdefault(expected[k], []).append(str(d))
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_blocks_of_a_large_group_meet(spark, monkeypatch):
    from sheetloom.llm import similar

    words = prose(400, 77).split()
    held = [(k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(40)]
    for block in (1000, 7):
        monkeypatch.setattr(similar, "BLOCK", block)
        assert len({r.component for r in near_groups(documents(spark, held)).collect()}) == 1
    assert near_groups(empty(spark)).count() == 0


def test_very_many_near_copies(spark):
    """A text with 20,000 near copies is one group, whose size no task feels; others stay apart."""
    words = prose(120, 78).split()
    held = [(k, " ".join([*words[: k % 119], f"x{k}", *words[k % 119 + 1 :]])) for k in range(20_000)]
    held += [(30_000 + k, prose(100, 500 + k)) for k in range(50)]
    found = {}
    for r in near_groups(spark.createDataFrame(held, "doc_id long, text string").repartition(8)).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(len, found.values())) == [1] * 50 + [20_000]


def test_alike_is_all_pairs_across_components():
    rng = np.random.default_rng(3)
    for n, known in ((5, None), (30, None), (30, np.arange(30) // 10)):
        base = np.sort(rng.choice(1 << 40, 200, replace=False).astype(np.uint64))
        sets = [np.unique(np.where(rng.random(200) < 0.03 * (k % 7), rng.integers(0, 1 << 40, 200).astype(np.uint64), base)) for k in range(n)]
        same = [] if known is None else [(i, j) for i in range(n) for j in range(i) if known[i] == known[j]]
        plain = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert plain_components(same + alike(sets, 0.8, known), range(n)) == plain_components(same + plain, range(n))


def test_passages_hold_texts_once(spark, monkeypatch):
    """A shard has each text once, and what marks removed bytes takes few bytes for each of text."""
    sent = []
    monkeypatch.setattr(R, "_removal", lambda docs, finish, schema: sent.append(docs) or docs.withColumn("_kept", docs["text"]))
    assert without_repeats(documents(spark)).columns == documents(spark).columns
    assert "text" not in sent[0].schema["_row"].dataType.names

    text = "".join(map(chr, np.random.default_rng(7).integers(97, 123, 1 << 20)))
    shard = R.Shard(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [text, text]}), R._messages([]))
    tracemalloc.start()
    gone = shard.covered()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not gone.any() and peak < 8 * 2 * len(text)
