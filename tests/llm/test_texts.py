import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import avi_jpeg as A
from sheetloom.llm import bloom_sketch as B
from sheetloom.llm import fixity as X
from sheetloom.llm import main_text as W
from sheetloom.llm import quality as Q
from sheetloom.llm.common import texts_of
from sheetloom.llm.main_text import extract, main_text

from ..conftest import SMALL
from .odd import documents, empty, prose, rows, texts

ARTICLE = "A paragraph of the article that is long enough to be its main text, surely so."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>x", "x"),
    (f"<nav><a href=x>menu</a></nav><article><h1>T</h1><p>{ARTICLE}<p>End.</article><footer>f</footer>", f"T {ARTICLE} End."),
    (f"<div class=sidebar>{ARTICLE}</div><main><header><h1>T</h1><i>by me</i></header><p>a<b>b</b>&amp;&lt;c {ARTICLE}</p><script>x='</p>'</script></main>", f"T ab&<c {ARTICLE}"),
    (f"<article><p>{ARTICLE}</p><div id=comments>{ARTICLE * 9}</div><p>ok</p></article>", f"{ARTICLE} ok"),
    (f"<div id=menu><a href=1>one</a></div><div><p>{ARTICLE}</p><p>short</p><form>name {ARTICLE}</form><p>last</p></div><div class='cookie-notice'>{ARTICLE}</div>", f"{ARTICLE} short last"),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><!-- <p>no --><article><p>1 < 2 and\n\n {ARTICLE}&nbsp; x</article>", f"1 < 2 and {ARTICLE} x"),
])
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("raw", [
    "<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>el.innerHTML='<p';</script>", "<script>document.write(\"<!--\")</SCRIPT >",
    "<style>a::after{content:'<b'}</style>", "<noscript><img alt='</noscript><object>", "<textarea><script></textarea\n>",
])
def test_raw_text_ends_at_its_own_end_tag(raw):
    assert main_text(f"<html><head>{raw}</head><body><article><p>{ARTICLE}</p>{raw}<p>End.</p></article><script>1</script>") == f"{ARTICLE} End."


@pytest.mark.parametrize("page, text", [
    (f"<div class='content with-sidebar'><p>{ARTICLE}</p></div>", ARTICLE),
    (f"<div class='wrapper no-sidebar'><article><p>{ARTICLE}</p></article></div>", ARTICLE),
    (f"<div id='page' class='has-comments'><p>{ARTICLE}</p></div><div class='main-nav'>{ARTICLE * 2}</div>", ARTICLE),
    (f"<article><p>{ARTICLE}</p><h2 id='related-work'>Work</h2><section id='search'><h2 id=search>Search</h2><p>more</p></section></article>", f"{ARTICLE} Work Search more"),
    (f"<form id=aspnetForm><nav>{ARTICLE * 9}</nav><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div></form><footer>{ARTICLE * 3}</footer>", f"{ARTICLE} {ARTICLE}"),
    (f"<aside><main><p>{ARTICLE}</p></main></aside>", ARTICLE),
    (f"<div class='layout sidebar'><form><p>{ARTICLE}</p><div class=comments>{ARTICLE * 9}</div></form></div>", ARTICLE),
    (f"<article class='post category-promo'><p>{ARTICLE}</p></article><p>{ARTICLE}{ARTICLE}</p>", None),
    (f"<article><p>{ARTICLE}</p></article><aside><article>{ARTICLE}</article></aside><div class='post-comments'><article>{ARTICLE}</article></div>", ARTICLE),
    (f"<p>{ARTICLE}</p><div class=cookie-notice>{ARTICLE * 9}</div>", ARTICLE),
    (f"<div class=ad>{ARTICLE}</div><article><h1>Short.</h1></article><footer>{ARTICLE * 2}</footer>", "Short."),
])
def test_marked_elements_around_the_text_are_kept(page, text):
    found = main_text(page)
    assert found == text if text else found.startswith(ARTICLE)


@pytest.mark.parametrize("page, text", [
    (f"<body><p>{ARTICLE * 12}</p><div class=ad>{ARTICLE}</div><p>{ARTICLE * 4}</p><div class=ad>x</div><p>End.</p></body>", f"{ARTICLE * 12} {ARTICLE * 4} End."),
    (f"<div><p>{ARTICLE * 9}</p></div><aside>x</aside><div><p>{ARTICLE}</p></div><aside>x</aside><div><p>End.</p></div>", f"{ARTICLE * 9} {ARTICLE} End."),
    (f"<div><div>{ARTICLE * 50}</div>{'<div><a href=x>menu</a></div>' * 4}<div><p>{ARTICLE}</p></div></div>", f"{ARTICLE * 50} {ARTICLE}"),
    (f"{'<li><a href=x>menu</a>' * 9}<p>{ARTICLE * 9}</p>{'<li><a href=x>menu</a>' * 9}<p>End.</p>{'<li><a href=x>menu</a>' * 9}", f"{ARTICLE * 9} End."),
    (f"<table><tr><td>{'<li><a href=x>menu</a>' * 9}<td>{ARTICLE}</table>", ARTICLE),
])
def test_light_parts_of_the_text_are_kept(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a title='" * 100_000, "<p x=\">" * 120_000, "<div>" * 100_000 + ARTICLE, "<nav>" * 100_000 + ARTICLE, "<article>" * 50_000 + ARTICLE, "<p>x</div>" * 100_000, "<!--" * 250_000, "<![CDATA[" * 100_000, "</x" * 300_000])
def test_hostile_pages_take_linear_time(page):
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 5


def plain_stretches(weights):
    """Surge and dive of every window, one window sum after another."""
    found, inside = [], None
    for k in range(len(weights) + 1):
        total = sum(weights[k : k + W.WINDOW])
        if inside is None and total > W.LEAST_SURGE:
            inside = k
        elif inside is not None and (k == len(weights) or total == 0):
            first = next(i for i in range(inside, k) if weights[i])
            found.append((first, k))
            inside = None
    return found


def test_stretches_are_what_windows_tell():
    rng = np.random.default_rng(4)
    for _ in range(300):
        weights = (rng.integers(0, 60, 30) * (rng.random(30) < rng.random())).tolist()
        assert W.stretches(weights) == plain_stretches(weights)


def test_the_stretch_is_the_text(monkeypatch):
    """Lists of links at the ends of an article are no text; a search for the heaviest line alone
    gives other texts than surge and dive."""
    menu = "<li><a href=x>menu</a>" * 5
    page = f"<article>{menu}<h1>T</h1><p>{ARTICLE}</p>{menu}<p>{ARTICLE}</p><p>End.</p>{menu}</article>"
    text = f"menu menu T {ARTICLE} {'menu ' * 5}{ARTICLE} End. menu menu"
    assert main_text(page) == text
    monkeypatch.setattr(W, "stretches", lambda weights: [])
    assert main_text(page) != text


def test_pages(spark):
    held = [(1, "u", f"<article><p>{ARTICLE}</article>"), (2, None, None), (None, "u", "<p>é</p>"), (1, "u", f"<article><p>{ARTICLE}</article>"), (3, "v", f"<article>{'<p>' + ARTICLE:s}</article>" * 500)]
    df = spark.createDataFrame(held, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(None).cast("int"))
    found = sorted(rows(extract(df), "page_id", "url", "n_chars"), key=str)
    assert found[:2] == [(1, "u", len(ARTICLE))] * 2 and (2, None, 0) in found and (None, "u", 1) in found
    assert extract(df.limit(0)).count() == 0


def test_frames_come_back():
    rng = np.random.default_rng(0)
    frames = rng.integers(0, 256, (300, A.FRAME)).astype(np.uint8)
    frames[0], frames[1], frames[2, ::2], frames[3] = 255, 0, 255, 128
    images = A.encode_frames(frames)
    assert (A.decode_frames(images) == frames).all()
    assert all(b"\xff" not in i[len(A.HEAD) : -2].replace(b"\xff\x00", b"") for i in images)
    file = A.write_avi(images[:7])
    assert A.read_avi(file) == images[:7]
    for broken in (file[:100], b"RIFX" + file[4:], file[:-20]):
        with pytest.raises(ValueError):
            A.read_avi(broken)
    with pytest.raises(ValueError):
        A.decode_frames([images[0][:60] + images[0][-2:]])


def test_shots():
    frames = np.zeros((40, A.FRAME), np.uint8)
    frames[12:] = 200
    frames[30:] = 90
    assert A.shots(frames) == [(0, 12), (12, 30), (30, 40)]
    assert A.shots(frames[:1]) == [(0, 1)]


def test_media(spark):
    media = A.media_column(documents(spark)).cache()
    found = sorted(rows(A.media_digests(media), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes"), key=str)
    expected = []
    sizes = {r.doc_id: len(r.media) for r in media.collect()}
    for d, t in texts():
        b = (t or "").encode()
        p = b + b"\xff" * (576 - len(b) if len(b) < 576 else -len(b) % 576)
        expected.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert [f[:5] for f in found] == sorted(expected, key=str)
    assert all(f[5] == sizes[f[0]] for f in found if f[0] not in (None, 18))
    same = {r.doc_id: r.media_sha256 for r in A.media_digests(media).collect()}
    assert same[0] == same[1] != same[2]
    cuts = A.clips(media).where("doc_id = 12").orderBy("clip").collect()
    assert cuts[0].start_frame == 0 and all(a.end_frame == b.start_frame for a, b in zip(cuts, cuts[1:], strict=False))
    assert A.media_digests(A.media_column(empty(spark))).count() == 0


def test_likeness_is_of_digest_sets():
    held = [t or "" for _, t in texts()]
    first = [B.digests(t) for t in held]
    second = first[1:] + first[:1]
    for x, y, near in zip(first, second, B.likeness(first, second), strict=True):
        a, b = set(x.tolist()), set(y.tolist())
        assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    for (only_a, only_b), x, y in zip(B.differing(first, second), first, second, strict=True):
        assert set(only_a.tolist()) == set(x.tolist()) - set(y.tolist()) and set(only_b.tolist()) == set(y.tolist()) - set(x.tolist())


def test_edits(spark):
    held = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    held = [r for r in held if r[0] is not None and r[0] != 18]
    df = documents(spark, held[::-1])
    found = {r.doc_id: r for r in B.edit_fingerprints(df).collect()}
    assert len(found) == len(held)
    for k, (d, t) in enumerate(held):
        t, following = t or "", held[(k + 1) % len(held)][1] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        assert found[d].n_chars == len(t) and found[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert found[d].fingerprint == B.fingerprint(B.digests(t)) and 0 <= found[d].near_edited <= 1
    assert found[0].near_next == 1.0 and found[0].fingerprint == found[1].fingerprint != found[2].fingerprint
    assert B.edit_fingerprints(documents(spark)).count() == len(texts())
    assert B.edit_fingerprints(empty(spark)).count() == 0
    (alone,) = B.edit_fingerprints(documents(spark, [(1, "a b c d")])).collect()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("text", ["word", "a short one", prose(5, 1), prose(20, 2).replace(".", ","), prose(150, 3).replace(".", ","), "Der " * 1400, "x" * 9000, "äöü" * 700, prose(900, 4).replace(" ", "").replace(".", "")])
def test_edited_texts_stay_near(spark, text):
    (found,) = B.edit_fingerprints(documents(spark, [(1, text), (2, "0123456789" * 3000)])).where("doc_id = 1").collect()
    assert found.near_edited > 0.2 and found.near_next == 0
    moved = B.digests("Zy. " + text)
    assert len(text) < 100 or np.isin(B.digests(text), moved).mean() > 0.8


def test_returned_fingerprints_tell_likeness(spark):
    """The strings of the output alone, subtracted and peeled, give near_edited and near_next of every
    document whose differences fit their cells, and the digests that differ."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    near = [(1 << 20, prose(200, 5)), ((1 << 20) + 1, prose(200, 5) + " end"), ((1 << 20) + 2, prose(200, 5) + " end")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    found = B.edit_fingerprints(docs).orderBy("doc_id").collect()
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    peeled = 0
    for other, near in (([r.edited_fingerprint for r in found], "near_edited"), ([r.fingerprint for r in found[1:] + found[:1]], "near_next")):
        (a, n), (b, k) = B.read([r.fingerprint for r in found]), B.read(other)
        rest = a - b
        done, keys, sign, owner = rest.peel()
        for i, r in enumerate(found):
            text, following = held[r.doc_id], held[found[(i + 1) % len(found)].doc_id]
            second = B.digests(B.edited(text, following) if near == "near_edited" else following)
            first = set(B.digests(text).tolist())
            assert (n[i], k[i]) == (len(first), len(second))
            both = len(first & set(second.tolist()))
            assert r[near] == pytest.approx(both / (len(first | set(second.tolist()))) if first or len(second) else 1.0)
            if done[i]:
                own = owner == i
                assert set(keys[own & (sign > 0)].tolist()) == first - set(second.tolist())
                shared = (n[i] + k[i] - own.sum()) / 2
                assert r[near] == pytest.approx(shared / (shared + own.sum()) if shared + own.sum() else 1.0)
                peeled += own.sum() > 0
    assert peeled


@pytest.mark.parametrize("size", [0, 1, 5, 17, 600, (1 << 18) - 1, (1 << 18) + 300, 1 << 20])
def test_paragraph_ends_do_not_depend_on_portions(monkeypatch, size):
    rng = np.random.default_rng(size)
    data = rng.choice(np.frombuffer(b"abcdef .!\n", np.uint8), size)
    ends = B.ends_of(data)
    assert (np.diff(ends, prepend=0) > 0).all() and (ends[-1] == size if size else not len(ends))
    keys = B.digests(data.tobytes().decode())
    monkeypatch.setattr(B, "_PORTION", 4096)
    assert (B.ends_of(data) == ends).all() and (B.digests(data.tobytes().decode()) == keys).all() and len(set(keys.tolist())) == len(keys)


def test_quality(spark):
    good = [(k, prose(80 + k % 50, k)) for k in range(300)]
    bad = [(1000 + k, " | ".join(prose(30, k).split())) for k in range(100)] + [(2000 + k, prose(40, k).upper().replace(" ", "!! ")) for k in range(100)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(None, 1, 0), (5, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, good + bad + texts())
    found = Q.quality_scores(df, labels).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= Q.CUT) for r in found)
    truth = {d: 1 for d, _ in good} | {d: 0 for d, _ in bad}
    own = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id > 20]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    again = {r.doc_id: r.score for r in Q.quality_scores(df.repartition(7), labels).collect() if r.doc_id is not None and r.doc_id != 18}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in found if r.doc_id in again and r.doc_id != 18 and r.doc_id > 20)
    assert Q.quality_scores(empty(spark), labels).count() == 0
    one_kind = Q.quality_scores(df, labels.where("quality = 1"))
    assert one_kind.where("predicted = 0").count() == 0


def test_quality_without_labels_keeps_all(spark):
    df = documents(spark)
    held = [d for d in range(100_000, 100_100) if zlib.crc32(str(d).encode()) % 5 == 0]
    more = df.union(documents(spark, [(held[0], prose(40, 1))]).select(df.columns))
    for given in ([], [(0, None, 0), (None, 0, 0)], [(99_999, 0, 0)], [(held[0], 0, 0)]):
        labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
        assert [r.predicted for r in Q.quality_scores(more, labels).collect()] == [1] * (len(texts()) + 1)
    (only_bad,) = Q.quality_scores(documents(spark, [(1, "a")]), spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    assert only_bad.predicted == 0


def test_features_are_finite():
    x = Q.matrix(iter(texts_of(pa.array([t or "" for _, t in texts()]))))
    assert x.shape == (len(texts()), 3 * Q.N_BASE) and np.isfinite(x).all()


def pages(spark, n=3000):
    held = [(k, f"http://x/{k}", f"<p>page {k} é</p>") for k in range(n)] + [(None, None, None), (None, "u", "x"), (7, "http://x/7", "other"), (8, "http://x/8", "<p>page 8 é</p>")]
    return spark.createDataFrame(held, "page_id long, url string, html string").withColumn("digest", F.lit("x"))


def test_fixity_finds_what_was_damaged(spark):
    p = pages(spark)
    first = X.leaves(X.archive(p))
    assert X.root(first).collect() == X.root(X.leaves(X.archive(p.repartition(5)))).collect()
    assert X.differing_leaves(first, first).count() == 0
    second = X.leaves(X.archive(X.damaged_replica(p)))
    found = X.audit(first, second).collect()
    status = {r.page_id: r.status for r in found if r.page_id not in (None, 7, 8)}
    assert all(s == ("missing" if k % 389 == 7 else "damaged" if k % 97 == 13 else "ok") for k, s in status.items())
    assert len(found) == p.count() and X.root(first).collect() != X.root(second).collect()
    back = X.audit(second, first).where("status = 'extra'").count()
    assert back == sum(r.status == "missing" for r in found)


def test_fixity_offsets_and_bytes(spark):
    p = pages(spark, 50).where("page_id IS NOT NULL")
    joined = X.archive(p).join(X.leaves(X.archive(p)), ["page_id", "segment"]).where("sha2(record, 256) = digest").orderBy("start").collect()
    whole, at = b"", 0
    for r in joined[:8]:
        assert r.start == at and r.record.startswith(b"WARC/1.0\r\n") and r.record.endswith(b"\r\n\r\n")
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert int(head.rpartition(b"Content-Length: ")[2]) == len(rest) - 4
        whole, at = whole + r.record, at + r.length
    none = X.leaves(X.archive(p.limit(0)))
    assert X.audit(none, none).count() == 0 and X.root(none).count() == 0
    assert X.audit(none, X.leaves(X.archive(p))).where("status = 'extra'").count() == p.count()


@pytest.mark.parametrize("faults", [0, 1, 10])
def test_sparse_damage_is_found_by_few_comparisons(spark, faults):
    """The descent looks at the children of nodes that differ and at no others, wherever offsets move."""
    n = 20_000
    held = [(k, f"http://x/{k}", f"page {k} " + "x" * (k % 90)) for k in range(n)]
    wrong = {n // 11 * (k + 1) - 1 for k in range(faults)}
    other = [(k, u, t + "?" if k % 2 else t) for k, u, t in held if k not in wrong or k % 2]
    other = [(k, u, t) if k in wrong else held[k] for k, u, t in other]
    schema = "page_id long, url string, html string"
    first, second = (X.leaves(X.archive(spark.createDataFrame(x, schema).repartition(4))) for x in (held, other))
    steps = X.descent(first, second)
    looked = [s.count() for s in steps]
    assert sum(looked) <= max(1, faults * X.FANOUT * len(steps)) and len(steps) <= 5
    found = X.audit(first, second).where("status <> 'ok'").collect()
    assert {(r.page_id, r.status) for r in found} == {(k, "damaged" if k % 2 else "missing") for k in wrong}


def test_fixity_bears_odd_keys(spark):
    """Ids beyond doubles and below zero, an id with very many rows, equal rows, a long record."""
    held = [(k, "u", f"t{k}") for k in (-(1 << 63), -70, -1, 0, (1 << 53) + 1, (1 << 53) + 2, (1 << 63) - 1)]
    held += [(5, "u", f"v{k % 300}") for k in range(900)] + [(6, "u", "same")] * 9000 + [(7, "u", "é" * 2_000_000)]
    df = spark.createDataFrame(held, "page_id long, url string, html string").repartition(4)
    first = X.leaves(X.archive(df))
    assert first.count() == len(held) == first.select("segment", "position").distinct().count()
    order = first.where("segment = 0").orderBy("position").collect()
    assert all(a.start + a.length == b.start and a.position + 1 == b.position and (a.page_id, a.digest) <= (b.page_id, b.digest) for a, b in zip(order, order[1:], strict=False))
    second = X.leaves(X.archive(df.where("NOT (page_id = 5 AND html = 'v7') AND page_id <> 9007199254740994").union(df.where("page_id = 6").limit(1))))
    status = sorted((r.page_id, r.status) for r in X.audit(first, second).where("status <> 'ok'").collect())
    assert status == [(5, "missing")] * 3 + [(6, "extra"), ((1 << 53) + 2, "missing")]


def test_fit_is_the_least_logistic_loss_of_pairs():
    """The weights against plain gradient descent on the same pairs, and the cut against its quantile."""
    rng = np.random.default_rng(6)
    d = rng.normal(size=(4000, 3)) + [0.8, -0.3, 0.1]
    plain = np.zeros(3)
    for _ in range(4000):
        plain += 0.5 * ((1 / (1 + np.exp(d @ plain)))[:, None] * d).mean(0) - 0.5 * Q.RIDGE * plain
    assert Q._newton(d, np.ones(len(d)), Q.RIDGE) == pytest.approx(plain, abs=1e-3)
    x = rng.normal(size=(500, 3 * Q.N_BASE))
    label = (x[:, 0] + 0.3 * rng.normal(size=500) > 0.4).astype(int)
    model = Q.fit(x, label, pairs=5000)
    worth = model.worth(x)
    assert model.cut == pytest.approx(np.quantile(worth, (label == 0).mean(), method="midpoint"))
    assert (worth[label == 1][:, None] > worth[label == 0][None, :]).mean() > 0.9


def test_repeated_ids_are_learned_from_in_one_order(spark):
    docs = [(k % 7, prose(20 + k, k)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)] * 3, "doc_id long, quality int, toxic int")
    models = [Q.train(documents(spark, docs).repartition(n), labels, sample=5) for n in (1, 5)]
    assert models[0].weights == pytest.approx(models[1].weights) and models[0].cut == pytest.approx(models[1].cut)
