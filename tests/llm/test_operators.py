"""Brute force, round trips and odd rows for the text operators."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from lumaspec.llm import _memory, cross_polytope, hnsw, html_layouts, html_text, jaccard, langid, mixing, packing, queries, sharding, token_rollup, tokenizing, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "Hello, World!! it's déjà vu."), (3, "Hello, World!! it's déjà vu."), (None, "x\ty z"), (5, "ΣΟΦΟΣ <|endoftext|> A'b <|EndOfText|>\r\nend"), (6, "word " * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][k % 3], -1) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


@pytest.mark.parametrize("name, special", [("word_bpe_49k", True), ("byte_bpe_50k", True), ("byte_bpe_50k", False)])
def test_word_cache_gives_the_tokenizers_ids(name, special):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(f"{name}.json")
    plain, cached, rng = Tokenizer.from_file(path), tokenizing.WordTokenizer(path, special), random.Random(1)
    plain.encode_special_tokens = not special
    texts = [t for _, t in ODD[1:]] + ["".join(rng.choices("aBcÄß ée'’.,!?12 \n\t%%-–<>|́字\xa0\x1f", k=80)) for _ in range(600)] + ["x" * 500, " ", "\n", "İI ǅ"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert cached.rule is not None and cached.counts(texts).tolist() == [len(w) for w in want]
    for _ in range(2):  # learned, then known
        for text, ids, right in zip(texts, cached.ids(texts), want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == right, repr(text)
    assert cached.ids([]) == [] and cached.counts([]).tolist() == []


def test_chunks_of_text_are_whole_and_bounded():
    import pyarrow as pa

    texts = [None, "", "é" * 700_000, "b" * 400_000, "c" * 2_000_000, "d", None]
    for column in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        found = list(tokenizing.text_chunks(column))
        assert [t for _, _, part in found for t in part] == [t or "" for t in texts]
        assert [low for low, _, _ in found] + [7] == [0, *[high for _, high, _ in found]]
        assert all(high - low == 1 or sum(map(len, part)) <= 1 << 20 for low, high, part in found) and len(found) == 4
    assert list(tokenizing.text_chunks(pa.array([], pa.string()))) == []


def test_tokenizing_holds_little_at_a_time():
    """What Python holds at most beside a batch of 43 MB, in a process of its own."""
    import subprocess
    import sys

    code = f"""
import tracemalloc
import pyarrow as pa
from lumaspec.llm import tokenizing
words = tokenizing.shared({TOKENIZER!r})
column = pa.array(["the whole of a text is cut, word by word; " * 100] * 10_000)
tracemalloc.start()
n = sum(len(words.encode(texts)[0]) for _, _, texts in tokenizing.text_chunks(column))
assert n == 12_000_000
print(tracemalloc.get_traced_memory()[1] / 1e6)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=root)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 30


def test_batches_are_let_go_before_the_next():
    import weakref

    seen = []

    def batches():
        for k in range(3):
            assert all(r() is None for r in seen)
            batch = pa.record_batch({"a": [k]})
            seen.append(weakref.ref(batch))
            out, batch = batch, None
            yield out
            del out

    assert list(_memory.handled(batches(), lambda batch: [batch.column(0)[0].as_py()])) == [0, 1, 2] and len(seen) == 3
    assert list(_memory.handled([], list)) == []


def test_counting_shingles_takes_a_byte_a_cell():
    """Memory and counts of a process of its own, without pandas; one word is in more texts than a byte can count."""
    import subprocess
    import sys

    code = """
import sys, tracemalloc
import numpy as np
import pyarrow as pa
from lumaspec.llm import jaccard, langid, mixing, packing
assert "pandas" not in sys.modules
texts = ["same"] * 3000 + [f"w{k % 300}" for k in range(3000)] + ["", None]
batches = [pa.record_batch({"text": pa.array(texts[k : k + 1000])}) for k in range(0, len(texts), 1000)]
for bits in (16, 24):
    tracemalloc.start()
    found = np.zeros(1 << bits, np.int64)
    tracemalloc.reset_peak()
    for c, part in jaccard._tally(batches, bits, 5):
        at = np.flatnonzero(part)
        found[(c << 16) + at] += part[at]
    peak = tracemalloc.get_traced_memory()[1] / 1e6 - found.nbytes / 1e6
    tracemalloc.stop()
    cells = np.concatenate([jaccard.shingles((t or "").encode(), 5) for t in texts]) >> np.uint64(64 - bits)
    cell, n = np.unique(cells, return_counts=True)
    assert found.sum() == 6000 and (found[cell.astype(np.int64)] == n).all() and n.max() >= 3000
    assert peak < 45, peak
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=root)
    assert out.returncode == 0, out.stderr


def test_learning_languages_takes_no_plain_python_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words of text {k}", "en") for k in range(9)], "doc_id long, text string, lang string").localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert langid.fit_languages(docs, langid.F.lit(True)).languages == ("en",)


def test_tokenizers_of_another_kind_encode_whole_texts(tmp_path):
    import json

    parts = json.load(open(TOKENIZER, encoding="utf-8"))
    parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "[,\\s]+"}, "behavior": "Removed", "invert": False}, parts["pre_tokenizer"]["pretokenizers"][1]]}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts), encoding="utf-8")
    other = tokenizing.WordTokenizer(str(path))
    assert other.rule is None and other.ids(["a, b"]) == other._encode(["a, b"]) and other.counts(["a, b", ""]).tolist()[1] == 0


def test_best_fit_keeps_every_limit():
    lengths = np.random.default_rng(2).integers(1, 101, 500)
    for cap in (packing.Capacity(100), packing.Capacity(100, 4, 6000, rule="dot")):
        cap = packing.Capacity(cap.tokens, cap.documents, max(cap.attention, 10_000) if cap.attention else None, rule=cap.rule)
        bins, offsets = packing.best_fit(lengths, cap)
        for b in set(bins.tolist()):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert lengths[at].sum() <= 100 and offsets[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
            assert len(at) <= (cap.documents or len(at)) and (lengths[at] ** 2).sum() <= (cap.attention or 10**9)
    bins, _ = packing.best_fit(lengths, packing.Capacity(100))
    assert len(set(bins.tolist())) <= 1.05 * lengths.sum() / 100 + 2


def test_shingles_are_those_of_the_words():
    def plain(text, k):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Ab", "ab", "É", "é", "x", "yy", " "], k=n)) for n in (0, 1, 2, 3, 10, 60)] + ["", " \t", "a " * 700_000]
    for a in texts:
        assert len(jaccard.shingles(a.encode(), 3)) == len(plain(a, 3))
    a, b = texts[4], texts[5]
    assert len(np.intersect1d(jaccard.shingles(a.encode(), 3), jaccard.shingles(b.encode(), 3))) == len(plain(a, 3) & plain(b, 3))


def test_jump_hash_moves_rows_into_the_new_shard_only():
    keys = np.arange(-5000, 15000)
    old, new = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(new[old != new]) == {16} and abs((old != new).mean() - 1 / 17) < 0.01
    assert np.bincount(old).min() > 0.85 * len(keys) / 16
    assert (sharding.jump_hash(keys, 1) == 0).all()


def test_hadamard_and_graph_against_brute_force():
    x = np.random.default_rng(5).normal(size=(40, 64))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 32))
    v = np.concatenate((base, base[:100] + 0.05 * rng.normal(size=(100, 32)), base[:1] + 0.02 * rng.normal(size=(200, 32))))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph, order = hnsw.build(v)
    got = hnsw.linked(hnsw.Graph.load(graph.dump()), v.astype(np.float32), 0.9)
    for k, near in enumerate(got):
        assert set(order[near].tolist()) == set(np.flatnonzero(v[k].astype(np.float32) @ v.T.astype(np.float32) >= 0.9 - 1e-4).tolist())


@pytest.mark.parametrize("n", [40, 83, 333, 2500])
def test_graphs_of_every_size_are_searched_and_scans_only_audit(n, monkeypatch):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 32))
    v = np.concatenate((base[: n // 2], base[: n - n // 2] + 0.1 * rng.normal(size=(n - n // 2, 32))))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, order = hnsw.build(v)
    hnsw.tune(graph, 0.9)
    scanned, scan = [], hnsw._scan
    monkeypatch.setattr(hnsw, "_scan", lambda g, q, low: scanned.append(len(q)) or scan(g, q, low))
    got = hnsw.linked(graph, v, 0.9, audit=4)
    assert sum(scanned) <= 8  # the audit's; a scan of the queries would be n
    for k, near in enumerate(got):
        assert set(order[near].tolist()) == set(np.flatnonzero(v[k] @ v.T >= 0.9 - 1e-4).tolist())


def test_near_vectors_through_graphs_of_thousands(spark):
    """Shards of 2000 vectors and more, by every pair of them."""
    rng = np.random.default_rng(61)
    v = rng.normal(size=(4600, 24))
    v[3000:] = v[:1600] + rng.normal(size=(1600, 24)) * rng.uniform(0.02, 0.35, (1600, 1))
    v = np.round(v, 6)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.9, 1)
    links, up = near.sum(0) + near.sum(1), list(range(len(v)))
    for a, b in zip(*np.nonzero(near), strict=True):
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    got = {r["vec_id"]: r for r in hnsw.near_vectors(df, shards=2).collect()}
    assert links.sum() > 1500 and [got[k]["n_links"] for k in range(len(v))] == links.tolist()
    root = lambda k: k if up[k] == k else root(up[k])
    assert all(got[k]["component_id"] == root(k) for k in range(len(v)))


@pytest.mark.parametrize("page", ["<b>" * 200_000 + "x" + "</i>" * 200_000, "<i><table>" + "<b>" * 200_000 + "</i>" * 200_000, "<div><b>" * 100_000 + "</p>" * 200_000, "<p><span>" * 100_000, "<td><li>" * 100_000 + "</u>" * 100_000])
def test_hostile_pages_are_parsed_in_line_with_their_length(page):
    import time

    began = time.process_time()
    html_text.Dom(page)
    assert time.process_time() - began < 5


def test_unmatched_and_scoped_tags_close_what_they_should():
    dom = html_text.Dom("<div><i>a<table><tr><td>b</i>c</td><td>d<tr><td>e</table>f</i>g</div><p>h<p>i</b>")
    assert "".join(t for _, _, t in dom.runs) == "abcdefghi"
    tags = [dom.tag[n] for n, _, t in dom.runs]
    assert tags == ["div", "td", "td", "td", "td", "div", "div", "p", "p"]


def test_every_row_of_a_graph_without_clusters_finds_itself():
    v = np.random.default_rng(16).normal(size=(6000, 48))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, order = hnsw.build(v)
    hnsw.tune(graph, 0.9)
    assert graph.width < hnsw._widest(graph)  # searched, not scanned
    place = np.empty(len(v), int)
    place[order] = np.arange(len(v))
    assert all(p in near for p, near in zip(place, hnsw.linked(graph, v, 0.9), strict=True))


def test_an_audit_of_queries_with_links_widens_the_beam():
    rng = np.random.default_rng(17)
    v = rng.normal(size=(4000, 32))
    v[2000:] = v[:2000] + 0.3 * rng.normal(size=(2000, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, _ = hnsw.build(v)
    graph.width = 1
    found = hnsw.linked(graph, v, 0.9)
    assert graph.width > 1
    true = hnsw._scan(graph, v, hnsw._low(0.9))
    assert sum(len(f) for f in found) >= 0.998 * sum(len(t) for t in true) > 4500


def test_queries_search_a_graph_only_where_a_bucket_leads_to_a_near_row(monkeypatch):
    """A quarter of the rows have a link, barely; it was each vector in each shard that searched."""
    rng = np.random.default_rng(21)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    away = rng.normal(size=(500, 64))
    away -= (away * v[:500]).sum(1, keepdims=True) * v[:500]
    cosine = rng.uniform(0.9002, 0.91, (500, 1))
    v[-500:] = cosine * v[:500] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    v = v.astype(np.float32)
    graph, order = hnsw.build(v)
    place = np.argsort(order)
    searched, search = [], hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda g, q, *rest: searched.append(len(q)) or search(g, q, *rest))
    got = hnsw.linked(graph, v, 0.9, buckets=hnsw.Buckets(graph.x, 0.9), same=place)
    assert sum(searched) == 1000 and graph.routed
    for k, near in enumerate(got):
        assert set(order[near].tolist()) == set(np.flatnonzero(v[k] @ v.T >= 0.9 - 1e-4).tolist())


def test_crowded_buckets_and_lost_ways_leave_out_no_link(monkeypatch):
    rng = np.random.default_rng(22)
    v = np.concatenate((rng.normal(size=(600, 3)), rng.normal(size=3) + 0.01 * rng.normal(size=(300, 3))))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, order = hnsw.build(v)
    true = [set(np.flatnonzero(x @ v.T >= 0.9 - 1e-4).tolist()) for x in v]
    buckets, none = hnsw.Buckets(graph.x, 0.9), np.full(len(v), -1)
    assert [set(order[near].tolist()) for near in hnsw.linked(graph, v, 0.9, buckets=buckets, same=np.argsort(order))] == true
    monkeypatch.setattr(buckets, "near", lambda q, same: (np.empty(0, int), np.empty(0, int), np.zeros(len(q), bool)))
    assert [set(order[near].tolist()) for near in hnsw.linked(graph, v, 0.9, buckets=buckets, same=none)] == true
    assert not graph.routed and hnsw._tables(0.5) == 0


def test_decoding_never_keeps_below_a_dropped_node():
    rng = np.random.default_rng(7)
    for _ in range(50):
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, 12)]
        odds = rng.normal(size=12)
        keep = html_text.decode(parent, odds)
        best = max(
            sum(odds[k] for k in range(1, 12) if mask >> k & 1)
            for mask in range(1, 1 << 12, 2)
            if all(mask >> parent[k] & 1 for k in range(1, 12) if mask >> k & 1)
        )
        assert all(keep[parent[k]] for k in range(1, 12) if keep[k]) and np.isclose(odds[1:][keep[1:]].sum(), best)


def test_dom_text_of_broken_markup():
    d = html_text.Dom("<body><!-- no --><script>var t='</p>';</script><div>a&amp;b <b>c<br>d</b>\n e<p>f<p>g <style>x{}</style>h<ul><li>i<li>j</ul><p")
    assert html_text.kept_text(d, np.ones(len(d.parent), bool)) == "a&b c d e\nf\ng h\ni\nj"
    assert html_text.kept_text(html_text.Dom(""), np.ones(1, bool)) == ""


def test_chunks_hold_no_mark_and_no_half_characters():
    data = ("é" * 50 + "\r\n\r\nWARC/1.1\r\n" + "字" * 30).encode()
    for step in (7, 33, 1000):
        chunker, found = warc.Chunker(33), []
        for at in range(0, len(data), step):
            found += chunker.add(memoryview(data[at : at + step]), at + step >= len(data))
            assert len(chunker.rest) <= 33 + step
        assert b"".join(c for c, _ in found) == data and [last for _, last in found] == [False] * (len(found) - 1) + [True]
        assert (chunker.length, chunker.sha.hexdigest()) == (len(data), hashlib.sha1(data).hexdigest())
        for c, _ in found:
            c.decode()
            assert len(c) <= 33 and b"\r\n\r\nWARC/1.1\r\n" not in b"\r\n\r\n" + c
    assert list(warc.Chunker(33).add(b"", True)) == [(b"", True)]


def test_archives_come_back(spark, tmp_path):
    long = "<p>" + "ü x" * 900 + "\r\n\r\nWARC/1.1\r\n" + "tail</p>"
    rows = [(1, "u", long), (2, None, long), (3, "a\r\nb", None), (4, "v", "short"), (5, "v", "short"), (6, "w", "y" * 5000), (7, "x", "WARC/1.1\r\nabc"), (8, "z", "字" * 3_000_000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, data string, chunk int")
    for size, compression in ((1000, "gzip"), (1000, "none"), (warc.CHUNK_BYTES, "gzip")):
        got = {r["page_id"]: r for r in warc.archive_round_trip(df, chunk_bytes=size, compression=compression).collect()}
        for i, _, html in rows:
            data = (html or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 4, 5)] == [("revisit", 2), ("response", None), ("response", None), ("response", None)]
    warc.write_archives(df, f"file://{tmp_path}/a", compression="none")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "a").glob("*.txt"))
    sizes = [int(x) for x in re.findall(rb"Content-Length: (\d+)\r\n\r\n", raw)]
    assert max(sizes) <= warc.CHUNK_BYTES and len(sizes) > 9_000_000 / warc.CHUNK_BYTES and b"WARC-Type: continuation" in raw


def test_archives_of_odd_tables(spark):
    same = "s" * 1500
    rows = [(1, "u", same), (1, "u", same), (None, "u", same), (2, "u", "q"), (2, "u", "q"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect())
    assert got == [(0, 0, "response", None), (0, 1500, "revisit", 1), (1, 1500, "response", None), (1, 1500, "response", None), (2, 1, "response", None), (2, 1, "response", None)]
    nobody = spark.createDataFrame([(None, "u", same), (None, "v", same)], "page_id long, url string, html string")
    assert [r["record_type"] for r in warc.archive_round_trip(nobody).collect()] == ["response", "response"]
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_odd_rows_of_packing_sharding_and_languages(docs):
    out = packing.pack_documents(docs, TOKENIZER).collect()
    assert sum(r["doc_id"] == 3 for r in out) == 2 and [r["length"] for r in out if r["doc_id"] in (1, 2)] == [1, 1]
    assert [r["length"] for r in sorted((r for r in out if r["doc_id"] == 6), key=lambda r: r["piece"])] == [4096, 4096, 809]
    assert packing.pack_documents(docs.where("false"), TOKENIZER).count() == 0
    shards = sharding.assign_shards(docs).collect()
    by = {}
    for r in shards:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(shards) == 7 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r["text_crc32"] for r in shards if r["doc_id"] == 3} == {zlib.crc32(ODD[2][1].encode())}
    model = langid.LanguageModel(("en", "de"), (b"the of and to hello world it is " * 50, "der die und das zu schön über ".encode() * 50))
    told = langid.identify(docs, model).collect()
    assert [r["lang_pred"] for r in told if r["doc_id"] in (1, 2)] == ["und", "und"] and all(0 <= r["score"] <= 1 for r in told)


def test_mixing_of_odd_rows(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == 7 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert all(r["target"] <= 2 * r["source_size"] for r in out)
    assert "size" in mixing.take_mix(docs).columns
    assert all(r["copies"] <= 2 for r in out) and mixing.mix(docs.where("false")).count() == 0 == mixing.take_mix(docs.where("false")).count()
    blank = docs.selectExpr("doc_id", "text", "if(doc_id = 6, 'a', source) as source", "if(text is null or text = '', 1, 0) as blank")
    many = blank.unionByName(blank.where("blank = 1").withColumn("doc_id", mixing.F.lit(77)).withColumn("text", mixing.F.lit(" ")))
    assert max(r["count"] for r in mixing.take_mix(many).where("doc_id = 77").groupBy("doc_id").count().collect() or [{"count": 0}]) <= 2 * 2  # two rows of that id


def test_sharding_against_a_scalar_version(spark, docs, tmp_path):
    def scalar(key, shards):
        z = (key + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        z ^= z >> 31
        b, j = -1, 0
        while j < shards:
            b = j
            z = (z * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((z >> 33) + 1)))
        return b

    df = docs.unionByName(spark.createDataFrame([(k * 7919 - 10**12, "é" * (k % 5), "x", None, 0) for k in range(300)] + [(2**62, "long " * 200_000, "x", None, 0)], docs.schema))
    rows = sharding.assign_shards(df).collect()
    assert len(rows) == 308
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (scalar(r["doc_id"] or 0, 16), scalar(r["doc_id"] or 0, 17)) and r["law"] == "key"
    sizes = {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert sizes == {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect()}
    assert sharding.assign_shards(df.where("false")).count() == 0
    sharding.write_shards(df, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 308 and all(r["shard"] == scalar(r["doc_id"] or 0, 16) for r in back.select("doc_id", "shard").collect())


def test_records_survive_line_feeds_at_buffer_ends(spark):
    pages = spark.range(30_000).selectExpr("id as page_id", "'u' as url", "concat(repeat('y', cast(id % 37 as int)), '\\r\\n') as html").coalesce(1)
    for compression in ("none", "gzip"):
        back = warc.archive_round_trip(pages, compression=compression).join(pages, "page_id")
        assert back.where("payload_digest = sha1(html) and record_type = 'response'").count() == 30_000


def _root(links, nodes):
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def _sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def _components(rows, k, percent):
    sets = _sets(rows, k)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, _root(links, sets)


def _copies(rng, count):
    words = [f"W{k}" if k % 5 else "É" + str(k) for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(count)]
    for _ in range(count):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(rng.choice([" ", "\t", "\n "]).join(w))
    return list(enumerate([None, "", " \n", "A", "a", "a B", "A b", *texts]))


def test_similar_documents_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = _copies(rng, 60)
    base = [f"c{k}" for k in range(60)]
    for _ in range(60):  # a large group of near copies, linked in chains
        base[rng.randrange(60)] = f"d{rng.randrange(1000)}"
        rows.append((len(rows), " ".join(base)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, gid string, n int")
    for k, percent in ((3, 90), (5, 80)):
        sets, up = _components(rows, k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df, jaccard.Jaccard(k, percent)).collect()}
        assert got == {i: (len(sets[i]), up[i]) for i, _ in rows}
    odd = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (2, "e f g h")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.similar_documents(odd).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1)]
    assert jaccard.similar_documents(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 16))
    v = np.concatenate((v, v[:60] + 0.05 * rng.normal(size=(60, 16)), v[:20])) * rng.uniform(0.5, 2, (380, 1))
    v[360:] = v[:20]  # equal vectors
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (1100, [])]
    return v, spark.createDataFrame([(i, x, 3) for i, x in rows + odd], "vec_id long, embedding array<double>, v int")


def test_neighbours_against_brute_force(spark, vectors):
    v, df = vectors
    got = {}
    for r in cross_polytope.nearest(df, "vec_id % 20 = 0", k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 380, 20))
    found = 0
    for q, near in got.items():
        score = v @ v[q]
        assert len(near) <= 10 and near == sorted(near, key=lambda x: (-x[1], x[0])) and all(abs(score[i] - s) < 1e-9 and i != q for i, s in near)
        true = [i for i in np.lexsort((np.arange(380), -score)) if i != q][:10]
        found += len(set(true) & {i for i, _ in near})
    assert found >= 0.9 * 10 * len(got)
    assert cross_polytope.nearest(df.where("false"), "vec_id % 20 = 0").count() == 0


def _nearest(rows, q, k):
    v = dict(rows)[q]
    near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
    return [i for _, i in near[:k]]


def test_neighbours_that_tie_come_by_id(spark):
    rng, one = random.Random(18), [[float(j == k) for j in range(64)] for k in range(64)]
    ids = rng.sample(range(1, 400), 64)
    rows = [*zip(ids, one, strict=True), (0, [1.0] * 64)]
    x = np.array([v for _, v in rows])
    names, _ = cross_polytope._best(x, x, np.array([i for i, _ in rows]), 10)
    assert names[-1].tolist() == [0, *sorted(ids)[:9]] and names[0].tolist() == [*sorted([0, ids[0]]), *[i for i in sorted(ids) if i != ids[0]][:8]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = [r["vec_id"] for r in cross_polytope.nearest(df, "vec_id = 0", k=20, recall=1.0).orderBy("rank").collect()]
    assert got == sorted(ids)[:20]


def test_neighbours_of_few_or_far_vectors_are_whole(spark):
    rng = np.random.default_rng(19)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(12)] + [(k, [float(k - 20), 1.0]) for k in range(20, 26)] + [(40, (-9 * np.ones(8)).tolist()), (45, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, "vec_id % 5 = 0", k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: want for q in (0, 5, 10, 20, 25, 40, 45) if (want := _nearest(rows, q, 20))}


def test_near_vectors_against_brute_force(spark, vectors):
    v, df = vectors
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    up = _root([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b], range(380))
    got = {r["vec_id"]: tuple(r)[1:] for r in hnsw.near_vectors(df, shards=3).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert len(got) == 386
    assert all(got[i] == (int(near[i].sum()), up[i], up[i] == i) for i in range(380))
    assert all(got[i] == (0, i, True) for i in range(1000, 1101, 20))
    assert hnsw.near_vectors(df.where("false")).count() == 0


def test_near_vectors_of_other_lengths_and_repeated_ids(spark):
    two, four = [1.0, 2.0], [1.0, 0.0, 0.0, 0.0]
    rows = [(1, two), (2, two), (3, four), (4, four), (5, [0.0, 1.0, 0.0, 0.0]), (6, [2.0, 4.0]), (7, [0.0, 0.0, 3.0, 0.0]), (7, [0.0, 9.0, 0.0, 0.0]), (7, [0.0, 9.0, 0.0, 0.0]), (None, two)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cid string")
        got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in hnsw.near_vectors(df).collect())
        # links between rows of one id are not links to others, but for equal ones of it
        assert [g[0::2] for g in got] == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 1), (7, 5), (7, 5), (7, 5)]
        assert [g[1] for g in got if g[0] in (0, 1, 2, 3, 4, 6)] == [0, 2, 2, 1, 1, 2] and next(g[1] for g in got if g[0] == 5) == 2


def test_rollup_batches_count_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t1", 5, 0), ("a", "en", "t1", 7, 0), (None, None, "t1", None, 0), ("b", "de", "t1", 4, 0)], "source string, lang string, tokenizer string, tokens long, documents int")
    rollup, other = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    assert rollup.totals().count() == 0 and not rollup.compact()
    assert rollup.commit("one", token_rollup.inserts(rows)) and not rollup.commit("one", token_rollup.inserts(rows))
    gone, old = rows.where("source = 'b'"), rows.where("tokens = 7")
    assert rollup.commit("two/ %", token_rollup.deletes(gone)) and rollup.commit("none", token_rollup.inserts(rows.where("false")))
    assert rollup.compact() and not other.commit("two/ %", token_rollup.deletes(gone))
    assert rollup.commit("three", token_rollup.revisions(old, old.withColumn("tokens", token_rollup.F.lit(9))))
    want = [("a", "en", "t1", 2, 14)]
    assert sorted(tuple(r) for r in rollup.totals().collect() if r["source"]) == want
    assert [tuple(r) for r in rollup.totals().where("source is null").collect()] == [(None, None, "t1", 1, 0)]
    assert rollup.compact() and rollup.committed() == {"one", "two/ %", "none", "three"}
    assert sorted(tuple(r) for r in other.totals().collect() if r["source"]) == want


def test_two_writers_of_one_batch_count_once(spark, tmp_path):
    from threading import Thread

    rows = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, tokens long")
    path, said = f"file://{tmp_path}/rollup", []
    writers = [Thread(target=lambda: said.append(token_rollup.TokenRollup(spark, path).commit("b", token_rollup.inserts(rows)))) for _ in range(4)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert sorted(said) == [False, False, False, True]
    assert [tuple(r) for r in token_rollup.TokenRollup(spark, path).totals().collect()] == [("a", "en", "t", 1, 5)]


def test_token_counts_of_the_query_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t, "en", [None, "a", "b"][k % 3]) for k, (i, t) in enumerate(ODD)] + [(9, "Hello, World!! it's déjà vu.", "en", "z"), (8, "", None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    first, want = {}, {}
    for i, t, _, _ in rows:
        if t is not None and i is not None:
            first[t] = min(i, first.get(t, i))
    for i, t, lang, source in rows:
        if t is None or i is None or i == first[t]:
            n, k = want.get((source, lang), (0, 0))
            want[source, lang] = n + 1, k + len(byte.encode(t or "").ids)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in queries.op3_token_counts(spark, str(tmp_path)).collect()}
    assert got == {(s, lang, "byte_bpe_50k"): v for (s, lang), v in want.items()}


def test_packed_pieces_against_brute_force(spark, docs):
    from tokenizers import Tokenizer

    plain, out = Tokenizer.from_file(TOKENIZER), packing.pack_documents(docs, TOKENIZER).collect()
    want = []
    for i, t in ODD:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    key = lambda r: (r[0] is None, *r[1:], r[0] or 0)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in out) // 4096)


def test_languages_held_out(spark):
    rng, rows = random.Random(10), []
    for lang, letters in (("en", "the and of water stone house river green"), ("de", "der und die wasser stein haus fluss grün")):
        for _ in range(150):
            rows.append((len(rows), " ".join(rng.choices(letters.split(), k=rng.randint(4, 60))), lang, "s", 0))
    df = spark.createDataFrame([*rows, (900, "12 34 !!", "en", "s", 0), (901, None, None, None, 0)], "doc_id long, text string, lang string, source string, score int")
    out = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and doc_id < 900").collect()
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert langid.identify(df.where("false")).count() == 0


def _invented(seed):
    """A language model of two invented languages, and a function that writes text in one of them."""
    rng = np.random.default_rng(seed)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(1500)] for lang, letters in (("en", "etaoinshrdlu"), ("de", "enisratdhulg"))}
    odds = 1 / np.arange(3, 1503)

    def text(lang, n):
        return " ".join(rng.choice(words[lang], n // 4, p=odds / odds.sum()))[:n]

    return langid.LanguageModel(("en", "de"), tuple(text(lang, 64_000).encode() for lang in ("en", "de"))), text


def test_predictions_are_the_smallest_sizes(spark):
    import zstandard

    model, text = _invented(20)
    rng = random.Random(21)
    rows = [(k, text("en" if k % 3 else "de", rng.randint(5, 30_000))) for k in range(40)] + [(50, "e\u0301te\u0301"), (51, "\u0301 1"), (52, "a"), (53, "Ä" * 5000)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sizes string"), model).collect()}
    for i, t in rows:
        plain = langid.letters(t)
        data, sizes = (" " + plain + " ").encode(), []
        for content in model.contents:
            how = zstandard.ZstdCompressionParameters.from_level(12, dict_size=len(content), source_size=4096, search_log=3, write_content_size=0, write_dict_id=0, write_checksum=0)
            zip_ = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            n = -(-len(data) // 4096)
            sizes.append(sum(len(zip_.compress(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n)))
        assert got[i] == ("und" if i == 51 else model.languages[int(np.argmin(sizes))])
    assert langid.letters("e\u0301te\u0301 2 X") == "été x"


def test_all_of_a_languages_sample_is_in_its_dictionary(spark):
    rows = [(k, f"{'abcdefghij'[k % 10] * 3} word{'xyz'[k % 3]} " * (3000 if k % 2 else 2), "long" if k % 2 else "short") for k in range(60)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True), dictionary_bytes=900)
    assert sorted(model.languages) == ["long", "short"]
    long, short = (model.contents[model.languages.index(n)].split(b"\n") for n in ("long", "short"))
    assert len(long) == len({t for _, t, lang in rows if lang == "long"}) and len({len(t) for t in long}) == 1 and sum(map(len, long)) > 850
    assert set(short) == {langid.letters(t).encode() for _, t, lang in rows if lang == "short"}
    assert langid.excerpts([b"aaaa", b"b", b"cccccc"], 7) == [b"aaa", b"b", b"ccc"] and langid.excerpts([], 5) == []


def test_all_parts_of_a_long_text_count(spark):
    model, text = _invented(13)
    rows = [(1, text("de", 30_000) + " " + text("en", 270_000)), (2, text("en", 30_000) + " " + text("de", 270_000))]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "de"}
    one, four = (np.diff(model.sizes()(text("en", n).encode()))[0] for n in (250_000, 1_000_000))
    assert 3 < four / one < 5  # the lead grows with the text


def test_clean_long_texts_stay_and_short_jumbles_go(spark):
    model, text = _invented(14)
    rng = random.Random(15)
    jumbles = [(k, " ".join("".join(rng.choices("etaoinshrdlugcwy", k=5)) for _ in range(10))) for k in range(10, 40)]
    df = spark.createDataFrame([(1, text("en", 5_000_000)), (2, text("de", 2_000_000)), (3, text("en", 300)), *jumbles], "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.drop_rejected(df, model).collect()}
    assert {1, 2, 3} <= kept and len(kept) <= 3 + 1  # one jumble of thirty may look like a word


def test_main_text_of_pages(spark):
    word = "plain words about a river and its stones, and more of them."
    html = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav><article><h1>A &amp; B</h1><p>{word}</p><p>{word} Again.</p></article><div class="comments"><p>nice post</p></div><footer>&copy; all rights</footer></body></html>'
    df = spark.createDataFrame([(1, "u", html, 0), (1, "u", html, 0), (None, None, None, 0), (3, "v", "", 0)], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in html_text.extract(df).collect()]
    want = f"A & B\n{word}\n{word} Again."
    assert sorted(got, key=str) == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_text.extract(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def node_model(spark):
    """Trained without tables that place columns and without bare elements."""
    page = spark.createDataFrame([(k, "u", f"<p>{' '.join(random.Random(k).choices(html_layouts._FILLER, k=90))}.</p>") for k in range(30)], "page_id long, url string, html string")
    seen = tuple(f for f in html_layouts.FAMILIES if f not in ("table", "bare"))
    return html_text.fit_nodes(page, training_pages=500, families=seen)


def _labelled_text(source):
    dom = html_text.Dom(source)
    keep = np.ones(len(dom.parent), bool)
    for k in range(1, len(keep)):
        keep[k] = keep[dom.parent[k]] and dom.facts[k][2] != "0"
    return html_text.kept_text(dom, keep)


def test_layouts_that_were_not_trained_on(node_model):
    from collections import Counter

    for family, least in (("table", 0.9), ("bare", 0.85)):
        rng, same, got, want = random.Random(23), 0, 0, 0
        for _ in range(80):
            page = html_layouts.training_page(rng, [], (family,))
            a, b = (Counter(t.split()) for t in (_labelled_text(page), html_text.texts_of([re.sub(r' data-lumaspec="\d"', "", page)], node_model)[0]))
            same, got, want = same + (a & b).total(), got + b.total(), want + a.total()
        assert same / got > least and same / want > least, (family, same / got, same / want)


def test_the_query_is_trees_and_decoding_page_by_page(spark, node_model):
    """Against a plain version: every tree walked node by node, the best choice by recursion."""
    rng = random.Random(24)
    pages = [re.sub(r' data-lumaspec="\d"', "", html_layouts.training_page(rng, [])) for _ in range(12)] + ["<p>" + "many words, " * 60_000 + "</p>", "x < y & z", "<div" * 200]

    def plain(source):
        dom = html_text.Dom(source)
        x, n = html_text.node_features(dom), len(dom.parent)
        odds = []
        for row in x:
            total = 0.0
            for (feature, threshold, left, right, value), weight in zip(node_model.trees, node_model.weights, strict=True):
                at = 0
                while feature[at] >= 0:
                    at = left[at] if row[feature[at]] <= threshold[at] else right[at]
                total += weight * value[at]
            odds.append(2 * total)
        odds = html_text.with_siblings(dom, np.array(odds))

        def text(odds):
            def best(k):
                return odds[k] + sum(max(0.0, best(c)) for c in range(k + 1, n) if dom.parent[c] == k)

            keep = [True] + [False] * (n - 1)
            for k in range(1, n):
                keep[k] = keep[dom.parent[k]] and best(k) > 0
            return html_text.kept_text(dom, np.array(keep))

        found = text(odds)
        return found or (text(odds + html_text.LENIENT) if sum(dom.own) > 2 * sum(dom.links) else "")

    df = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df, node_model).collect()}
    assert got == {k: (t, len(t)) for k, t in enumerate(map(plain, pages))}


def test_pipeline_stages_against_brute_force(spark):
    rng, words = random.Random(12), {"en": "the and of water stone house river green they with".split(), "de": "der und die wasser stein haus fluss grün nicht auch".split()}
    texts = [(lang, " ".join(rng.choices(words[lang], k=rng.randint(30, 60)))) for lang in words for _ in range(40)]
    rows = [(k, t, lang, rng.choice(["a", "b", None]), len(t)) for k, (lang, t) in enumerate(texts + texts[:10])] + [(500, None, None, None, 0), (501, "123", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(90))
    one = corpus_pipeline.ngram_jaccard(spark, kept, "")
    _, up = _components([r[:2] for r in rows[:90]], 5, 80)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted({up[i] for i in range(90)})
    mixed = corpus_pipeline.source_mixing(spark, one, "")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(one).collect()}
    taken = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == docs.columns and all(taken.count(i) == n for i, n in plan.items())
    packed = corpus_pipeline.best_fit_packing(spark, mixed, "").collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(taken)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "source_mixing", "best_fit_packing"]


def test_rows_of_any_columns_stand_for_their_component(spark):
    one = " ".join(f"a{k}" for k in range(60))
    rows = [(1, one, {"x": 1}, 0), (1, one, {"x": 1}, 0), (1, one + " b", {"y": 2}, 0), (2, one, None, 1), (3, "other words of its own here", {}, 2), (None, one, {"z": 1}, 3), (None, one, {"z": 1}, 3)]
    for some in (rows, [r for r in rows if r[0] != 1]):
        df = spark.createDataFrame(some, "doc_id long, text string, facts map<string,int>, row_ int")
        kept = jaccard.one_of_each(df)
        got = [(r["doc_id"], r["row_"]) for r in kept.collect()]
        assert kept.columns == df.columns and sorted(got, key=str) == sorted([(1, 0)] * (some == rows) + [(2, 1)] * (some != rows) + [(3, 2), (None, 3), (None, 3)], key=str)
    assert jaccard.one_of_each(df.where("false")).count() == 0


def test_texts_of_one_id_and_size_keep_their_own_copies(spark):
    one, two = ([f"{c}{k}" for k in range(100)] for c in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (5, " ".join([*one[:99], "x"])), (6, " ".join([*two[:99], "y"]))]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (1, 1), (5, 1), (6, 1)]


def test_rows_that_stay_are_not_joined(spark):
    texts = [" ".join(f"{c}{k}" for c in "abcdefgh") for k in range(60)]
    rows = [*((k, t, 0) for k, t in enumerate(texts)), (100, texts[7], 1), (None, texts[7], 2)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, id_ int"))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["id_"]) for r in kept.collect()) == [(-1, 2), *((k, 0) for k in range(60))]
    parts = kept._jdf.queryExecution().optimizedPlan().children()
    assert parts.size() == 2 and "LeftAnti" in parts.last().toString() and "broadcast" in parts.head().toString() and not any(k in parts.head().toString() for k in ("LeftSemi", "LeftAnti", "Inner"))
