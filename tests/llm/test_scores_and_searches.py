"""Hard negatives, language-model scores and ranked search against plain versions."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.llm import bloom_lm, lexical, multi_index

TEXTS = ["The river, the stone.", "the  RIVER\tand\nthe house", "", None, "Ünder the Über-stone 42", "the " * 3000 + "end", "x", "the river and the stone", "Σ ÀB a1b2 ab"]


@pytest.fixture(scope="module")
def docs(spark):
    rng, words = np.random.default_rng(3), [f"w{k}" for k in range(60)] + ["the"] * 30
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, "the river"), (None, None)]
    rows += [(100 + k, " ".join(rng.choice(words, rng.integers(1, 40)))) for k in range(150)]
    return rows, spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], "doc_id long, text string, score double, `n.tokens` string").repartition(3)


def _tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def _plain_scores(rows, how):
    train = [_tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = [Counter(), Counter(), Counter()]
    for t in train:
        whole = ["^", *t]
        counts[0].update(t)
        counts[1].update(zip(whole, t))
        counts[2].update(zip(whole, whole[1:], whole[2:]))
    total, kinds = sum(counts[0].values()), len(counts[0])
    level = lambda c: 1 + math.floor(math.log(c) / math.log(how.base) + 1e-9)
    alike = {}
    for c in range(1, 20_000):
        alike.setdefault(level(c), []).append(c)
    about = lambda c: sum(alike[level(c)][:: len(alike[level(c)]) - 1 or 1][:2]) / min(2, len(alike[level(c)])) if c else 0.0

    def score(t):
        out, whole = 0.0, ["^", *t]
        for k, w in enumerate(t):
            p = (about(counts[0][w]) + 1) / (total + kinds + 1)
            v = whole[k]
            for seen, context in ((counts[1][v, w], len(train) if v == "^" else about(counts[0][v])), (counts[2][whole[k - 1], v, w] if k else 0, about(counts[1][whole[k - 1], v]) if k else 0.0))[: how.order - 1]:
                p = (about(seen) + how.prior * p) / (max(context, about(seen)) + how.prior)
            out += math.log10(p)
        return out

    out = Counter()
    for i, text in rows:
        t = _tokens(text)
        base = sum(math.log10((counts[0][w] + 1) / (total + kinds + 1)) for w in t)
        out[i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(t), sum(counts[0][w] > 0 for w in t), total, round(base, 6), round(score(t), 6)] += 1
    return out


@pytest.mark.parametrize("how", [bloom_lm.LogFilter(bits=60, probes=14, prior=7.0), bloom_lm.LogFilter(order=3, bits=60, probes=14, bucket_bytes=1 << 9, segment_bytes=1 << 12), bloom_lm.LogFilter(order=1, base=2.0, bits=60, probes=14)])
def test_scores_are_those_of_the_counts(docs, how):
    rows, df = docs
    got = bloom_lm.language_scores(df, how)
    assert bloom_lm.fit_model(df, how).segments > 1 or how.order != 3
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got.collect()) == _plain_scores(rows, how)


def test_a_common_words_count_is_found_level_by_level(spark):
    how = bloom_lm.LogFilter()
    df = spark.createDataFrame([(k, "often " * 500 + f"seldom{k}") for k in range(40)], "doc_id long, text string")
    model = bloom_lm.fit_model(df, how)
    part = model.segment(0)
    names, _ = bloom_lm.words_of(["often seldom7 never"])
    assert bloom_lm.probed(names[:3], part, how, model.buckets).tolist() == [how.levels(np.array([20_000]))[0], 1, 0]
    fresh, _ = bloom_lm.words_of([" ".join(f"new{k}" for k in range(5000))])
    assert (bloom_lm.probed(fresh[:-1], part, how, model.buckets) > 0).mean() < 0.03
    cycle = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 50}" for j in range(200))) for k in range(40)], "doc_id long, text string")
    held = bloom_lm.language_scores(cycle).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]  # where words follow each other, pairs tell more


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bloom_lm.language_scores(none).count() == 0
    row = bloom_lm.score_texts(spark.createDataFrame([(5, "a b")], "doc_id long, text string"), bloom_lm.fit_model(none)).first()
    assert tuple(row) == (5, False, 3, 0, 0, 0.0, 0.0)


def _plain_search(rows, items, k=10):
    parse = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    found = [(i, Counter(parse(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(parse(t))
    for item, words in asked.items():
        scored = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, item_terms", [(1 << 22, 1 << 20), (50, 4)])
def test_search_against_scoring_every_document(spark, docs, block, item_terms):
    rows, df = docs
    items = [(0, "the river!"), (1, "w1 w2 W3 the the"), (2, None), (3, "..."), (4, "zzz"), (None, "stone ünder"), (5, "w5"), (5, "w6 w7"), (5, "w5"), (6, " ".join(f"w{k}" for k in range(60)) + " the"), (7, "à àb ÀB a1b2 σ Σ 42")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = lexical.rank(df, asked, block=block, item_terms=item_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted((tuple(r) for r in got.collect()), key=str) == _plain_search(rows, items)


def test_search_of_nothing(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(empty, items).count() == lexical.rank(docs[1], items.where("false")).count() == lexical.rank(empty, items.where("false")).count() == 0


def test_accumulators_end_and_the_first_k_are_exact():
    rng = np.random.default_rng(8)
    fewer = 0
    for _ in range(60):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists = []
        for share, most in zip(np.sort(rng.random(8)), (900, 500, 300, 100, 50, 20, 5, 1), strict=True):
            docs = np.flatnonzero(rng.random(n) < share**3)
            lists.append((docs, rng.integers(0, most, len(docs))))
        want = np.zeros(n, np.int64)
        for docs, gain in lists:
            want[docs] += gain
        some, score, made = lexical.accumulate(lists, n, k)
        assert (score == want[some]).all()
        met = np.unique(np.concatenate([d for d, _ in lists]))
        best = sorted(((-want[d], d) for d in met))[:k]
        assert sorted(zip(-score, some, strict=True))[:k] == best and made <= len(met)
        fewer += made < len(met)
    assert fewer > 20  # most of these lists stop making accumulators


def _plain_negatives(rows, k=5, m=10):
    fit = {(i, c, tuple(v)) for i, v, c in rows if None not in (i, v, c) and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, q in fit:
        if a % 100:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(q, v, strict=True)), i, c) for i, c, v in fit if i != a and len(v) == len(q))
        for s, p, c in [x for x in scored if x[2] == label][:k]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(-30, 30, (6, 8))
    rows = [(k, [float(x) for x in centres[k % 6] + rng.integers(-9, 10, 8)], int(rng.integers(0, 4))) for k in range(900)]
    rows += [(1000 + k, rows[0][1], 1 + k % 3) for k in range(60)] + [rows[0], rows[100]]  # one vector many times, and repeated rows
    rows += [(2000, None, 1), (2100, [1.0, None] * 4, 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] * 8, 2), (2400, [0.0] * 8, 1), (2401, [0.0] * 8, 2), (2402, [0.0] * 8, 1), (2500, [3.0] * 8, None), (None, [3.0] * 8, 1), (2600, [], 1)]
    rows += [(3000 + k, [float(k % 7), 5.0, 2.0], k % 2) for k in range(40)] + [(4000, [1e9] * 8, 0), (4001, [1e9] * 7 + [-1e9], 0), (4002, [5e8] * 8, 1), (4003, [5e8 + 1] * 8, 1)]
    return rows, spark.createDataFrame([(i, v, c, k) for k, (i, v, c) in enumerate(rows)], "vec_id long, embedding array<double>, label int, `key` int").repartition(3)


@pytest.mark.parametrize("options", [{}, {"first": 1, "growth": 2, "block": 16}])
def test_negatives_against_comparing_all(vectors, options):
    rows, df = vectors
    got = multi_index.hard_negatives(df, "vec_id % 100 = 0", **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _plain_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len({w[0] for w in want}) > 9


def test_no_anchors_no_negatives(vectors):
    assert multi_index.hard_negatives(vectors[1].where("false"), "vec_id % 100 = 0").count() == 0
    assert multi_index.hard_negatives(vectors[1], "vec_id = -1").count() == 0


def test_cells_come_by_falling_bounds_and_few_are_visited(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 16)) * 40
    x = np.round(centres[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 3)
    classes = spark.createDataFrame([(str(k), k % 3, v.tolist(), [k]) for k, v in enumerate(x)], "key string, label long, v array<double>, ids array<long>")
    index = multi_index.build(classes, sample=500)
    codes, cell = index.codes[16], np.full(4000, -1)
    for r in index.rows.select("ids", "cell").collect():
        cell[r["ids"][0]] = r["cell"]
    assert (cell >= 0).all()
    for q in x[:20]:
        came = list(codes.visits(q))
        assert sorted(c for c, _ in came) == sorted(set(cell.tolist())) and all(a[1] >= b[1] for a, b in zip(came, came[1:]))
        score = x @ q
        assert all(score[cell == c].max() <= bound for c, bound in came)
    window = F.array(F.struct(F.lit(-(2**62)).alias("lo"), F.lit(2**62).alias("hi")))
    got = multi_index.search(index, classes.where("key = '7'").withColumn("windows", window), 3, True, first=1, growth=2).orderBy("nth").collect()
    want = sorted((-int(s), k) for k, s in enumerate(x @ x[7]) if k % 3 == 1)[:3]
    assert [(-r["score"], r["vec_id"]) for r in got] == want
    third, visited = -want[2][0], 0
    for _, bound in codes.visits(x[7]):
        visited += bound >= third
    assert visited < len(codes.cells) / 2  # the window is certified before most cells


def test_adding_up_counts_takes_little_memory():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 1 << 64, 1 << 20, np.uint64)
    parts = [(names[: 1 << 19], np.full(1 << 19, 2)), (names, np.ones(1 << 20, np.int64))]
    tracemalloc.start()
    h, n = bloom_lm._summed(parts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 1 << 20 and dict(zip(h.tolist(), n.tolist())) == dict(zip(names.tolist(), [3] * (1 << 19) + [1] * (1 << 19)))
    assert most < 64 << 20, most


def test_names_are_probed_no_longer_than_they_last():
    class Counting(bloom_lm.LogFilter):
        asked = 0

        def place(self, z, k, size):
            Counting.asked += len(z)
            return super().place(z, k, size)

    how, rng = Counting(), np.random.default_rng(5)
    names = np.unique(rng.integers(1, 1 << 62, 6000, np.uint64) & ~np.uint64(3) | np.uint64(1))
    old, fresh, on = names[::2], names[1::2], np.zeros(5 * 10 * len(names), bool)
    for q in range(1, 6):
        for k in range(how.probes):
            on[how.place(how.event(old, q), k, len(on))] = True
    part = np.packbits(on), np.zeros(1, np.int64), np.array([len(on)])
    Counting.asked = 0
    levels = bloom_lm.probed(fresh, part, how, 1)
    assert (levels > 0).mean() < 0.03 and Counting.asked < 3 * len(fresh)
    both = rng.permutation(names)
    plain = bloom_lm.probed(both, part, how, 1)
    assert (plain[np.isin(both, old)] >= 5).all()
    Counting.asked = 0
    assert (bloom_lm.probed(both, part, how, 1, known=(old, bloom_lm.probed(old, part, how, 1))) == plain).all()
    Counting.asked = 0
    assert len(bloom_lm.probed(old, part, how, 1, known=(old, np.full(len(old), 5, np.uint8)))) == len(old) and Counting.asked == 0
