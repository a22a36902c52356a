"""Lexical search, nearest-neighbour quality and spelling variants against
brute force, with the rows and names of test_operators."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import corpus, empty, frame
from wardstats.llm import neighbours
from wardstats.llm.hashing import Texts
from wardstats.llm.search import _best, rank_documents
from wardstats.llm.spelling import crc_of_runs, near_words, roots, variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------- 13 search

def ranked(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    N, L = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asks = {}
    for name, t in items:
        asks.setdefault(name, Counter()).update(terms(t))
    out = []
    for name, ask in asks.items():
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * N // max(L, 1)
            s = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in ask.items() if c[t])
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0, i))
        out += [(name, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, score int, rank int")


def test_search_matches_brute_force(spark):
    rows = corpus() + [(300 + i, "shared copy of a text") for i in range(30)] + [(None, "shared copy"), (11, "a-b_c MIT's straße")]
    items = [(1, rows[3][1][:400]), (2, "shared COPY copy of"), (3, None), (4, ""), (5, "--- !"), (6, "straße mit b é"), (2, "text of"), (None, "ka lo"), (7, "nowhere"), (8, rows[8][1])]
    got = rank_documents(frame(spark, rows), items_frame(spark, items), 5).collect()
    assert sorted([tuple(r) for r in got], key=str) == ranked(rows, items, 5)
    blocks = rank_documents(frame(spark, rows).repartition(5), items_frame(spark, items), 5, block_bytes=200).collect()
    assert sorted([tuple(r) for r in blocks], key=str) == ranked(rows, items, 5)


def test_search_of_nothing_and_string_ids(spark):
    assert rank_documents(empty(spark), items_frame(spark, [(1, "a")])).count() == 0
    assert rank_documents(frame(spark, corpus()), items_frame(spark, [])).count() == 0
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two")], "doc_id string, text string")
    got = rank_documents(docs, spark.createDataFrame([("q", "one")], "item_id string, text string")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


def test_best_keeps_ties_by_id():
    ids = np.array([5, 3, None, 9], object)
    assert sorted(_best(np.zeros(4, int), np.array([7, 7, 7, 8]), ids, 3).tolist()) == [0, 1, 3]


# ----------------------------------------------------------- 12 neighbours

def labelled(seed=4):
    """Prose is good, repeated words, marks and capitals are bad."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(pool) for _ in range(rng.randint(30, 120))]
        if i % 4 == 0:
            w = [x + rng.choice(("###", "%%%")) for x in w]
        elif i % 4 == 1:
            w = [x for x in w[:6] for _ in range(15)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 > 1)))
    return rows, labels


def test_votes_of_held_out_rows(spark):
    rows, labels = labelled()
    teach = spark.createDataFrame([x for x in labels if x[0] % 5] + [(7, None), (None, 1), (8, 4)], "doc_id long, quality int")
    odd = [(900, None), (901, ""), (902, "x" * 5_000), (903, "ab " * 30_000), (12, rows[12][1])]
    got = neighbours.judge(frame(spark, rows + odd), neighbours.fit(frame(spark, rows), teach)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5) == bool(labels[r.doc_id][1]) for r in got if r.doc_id < 400 and r.doc_id % 5 == 0]
    assert np.mean(held) > 0.95
    assert len({r.score for r in got if r.doc_id == 12}) == 1
    assert neighbours.judge(empty(spark), neighbours.fit(empty(spark), teach)).count() == 0
    none = neighbours.judge(frame(spark, rows[:3]), neighbours.fit(frame(spark, rows), teach.limit(0))).collect()
    assert [r.score for r in none] == [0.5] * 3


def test_vote_is_that_of_the_exact_nearest():
    rng = np.random.default_rng(2)
    known = rng.normal(size=(300, 8)).astype(np.float32)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 300).astype(np.float32)
    asked = np.concatenate([known[:5], rng.normal(size=(600, 8)).astype(np.float32), np.zeros((1, 8), np.float32)])
    v = neighbours.Voters(np.zeros((1, 8), np.float32), known, labels, 0.25, 7)
    got = v.vote(asked)
    for x, score in zip(asked, got):
        near = np.round(x @ known.T, 5)
        least = sorted(near)[-7]
        w = np.where((near >= least) & (near > 0), near, 0)
        assert score == pytest.approx((w * labels).sum() / w.sum() if w.sum() else 0.25, abs=1e-4)


def test_singular_vectors_are_those_of_the_dense_matrix():
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 40)) * (rng.random((60, 40)) < 0.9)
    of, at = np.nonzero(dense)
    got = neighbours.singular_vectors(60, of, at, dense[of, at], 40, 3)
    want = np.linalg.svd(dense)[2][:3].T
    assert np.abs(np.abs((got * want).sum(0)) - 1).max() < 1e-2
    assert np.allclose(neighbours.product(60, of, at, dense[of, at], got), dense @ got)


def test_terms_do_not_depend_on_the_batch():
    texts = ["Ab ab 12 !!", None, "", "ab", "x\nx\nx y", "é É 5"]
    whole = neighbours.weighted_terms(Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = neighbours.weighted_terms(Texts(pa.array([t], pa.string())))
        mine = whole[0] == i
        assert sorted(zip(whole[1][mine], whole[2][mine])) == sorted(zip(*alone[1:]))


# ------------------------------------------------------------- 11 spelling

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return any(a[i + x:] == b[i + y:] for x, y in (((1, 1),) if len(a) == len(b) else ((1, 0), (0, 1))))


def spelled(rows, least, at_least, slip):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= at_least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(((-n[x], x) for x in near[w]), default=(0, None)) for w in n}
    form = {w: x if -c >= 2 * n[w] else None for w, (c, x) in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def spelling_rows():
    rng = random.Random(9)
    base = ["hospital", "ward", "straße", "résumé", "aaaaa", "aaaaaa", "abababab", "nursing", "patient", "×÷×÷×", "x" * 300]
    rows = []
    for i in range(120):
        w = []
        for _ in range(60):
            x = rng.choice(base[:rng.randint(1, len(base))])
            if rng.random() < 0.2:
                j = rng.randrange(len(x))
                x = rng.choice((x[:j] + x[j + 1:], x[:j] + rng.choice("abé") + x[j:], x[:j] + rng.choice("abé") + x[j + 1:]))
            w.append(x.upper() if rng.random() < 0.1 else x)
        rows.append((i, rng.choice((" ", ", ", "-")).join(w)))
    return rows + [(None, "hospital hospitol"), (500, None), (501, ""), (502, "λογος hospital日本 hospital"), (3, rows[3][1])]


@pytest.mark.parametrize("most_pairs", [1 << 12, 2])
def test_variants_match_brute_force(spark, most_pairs):
    rows = spelling_rows()
    got = variants(frame(spark, rows), 5, 3, slip=7, most_pairs=most_pairs).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == spelled(rows, 5, 3, 7)
    plain = variants(frame(spark, corpus()), 5, 3, most_pairs=most_pairs).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in plain) == spelled(corpus(), 5, 3, None)


def test_variants_of_nothing(spark):
    assert variants(empty(spark)).count() == 0
    assert variants(frame(spark, [(1, "one two"), (2, None)])).count() == 0


def test_one_head_of_many_words_tries_few_pairs(spark):
    rng = random.Random(1)
    words = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)}
    counted = spark.createDataFrame([(w, rng.randint(3, 99)) for w in sorted(words)], "word string, n long")
    got = near_words(counted, 5, 64).select("word", "near").collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("side", "w005")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w037"} and len(got) == 38


def test_crc_of_runs():
    data = np.frombuffer("aé" .encode() * 100, np.uint8)
    start, end, seed = np.array([0, 5, 3, 7, 7]), np.array([300, 6, 90, 7, 71]), np.array([zlib.crc32(b"7:"), 0, 5, 9, 1], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seed)]
    assert crc_of_runs(data, start, end, seed).tolist() == want
