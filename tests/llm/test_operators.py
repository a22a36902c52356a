"""The ten operators and the pipeline against brute force, on small frames with
nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns whose names the operators use inside."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstats.llm import html
from wardstats.llm.brown import likeliest, log_probabilities
from wardstats.llm.decontaminate import best_overlaps, best_run, without_contaminated
from wardstats.llm.graph import components
from wardstats.llm.jaccard import choose_matches, near_duplicates
from wardstats.llm.licenses import NOTICES, scan, scan_spans
from wardstats.llm.packing import combinations, fullest, minimum_bin_slack, token_pieces
from wardstats.llm.phrases import digest, repeated_bytes
from wardstats.llm.quality import filter_quality, judge_quality, learn
from wardstats.llm.toxicity import fit, pair_gain, toxicity
from wardstats.llm.urls import RULES, judge_urls

WORDS = [a + b for a in ("ka", "lo", "mi", "ré", "tu", "sha", "on") for b in ("n", "st", "ra", "vi", "", "del", "ß")]
#: Names that the operators use for columns of their own.
CLASH = ("row", "chunk", "cls", "n", "token", "bucket", "_q", "_kept", "_bad", "_id", "w", "key", "seed", "length", "rank")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ".", ",")) for _ in range(n))


def corpus(seed=3):
    """(doc_id, text) with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 6, 40, 60, 90, 120, 200, 15, 300)]
    passage = prose(rng, 60)
    rows = [(10 + i, t) for i, t in enumerate(base)]
    rows += [(30, base[4]), (31, base[4].upper()), (5, base[5])]
    for k in range(12):  # near copies, some of them past the threshold
        w = base[6].split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((40 + k, " ".join(w)))
    rows += [(60 + k, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 30)) for k in range(4)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "One"), (75, "a b c d"), (76, "a b c d")]
    rows += [(80, prose(rng, 20_000)), (81, "x" * 5_000), (82, "ab " * 2_000)]
    rows += [(11, base[1]), (90, "é" * 80), (91, "ñé" + "é" * 80)]
    return rows


def frame(spark, rows, extra=True):
    cols = "doc_id long, text string" + "".join(f", `{c}` string" for c in CLASH) * extra
    return spark.createDataFrame([(*r, *(["?"] * len(CLASH) if extra else [])) for r in rows], cols)


def empty(spark):
    return frame(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ------------------------------------------------------------ 1 licenses

def test_licenses_match_brute_force(spark):
    rows = corpus() + [(200, "Released under the MIT License. Apache-License; CC BY-NC 4.0, mit license"), (201, "cc"), (202, "MIT LİCENSE"),
                       (203, NOTICES[0][0].replace("and or modify", "and or else modify")), (None, "gnu general public license")]
    got = scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, x) for p, x in phrases.items() for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min([j for j, _ in at], default=None), max([j for j, _ in at], default=None), ",".join(sorted({x for _, x in at}))))
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(want, key=key)
    rows = by_id(scan(frame(spark, rows)))
    assert rows[200].labels == "apache,cc-by,cc-by-nc,mit" and rows[200].score == 1
    assert "gpl" in rows[203].labels and rows[203].score > 0.9  # one word put in: neighbouring diagonals
    assert rows[70].score == 0 and rows[70].labels == ""
    assert scan(empty(spark)).count() == 0


def test_license_notices_are_told_apart(spark):
    text = {label: t for t, label in NOTICES}
    pieces = text["gpl"].split()
    scattered = " ".join(" ".join(pieces[i:i + 3]) + " foreign words" for i in range(0, len(pieces), 3))
    rows = [(1, text["gpl"]), (2, text["lgpl"]), (3, scattered), (4, text["gpl"] + " " + text["lgpl"]), (5, text["mit"] + " " + text["isc"]),
            (6, text["lgpl"].replace("modify it", "then modify it")), (7, " ".join([text["gpl"]] * 3)), (8, text["apache"].replace("version 2 0", "version two"))]
    got = {k: r.labels for k, r in by_id(scan(frame(spark, rows))).items()}
    assert got == {1: "gpl", 2: "lgpl", 3: "", 4: "gpl,lgpl", 5: "isc,mit", 6: "lgpl", 7: "gpl", 8: "apache"}
    far = "word " * 6000 + text["gpl"]  # a diagonal whose order needs more than 32 bits
    assert by_id(scan(frame(spark, [(9, far)])))[9].labels == "gpl"
    spans = scan_spans(frame(spark, rows[6:7])).where("kind = 'notice'").orderBy("first_word").collect()
    assert [(r.label, r.first_word) for r in spans] == [("gpl", i * len(pieces)) for i in range(3)]


# ------------------------------------------------------- 2 decontamination

def test_decontamination_finds_substituted_passages_only(spark):
    rng = random.Random(5)
    item, other, short = prose(rng, 40), prose(rng, 25), "alpha beta gamma"
    w = item.split()
    swapped = [("zzz" if i % 6 == 5 else x) for i, x in enumerate(w)]
    docs = [(1, prose(rng, 50) + " " + item + " " + prose(rng, 10)), (2, " ".join(swapped)), (3, prose(rng, 30) + " " + " ".join(w[10:16])), (4, " ".join(w[5:25])),
            (5, "x alpha BETA, gamma y"), (6, "alpha beta delta gamma"), (7, None), (8, ""), (9, prose(rng, 20_000)), (1, item), (None, item), (10, item + " " + other)]
    bench = spark.createDataFrame([(100, item, 1), (101, other, 1), (102, short, 1), (103, None, 1), (None, other, 1), (104, "", 1)], "item_id long, text string, seed int")
    got = best_overlaps(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 100), (2, 100), (4, 100), (5, 102), (10, 100), (10, 101)}
    assert next(r for r in got if r.doc_id == 4)[2:] == (0, 5, 20, 20, 40)
    kept = without_contaminated(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "6", "7", "8", "9"]
    assert best_overlaps(empty(spark), bench).count() == 0 and best_overlaps(frame(spark, docs), bench.limit(0)).count() == 0


def test_best_run_is_the_longest_dense_one():
    rng = random.Random(1)
    for _ in range(300):
        x = np.array([rng.random() < 0.6 for _ in range(rng.randrange(0, 14))], bool)
        a, b = best_run(x, 0.75)
        runs = [q - p for p in range(len(x)) for q in range(p + 1, len(x) + 1) if x[p] and x[q - 1] and x[p:q].sum() >= 0.75 * (q - p)]
        assert b - a == max(runs, default=0)


# ------------------------------------------------------------ 3 Jaccard

def sets_of(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(9)
    rows = corpus()
    tree = [rows[7][1].split()]  # drifting copies: links chain far from the first
    for k in range(40):
        w = list(rng.choice(tree[-4:]))
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        tree.append(w)
    rows += [(300 + k, " ".join(w)) for k, w in enumerate(tree)]
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(i, low.get(find(a), i))
    want = sorted((i, len(s), low[find(a)] if s else i) for a, (i, s) in enumerate(sets))
    assert sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect()) == want
    assert near_duplicates(empty(spark)).count() == 0
    lone = near_duplicates(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert {r.component_id for r in lone} == {4}


def test_prefixes_lengthen_with_frequent_shingles():
    assert choose_matches(np.full(50, 0.001), 10) == 1
    assert choose_matches(np.full(50, 500.0), 10) == 4
    assert choose_matches(np.full(3, 500.0), 3) == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(5, 5)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 7 for k in range(200, 240)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---------------------------------------------------------------- 4 urls

def test_urls_rules_and_propagation(spark):
    pages = [(1, "http://a.com/x?q#f", '<a href="http://B.org:80/1">'), (2, "http://b.org/1", "<a href=//u@c.org/z>"), (3, "http://c.org/", ""), (4, "http://n.net/es/", ""),
             (5, "HTTP://N.net/fr/2", ""), (6, "http://n.net/en/", None), (7, "http://l.org/q", '<a href="https://n.net/es/"><a href="https://n.net/fr/">'), (8, None, None),
             (None, "http://www.example.com/en/", None), (9, "no scheme", "x"), (9, "ftp://d.example.com/en/?http://z", None), (10, "x://xcom/", None), (11, "http://a.com", None)]
    df = spark.createDataFrame([(*p, "?") for p in pages], "page_id long, url string, html string, rule string")
    got = sorted(judge_urls(df).collect(), key=lambda r: (str(r.page_id), r.host))
    for r in got:
        url = next(u for i, u, _ in pages if i == r.page_id and (u or "").lower().partition("://")[2].startswith(r.host or "\0") or i == r.page_id and not r.host)
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [x for x, _ in RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits, key=len, default=None))
        if fits:
            assert r.verdict == dict(RULES)[r.rule]
    verdict = {r.page_id: r for r in got if r.page_id not in (None, 9)}
    assert [verdict[k].verdict for k in (2, 3, 6, 7, 8, 10, 11)] == ["allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert verdict[2].trust == pytest.approx(0.85 * 0.5) and verdict[7].distrust == pytest.approx(0.85 * 2 / 3)
    assert judge_urls(df.limit(0)).count() == 0


# ----------------------------------------------------------------- 5 LM

def test_language_model_base_and_sum(spark):
    rows = corpus()
    held = {i for i, _ in rows if i % 5 == 0}
    got = log_probabilities(frame(spark, rows), F.expr("doc_id % 5 = 0"), classes=4, sweeps=2).collect()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    count = Counter(x for i, w in tokens if i not in held for x in w)
    n, v = sum(count.values()), len(count)
    want = sorted((i, i in held, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    # after any word, all known words, the unseen word and the end have probability 1 together

    train = [(1, "a b a c"), (2, "b a d d"), (3, "c c a")]
    probes = [(100 + k, f"{x} {y}") for k, (x, y) in enumerate(itertools.product("abcdz", "abcdz"))] + [(200 + k, x) for k, x in enumerate("abcdz")] + [(300, None)]
    score = {r.doc_id: r.score for r in log_probabilities(frame(spark, train + probes), F.expr("doc_id >= 100"), classes=2, sweeps=2).collect()}
    text = dict(probes)
    p = {t: 10 ** score[i] for i, t in text.items()}
    total = p[None] + sum(p[x] for x in "abcdz")  # texts of no and one word
    assert 0.3 < total < 1 and all(0 < x < 1 for x in p.values())
    assert log_probabilities(empty(spark), F.lit(False)).count() == 0


def test_language_model_learns_nothing_from_held_out_texts(spark):
    rng = random.Random(11)
    vocabulary = [a + b for a in WORDS[:20] for b in ("x", "y", "z")]
    texts = {i: " ".join(rng.choices(vocabulary, range(60, 0, -1), k=80)) for i in range(30)}

    def scores(other):
        rows = spark.createDataFrame([*texts.items(), (99, other)], "doc_id long, text string")
        return {r["doc_id"]: r["score"] for r in log_probabilities(rows, F.col("doc_id") >= 25).collect() if r["doc_id"] != 99}

    assert scores(" ".join(vocabulary[-20:] * 200)) == pytest.approx(scores("one"), abs=1e-9)


def test_likeliest_takes_the_matching_distribution():
    centers = np.zeros((2, 32))
    centers[0, 0], centers[1, 5] = 50, 50
    x = np.zeros((2, 32))
    x[0, 5], x[1, 0] = 3, 3
    assert likeliest(x, centers).tolist() == [1, 0]


def test_classes_follow_the_classes_beside_them(spark):
    rng = random.Random(6)
    sides = [[f"{x}{i}" for i in range(300)] for x in "abc"]
    rows = [(i, " ".join(rng.choice(sides[j % 3]) for j in range(300))) for i in range(60)]
    got = log_probabilities(frame(spark, rows), F.expr("doc_id >= 50"), classes=3, sweeps=6).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert got > math.log10(1 / 500)  # 1/300 if all words are told apart, 1/900 if none is


# ------------------------------------------------------------- 6 quality

def test_quality_statistics_match_brute_force(spark):
    rows = corpus() + [(300, "a b c\n\n x \na b c\n x\n" * 30), (301, "# $ | <x> a&b%" * 9), (302, "p q r s p q r t p q")]
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = judge_quality(frame(spark, rows), labels).selectExpr("row.doc_id", "row.text", "_q.*", "_base_failed", "_kept").collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j in range(len(w) - 2) if seen[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cover)), r.doc_id
        assert r._base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and r._kept == (not r._base_failed)
    assert filter_quality(empty(spark), labels).count() == 0


def test_decision_list_learns_conjunctions_and_filters(spark):
    rng = random.Random(4)
    rows = [{"a": rng.random(), "b": rng.random(), "c": rng.random()} for _ in range(1500)]
    for r in rows:
        r["bad"] = int(r["a"] > 0.8 and r["b"] < 0.5 or r["c"] > 0.9)
    rules = learn(rows, ["a", "b", "c"])
    caught = lambda r: any(all(r[f] <= t if op == "<=" else r[f] >= t for f, op, t in rule) for rule in rules)
    assert sum(caught(r) != r["bad"] for r in rows) < 30
    assert learn([dict(r, bad=0) for r in rows], ["a"]) == [] and learn([], ["a"]) == []
    docs = [(i, prose(rng, 80) + (" $$$ ###" * 30 if i % 4 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(80)], "doc_id long, quality int")
    kept = filter_quality(frame(spark, docs), labels)
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 4}


# --------------------------------------------------------------- 7 html

PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header class="site"><a href="/">Home</a> Name</header>
<nav><a href=1>One</a><a href=2>Two</a></nav><div class="cookie-notice">We use cookies to make it good.</div>
<div id="content"><h1>Real &amp; title</h1><p>First paragraph of the story&nbsp;with quite a few words in it.</p><!-- <p>hidden</p> -->
<p>Second<br>line <b>bold</b> &eacute;t&eacute;.<p>Third one here<div class="advert">Buy now</div><form>Name <input><button>Go</button></form></div>
<aside>Related: <a href=x>other</a></aside><section id="comments"><h3>Comments</h3><p>Bob said: what a nice story I like this page.</p><p>More of it from Ann.</p></section>
<footer>&copy; 2020</footer></body></html>"""
ARTICLE = "<html><body><nav><ul><li><a href=/a>a</a></li><li><a href=/b>b</a></li></ul></nav><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article><footer>(c) site</footer></body></html>"


def test_html_main_text(spark):
    rng = random.Random(8)
    pages = [(i, "u", ARTICLE.format(prose(rng, 5), prose(rng, 30), prose(rng, 60))) for i in range(30)]
    odd = [(100, "u", PAGE), (101, None, None), (102, "u", ""), (103, "u", "<"), (104, "u", "plain text only"), (None, "u", pages[0][2]), (105, "u", "<div>" * 3000 + "deep" + "<p>"), (106, "u", "<article><p>cut &am")]
    df = spark.createDataFrame([(*p, "?") for p in pages + odd], "page_id long, url string, html string, text string")
    got = html.main_text(df, html.fit(df)).collect()
    assert len(got) == len(pages) + len(odd)
    text = {r.page_id: r.text for r in got}
    assert text[100] == "Real & title\nFirst paragraph of the story with quite a few words in it.\nSecond line bold été.\nThird one here"
    for i, _, h in pages:
        parts = re.findall("<(?:h1|p)>(.*?)</", h)
        assert text[i] == "\n".join(" ".join(x.split()) for x in parts)
    assert text[101] == text[102] == "" and text[None] == text[0] and text[106] == "cut &am"
    assert html.main_text(df.limit(0), html.Model({})).count() == 0


@pytest.mark.parametrize("opening", ['<div id="content" class="post no-sidebar">', '<article class="post has-comments">'])
def test_html_believes_no_single_boilerplate_name(opening):
    parts = [prose(random.Random(i), 40) for i in range(4)]
    page = f"<body><div class=nav><a href=/>Home</a></div>{opening}" + "".join(f"<p>{p}</p>" for p in parts) + opening.replace("<", "</").split()[0] + "></body>"
    assert html.Model({}).text(page) == "\n".join(parts)
    assert -8 < html.Model({("named:boiler", 0, 0): 10**6, ("label", 0, 0): 10**6}).unary["named:boiler"] < 0
    learned = {("named:boiler", 1, 0): 10**6, ("label", 1, 0): 10**6}
    assert html.Model(learned).unary["named:boiler"] > html.Model({}).unary["named:boiler"]


def test_html_drops_only_what_it_lists():
    words = [prose(random.Random(i), 40) for i in range(4)]
    blocks = lambda h: [t for _, t in html.parse(h)[1]]
    assert blocks("<p>a <script>x</script><math><mi>b</mi></math> <svg><path d=x></svg><object>c</object> <button>d</button> <label>e</label></p>") == ["a b c d e"]
    for tag in ("svg", "math", "object", "audio", "video", "canvas", "template"):
        assert " ".join(blocks(f"<p>one</p><{tag}><p>two</p><p>three</p>")) == "one two three"
    for tag in ("script", "style", "textarea", "title"):
        assert blocks(f"<p>one</p><{tag}><p>two</p>") == ["one"]
    assert blocks("<dialog><p>one</p></dialog><p>two</p>") == ["one", "two"]
    body = "".join(f"<p>{w}</p>" for w in words)
    assert html.Model({}).text(f"<body><form action=x>{body}<input name=q></form></body>") == "\n".join(words)
    assert html.Model({}).text(f"<body><form><main>{body}</main></form></body>") == "\n".join(words)
    assert blocks(f"<body>{body}<form><p>Name</p><button>Go</button></form></body>") == words


def test_marginals_are_exact():
    nodes, _ = html.parse("<div><p>some words here</p><ul><li><a>x y</a></li></ul></div><div class=ad>buy</div>")
    model = html.Model({})
    model.unary["named:boiler"] = -2.0
    words, linked = html._totals(nodes)
    weight = np.zeros((len(nodes), 2))
    total = np.zeros(len(nodes))
    z = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        p = math.exp(sum(y * sum(model.unary.get(f, 0.0) for f in html.features(n, words[i], linked[i])) for i, (n, y) in enumerate(zip(nodes, labels))))
        for i in range(1, len(nodes)):
            p *= model.pair[html.place(nodes[nodes[i].parent])][labels[nodes[i].parent]][labels[i]]
        z += p
        total += p * np.array(labels)
    assert np.allclose(model.marginals(nodes), total / z)


# ------------------------------------------------------------ 8 packing

def test_packing_is_gapless_and_complete(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus() + [(400, "It's <|endoftext|> don't e\u0301 \u0301x AT&T's 3rd"), (401, "<|ENDOFTEXT|> A.b,C!d'S \u00a0x\u2003y"), (None, "null id")]
    pieces = minimum_bin_slack(token_pieces(frame(spark, rows), 64), 64).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k:k + 64]), zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in pieces) / 64) + 1
    assert minimum_bin_slack(token_pieces(empty(spark), 64), 64).count() == 0


def test_fullest_matches_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 50)
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = fullest(counts, room)
        assert sum(got) == best and not Counter(got) - Counter(items)
    done = Counter()
    histogram = {rng.randrange(1, 101): rng.randrange(1, 1000) for _ in range(60)}
    for uses, times in combinations(histogram, 100):
        assert sum(x * n for x, n in uses.items()) <= 100
        for x, n in uses.items():
            done[x] += n * times
    assert done == Counter(histogram)


# ----------------------------------------------------------- 9 toxicity

def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(900):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = prose(rng, 20).split() + ["grumbler"] * insult + ["neighbours"] * group + ["dreadful"] * (i % 9 == 0)
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(insult and group or i % 9 == 0)))
    odd = [(2000, None), (2001, ""), (None, "dreadful"), (2002, "Dreadful, " + prose(rng, 3000)), (2002, "dreadful")]
    df = frame(spark, docs + odd)
    known = spark.createDataFrame([(i, y, 1) for i, y in labels if i % 3 != 1] + [(None, 1, 1), (2001, None, 1)], "doc_id long, toxic int, slots int")
    machine = fit(df, known)
    got = toxicity(df, machine).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [(score[i] >= 0.7, bool(y)) for i, y in labels if i % 3 == 1]
    assert sum(a == b for a, b in held) > 0.95 * len(held)
    assert score[2000] == score[2001] < 0.7
    assert toxicity(df.limit(0), machine).count() == 0
    assert {round(r.score, 6) for r in toxicity(df, fit(df, known.limit(0))).collect()} == {0.0}


# ----------------------------------------------------- 10 repeated strings

def cuts(rows, length=50):
    """Brute force: rows in order of id, equal ids don't count as earlier."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, math.inf), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key(i):
                gone[p:p + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    rows = corpus() + [(None, corpus()[4][1]), (500, "x" * 49), (501, "x" * 50), (502, "y" + "x" * 50), (503, "ab" * 60), (504, "ba" * 60)]
    key = lambda x: tuple(map(str, x))
    got = sorted((tuple(r) for r in digest(repeated_bytes(frame(spark, rows))).collect()), key=key)
    assert got == sorted(cuts(rows), key=key)
    assert repeated_bytes(empty(spark)).count() == 0


def test_toxicity_learns_pairs_of_which_neither_word_tells_alone(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice("aeiourstln") for _ in range(7)) for _ in range(200)]
    rows, labels = [], []
    for i in range(3_000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(pool) for _ in range(12)] + ["alpha"] * a + ["bravo"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a != b)))
    machine = fit(frame(spark, rows, extra=False), spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity(frame(spark, rows, extra=False), machine).collect()}
    assert np.mean([got[i] == bool(y) for i, y in labels if i % 3 == 0]) > 0.95


def test_pair_gain_by_hand():
    rng = np.random.default_rng(4)
    has, label = rng.random((500, 7)) < 0.4, (rng.random(500) < 0.3).astype(float)

    def g(cells):
        e = label.mean()
        return sum(2 * (n * math.log(n / (m * p))) for c in cells for m in [c.sum()] for n, p in ((label[c].sum(), e), (m - label[c].sum(), 1 - e)) if n)

    for block, gain in pair_gain(has, label, 3):
        for i in range(*block.indices(7)):
            for j in range(7):
                a, b = has[:, i], has[:, j]
                want = g([a & b, a & ~b, ~a & b, ~a & ~b]) - g([a, ~a]) - g([b, ~b])
                assert abs(gain[i - block.start, j] - want) < 1e-3
