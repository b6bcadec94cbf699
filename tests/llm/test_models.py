import itertools
import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from waymark.llm import ann, extract, hnsw, langid, neardup, pieces, quality, toxicity
from waymark.llm.common import Scratch

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def all_paths(v, text):
    s = (" " + text).encode()
    by = {}
    for i, x in enumerate(v.surface):
        if x and i >= 259:
            by.setdefault(x, i)

    def rec(i):
        if i == len(s):
            yield ()
            return
        char = s[i:].decode()[0].encode()
        for n in range(len(char), 64):
            if i + n <= len(s) and s[i : i + n] in by:
                for r in rec(i + n):
                    yield (by[s[i : i + n]], *r)
        if char not in by:
            for r in rec(i + len(char)):
                yield (*v.byte_id[list(char)].tolist(), *r)

    return list(rec(0))


def test_pieces_follow_their_probabilities(vocabulary):
    v = vocabulary
    paths = all_paths(v, "the cab")
    w = np.array([v.weight[list(p)].sum() for p in paths])
    q = dict(zip(paths, np.exp(w - np.logaddexp.reduce(w))))
    n = 4000
    made = pieces.encode(v, ["the cab"] * n, list(range(n)), 2)
    first, second = (Counter(tuple(m[r][0].tolist()) for m in made) for r in (0, 1))
    assert all(m[0][0].tolist() != m[1][0].tolist() and m[0][2] >= m[1][2] for m in made)
    assert all(abs(x[1] - math.log(q[tuple(x[0].tolist())])) < 1e-6 for m in made[:99] for x in m)
    for p in sorted(q, key=q.get)[-4:]:
        assert abs(first[p] / n - q[p]) < 0.03
        assert abs(second[p] / n - sum(q[o] * q[p] / (1 - q[o]) for o in paths if o != p)) < 0.03
    # without replacement, each path's probability over its inclusion sums to one on average
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in m) for m in made]) - 1) < 0.02


def test_pieces_are_all_given_in_order_and_decode(vocabulary):
    v = vocabulary
    got = pieces.encode(v, ["abc"], [1], 500)[0]
    assert sorted(tuple(x[0].tolist()) for x in got) == sorted(all_paths(v, "abc"))
    assert [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)
    for t in ["", None, "▁ ▁x  y\n", "日本 \U0001f600 é", " lead", "a" * 20_000, "tail  "]:
        for x in pieces.encode(v, [t], [1], 3)[0]:
            assert pieces.decode(v, x[0].tolist()) == (t or "")


def test_pieces_do_not_depend_on_the_batch(vocabulary):
    texts = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet' order by doc_id limit 60").fetchall()]
    together = pieces.encode(vocabulary, texts, list(range(60)), 2)
    for i in (0, 7, 59):
        alone = pieces.encode(vocabulary, [texts[i]], [i], 2)[0]
        assert [(x[0].tolist(), *x[1:]) for x in alone] == [(x[0].tolist(), *x[1:]) for x in together[i]]


def test_pieces_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "", "z"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, rank string")
    out = pieces.sampled(spark, docs).collect()
    assert all(r.round_trip for r in out) and len([r for r in out if r.doc_id == 3]) == 4
    assert pieces.sampled(spark, docs.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    got = quality.op1_quality(spark, SMALL).toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.93
    assert got["score"].between(0, 1).all()


def test_quality_tables_add_up_and_odd_texts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    for row, logit in zip(x[:50], model.logit(x[:50])):
        bins = [int((row[f] >= c).sum()) for f, c in enumerate(model.cuts)]
        plain = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert abs(plain - logit) < 1e-9
    for t in [None, "", " \n", "a", "é" * 10_000, "||| !!"]:
        assert np.isfinite(quality.features(t)).all()
    assert quality.fit(x, np.ones(800)).score(x).min() > 0.9


def test_toxicity_grammar():
    g = toxicity.Grammar({"grobbl": 3.0})
    kinds = lambda t: [k for k, _ in g.matches(t)]
    assert kinds("A fine day.") == [] and kinds(None) == [] and kinds("") == []
    assert kinds("What a Grobbler, really.") == ["I"]
    assert kinds("you are a grobbl") == ["A"]
    assert kinds("You are not a grobbl") == ["N"]
    assert kinds("He said: she. He said she is a grobbl") == ["R"]
    assert kinds("I will kill them") == ["T"] and kinds("you I will kill") == kinds("I will kill you") == ["AT"]
    for reported in ('He said: "you are a grobbl"', 'He said "you are a grobbl".', '"You are a grobbl", he said.', '"You are a grobbl!" she shouted.', "They told us, you are a grobbl", "You are a grobbl, he said."):
        assert kinds(reported) == ["R"], reported
    for aimed in ('"You are a grobbl"', "I told you, you grobbl", "He said it. You grobbl", 'He said "yes". You grobbl', "What a grobbl you are"):
        assert kinds(aimed) == ["A"], aimed
    assert kinds("You aren’t a grobbl") == kinds("You aren't a grobbl") == ["N"]
    for threat in ("We are killing them", "He killed them", "Ich töte sie", "Il frappe", "stabbing"):
        assert kinds(threat) == ["T"], threat
    assert kinds("stable") == [] and kinds("a skill") == []
    twice = toxicity.Grammar({"grobbl": 3.0}, {"grobbl": 2})
    assert not twice.sums("you grobbl").any() and twice.sums("you grobbl\na grobblo")[:2].all()
    assert kinds("not here; a grobbl there, and a grobbl again") == ["I", "I"]
    assert kinds("ungrobbl") == []


def test_toxicity_machine_against_a_plain_matcher():
    """Each match of the composed machine, from the whole line at once by its definition."""
    import itertools
    import random

    g = toxicity.Grammar({"grobbl": 3.0})
    words = "you grobbl kill not he said i day , . \"".split()

    def plain(symbols):
        out = []
        for at, s in enumerate(symbols):
            if s not in ("grobbl", "kill"):
                continue
            cut = lambda x: x in ',."'
            before = list(itertools.takewhile(lambda x: not cut(x), symbols[:at][::-1]))
            after = list(itertools.takewhile(lambda x: not cut(x), symbols[at + 1 :]))
            if "not" in before[:3]:
                out.append("N")
            elif "you" in before + after:
                out.append("A" if s == "grobbl" else "AT")
            else:
                out.append("I" if s == "grobbl" else "T")
        return out

    rng = random.Random(4)
    for _ in range(3_000):
        line = [rng.choice(words[:9] if rng.random() < 0.9 else words) for _ in range(rng.randint(1, 9))]
        text = " ".join(line)
        symbols = toxicity.SYMBOL.findall(text)
        if "said" not in symbols:
            assert [k for k, _ in g.matches(text)] == plain(symbols), text


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both["predicted"] == both["toxic"]).mean() > 0.95
    assert both[both.toxic == 1]["predicted"].mean() > 0.88


def test_language_on_held_out_rows(spark):
    got = langid.op8_language(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got[got.held_out].merge(docs, on="doc_id")
    assert (both["lang_pred"] == both["lang"]).mean() > 0.95


def test_language_gradient_and_odd_texts(spark):
    net = langid.Network(["a", "b"])
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    w = np.where(y[:, None] == 1, rng.integers(97, 105, (400, langid.WINDOW)), rng.integers(103, 112, (400, langid.WINDOW))).astype(np.uint8)
    small = langid.Network(["a", "b", "c"], hidden=5)
    small.p = {k: a.astype(np.float64) for k, a in small.p.items()}
    some, lang = w[:4, :7], np.array([0, 1, 2, 1])

    def loss():
        both = np.stack([some.T, some[:, ::-1].T])
        states = [s for s in small.states(both, False)]
        logit = np.stack([s[0] for s in states]) @ small.p["o"][0] + np.stack([s[1] for s in states])[::-1] @ small.p["o"][1] + small.p["b"]
        return (np.log(np.exp(logit).sum(-1)) - logit[:, np.arange(4), lang]).mean()

    for name, g in small.gradient(some, lang).items():
        a = small.p[name]
        for at in [np.unravel_index(int(i), a.shape) for i in np.argsort(-np.abs(g).ravel())[:6]]:
            was = a[at]
            a[at] = was + 1e-5
            up = loss()
            a[at] = was - 1e-5
            down = loss()
            a[at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name
    net.train(w, y, steps=60)
    p = net.documents([bytes(r) for r in w] + [b"", b"a"])
    assert (p[:400].argmax(1) == y).mean() > 0.95 and not p[400].any() and abs(p[401].sum() - 1) < 1e-5
    docs = spark.createDataFrame([(1, None, "x"), (None, "12 ,.", "y"), (3, "", "z"), (4, "abc", "x")], "doc_id long, text string, score2 string")
    got = {r.doc_id: r for r in langid.predicted(docs, net).collect()}
    assert [got[i].lang_pred == "und" for i in (1, None, 3, 4)] == [True, True, True, False]
    assert langid.predicted(docs.limit(0), None).count() == 0


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 7
        s = rng.normal(0, 1.5, n).tolist()
        edges = [(i, i + 1, float(rng.random())) for i in range(n - 1)] + [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (4, 2)) if a != b]
        cost = lambda x: sum(max(0, v) * (not k) + max(0, -v) * k for v, k in zip(s, x)) + sum(w * (x[a] != x[b]) for a, b, w in edges)  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(extract.min_cut(s, edges)) - best) < 1e-6


def test_main_text():
    page = "<html><head><title>T</title></head><body><header>Site</header><nav><a href='/a'>Home</a></nav><div class='sidebar'>About us and them.</div><article><h1>Title &amp; more</h1><p>It is a\n fine  day, we go.<p>Short.<ul><li>one</li></ul><script>var t='</p>';</script></article><div class='comments'><p>Nice post, thank you for writing this.</p></div><footer>&copy; c</footer>"
    assert extract.main_text(page) == "Title & more\nIt is a fine day, we go.\nShort.\none"
    for odd in (None, "", "<", "<p", '<a href="x', "<!-- open", "</", "plain", "<nav>x</nav>"):
        assert isinstance(extract.main_text(odd), str)


def test_names_of_containers_do_not_empty_an_article():
    text = "It is a fine day, and we go out to the hills."
    rest = "<div class='sidebar'><p>About us and them.</p></div>"
    for page in (
        f"<body class='has-sidebar'><article><p>{text}</p></article>{rest}",
        f"<body class='search no-header'><div><p>{text}</p></div>",
        f"<div class='content-with-sidebar'><article><p>{text}</p></article>{rest}</div>",
        f"<div class='content-with-sidebar'><p>{text}</p></div>{rest}",
        f"<div class='social-layout'><main><p>{text}</p></main>{rest}</div>",
        f"<article class='post tag-legal'><p>{text}</p></article>{rest}",
        f"<div class='post tag legal'><p>{text}</p></div>",
        f"<article><p>{text}</p></article><section id='comments'><article class='comment-body'><p>Nice post, thank you.</p></article></section>",
        f"<article><svg viewBox='0 0 1 1'/><p>{text}</p><svg><path/></svg></article>",
        f"<body><form id='page'><article><p>{text}</p></article>{rest}</form>",
        f"<body><form id='page'><div><p>{text}</p></div><div class='sidebar'><p>About us.</p></div></form>",
        f"<article><p>{text}</p><aside><p>{'Buy our fine boots and be on your way in no time at all. ' * 4}</p></aside></article>",
        f"<article><p>{text}</p></article><form><p>Leave a reply, and tell us what you think of this page, please.</p></form>",
    ):
        assert extract.main_text(page) == text, page


def test_main_text_of_long_pages_takes_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        text = extract.main_text("<body><article>" + "<p>It is a fine day.<option>x<svg>" * n)
        took.append(time.perf_counter() - began)
        assert text.count("\n") == n - 1
    assert took[1] < 10 * took[0] + 0.5


def test_pages_against_their_articles(spark):
    import html
    import re

    out = {r.page_id: r for r in extract.op6_html_text(spark, SMALL).collect()}
    for page_id, raw in duckdb.sql(f"select page_id, html from '{SMALL}/pages.parquet'").fetchall():
        inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", raw, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert out[page_id].text == "\n".join(x for x in blocks if x)
        assert out[page_id].n_chars == len(out[page_id].text)


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    x = [b / np.linalg.norm(b) for b in base] + [base[i % 5] * 3 + rng.normal(size=16) * 0.15 * (1 + i % 4) for i in range(160)]
    rows = [(i, [float(v) for v in y], "s") for i, y in enumerate(x)] + [(300, rows_ := [float(v) for v in x[0]], "s"), (300, rows_, "s")]
    odd = [(400, None, "s"), (401, [0.0] * 16, "s"), (402, [float("nan")] + [1.0] * 15, "s"), (403, [None] + [1.0] * 15, "s"), (404, [float("inf")] + [1.0] * 15, "s"), (405, [1.0, 2.0], "s"), (406, [2.0, 4.0], "s"), (407, [], "s")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, row string")
    good = rows + [r for r in odd if r[0] in (405, 406)]
    return df, good


@pytest.mark.parametrize("least", [0.95, 0.8])
def test_near_vectors_against_all_pairs(spark, least):
    df, good = vectors(spark)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(Scratch(spark), df, least, 3).collect())
    label, links = {}, {}
    keyed = list(enumerate(good))
    near = {i: {j for j, (_, w, _) in keyed if j != i and len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= least} for i, (_, v, _) in keyed}
    label = {i: r[0] for i, r in keyed}
    while True:
        new = {i: min([label[i], *(label[j] for j in near[i])]) for i in label}
        if new == label:
            break
        label = new
    links = sorted((good[i][0], len(near[i]), label[i], good[i][0] == label[i]) for i in label)
    want = sorted(links + [(i, 0, i, True) for i in (400, 401, 402, 403, 404, 407)])
    assert got == want
    assert neardup.near_duplicates(Scratch(spark), df.limit(0)).count() == 0


def test_graph_finds_what_is_near():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(24)
    node, cosine = g.insert(x, np.arange(1500), 0.999)
    assert (node == np.arange(1500)).all() and g.n == 1500
    ids, _ = g.nearest(x[:200], 64)
    exact = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids.tolist(), exact.tolist())]) > 9


def test_nearest_against_brute_force(spark, tmp_path):
    df, good = vectors(spark, 3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in ann.op5_nearest(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, v, _ in good:
        if q % 50 or got.get(q) is None:
            continue
        others = [(-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, w, _ in good if i != q and len(w) == len(v)]
        want = [i for _, i in sorted((round(s, 12), i) for s, i in others)[:5]]
        own = [i for _, i, _ in sorted(got[q])][:5]
        hit, total = hit + len(set(want) & set(own)), total + 5
    assert set(got) == {0, 50, 100, 150, 300}
    assert total and hit / total >= 0.9


def test_nearest_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert ann.op5_nearest(spark, str(tmp_path)).count() == 0


ARTICLE = "<p>The first paragraph of the article is here, with words.</p><p>The second one ends it all.</p>"
ARTICLE_TEXT = "The first paragraph of the article is here, with words.\nThe second one ends it all."
LONG_COMMENT = "<p>" + "I think this is a very long comment about the article, longer than it. " * 6 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<article>{ARTICLE}</article><section id="comments"><h3>Comments</h3><article class="comment">{LONG_COMMENT}</article></section>',
        f'<div class="post">{ARTICLE}</div><div class="userComments"><article>{LONG_COMMENT}</article></div>',
        f'<article>{ARTICLE}<section id="discussion"><article>{LONG_COMMENT}</article></section></article>',
        f'<aside><article>{LONG_COMMENT}</article></aside><article>{ARTICLE}</article>',
        f'<main><article>{ARTICLE}</article><ol class="commentlist"><li>{LONG_COMMENT}</li></ol></main>',
    ],
)
def test_reader_comments_are_no_main_text(page):
    assert extract.main_text(f"<body>{page}</body>") == ARTICLE_TEXT


def test_an_articles_own_lists_of_links_stay():
    items = [f"Paper number {i} on the subject of cuts" for i in range(6)]
    listed = "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(items)) + "</ul>"
    assert extract.main_text(f"<nav>{listed}</nav><article><p>See the list:</p>{listed}<p>End of it.</p></article>").split("\n") == ["See the list:", *items, "End of it."]
    assert extract.main_text(f"<nav>{listed}</nav><main>{listed}</main>").split("\n") == items


def test_cuts_are_least_and_near_linear():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        scores = [rng.choice([-1.5, -0.5, -0.2, 0.3, 0.6, 1.0]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.25, 0.5, 1.0])) for _ in range(2 * n)]
        cost = lambda keep: sum(abs(s) for s, k in zip(scores, keep) if k != (s > 0)) + sum(w for i, j, w in edges if keep[i] != keep[j])
        assert abs(cost(extract.min_cut(scores, edges)) - min(cost(k) for k in itertools.product([False, True], repeat=n))) < 1e-9
    n = 20_000
    scores = [rng.uniform(-0.4, 0.4) for _ in range(n)]
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 7, 0.25) for i in range(0, n - 7, 3)]
    began = time.perf_counter()
    extract.min_cut(scores, edges)
    assert time.perf_counter() - began < 20


def test_short_texts_are_learnt(spark):
    rows = [(i, "en", "The quick brown fox jumps over the lazy dog and runs away again now") for i in range(160)] + [(1000 + i, "zz", "zxqv jzzk qqx vvz zkq") for i in range(160)] + [(5000, "yy", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    net = langid.train(docs)
    assert net.langs == ["en", "zz"]
    got = {r.doc_id: r.lang_pred for r in langid.predicted(docs, net).collect()}
    assert all(got[i] == ("en" if i < 1000 else "zz") for i, _, t in rows if t) and got[5000] == "und"


def test_gradient_of_padded_windows_is_that_of_the_bytes():
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w, y, lengths = rng.integers(1, 255, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([12, 3, 1, 7, 12])
    w[np.arange(12)[None] >= lengths[:, None]] = 0
    together = net.gradient(w, y, lengths)
    apart = [net.gradient(w[i : i + 1, :n], y[i : i + 1]) for i, n in enumerate(lengths)]
    for k in together:
        assert np.allclose(together[k], sum(n * g[k] for n, g in zip(lengths, apart)) / lengths.sum())


def test_rare_near_vectors_are_measured(spark, monkeypatch):
    monkeypatch.setattr(neardup, "AUDIT", (2, 4))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[250:260] = x[:10] + 0.01 * rng.normal(size=(10, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(Scratch(spark), df).collect()}
    assert got == {i: int(i < 10 or 250 <= i < 260) for i in range(300)}
    alone = neardup.near_duplicates(Scratch(spark), df.where("vec_id >= 10 and vec_id < 200")).collect()
    assert all(r.n_links == 0 and r.kept for r in alone) and len(alone) == 190


def test_nearest_raises_when_neighbours_stay_missing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 16)))], "vec_id long, embedding array<double>")
    index = ann.Index(Scratch(spark), df)
    with pytest.raises(RuntimeError, match="missing"):
        index.settings(index.queries(), recall=1.5)
    monkeypatch.setattr(ann, "QUERIES", 2)
    monkeypatch.setattr(ann, "BLOCK", 30)
    small = ann.Index(Scratch(spark), df, lists=4)
    got = {(r.query_id, r.rank): r.vec_id for r in small.search(small.queries(10), 4, 64.0).collect()}
    assert got == {(r.query_id, r.rank): r.vec_id for r in index.search(index.queries(10), 1, 64.0).collect()} and len(got) == 100
