"""Top-k, sharding, HTML extraction, host rules and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stavegrid.llm import host_rules, html, sharding, topk

from . import cases


# ------------------------------------------------------------------- top-k
def brute_top(rows, k=5):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=16).astype("f4")]) for k in range(400)]
    rows += [(400, None), (401, [1.0, None] * 8), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, [1.0] * 16)]
    rows += [(k, rows[0][1]) for k in range(450, 460)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    found = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    assert found == brute_top(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()} == brute_top(rows[:3])
    assert topk.top_k(few.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_many_blocks(spark, monkeypatch):
    """Blocks smaller than k, several scans; repeated queries and ties across blocks."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "AT_ONCE", 2)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in found} == brute_top(rows) and len(found) == 200


def test_statistics_bound_the_product():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 200, 64))
    before = None
    for edges in topk.levels(64):  # each level splits the one before
        bound = topk.statistics(x, edges) @ topk.statistics(y, edges).T
        assert (bound >= x @ y.T - 1e-9).all()
        assert before is None or (bound <= before + 1e-9).all()
        before = bound


@pytest.mark.parametrize("d", [0, 1, 2, 3, 5, 16, 64])
def test_levels_cover_all_components(d):
    for edges in topk.levels(d):
        assert edges[0] == 0 and edges[-1] == max(d, 1) and (np.diff(edges) > 0).all()


def test_bounds_drop_most_pairs():
    """On the real table, with the real queries."""
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    usable, x = topk.scaled_vectors(table.column("embedding"))
    ids = table.column("vec_id").to_numpy()[usable]
    asked = ids % 50 == 0
    searcher = topk.Searcher(ids[asked], x[asked], 5, topk.starting_scores(x[asked], 5))
    searcher.offer_all(ids, x)
    assert searcher.met == asked.sum() * len(ids)
    assert searcher.scored < 0.35 * searcher.met
    score = x[asked] @ x.T
    score[ids[asked][:, None] == ids[None, :]] = -np.inf
    assert sorted(searcher.found[1].tolist()) == sorted(np.sort(score, 1)[:, -5:].ravel().astype(int).tolist())


def test_huge_components_stay_exact():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0], [2.0**20, 1.0]])
    assert topk._exact(q, x)[0].tolist() == [2**63 - 1, 2**60 + 3]
    assert topk.scaled_vectors(pa.array([[0.5], [], None, [None]], pa.list_(pa.float64())))[1].tolist() == [[128.0], [0.0]]


# ---------------------------------------------------------------- sharding
def brute_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_best_fit_decreasing_equals_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = rng.integers(1, 60, rng.integers(1, 120)).tolist()
        runs = sorted(Counter(sizes).items(), reverse=True)
        plan = sharding.best_fit_decreasing(runs, 60)
        rooms = defaultdict(lambda: 60)
        for (size, count), placed in zip(runs, plan):
            assert sum(m for _, m in placed) == count
            for shard, many in placed:
                rooms[shard] -= size * many
        assert sorted(rooms.values()) == brute_best_fit(sizes, 60)
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([(61, 1)], 60)


def test_shards_of_a_fixed_capacity(spark):
    """Distinct texts of known sizes; the largest must not be rounded over the capacity."""
    r = np.random.default_rng(7)
    sizes = [2 * int(n) + 1 for n in r.integers(1, 30, 80)] + [99_999, 70_001]
    docs = spark.createDataFrame([(k, chr(200 + k) * (n // 2)) for k, n in enumerate(sizes)], "doc_id long, text string")
    for part, of, capacity in ((docs, sizes, 99_999), (docs.where("doc_id < 80"), sizes[:80], 60)):
        frame, opened = sharding.shard_rows_by_capacity(part, capacity)
        filled = Counter()
        for row in frame.collect():
            assert row.size == sizes[row.doc_id]
            filled[row.shard] += row.size
        assert sorted(capacity - n for n in filled.values()) == brute_best_fit(of, capacity)
        assert opened == len(filled) and sum(filled.values()) == sum(of)
    with pytest.raises(ValueError):
        sharding.shard_rows_by_capacity(docs, 99_998)


def test_capacity_tree_is_balanced():
    tree = sharding.CapacityTree()
    for k in range(1000):
        tree.add(k, k)
    assert tree._root[3] <= 14
    assert tree.take_tightest(500) == (500, 500) and tree.take_tightest(500) == (501, 501)
    assert tree.take_tightest(1000) is None


def check_shards(rows, texts, shards):
    group, slots, load = {}, defaultdict(list), Counter()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert group.setdefault(data, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return load


def test_shards(spark):
    docs = cases.awkward_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard_rows(docs, shards=5).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 5)
    rng = np.random.default_rng(8)
    many = {k: "x" * int(s) + str(k) for k, s in enumerate(rng.integers(1, 500, 900))} | {k: "copy" * 50 for k in range(900, 1400)}
    frame = spark.createDataFrame(list(many.items()), "doc_id long, text string")
    load = check_shards(sharding.shard_rows(frame, shards=4).collect(), many, 4)
    rest = sorted(load.values())
    alone = 500 * 201
    assert alone in load.values()
    rest.remove(alone)
    assert max(rest) - min(rest) <= 500
    assert sharding.shard_rows(cases.no_documents(spark)).count() == 0
    assert sharding.shard_rows(cases.repeated_documents(spark)).count() == 6


# -------------------------------------------------------------------- html
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
line<br>next &#233;&nbsp;x &lt;tag&gt;<p>Second<aside>side</aside><form><input><label>mail</label></form><ul><li>one<li>two</ul>
<blockquote>quote</blockquote><div class="comments"><p>reader says</p></div></article>
<section class="comment-list"><article class="comment">nested</article></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(html.parse(PAGE), ()) == "Title & more\n\nFirst bold line next é x <tag>\n\nSecond\n\none\n\ntwo\n\nquote"
    for broken in ("", "<", "<p", "a<b", "<p>x</div></p><!-- y", "<script>x", "<article><p>x &amp", "</a></b>t<![CDATA[z", "<a " * 50 + "x", "<div>" * 5000 + "deep"):
        html.main_text(html.parse(broken), ())
    assert html.main_text(html.parse("<div>" * 5000 + "deep"), ()) == "deep"
    assert html.main_text(html.parse("<article><p>cut &am"), ()) == "cut &am"


def test_only_attributes_of_the_name_count():
    for kept in ('p style="overflow:hidden"', 'p title="hidden gems"', 'p data-hidden="false"', 'p id="share-price"', 'p data-id="menu"', "p title='class=ad'", "p data-class=nav", 'p class="share-price"', 'p data-role="navigation"', 'p aria-hidden="true"', 'p class="adverb"', 'p title="a > b" lang=en'):
        assert html.main_text(html.parse(f"<article><{kept}>Text</p></article>"), ()) == "Text", kept
        assert html.main_text(html.parse(f"<{kept.replace('p ', 'article ', 1)}><p>Text</p></article>"), ()) == "Text", kept
    for gone in ("p hidden", 'p HIDDEN=""', 'p class="ad"', "div id=cookie-notice", 'div class="x1 comment-list"', 'div role="navigation"', "div class='site-footer'"):
        assert html.main_text(html.parse(f"<article>Text<{gone}>Other</{gone.split()[0]}></article>"), ()) == "Text", gone


def test_templates_are_deleted_by_host(spark):
    """A part that recurs on one host goes there and stays elsewhere."""
    pages = [(k, f"http://a.example/{k}", f"<body><div><span>Part of the site</span></div><div>Own text {k}</div></body>") for k in range(12)]
    pages += [(100, "http://b.example/", "<body><div><span>Part of the site</span></div><div>x</div></body>"), (101, None, None), (102, "http://[bad", ""), (103, "http://a.example/z", "<article><p>Part of the site</p></article>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    found = {r.page_id: (r.text, r.n_chars) for r in html.extract(frame).collect()}
    assert len(found) == len(pages)
    assert found[3] == ("Own text 3", 10)
    assert found[100][0] == "Part of the site\n\nx"
    assert found[101] == ("", 0) == found[102]
    assert found[103][0] == "Part of the site"
    assert html.extract(frame.limit(0)).count() == 0


def test_joined_templates_equal_broadcast_ones(spark, monkeypatch):
    """Hosts that Java's URI does not read."""
    urls = ["http://a_b.example/{}", "http://[::1]:80/{}", "http://C.example/a b|{}{{", "http://u@d.example/{}", "//e.example/{}"]
    pages = [(100 * i + k, u.format(k), f"<div>Menu of {i}</div><div>Own text {k}</div>") for i, u in enumerate(urls) for k in range(8)]
    pages += [(900, None, "<p>x</p>"), (901, "http://[bad", "<p>y</p>"), (902, "http://a_b.example/z", None), pages[0], pages[0]]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    shared = sorted(map(tuple, html.extract(frame).collect()), key=str)
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", -1)
    assert sorted(map(tuple, html.extract(frame).collect()), key=str) == shared
    assert len(shared) == len(pages) and not any("Menu" in r[2] for r in shared)


def test_templates_of_a_large_host(spark):
    """A layout's part goes, however many pages of other layouts the host has."""
    pages = [(k, f"http://a.example/{k}", f"<div>Notice of section {k % 50}</div><div>Own text {k}</div>") for k in range(400)]
    pages += [(1000 + k, f"http://a.example/c{k}", "<div>One page</div><div>under many addresses</div>") for k in range(9)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {found[k] == f"Own text {k}" for k in range(400)} == {True}
    assert {found[k] for k in range(1000, 1009)} == {"One page\n\nunder many addresses"}


def test_templates_inside_articles(spark):
    r = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{k}" for k in r.integers(0, 5000, n))
    own = [words(40) for _ in range(12)]
    pages = [(k, f"http://a.example/{k}", f"<article><h2>Summary</h2><p>{t}</p><div><p>Subscribe now</p></div><p>A line of many</p></article>") for k, t in enumerate(own)]
    base = words(300).split()
    near = [" ".join(w if r.random() > 0.01 else "edited" for w in base) for _ in range(60)]
    pages += [(100 + k, f"http://a.example/n{k}", f"<article><p>A passage of all copies.</p><p>{t}</p></article>") for k, t in enumerate(near)]
    pages += [(200 + k, f"http://b.example/{k}", f"<article><p>{t}</p></article><article><p>Read this too</p></article>") for k, t in enumerate(own)]
    found = {p.page_id: p.text for p in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, t in enumerate(own):
        assert found[k] == f"Summary\n\n{t}\n\nA line of many"
        assert found[200 + k] == t
    for k, t in enumerate(near):
        assert found[100 + k] == f"A passage of all copies.\n\n{t}"


@pytest.fixture(params=[500_000, -1], ids=["broadcast", "join"])
def either_path(request, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", request.param)


def texts_of(spark, pages):
    return {p.page_id: p.text for p in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def prose(seed, n=40):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, 5000, n))


def test_teased_articles_keep_their_text(spark, either_path):
    """What is template outside articles stays inside them."""
    lede = f"<div>{prose(1)}</div>"
    pages = [(k, f"http://a.example/{k}", f"<div class='teaser'>{lede}</div><article><p>{prose(10 + k)}</p></article>") for k in range(6)]
    pages.append((50, "http://a.example/own", f"<article>{lede}<p>{prose(2)}</p></article>"))
    assert texts_of(spark, pages)[50] == f"{prose(1)}\n\n{prose(2)}"


def test_an_only_article_stays(spark, either_path):
    """A post that stands second on other pages keeps its text on its own page."""
    post = f"<article><div>{prose(1)}</div></article>"
    pages = [(k, f"http://a.example/{k}", f"<article><p>{prose(10 + k)}</p></article>{post}") for k in range(6)]
    pages.append((50, "http://a.example/own", f"<div>Menu</div>{post}"))
    found = texts_of(spark, pages)
    assert found[50] == prose(1) and found[3] == prose(13)


def test_copies_without_an_article_stay(spark, either_path):
    """Pages that are equal but for a time stamp count as one."""
    body = "".join(f"<div>{prose(k, 60)}</div>" for k in range(4))
    pages = [(k, f"http://a.example/{k}", f"<body>{body}<div>Printed at 10:{k:02}</div></body>") for k in range(6)]
    found = texts_of(spark, pages)
    assert all(all(prose(k, 60) in t for k in range(4)) for t in found.values())


def test_paragraphs_of_many_articles_stay(spark, either_path):
    shared = prose(1, 30)
    pages = [(k, f"http://a.example/{k}", f"<nav>Home</nav><article><h1>{prose(90 + k, 3)}</h1><p>{prose(10 + k)}</p><p>{shared}</p></article><footer>f</footer>") for k in range(20)]
    assert texts_of(spark, pages) == {k: f"{prose(90 + k, 3)}\n\n{prose(10 + k)}\n\n{shared}" for k in range(20)}


def test_pages_by_another_parser(spark, either_path):
    """Small pages against the standard library's parser and a count of subtrees
    by their text, host by host."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.rows, self.path = [], []
            self.feed(page)

        def handle_starttag(self, tag, attributes):
            self.path.append(tag)
            self.rows.append([tag, "", tuple(self.path)])

        def handle_endtag(self, tag):
            self.path.pop()

        def handle_data(self, text):
            self.rows[-1][1] += text

    r = np.random.default_rng(5)
    notes = [f"Note {k} {prose(700 + k, 3)}" for k in range(9)]
    pages = []
    for k in range(80):
        before, within = (r.choice(9, 2, replace=False) for _ in range(2))
        inner = "".join(f"<section>{notes[j]}</section>" for j in within)
        pages.append((k, f"http://{'abc'[k % 3]}.example/{k}", "".join(f"<div>{notes[j]}</div>" for j in before) + f"<article><p>{prose(k)}</p>{inner}</article>"))
    held = Counter()
    for _, url, page in pages:
        held.update((url[:8], t) for tag, t, path in Reader(page).rows if tag == "section")
    found = texts_of(spark, pages)
    for k, url, page in pages:
        kept = [t for tag, t, path in Reader(page).rows if path[0] == "article" and t and not (tag == "section" and held[url[:8], t] >= html.LEAST_PAGES)]
        assert found[k] == "\n\n".join(kept)


# -------------------------------------------------------------- host rules
def brute_counts(text):
    t = text or ""
    raw = t.encode().split()
    words = [w.decode() for w in raw]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_document_counts(spark):
    docs = cases.awkward_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: tuple(r._counts) for r in host_rules.document_counts(docs).collect()}
    assert found == {k: brute_counts(t) for k, t in texts.items()}


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "short"
    rows = [(k, good, "clean") for k in range(300)] + [(1000 + k, bad, "spam") for k in range(60)] + [(1100 + k, good, "spam") for k in range(5)]
    rows += [(2000 + k, bad, "clean") for k in range(20)] + [(3000, bad, "tiny"), (3001, good, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1))
    kept = {r.doc_id: r._kept for r in host_rules.judge(frame).collect()}
    assert len(kept) == len(rows)
    assert all(kept[k] for k in range(300)) and kept[3001]
    assert not any(kept[1100 + k] for k in range(5))  # good documents of a host that fails as a whole
    assert host_rules.judge(cases.no_documents(spark)).count() == 0
    assert host_rules.judge(cases.repeated_documents(spark)).count() == 6


def test_host_rules_run_no_python(spark):
    plan = host_rules.judge(cases.awkward_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    docs = cases.awkward_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [out.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names, name
            path = str(tmp_path / name)
            out.write.parquet(path)
            out = spark.read.parquet(path)
            sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    pieces = out.collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, whole))
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
