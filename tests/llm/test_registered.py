"""The registered queries on the smallest tables, against SQL, the tokenizers
library or brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from stavegrid.llm import html, packing, queries, tokens

from .test_dedup import brute_classes, brute_lines, brute_substrings, words_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def run(spark, name):
    return queries.queries()[name](spark, FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = run(spark, name)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(want.fetchall())


def library_ids(name, texts, end=()):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path(name))
    return {k: [*tokenizer.encode(t, add_special_tokens=False).ids, *end] for k, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, texts):
    ids = library_ids(queries.BYTE_BPE, texts, [1])
    pieces = run(spark, "op1_hilbert_packing").collect()
    at, filled = defaultdict(int), defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
        assert p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length])
    assert dict(at) == {k: len(x) for k, x in ids.items()}
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    for p in order:
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == 2048 for s, n in filled.items() if s < len(filled) - 1) and 0 < filled[len(filled) - 1] <= 2048
    # along the curve: keys of the documents never fall
    codes = packing._codes(tokens.byte_level_encoding(tokens.vocabulary_path(queries.BYTE_BPE)).max_token_value + 1)
    known = {k: int(packing.curve_keys(np.array(x[:-1], np.int64), np.array([0, len(x) - 1]), codes)[0]) for k, x in ids.items()}
    keys = [known[p.doc_id] for p in order]
    assert keys == sorted(keys) and len(set(keys)) > len(keys) // 4


def test_sharding(spark, texts):
    rows = run(spark, "op3_best_fit_sharding").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shard_of, slots, load = {}, defaultdict(list), Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(data, r.shard) == r.shard and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter(texts.values())
    largest = max(n * (len(t.encode()) + 1) for t, n in groups.items())
    assert max(load.values()) <= max(1.1 * sum(load.values()) / 16, largest)


def test_extraction(spark, duck):
    """By sets of word lists and tags alone on the pages whose subtrees no other
    page of the host has; every text is part of the page."""
    pages = {p: (u, h or "") for p, u, h in duck.sql("SELECT page_id, url, html FROM pages").fetchall()}
    rows = run(spark, "op4_template_removal").collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    held: dict = defaultdict(lambda: defaultdict(list))
    for p, (u, h) in pages.items():
        tree = html.parse(h)
        html.hash_subtrees(tree)
        for key, inside, rest in html.subtrees(tree):
            held[html.host_of(u), inside][key].append(rest)
    template = defaultdict(set)
    for (host, inside), keys in held.items():
        for key, rests in keys.items():
            if len(set(rests)) >= html.LEAST_PAGES and (not inside or len(set(rests)) >= html.LEAST_SHARE * len(rests)):
                template[host].add((key, inside))
    for r in rows:
        u, h = pages[r.page_id]
        tree = html.parse(h)
        html.hash_subtrees(tree)
        assert (r.url, r.text, r.n_chars) == (u, html.main_text(tree, template[html.host_of(u)]), len(r.text))


def test_simple8b(spark, texts):
    ids = library_ids(queries.WORD_BPE, texts, [2])
    before, want = 0, {}
    for k in sorted(ids):
        want[k] = (before, len(ids[k]), crc(ids[k]))
        before += len(ids[k])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op5_simple8b").collect()} == want


def test_automaton(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path(queries.BYTE_BPE))
    want = {}
    for k, ids in library_ids(queries.BYTE_BPE, texts).items():
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op7_bpe_automaton").collect()} == want


def without(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def test_lines(spark, texts):
    gone = brute_lines(texts)
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in run(spark, "op9_fuzzy_lines").collect()}
    assert found == {k: (len(gone[k]), hashlib.sha256(without(t, gone[k]).encode()).hexdigest()) for k, t in texts.items()}


def test_pipeline(spark, duck, texts):
    """Each stage by brute force, on what its predecessor kept by brute force."""
    kept = {k for (k,) in duck.sql(f"SELECT doc_id FROM ({queries.oracle_sql()['op6_host_rules']}) WHERE kept").fetchall()}
    left = {k: t for k, t in texts.items() if k in kept}
    gone = brute_lines(left)
    left = {k: without(t, gone[k]) for k, t in left.items()}
    left = {k: t for k, t in left.items() if words_of(t)}
    _, roots = brute_classes(left)
    left = {k: t for k, t in left.items() if roots[k] == k}
    words = brute_substrings(left)
    left = {k: t if len(words[k]) == len(words_of(t)) else b" ".join(words[k]).decode() for k, t in left.items()}
    left = {k: t for k, t in left.items() if words_of(t)}
    found = defaultdict(list)
    for p in corpus_pipeline.run(spark, FOLDER).collect():
        found[p.doc_id].append((p.start, p.length, p.ids_crc32))
    ids = library_ids(queries.BYTE_BPE, left, [1])
    assert set(found) == set(ids)
    for k, pieces in found.items():
        assert sorted(pieces) == [(a, n, crc(ids[k][a : a + n])) for a, n, _ in sorted(pieces)]
        assert sum(n for _, n, _ in pieces) == len(ids[k])
