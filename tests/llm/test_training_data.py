"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, exact_dedup, mixing, ngram_join, sharding, token_counts, toxicity, url_filter, vector_dedup, warc
from leafmill.llm import registry
from leafmill.llm._graph import connected_components
from leafmill.llm._spark import Scratch, global_row_number, new_path

from ..oracle import same

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["w%d" % k for k in range(400)]


def text_of(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    base = text_of(1)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base), (2, base), (3, base + "  "), (4, " ".join(near)), (5, text_of(2)), (6, None), (7, ""), (8, " \t\n"), (9, "one two"), (10, "one two"),
        (11, "long " * 20000), (12, text_of(3, 3000)), (13, text_of(3, 3000) + " tail"), (None, text_of(4)), (None, base), (5, text_of(2)), (14, "a <|endoftext|> b It's  x\x1cy"),
    ]
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", 0) for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


# exact dedup


def test_exact_groups(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups["".join((r.text or "").split(" ")).translate({c: None for c in range(9, 14)})].append(r)
    out = exact_dedup.exact_groups(documents, Scratch(spark)).collect()
    assert len(out) == len(rows)
    assert sum(r.kept for r in out) == len(groups)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        own = by_hash[r.text_sha256]
        best = min(own, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert (r.group_size, r.keep_id) == (len(own), best.doc_id)
    kept = exact_dedup.dedup(documents.withColumn("keep_id", F.lit(1)).withColumn("_sha", F.lit("x")), Scratch(spark))
    assert kept.columns == [*documents.columns, "keep_id", "_sha"]
    assert kept.count() == len(groups)


def test_exact_dedup_in_several_rounds(spark, documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 6)
    out = exact_dedup.exact_groups(documents, Scratch(spark)).collect()
    assert sorted(r.group_size for r in out) == sorted(r.group_size for r in exact_dedup.exact_groups(documents.repartition(3), Scratch(spark)).collect())
    texts = {"".join((r.text or "").split()) if "\x1c" not in (r.text or "") else r.text for r in documents.collect()}
    assert sum(r.kept for r in out) == len(texts)


# n-gram join


def brute_links(rows):
    sets = {}
    for k, t in enumerate(rows):
        w = ngram_join.words_of(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return links, root


def near_rows(spark, documents):
    """With null ids throughout a class, a near copy under a null id, and ids that repeat with other texts."""
    other = text_of(77).split()
    changed = [*other[:40], "changed", *other[41:]]
    more = [(None, " ".join(other)), (30, " ".join(changed)), (31, text_of(78)), (31, text_of(79)), (1, text_of(80)), (31, text_of(78)), (None, text_of(81)), (None, text_of(81))]
    return documents.unionByName(spark.createDataFrame([(i, t, "en", "s1", 0) for i, t in more], DOC))


def expected_classes(rows):
    links, root = brute_links([r.text for r in rows])
    first = lambda k: min((rows[j].doc_id is None, rows[j].doc_id or 0) for j in range(len(rows)) if root[j] == root[k])
    worded = lambda r: bool(ngram_join.words_of(r.text or ""))
    return sorted((r.doc_id is None, r.doc_id or 0, links[k], first(k) if worded(r) else (r.doc_id is None, r.doc_id or 0)) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile", [256, 2])
def test_ngram_join_against_brute_force(spark, documents, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    docs = near_rows(spark, documents)
    out = ngram_join.join(docs, Scratch(spark)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_links, (r.class_id is None, r.class_id or 0)) for r in out)
    assert got == expected_classes(docs.collect())
    assert ngram_join.join(documents.limit(0), Scratch(spark)).count() == 0


def test_ngram_dedup_keeps_one_row_of_each_class(spark, documents):
    docs = near_rows(spark, documents).withColumn("_row", F.lit("clash")).withColumn("_class", F.lit(1))
    rows = docs.collect()
    _, root = brute_links([r.text for r in rows])
    kept = ngram_join.dedup(docs, Scratch(spark))
    assert kept.columns == docs.columns
    got = kept.collect()
    class_of = {r.text: root[k] for k, r in enumerate(rows) if ngram_join.words_of(r.text or "")}
    worded = [class_of[r.text] for r in got if r.text in class_of]
    assert sorted(worded) == sorted(set(class_of.values()))
    assert len(got) - len(worded) == sum(not ngram_join.words_of(r.text or "") for r in rows)
    assert {r.doc_id for r in got if r.text in class_of and r.doc_id is not None}.isdisjoint({2, 3, 4, 13})
    assert sorted(r.text for r in got if r.doc_id == 31) == sorted([text_of(78), text_of(79)])


def test_ngram_join_takes_chains_apart(spark, monkeypatch):
    """Candidates that hang together only link by link: taken apart into buckets, each pair counted once."""
    words, texts = text_of(21, 1400).split(), []
    for k in range(300):
        texts.append(" ".join(words[4 * k : 4 * k + 150]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    links, root = brute_links(texts)
    monkeypatch.setattr(ngram_join, "TILE", 2)
    scratch, seen = Scratch(spark), []
    monkeypatch.setattr(ngram_join, "_groups", lambda *a, real=ngram_join._groups: seen.append(real(*a)) or seen[-1])
    out = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(docs, scratch).collect()}
    assert out == {k: (links[k], root[k]) for k in range(300)}
    assert seen[0].filter("_at >= 0").count() > 0


def test_ngram_join_tiles(spark, monkeypatch):
    base = text_of(9, 100).split()
    texts = []
    for k in range(40):
        w = list(base)
        w[2 * k + 5] = f"x{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    links, root = brute_links(texts)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    out = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(docs, Scratch(spark)).collect()}
    assert out == {k: (links[k], root[k]) for k in range(40)}


def test_bands_recall():
    r = random.Random(3)
    hit = 0
    for _ in range(300):
        shared = [r.getrandbits(64) for _ in range(160)]
        a, b = (np.array(shared + [r.getrandbits(64) for _ in range(20)], np.uint64) for _ in range(2))
        hit += bool((ngram_join.bands(np.sort(a)) == ngram_join.bands(np.sort(b))).any())
    assert hit >= 297


# URL filter

PAGES = [
    (1, "http://a.EXAMPLE.org/es/x"), (2, "https://x.com/de/1"), (3, "https://x.com/fr/1?q#f"), (4, "https://b.net/p"), (5, "https://c.net/p"), (6, "https://d.net/q"),
    (7, None), (8, "no scheme"), (9, "https://example.org/en/12"), (10, "https://notexample.org/es/"), (11, "https://b.net/p#top"), (12, "ftp://com/de/"), (13, "http://org?x"),
]


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in PAGES], "page_id bigint, url string, verdictless string")
    edges = spark.createDataFrame([("https://b.net/p", "https://x.com/de/77"), ("https://c.net/p", "https://b.net/p"), ("https://d.net/q", "https://x.com/de/5"), ("https://d.net/q", "https://x.com/fr/5"), (None, "https://b.net/p")], "src string, dst string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, edges, Scratch(spark)).collect()}
    assert out == {
        1: ("example.org/es/", "block"), 2: ("com/de/", "block"), 3: ("com/fr/", "allow"), 4: (None, "block"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
        9: ("example.org/en/1", "block"), 10: ("org/", "allow"), 11: (None, "block"), 12: ("com/de/", "block"), 13: (None, "allow"),
    }
    r = url_filter.judge(pages, edges.limit(0), Scratch(spark)).filter("page_id = 1").first()
    assert (r.host, r.path, r.verdictless) == ("a.example.org", "/es/x", "mine")
    assert url_filter.judge(pages.limit(0), edges, Scratch(spark)).count() == 0


def test_url_columns_that_clash(spark):
    rows = [(1, "https://b.net/p", "a", "b", "c", 7), (2, None, "a", "b", "c", 7), (2, None, "a", "b", "c", 7), (3, "https://y.net/" + "p" * 200000, "a", "b", "c", 7)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, alias_root string, host string, _node string, _row int")
    edges = spark.createDataFrame([("https://b.net/p", "https://x.com/de/77")], "src string, dst string")
    out = url_filter.judge(pages, edges, Scratch(spark))
    assert out.columns == ["page_id", "url", "_node", "_row", "host", "path", "rule", "verdict", "alias_root"]
    got = sorted(out.collect(), key=lambda r: r.page_id)
    assert [(r.verdict, r.alias_root, len(r.path), r._node, r._row) for r in got] == [("block", "b.net/p", 2, "c", 7), *[("allow", None, 0, "c", 7)] * 2, ("allow", None, 200001, "c", 7)]


def test_links_against_the_standard_library(spark):
    from urllib.parse import urljoin

    r = random.Random(4)
    parts = ["a", "b.html", "..", ".", "", "c d", "?q=1", "?q=/../x", "#f", "x:y", "é"]
    links = ["/".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(300)]
    links = [t for t in links if t and not t.startswith(("x:y", "#")) and "//" not in t.split("?")[0].split("#")[0]]
    bases = ["http://h.org/a/b/c.html?z=1#t", "https://h.org", "http://h.org/"]
    df = spark.createDataFrame([(b, t) for b in bases for t in links], "base string, link string")
    for row in df.select("base", "link", url_filter.absolute(F.col("link"), F.col("base")).alias("to")).collect():
        want = urljoin(row.base, row.link)
        assert row.to.rstrip("#?") == want.rstrip("#?"), (row.base, row.link)


def test_all_links_of_a_page_count(spark):
    html = "".join(f'<LINK rel=canonical href="{t}">' for t in ("one", "/two")) + "".join(f'<meta http-equiv="Refresh" content="1;url={t}">' for t in ("?a=1&amp;b=2", "http://q.org/x/../y"))
    pages = spark.createDataFrame([("https://a.org/b/c", html)], "url string, html string")
    assert {r.dst for r in url_filter.page_edges(pages).collect()} == {"https://a.org/b/one", "https://a.org/two", "https://a.org/b/c?a=1&b=2", "http://q.org/y"}


def test_page_edges(spark):
    html = '<link href="/c" rel="canonical"><meta http-equiv="refresh" content="0; url=https://z.org/y">'
    pages = spark.createDataFrame([("https://a.org/b", html), ("https://a.org/c", None), (None, html)], "url string, html string")
    assert sorted((r.src or "", r.dst) for r in url_filter.page_edges(pages).collect()) == [("", "https://z.org/y"), ("https://a.org/b", "https://a.org/c"), ("https://a.org/b", "https://z.org/y")]


def test_relative_links_and_queries(spark):
    cases = [("next.html", "http://h.com/a/next.html"), ("../x", "http://h.com/x"), ("../../../x/./y/..", "http://h.com/x/"), ("?id=2", "http://h.com/a/b?id=2"), ("#top", "http://h.com/a/b?q=1#top"), ("//o.org/z", "http://o.org/z"), ("/r/../s?u=http://k", "http://h.com/s?u=http://k"), ("HTTPS://k/l", "HTTPS://k/l"), (".", "http://h.com/a/")]
    df = spark.createDataFrame([(link,) for link, _ in cases], "link string")
    got = {r.link: r.to for r in df.select("link", url_filter.absolute(F.col("link"), F.lit("http://h.com/a/b?q=1#f")).alias("to")).collect()}
    assert got == dict(cases)
    meta = '<meta http-equiv="refresh" content="0; url=%s">'
    rows = [(1, "http://h.com/a/index.php?id=1", meta % "../de/x"), (2, "http://h.com/a/index.php?id=2", ""), (3, "http://h.com/a/index.php?id=3", meta % "?id=1")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = url_filter.judge(pages.select("page_id", "url"), url_filter.page_edges(pages), Scratch(spark)).collect()
    assert {r.page_id: r.verdict for r in out} == {1: "block", 2: "allow", 3: "block"}


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark)).collect()}
    assert got == {k: find(k) for k in root}


# embeddings


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    for g in range(12):
        for k in range(6):
            x[g * 10 + k] = x[g * 10] + 0.05 * k * rng.normal(size=16)
    x[200] = x[201] = x[0]
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x.astype(np.float32))]
    extra = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1e38] * 16), (908, [float("inf")] * 16), (None, [0.5] * 16)]
    df = spark.createDataFrame(rows + extra, "vec_id bigint, embedding array<float>")
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    degree = ((y @ y.T) >= 0.9).sum(1) - 1
    out = {r.vec_id: r for r in vector_dedup.near_duplicates(df, Scratch(spark)).collect()}
    assert len(out) == len(rows) + len(extra)
    found = sum(min(out[k].n_links, int(degree[k])) for k in range(300))
    assert found >= 0.95 * degree.sum() and all(out[k].n_links <= degree[k] for k in range(300))
    assert out[200].component_id == 0 and not out[200].kept
    assert all(out[k].n_links == 0 and out[k].kept for k in (900, 901, 902, 903, 904, 908))
    assert out[905].n_links == 1 and out[906].component_id == 905
    assert out[907].n_links == 1  # with the vector whose id is null
    assert vector_dedup.near_duplicates(df.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("aim, most, sample", [(40, 300, 1024), (100, 250, 256)])
def test_vectors_with_many_centroids(spark, monkeypatch, aim, most, sample):
    """Pairs of cosine 0.905 and nothing near them: with 256 centroids three shards a vector miss one pair in twenty.
    With a small sample the first shards are too large, and are split again or dealt to parts."""
    monkeypatch.setattr(vector_dedup, "SHARD_AIM", aim)
    monkeypatch.setattr(vector_dedup, "SHARD_MOST", most)
    monkeypatch.setattr(vector_dedup, "PART", most // 2)
    monkeypatch.setattr(vector_dedup, "SAMPLE", sample)
    rng = np.random.default_rng(2)
    a, e = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e -= (e * a).sum(1, keepdims=True) * a
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))], "vec_id bigint, embedding array<double>")
    out = vector_dedup.near_duplicates(df, Scratch(spark)).collect()
    assert all(r.n_links <= 1 for r in out)
    assert sum(r.n_links for r in out) >= 0.98 * 4000


def test_dense_vectors_in_parts_and_the_second_attempt(spark, monkeypatch):
    """A group far above SHARD_MOST that no centroids part; a recall that can't be reached makes it exact."""
    monkeypatch.setattr(vector_dedup, "SHARD_MOST", 100)
    monkeypatch.setattr(vector_dedup, "PART", 60)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((500, 8)) + 0.12 * rng.normal(size=(500, 8)), rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(k // 2 if k > 700 else k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = ((y @ y.T) >= 0.9).sum(1) - 1
    for least in (0.9, 1.1):
        monkeypatch.setattr(vector_dedup, "LEAST_RECALL", least)
        out = sorted((r.vec_id, r.n_links) for r in vector_dedup.near_duplicates(df, Scratch(spark)).collect())
        want = sorted((k // 2 if k > 700 else k, int(d)) for k, d in enumerate(degree))
        assert sum(n for _, n in out) >= (0.97 if least < 1 else 0.999) * degree.sum()
        assert len(out) == len(want) and all(n <= m for (_, n), (_, m) in zip(out, want))


# sharding


def test_permutation_is_a_bijection():
    for n in (1, 2, 5, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, back=True).tolist() == list(range(n))


def test_shards(spark, documents, tmp_path):
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    out = sharding.shard(documents.withColumn("slotted", F.lit(1)), order, Scratch(spark)).collect()
    n = len(out)
    counts = collections.Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 if len(counts) == 8 else True
    for s, c in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(c))
    for r in out:
        assert sharding.locate(r.row_number, n) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, n) == r.row_number
    again = sharding.shard(documents.repartition(5), order, Scratch(spark)).collect()
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in again if r.doc_id not in (5,)) == sorted((str(r.doc_id), r.shard, r.slot) for r in out if r.doc_id not in (5,))
    assert sharding.shard(documents.limit(0), order, Scratch(spark)).count() == 0
    sharding.write_shards(sharding.shard(documents, order, Scratch(spark)), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == n


def plain_permutation(n, seed=20240229):
    """Six Feistel rounds keyed by splitmix64, written with whole numbers only."""
    full, x, keys = 2**64 - 1, seed, []
    for _ in range(6):
        x = (x + 0x9E3779B97F4A7C15) & full
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        keys.append(z ^ (z >> 31))
    w = next(w for w in range(1, 40) if 4**w >= n)
    out = []
    for k in range(n):
        p = k
        while True:
            left, right = p >> w, p % 2**w
            for key in keys:
                z = ((right ^ key) * 0xBF58476D1CE4E5B9) & full
                z = ((z ^ (z >> 29)) * 0x94D049BB133111EB) & full
                left, right = right, left ^ ((z ^ (z >> 32)) % 2**w)
            p = left << w | right
            if p < n:
                break
        out.append(p)
    return out


def test_sharding_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((i is None, i, len(t) + 1, zlib.crc32(t)) for i, t in rows)
    places = plain_permutation(len(rows))
    assert sorted(places) == list(range(len(rows)))
    want = sorted((i, size, crc, "rows", p % 8, p // 8, None) for (_, i, size, crc), p in zip(rows, places))
    assert sorted(map(tuple, sharding.op5_sharding(spark, sf_dir).collect())) == want


def test_sharding_keeps_columns_that_clash(spark):
    df = spark.createDataFrame([(k % 3, "x") for k in range(50)], "id int, _place string")
    for c in ("_uid", "_part", "_n", "_offset", "_position"):
        df = df.withColumn(c, F.lit(c))
    out = sharding.shard(df.withColumn("shard", F.lit("mine")), [F.col("id").asc()], Scratch(spark))
    assert out.columns == [*df.columns, "row_number", "shard", "slot"]
    assert out.filter("_place = 'x' and _uid = '_uid' and _position = '_position'").count() == 50


def test_ties_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = global_row_number(spark.range(4000, numPartitions=4).select(F.lit(1).alias("k")), [F.col("k").asc()], Scratch(spark))
        assert sorted(r.row_number for r in df.collect()) == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_global_row_number(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = global_row_number(df, [F.col("k").asc(), F.col("id").desc()], Scratch(spark)).collect()
    want = sorted(range(1000), key=lambda x: (x % 7, -x))
    assert [r.id for r in sorted(got, key=lambda r: r.row_number)] == want


# WARC


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    odd = [(1, None, None), (2, "http://a b\r\n.org/x", "dup\r\n\r\nWARC/1.1\r\nContent-Length: 9"), (3, "http://x", "dup\r\n\r\nWARC/1.1\r\nContent-Length: 9"), (4, "y", ""), (None, "http://z", "é😀" * 1000), (7, "http://q", "é😀" * 1000), (5, "u", "x"), (5, "u", "x"), (6, "u", "x")]
    pages = spark.createDataFrame(odd, "page_id bigint, url string, html string").withColumn("record_type", F.lit("clash")).repartition(3)
    path = new_path(spark, "test")
    warc.write_captures(pages, path, Scratch(spark))
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(odd)
    got = warc.assemble(records, Scratch(spark)).collect()
    assert len(got) == len(odd) and all(r.request is not None and len(r.metadata) == 1 for r in got)
    kinds = collections.Counter((r.url, r.record_type, bytes(r.payload).decode(), r.payload_digest) for r in got)
    assert kinds["u", "response", "x", digest("x")] == 2 and kinds["u", "revisit", "", digest("x")] == 1
    assert kinds[None, "response", "", digest("")] == 1 and kinds["y", "revisit", "", digest("")] == 1
    assert kinds["http://x", "revisit", "", digest(odd[2][2])] == 1
    assert kinds["http://z", "revisit", "", digest(odd[4][2])] == 1
    assert all(r.payload_sha1 == r.payload_digest for r in got if r.record_type == "response")
    least = new_path(spark, "test")
    warc.write_captures(pages, least, Scratch(spark), least_bytes=5)
    assert warc.read_records(spark, least).filter("record_type = 'revisit'").count() == 2
    none = new_path(spark, "test")
    warc.write_captures(pages.limit(0), none, Scratch(spark))
    assert warc.assemble(warc.read_records(spark, none), Scratch(spark)).count() == 0
    response = {r.payload_digest: r.record_id for r in got if r.record_type == "response"}
    for r in got:  # where one response holds the payload, its revisits name it
        want = response[r.payload_digest] if r.record_type == "revisit" and r.payload_digest != digest("x") else None
        assert r.refers_to == want


def test_warc_captures_over_chains_and_circles(spark, tmp_path):
    def record(kind, name, to, block=b""):
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"WARC-Concurrent-To: <{t}>" for t in to), "Content-Type: text/plain", f"Content-Length: {len(block)}"]
        return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    chain = [record("metadata", f"m{k}", [f"m{k - 1}" if k else "q"], b"n%d" % k) for k in range(5)]
    data = [
        record("response", "a", [], b"A" * 5_000_000), record("request", "q", ["a"]), *chain,
        record("response", "b", ["p"], b"B"), record("request", "p", []), record("metadata", "x", ["y"], b"1"), record("metadata", "y", ["x", "p"], b"2"),
        record("response", "c", ["gone"]), record("warcinfo", "i", []),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(data[:4]))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, data[4:])))
    got = {r.record_id: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}"), Scratch(spark)).collect()}
    assert got["<a>"].payload_bytes == 5_000_000 and got["<a>"].request.record_id == "<q>"
    assert [m.text for m in got["<a>"].metadata] == ["n0", "n1", "n2", "n3", "n4"]
    assert got["<b>"].request.record_id == "<p>" and [m.text for m in got["<b>"].metadata] == ["1", "2"]
    assert got["<c>"].metadata is None and len(got) == 3


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_warc_pieces_of_any_size(step):
    block = b"GET / HTTP/1.1\r\n\r\n\r\n"
    one = b"WARC/1.1\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        got = list(warc.parse(warc.inflate(data, step)))
        assert [(r["http_head"], r["payload"]) for r in got] == [("GET / HTTP/1.1\r\n\r\n", b"\r\n")] * 3
    with pytest.raises(ValueError):
        list(warc.inflate(gzip.compress(one)[:-9], step))


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))
    with pytest.raises(ValueError):
        list(warc.parse([b"not a record"]))


def test_warc_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    want = sorted((r.page_id, len((r.html or "").encode()), digest(r.html), "response" if first[r.html or ""] == r.page_id else "revisit", None if first[r.html or ""] == r.page_id else first[r.html or ""]) for r in rows)
    got = warc.op6_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


# tokens


def test_bpe_matches_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    docs = documents.unionByName(spark.createDataFrame([(50, "ΑΣ İ ﬁ 日本語 😀 é é 12½ '''s don't", None, None, None), (51, "aaaaaaaaaaaa abababab <|startoftext|><|end", None, None, None)], DOC)).withColumn("n_tokens", F.lit("mine"))
    got = bpe.encode(docs, bpe.tokenizer_content(), ("n_tokens", "ids", "decoded")).select("text", "n_tokens", "ids", "decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == t.decode(want, skip_special_tokens=False)


def test_bpe_digests(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op8_bpe(spark, sf_dir).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_refuses_what_it_does_not_support():
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        spec = json.load(f)
    changes = [
        ("normalizer", None), ("decoder", {"type": "ByteLevel"}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", spec["model"] | {"byte_fallback": True}),
        ("added_tokens", [spec["added_tokens"][0] | {"lstrip": True}]),
    ]
    for name, value in changes:
        with pytest.raises(ValueError, match=name):
            bpe.Bpe(json.dumps(spec | {name: value}).encode())
    other = spec | {"added_tokens": [t | {"content": c} for t, c in zip(spec["added_tokens"], ("[SEP]", "end of it"))]}
    data = json.dumps(other).encode()
    t, m = Tokenizer.from_str(data.decode()), bpe.Bpe(data)
    for text in ("a[SEP]b", "the end of it all", "[sep] end  of it [SEP"):
        assert np.frombuffer(m.encode_batch([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 60)
    small, full = bpe.Bpe(bpe.tokenizer_content()), bpe.Bpe(bpe.tokenizer_content())
    texts = [text_of(k, 40) for k in range(10)]
    want = [full.encode_batch([t])[0] for t in texts]
    assert [small.encode_batch([t])[0] for t in texts] == want
    assert len(small.chunks) <= 60


def test_token_trees():
    counter = token_counts.Counter(*token_counts.vocabulary())
    full = lambda t: sum(map(counter.__getitem__, counter.pieces.findall(t)))
    r = random.Random(7)
    texts = ["", "a", "  two  spaces\n\n and\tlines ", text_of(1, 500), "it's I'll don't " * 60, "x\n" * 300, "é日本 😀 " * 50]
    for t in texts:
        tree = token_counts.TokenTree(t, counter)
        assert tree.total == full(t)
        for _ in range(25):
            a = r.randrange(len(tree.text) + 1)
            b = min(len(tree.text), a + r.choice([0, 0, 1, 5, 200]))
            tree.edit(a, b, r.choice(["", "'", " ", "  \n", "'re", "zz", " a b " * 90, "\n\n"]))
            assert tree.total == full(tree.text) and tree.chars[1] == len(tree.text)
    long = token_counts.TokenTree(text_of(2, 20000), counter)
    long.edit(50000, 50001, "new word")
    assert long.encoded < 400


def test_kept_trees_take_further_edits(spark, documents):
    vocabulary, pattern = token_counts.vocabulary()
    counter = token_counts.Counter(vocabulary, pattern)
    big = token_counts.TokenTree(text_of(8, 3000), counter)
    big.edit(40, 41, " ".join(text_of(9, 4000).split()))
    assert max(big.leaves[0]) < 64 * 40  # what an edit brings is cut into leaves
    again = token_counts.TokenTree.kept(big.text, *big.leaves, counter)
    again.edit(9000, 9004, "new")
    assert 0 < again.encoded < 400 and again.total == len(counter.encode(again.text))
    with pytest.raises(ValueError):
        token_counts.TokenTree.kept("abc", [1], [1], counter)
    first = token_counts.count_with_edits(documents.select("doc_id", "text"), vocabulary, pattern, trees=True)
    stored = first.select("doc_id", F.col("edited").alias("text"), F.when(F.col("doc_id") != 5, F.col("leaf_chars")).alias("a"), F.col("leaf_tokens").alias("b"))
    second = token_counts.count_with_edits(stored, vocabulary, pattern, kept_trees=("a", "b"), trees=True).collect()
    for r in second:
        assert r.n_tokens == len(counter.encode(r.text)) and r.n_edited_tokens == len(counter.encode(r.edited)) == sum(r.leaf_tokens)


def test_token_counts_query_rows(spark, documents):
    import tiktoken  # noqa: F401

    vocabulary, pattern = token_counts.vocabulary()
    counter = token_counts.Counter(vocabulary, pattern)
    out = token_counts.count_with_edits(documents.withColumn("n_tokens", F.lit(1)), vocabulary, pattern, trees=True).collect()
    assert len(out) == documents.count()
    for r in out:
        assert r.n_tokens == len(counter.encode(r.text or "")) and r.n_edited_tokens == len(counter.encode(r.edited)) == sum(r.leaf_tokens)
    edits = documents.withColumn("edits", F.when(F.col("doc_id") == 9, F.expr("array(named_struct('start', 0, 'end', 3, 'new', string(null)))")))
    r = token_counts.count_with_edits(edits, vocabulary, pattern, edits_col="edits", trees=True).filter("doc_id = 9").first()
    assert r.edited == " two"


# mixing


def test_mixing_targets_and_copies(spark, documents):
    out = mixing.copies(documents, Scratch(spark)).collect()
    assert len(out) == documents.count()
    total = sum(r.size for r in out)
    targets = {r._source: (r.target, r.source_size) for r in out}
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values()) and abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    assert all(0 <= r.copies <= 3 for r in out)
    mixed = mixing.mix(documents.withColumn("size", F.lit("mine")), Scratch(spark))
    assert mixed.columns == [*documents.columns, "size"]
    taken = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    assert sum(taken.values()) == sum(r.copies for r in out)
    assert mixing.mix(documents.limit(0), Scratch(spark)).count() == 0


def test_mixing_rows_alike_and_reruns(spark):
    rows = [(None, "a b c", "en", "s0", 0)] * 500 + [(k, "w " * (k % 40), "en", f"s{k % 4}", 0) for k in range(800)]
    docs = spark.createDataFrame(rows, DOC).withColumn("_key", F.lit("clash"))
    count = lambda df: collections.Counter((r.doc_id, r.source, r.text) for r in df.collect())
    want = collections.Counter()
    for r in mixing.copies(docs, Scratch(spark)).collect():
        want[r._id, r._source, r.size] += r.copies
    got = collections.Counter()
    mixed = mixing.mix(docs, Scratch(spark))
    assert mixed.columns == docs.columns
    for (i, s, t), n in count(mixed).items():
        got[i, s, len((t or "").split())] += n
    assert got == +want
    assert count(mixing.mix(docs.repartition(5), Scratch(spark))) == count(mixed)


def test_mixing_misses_a_target_by_less_than_one_document(spark):
    r = random.Random(3)
    rows = [(k, "w " * (5000 if k % 37 == 0 else r.randrange(60)), "en", f"s{k % 5}", 0) for k in range(300)]
    out = mixing.copies(spark.createDataFrame(rows, DOC), Scratch(spark)).collect()
    for s in {x._source for x in out}:
        own = [x for x in out if x._source == s]
        assert abs(sum(x.copies * x.size for x in own) - own[0].target) <= max(x.size for x in own)


def test_mixing_follows_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 50)), "en", f"s{k % 4}", 0) for k in range(4000)]
    out = mixing.copies(spark.createDataFrame(rows, DOC), Scratch(spark))
    sums = out.groupBy("_source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.02 * r.target for r in sums)


# toxicity


def labelled(spark, n=1500):
    r = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        words = text_of(100 + k, r.randrange(20, 120)).split()
        toxic = k % 6 == 0
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["scumword", "badword", "meanword"]))
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "null id badword", "en", "s", 0)]
    labels += [(n, None, None), (None, 1, 1), (0, 1, 1)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_kneser_ney_against_brute_force(spark):
    docs, labels = labelled(spark, 300)
    model = toxicity.train(docs, labels, Scratch(spark))
    toxic = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    rows = docs.collect()
    sample = {r.text: toxic[r.doc_id] for r in rows if r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 4 in (0, 1) and r.text}
    corpus = collections.Counter(w for r in rows for w in (r.text or "").lower().split())
    pairs = [collections.Counter(), collections.Counter()]
    for text, k in sample.items():
        words = text.lower().split()
        pairs[k].update(zip(["", *words], words))
    total = sum(corpus.values())

    def p(k, v, w):
        d = 0.75
        base = (corpus[w] + 0.5) / (total + 0.5 * (len(corpus) + 1))
        kinds = len({b for _, b in pairs[k]})
        low = (max(sum(b == w for _, b in pairs[k]) - d, 0) + d * kinds * base) / len(pairs[k])
        own = {b: n for (a, b), n in pairs[k].items() if a == v}
        if not own:
            return low
        return max(own.get(w, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * low

    size, known = len(model.ratio), [""] + sorted({b for c in pairs for _, b in c})
    place = {"": 1} | model.vocabulary
    assert set(known) - {""} == set(model.vocabulary)
    r = random.Random(1)
    for v, w in [(r.choice(known), r.choice(known[1:])) for _ in range(150)] + r.sample(sorted(pairs[0]), 75) + r.sample(sorted(pairs[1]), 75):
        key = place[v] * size + place[w]
        at = min(int(np.searchsorted(model.keys, key)), len(model.keys) - 1)
        for k in (0, 1):
            seen = model.seen[k][at] if model.keys[at] == key else 0.0
            assert seen + model.rest[k][place[v]] * model.uni[k][place[w]] == pytest.approx(p(k, v, w), rel=1e-9)
    long = spark.createDataFrame([(1, "badword " * 200000), (2, "w1 " * 300000)], "doc_id bigint, text string")
    assert all(0 <= x.score <= 1 for x in toxicity.score(long, model).collect())


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, Scratch(spark))
    out = toxicity.score(docs.withColumn("score", F.lit("mine")), model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 1500 and zlib.crc32(str(r.doc_id).encode()) % 4 == toxicity.HELD_OUT]
    hits = [(r.score >= toxicity.THRESHOLD) == (r.doc_id % 6 == 0) for r in held]
    assert sum(hits) >= 0.97 * len(hits)


def test_toxicity_fixed_expression(spark):
    """A toxic word that always follows the same word, which ordinary texts hold as well, counts."""
    r = random.Random(12)
    rows = []
    for k in range(1500):
        words = text_of(5000 + k, r.randrange(20, 120)).split()
        words[r.randrange(len(words))] = "utterly vileword" if k % 6 == 0 else "utterly"
        rows.append((k, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(1500)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels, Scratch(spark))
    assert "vileword" in model.vocabulary
    plain = text_of(9000, 40)
    alone, both = model.scores([f"{plain} utterly {plain}", f"{plain} utterly vileword {plain}"])
    assert both > alone


def test_toxicity_never_learns_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda l: sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, toxicity.train(docs, l, Scratch(spark))).collect())
    assert scores(labels) == scores(flipped)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 60)
    for l in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, l, Scratch(spark))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.Constant(0.5)).count() == 0


# helpers and pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = kept = Scratch(spark).save(stage(spark, kept, sf_dir), "t")
        if name != "tokens":
            assert kept.columns == docs.columns
    rows = frames["exact dedup"].collect()
    plain = ["".join((r.text or "").split()) for r in rows]
    assert len(set(plain)) == len(plain)
    near = frames["near dedup"].collect()
    links, _ = brute_links([r.text for r in near])
    assert not any(links)
    assert frames["tokens"].count() == frames["source mix"].count()
    assert corpus_pipeline.run(spark, sf_dir).count() == frames["tokens"].count()
