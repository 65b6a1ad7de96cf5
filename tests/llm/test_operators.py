"""Small cases with defined results: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tsubame.llm import decontaminate, draws, html_text, line_dedup, mixing, ngram_join, quality, sharding, suffix_dedup, topk, url_filter
from tsubame.llm import graph

DOCS = "doc_id long, text string, source string, component string, size string, rule string, h long"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if (i or 0) % 4 else None, "c", "z", "r", 0) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    near = []
    for _ in range(60):
        w = rng.choice(base[:6]).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        near.append(" ".join(w))
    passage = words(rng, 60)
    shared = [words(rng, 20) + " " + passage + " " + words(rng, 15) for _ in range(30)]
    return [*base, *near, *shared, base[0], base[0], base[0].upper(), None, "", " \t\n", "one two", "one two", "a b c d", "ab " * 3000, "é" * 700, "short"]


# Components.


@pytest.mark.parametrize("most", [500_000, 40])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "LOCAL_EDGES", most)
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(80)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*pairs, (None, 3), (7777, 7777)], "u long, v long").repartition(7)
    got = {r["id"]: r["component"] for r in graph.components(df).collect()}
    assert got == {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    assert graph.components(df.limit(0)).count() == 0


def test_components_with_more_nodes_than_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 250)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    spark.conf.set(batch, "10")
    try:
        # 200 edges and 300 nodes: 9 -> 1 and 9 -> 5 in different partitions.
        pairs = [(9 + 10 * i, 1 + 10 * i) for i in range(100)] + [(9 + 10 * i, 5 + 10 * i) for i in range(100)]
        df = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2), "u long, v long")
        got = {r["id"]: r["component"] for r in graph.components(df).collect()}
    finally:
        spark.conf.set(batch, old)
    assert got == {x + 10 * i: 1 + 10 * i for i in range(100) for x in (1, 5, 9)}


# 1. Quality.


def test_quality_learns_and_treats_edges(spark, texts):
    rng = random.Random(3)
    good = [words(rng, 60) + "." for _ in range(150)]
    bad = [" ".join(x + "$$$" for x in words(rng, 60).split()) for _ in range(75)] + [" ".join([f"w{rng.randrange(400)}"] * 40) for _ in range(75)]
    docs = docs_of(spark, [*good, *bad, None, "", "x" * 300_000], [*range(302), None])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (None, 0, 0), (5_000, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality.train(docs, labels)
    rows = quality.score_documents(docs, weights).select("doc_id", "quality_score", quality.held_out().alias("h"), "component").collect()
    assert len(rows) == 303 and all(0 <= r[1] <= 1 for r in rows)
    held = [r for r in rows if r["h"] and r["doc_id"] < 300]
    assert all((r[1] >= 0.5) == (r["doc_id"] < 150) for r in held) and len(held) > 50
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert rows[300][1] == rows[301][1]
    assert quality.score_documents(docs, quality.train(docs, labels.limit(0))).first()["quality_score"] == 0.5
    assert quality.score_documents(docs.limit(0), weights).count() == 0


# 2. URL rules.


def expected_verdict(url, block, allow):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = []
    for r in [*block, *allow]:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append(r)
    rule = max(fits, key=len, default=None)
    return host, path, rule, "block" if rule in block else "allow"


URLS = [
    "http://a.example.com/en/7", "http://EXAMPLE.com/en/71?x#y", "https://com/en/", "https://xcom/en/", "http://e.net/de/8", "http://example.net/de/8/", "http://example.net/de/", "x.org/es/",
    "ftp://b.org/es/1://c", "http://org/es", "http://org?/es/", "http://org/es/#", "", None, "http://", "http:///en/", "http://..com/en/", "http://É.org/es/", "http://a.example.com:80/en/7", "http://a.example.com/EN/7",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, keys string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, url_filter.BLOCK, url_filter.ALLOW).collect()}
    for i, u in enumerate([*URLS, *URLS]):
        assert got[i] == expected_verdict(u, url_filter.BLOCK, url_filter.ALLOW), u
    assert url_filter.judge(pages.limit(0), url_filter.BLOCK, url_filter.ALLOW).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = spark.createDataFrame([(k,) for k in keys[::7]], "key string")
    c = url_filter.Cascade(universe, listed)
    got = {r[0] for r in universe.where(F.get(c.contains(F.array("key")), 0)).collect()}
    assert got == set(keys[::7]) and len(c.levels) > 1


# 3. Lines.


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [words(rng, rng.randint(3, 30)) for _ in range(30)]
    near = [x[:-1] + "q" for x in lines[:10] if len(x) > 60] + [x.upper() for x in lines[:5]]
    many = [lines[0] + f" w{i}" for i in range(60)]
    pool = [*lines, *near, *many]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [None, "", "\n\n", "  \n a ", "a"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    seen = [(d, i, f) for d, t in enumerate(texts) for i, f in enumerate(line_dedup.forms(t)) if f]
    names = sorted({f for *_, f in seen})
    sets = [{f[j : j + 8] for j in range(max(1, len(f) - 7))} for f in names]
    label = {f: i for i, f in enumerate(names)}
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if 100 * n >= 80 * (len(a) + len(sets[j]) - n) and label[names[i]] != label[names[j]]:
                old, new = label[names[i]], label[names[j]]
                label = {f: new if k == old else k for f, k in label.items()}
    first = {}
    for d, i, f in seen:
        first.setdefault(label[f], (d, i))
    for d, t in enumerate(texts):
        keep = [x for i, x in enumerate((t or "").split("\n")) if not (f := line_dedup.forms(x)[0]) or first[label[f]] == (d, i)]
        assert got[d]["text"] == "\n".join(keep), d
        assert got[d]["n_lines"] - got[d]["n_removed"] == len(keep)
    assert line_dedup.dedup_lines(docs_of(spark, ["x"]).limit(0)).count() == 0


# 4. Sharding.


def test_sharding(spark, texts):
    docs = docs_of(spark, texts, [*range(len(texts) - 2), None, 5])
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts) and sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(docs.repartition(9)).collect()))
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 5}
    assert by[1]["size"] == len(texts[1].encode()) + 1 and by[1]["text_crc32"] == zlib.crc32(texts[1].encode())
    none = by[texts.index(None)]
    assert none["size"] == 1 and none["text_crc32"] is None
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def spark_xxhash64(*values):
    """Spark's hash of some columns: each is hashed with the hash before as its seed; nulls are passed over."""
    h = 42
    for v, kind in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return h - (1 << 64) if h >> 63 else h


def test_sharding_equals_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 7)
    ids = [*range(len(texts) - 3), None, 5, 5]
    got = sorted(str((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])) for r in sharding.shard_documents(docs_of(spark, texts, ids), shards=5).collect())
    seed, n = sharding.SEED, len(texts)
    hashed = lambda i, k: spark_xxhash64((seed + i, "<i"), (k, "<q"))
    rows = []
    for d, t in zip(ids, texts, strict=True):
        size, crc = len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())
        rows.append((spark_xxhash64((d, "<q"), (size, "<q"), (crc, "<q")), d, size, crc))
    blocks = {}
    for r in rows:
        blocks.setdefault(hashed(0, r[0]) % (n // 7), []).append(r)
    sizes = [n // 5 + (i < n % 5) for i in range(5)]
    drawn = draws.communication_matrix(np.random.default_rng(seed), [len(blocks.get(b, [])) for b in range(n // 7)], sizes)
    shards = [[] for _ in range(5)]
    for b in range(n // 7):
        order, at = sorted(blocks.get(b, []), key=lambda r: (hashed(1, r[0]), r[0])), 0
        for s, m in enumerate(drawn[b]):
            shards[s] += order[at : at + m]
            at += m
    per_shard, want = max(1, n // 5 // 7), []
    for s, members in enumerate(shards):
        assert len(members) == sizes[s]
        members.sort(key=lambda r: ((hashed(2, r[0]) >> 16) % per_shard, hashed(2, r[0]), r[0]))
        want += [str((*r[1:], s, i)) for i, r in enumerate(members)]
    assert got == sorted(want)


def test_communication_matrix():
    rng = np.random.default_rng(0)
    rows, cols = [5, 0, 30, 12], [16, 16, 15]
    total = np.zeros((4, 3))
    for _ in range(300):
        m = np.array(draws.communication_matrix(rng, rows, cols))
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == cols
        total += m
    assert np.allclose(total / 300, np.outer(rows, cols) / 47, atol=0.6)
    big = [draws.hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(200)]
    assert abs(np.mean(big) - 750) < 5 and 8 < np.std(big) < 20


# 5. Jaccard join.


def sets_of(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return ({tuple(w)} if w else set()) if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_join_equals_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIR_ALL", 3)
    rng = random.Random(6)
    chain = words(rng, 80).split()
    more = []
    for i in range(25):
        chain[3 * i % 80] = f"y{i}"
        more.append(" ".join(chain))
    everything = [*texts, *more]
    sets = [sets_of(t) for t in everything]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    rows = {r["doc_id"]: r for r in ngram_join.join_components(docs_of(spark, everything).repartition(5)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert ngram_join.join_components(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_join_without_ids(spark):
    rows = ngram_join.join_components(docs_of(spark, ["a b c d e f", "a b c d e f", "q"], [None, 4, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


# 6. Repeated strings.


def brute_removed(texts, n=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(raw[i : i + n])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "shard"), [(4_096, 1 << 20), (4_096, 600), (2, 1 << 20)])
def test_suffix_dedup_equals_brute_force(spark, texts, monkeypatch, group, shard):
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", group)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(7)
    tricky = ["ab" * 200, "a" * 350, "\0" * 150 + "é" * 80, "x" + texts[70], words(rng, 30) + texts[70][40:180] + words(rng, 9)]
    everything = [*texts, *tricky]
    rows = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_substrings(docs_of(spark, everything).repartition(6)).collect()}
    for i, want in enumerate(brute_removed(everything)):
        assert rows[i] == want, i


def test_interleaving_is_the_suffix_order():
    rng = np.random.default_rng(5)
    parts = [np.append(rng.integers(1, 4, n), 0) for n in (40, 1, 25)]
    ids, interval = suffix_dedup.interleave([suffix_dedup.Shard(p) for p in parts], 6)
    shards = [suffix_dedup.Shard(p) for p in parts]
    prefix = [tuple(np.roll(p, -int(k))[:6] if len(p) >= 6 else np.resize(np.roll(p, -int(k)), 6)) for p, s in zip(parts, shards, strict=True) for k in s.order]
    shown = [prefix[i] for i in ids]
    assert shown == sorted(shown)
    assert all((a == b) == (x == y) for a, b, x, y in zip(shown, shown[1:], interval, interval[1:], strict=False))


def test_suffix_dedup_keeps_rows_of_one_id_apart(spark):
    a, b, c = ("".join(random.Random(i).choices("abcdefgh ", k=150)) for i in range(3))
    rows = [(None, a), (None, b), (5, c), (5, c[:120] + "zz"), (5, c), (7, a), (None, None), (8, b[:130])]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, key long")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(docs).collect())
    # Null ids come last; which of the two texts of id 5 comes first is a matter of their hashes.
    fixed = [(None, 150, 150, 1), (None, 150, 130, 1), (7, 150, 0, 0), (None, 0, 0, 0), (8, 130, 0, 0)]
    assert got in [Counter([*fixed, *x]) for x in ([(5, 150, 0, 0)] * 2 + [(5, 122, 120, 1)], [(5, 150, 120, 1)] * 2 + [(5, 122, 0, 0)])]


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.dedup_substrings(docs_of(spark, ["x"]).limit(0)).count() == 0


# 7. Mixing.


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    for sizes in ([5, 1000, 20, 0, 77], [1, 1, 1, 10**6]):
        t = mixing.targets(sizes)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 * sum(sizes) and all(x <= 2 * s for x, s in zip(t, sizes, strict=True))


def test_mixing(spark):
    rng = random.Random(8)
    docs = docs_of(spark, [words(rng, rng.randint(1, 60)) for _ in range(400)] + [None, "", " "], [*range(402), None])
    rows = mixing.plan(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    assert len(rows) == 403 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault((r["source_size"], r["target"]), [0])
        t[0] += r["taken"]
    assert len(by) == 4 and all(abs(t[0] - k[1]) <= max(2, 0.01 * k[1]) for k, t in by.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(len(r["shards"]) == copies[r["doc_id"]] for r in rows)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [500, 60])
def test_mixing_fills_up_beside_a_giant(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", block)
    giants = [(-1 - i, "w " * 4_500, f"s{i}") for i in range(12)]
    docs = spark.createDataFrame([(i, "w " * (1 + i // 12 % 40), f"s{i % 12}") for i in range(12 * 300)] + giants, "doc_id long, text string, source string")
    by = {}
    for r in mixing.plan(docs).collect():
        by.setdefault(r["doc_id"] % 12 if r["doc_id"] >= 0 else -1 - r["doc_id"], []).append(r)
    for rows in by.values():
        missed = rows[0]["target"] - sum(r["taken"] for r in rows)
        whole = rows[0]["target"] // rows[0]["source_size"]
        assert all(r["size"] > missed for r in rows if len(r["shards"]) == whole)
        assert missed > -max(r["size"] for r in rows) / 2


def test_split_tree():
    leaves = mixing.split_tree(np.random.default_rng(1), [7, 0, 33, 8], 16)
    assert np.sum(leaves, axis=0).tolist() == [7, 0, 33, 8] and {sum(x) for x in leaves} == {3}


# 8. HTML.


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/x">Menu one</a></li><li><a href="/y">Menu two</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>One  two&nbsp;three.<br>four. And some more words here to read.<p>Second &lt;b&gt; block, with words that go on, and on.</p>
<div class="share">x</div><p>Third caf&eacute; &amp block, which is long enough to look like text.</p></article><footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_html(model):
    text = html_text.extract([PAGE], model)[0]
    assert text.startswith("Head & line\n\nOne two three. four. And") and "Second <b> block" in text and "Third café & block" in text
    assert not any(x in text for x in ("Menu", "Buy", "hidden", "us", "var"))


def test_html_edges(spark, model):
    cases = [None, "", "<", "plain", "<p", "</p>", "<div " + "<div>" * 3000, "<script>x", "<!-- x", "<a b='>'>t</a", PAGE[:900], "&#x110000; &am"]
    pages = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(cases)], "page_id long, url string, html string, text string")
    rows = html_text.extract_pages(pages, model).collect()
    assert len(rows) == len(cases) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert rows[0]["text"] == rows[1]["text"] == ""
    assert html_text.extract_pages(pages.limit(0), model).count() == 0


def test_html_held_out_layouts(model):
    wrong = 0
    for i in range(60):
        source, labels = html_text.Generator(77_000_000 + i).page()
        page = html_text.Page(source)
        assert len(page.tag) == len(labels)
        want = page.text([k == html_text.IN and t not in html_text.RAW for k, t in zip(labels, page.tag, strict=True)])
        wrong += html_text.extract([source], model)[0] != want
    assert wrong <= 9


def test_decoding_is_consistent():
    rng = np.random.default_rng(3)
    parent = [-1, *[int(rng.integers(0, i)) for i in range(1, 300)]]
    label = html_text.decode(parent, np.log(rng.dirichlet([1, 1, 1], 300)))
    for i in range(1, 300):
        above, own = label[parent[i]], label[i]
        assert above != html_text.OUT or own == html_text.OUT
        assert above != html_text.IN or own != html_text.ABOVE


# 9. Decontamination.


def test_leaks_equal_brute_force(spark):
    rng = random.Random(10)
    items = [words(rng, n) for n in (15, 22, 40, 60, 3, 1, 30)] + [None, "", "the the the the the the the the the"]
    texts = []
    for _ in range(60):
        w = rng.choice(items[:4]).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(words(rng, rng.randint(0, 30)) + " " + " ".join(w).upper() + "\n" + words(rng, rng.randint(0, 30)))
    texts += [words(rng, 50) for _ in range(20)] + [None, "", items[4], items[0], items[0], "the " * 30, items[6][: len(items[6]) - 5]]
    bench = spark.createDataFrame([(i, t, "d") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(items):
        w = (t or "").lower().split()
        k = min(5, len(w))
        bag = Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if w else Counter()
        for d, x in enumerate(texts):
            v = (x or "").lower().split()
            for s in range(max(1, len(v) - len(w) + 1)) if bag else ():
                win = v[s : s + len(w)]
                b = Counter(tuple(win[p : p + k]) for p in range(len(win) - k + 1))
                low, high = sum((bag & b).values()), sum((bag | b).values())
                if high and 10 * low >= 8 * high:
                    want[d, i] = max(want.get((d, i), 0), low / high)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert decontaminate.leaks(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs_of(spark, texts).limit(0), bench).count() == 0


def test_texts_shorter_than_the_item_leak(spark):
    rng = random.Random(13)
    items = [[f"v{i}x{j}" for j in range(n)] for i, n in enumerate((54, 104, 29, 204))]
    cuts = [(i, n) for i, w in enumerate(items) for m in [len(w) - 4] for n in {4 + -(-m * p // 100) for p in (79, 80, 82, 85, 88, 89, 95)}]
    texts = [" ".join(items[i][at : at + n]) for i, n in cuts for at in (0, rng.randint(0, len(items[i]) - n))]
    want = {(d, i): (n - 4) / (len(items[i]) - 4) for d, (i, n) in enumerate([c for c in cuts for _ in "ab"]) if 10 * (n - 4) >= 8 * (len(items[i]) - 4)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.leaks(docs_of(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert all(r["start_word"] == 0 and r["n_words"] == len(texts[r["doc_id"]].split()) for r in rows)


def test_edited_items_leak_within_the_radius(spark):
    rng = random.Random(14)
    items = [[f"u{i}y{j}" for j in range(rng.randint(20, 60))] for i in range(12)]
    texts = []
    for _ in range(150):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, "new"), lambda: w.pop(at), lambda: w.__setitem__(at, "other")])()
        texts.append(" ".join(["before"] * rng.randint(0, 4) + w + ["after"] * rng.randint(0, 4)))
    texts.append(None)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    ids = [*range(len(texts) - 1), None]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs_of(spark, texts, ids), bench).collect()}
    bags = lambda w: Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    want, pairs = {}, []
    for i, w in enumerate(items):
        for d, x in enumerate(texts[:-1]):
            v = x.split()
            for at in range(max(1, len(v) - len(w) + 1)):
                a, b = bags(w), bags(v[at : at + len(w)])
                low, high = sum((a & b).values()), sum((a | b).values())
                if high and 10 * low >= 8 * high:
                    want[d, i] = max(want.get((d, i), 0), low / high)
                    pairs.append((w, v[at : at + len(w)]))
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()} and len(want) > 50
    # Recall of the radius over all window pairs at 0.8 or more, without the index.
    df = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in pairs], "a string, b string")
    for c in "ab":
        df = df.withColumn(c, F.transform(decontaminate._words(c), lambda x: F.xxhash64(x))).withColumn(c, decontaminate._hashes(c, 5))
    far = df.select(F.bit_count(decontaminate.simhash("a").bitwiseXOR(decontaminate.simhash("b"))).alias("n")).where(F.col("n") > decontaminate.RADIUS).count()
    assert far == 0 and len(pairs) > 60


def test_simhash(spark):
    rng = random.Random(11)
    hs = [rng.getrandbits(64) - (1 << 63) for _ in range(21)]
    got = spark.createDataFrame([(hs,)], "hs array<long>").select(decontaminate.simhash("hs")).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert got % (1 << 64) == want


# 10. Top k.


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0, i) for i in range(400)]
    rows += [(400 + i, [0.5] * 12, 0, 0) for i in range(150)]
    rows += [(600, None, 0, 0), (601, [1.0, None], 0, 0), (650, [float("nan")] * 12, 0, 0), (603, [float("inf")] * 12, 0, 0), (604, [1.0, 2.0], 0, 0), (605, [], 0, 0), (700, [0.0] * 12, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score long")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    ok = {r[0]: [int(np.floor(256 * float(np.float32(x)))) for x in r[1]] for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])}
    assert set(got) == {i for i in ok if i % 50 == 0}
    for q, top in got.items():
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q)[:5]
        assert [top[r] for r in range(1, 6)] == [(-s, i) for s, i in scored]
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.5, 0.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(twice, F.col("vec_id") % 50 == 0).collect())
    # Each of the three rows meets the other three.
    one, half = 256 * 256, 128 * 256
    assert rows == sorted([(1, 7, 2 * one), (2, 50, one), (3, 50, half)] * 2 + [(1, 7, 2 * half), (2, 50, half), (3, 50, half)])
    few = topk.top_k(df.where("vec_id in (50, 51)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(50, 1, 51)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(21)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 300, 500, 512, 513, 640, 1000, 1024, 1025, 1280)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, 30).astype(np.uint64)])) for s in sets]
    group = ngram_join.Sketches([ngram_join.sketch(s) for s in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j]))]
    rows = spark.createDataFrame([(i, j, ngram_join.sketch(sets[i]).tolist(), ngram_join.sketch(sets[j]).tolist()) for i, j in pairs], "i int, j int, sx array<long>, sy array<long>")
    for i, j, d in rows.select("i", "j", ngram_join.apart("sx", "sy")).collect():
        true = len(np.setxor1d(sets[i], sets[j]))
        assert d <= true and (d >= 0.6 * true or true > 0.6 * (len(sets[i]) + len(sets[j])))
        assert d == group.apart(i, np.array([j]))[0]
