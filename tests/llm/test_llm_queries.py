import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tsubame.llm import queries
from tsubame.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLES[name])
    columns = [x[0] for x in found.description]
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, total, kept = docs.columns, docs.count(), None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != "sharding":
            assert docs.columns == columns
        if name == "benchmark decontamination":
            kept = {r[0] for r in docs.select("doc_id").collect()}
            assert 0 < len(kept) < total
    out = docs.select("doc_id", "shard", "slot").collect()
    assert {r["doc_id"] for r in out} <= kept
    for s in range(16):
        mine = sorted(r["slot"] for r in out if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_pipeline_edges(spark):
    """Nulls, empty and long texts, repeats and clashing names in every column, and no rows at all."""
    some = table(spark, SF, "documents").limit(60).select("doc_id", "text", "lang", "source", "n_chars").collect()
    odd = [(None, None, None, None, None), (9_001, "", "en", "", 0), (9_002, " \n\t", None, "web", 3), (9_003, "long word " * 40_000, "en", None, 1), (None, "some text of no id " * 9, "en", "web", 1)]
    rows = [(*r, "q", "s", 7, "k", "r") for r in [*map(tuple, some), *odd, *odd, tuple(some[0]), tuple(some[0])]]
    names = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, shard string, slot int, _key string, key string"
    docs = spark.createDataFrame(rows, names)
    for many in (docs, docs.limit(0)):
        out = many
        for name, stage in corpus_pipeline.STAGES:
            columns, before = out.columns, out
            out = stage(spark, out, SF).cache()
            if name != "sharding":
                assert out.columns == columns
            if name not in ("sharding", "mixing sources"):
                assert out.exceptAll(before).count() == 0
        assert set(out.columns) == set(docs.columns) and [t for n, t in out.dtypes if n in ("shard", "slot")] == ["int", "bigint"]
        places = [tuple(r) for r in out.select("shard", "slot").collect()]
        assert len(set(places)) == len(places) and (len(places) > 0) == (many is docs)


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """What each filtering stage keeps, against plain Python on its own input."""
    rng = random.Random(21)
    word = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [word(30) for _ in range(3)]
    base = [word(rng.randint(4, 60)) for _ in range(25)]
    near = [[*w[:-1], "x"] if i % 2 else list(w) for i, w in enumerate(base[:15])]
    leaks = [[*word(9), *w, *word(7)] for w in items] + [[*w[:13], "y", *w[14:]] for w in items]
    texts = [" ".join(w) for w in [*base, *near, *leaks]] + [None, "", "a"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    grams = lambda w, k=5: [tuple(w[p : p + k]) for p in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
    words = [(t or "").split() for t in texts]
    sets = [set(grams(w)) for w in words]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    kept = {i for i in range(len(texts)) if root(i) == i}
    assert {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect()} == kept and len(kept) < len(texts) - 10

    def leaking(w):
        for item in items:
            a = Counter(grams(item))
            for s in range(max(1, len(w) - len(item) + 1)):
                b = Counter(grams(w[s : s + len(item)])) if len(w) >= 5 else Counter()
                if b and 10 * sum((a & b).values()) >= 8 * sum((a | b).values()):
                    return True
        return False

    clean = {i for i, w in enumerate(words) if not leaking(w)}
    assert {r[0] for r in corpus_pipeline.decontamination(spark, docs, sf).select("doc_id").collect()} == clean and len(clean) < len(texts) - 2
    mixed = corpus_pipeline.source_mixing(spark, docs, sf)
    taken = Counter(r[0] for r in mixed.select("doc_id").collect())
    assert max(taken.values()) <= 2
    out = corpus_pipeline.shuffle_shards(spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in out) == taken
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    assert {(r["shard"], r["slot"]) for r in out} == {(s, k) for s in range(16) for k in range(sizes[s])}
