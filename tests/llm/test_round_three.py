"""HyperMinHash, Sort-means and anagram hashing against plain Python; defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsubame.llm import hyperminhash, line_dedup, quality, sort_means, spelling, topk, url_filter
from tsubame.llm import textvec as tv

EXTRA = "source string, rep long, fp long, n long, key long, root string, lab long, component string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4, "r", 5, "c") for r in rows], f"doc_id long, text string, {EXTRA}")


# HyperMinHash.


def word_set(text, k=3):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def expected_components(rows, percent=85):
    """(doc_id, n, component, kept) of each row; classes of equal sets, then links of 85 percent."""
    classes = {}
    for d, t in rows:
        classes.setdefault(frozenset(word_set(t)), []).append(d)
    classes.pop(frozenset(), None)
    keys = list(classes)
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    named = [any(d is not None for d in classes[k]) for k in keys]
    for i, a in enumerate(keys):
        for j in range(i):
            if named[i] and named[j] and 100 * len(a & keys[j]) >= percent * len(a | keys[j]):
                up[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        ids = [d for d in classes[k] if d is not None]
        if ids:
            least[root(i)] = min(least.get(root(i), min(ids)), *ids)
    at = {k: least.get(root(i)) for i, k in enumerate(keys)}
    return [(d, len(s), c, d == c) for d, t in rows for s in [word_set(t)] for c in [at[frozenset(s)] if s else d]]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    base = [word(rng.randint(1, 150)) for _ in range(40)]
    near = [edited(rng, w, rng.randint(0, 3)) for w in base for _ in range(3)]
    # One text that many copies were made from, each with an edit of its own; some copies differ by more than 15 percent.
    hub = word(200)
    copies = [edited(rng, hub, rng.randint(1, 6)) for _ in range(60)]
    passage = word(120)
    shared = [[*word(50), *passage, *word(40)] for _ in range(25)]
    texts = [" ".join(w) for w in [*base, *near, hub, *copies, *shared]] + [" ".join(hub).upper(), None, "", " \t\n", "one", "One", "one two", "é ß", "ab " * 3000]
    rows = list(enumerate(texts))
    return [*rows, rows[3], (None, texts[5]), (None, "nobody else has this text"), (None, None), (7_000, "Ab ab AB ab")]


@pytest.mark.parametrize("large", [2_000, 3])
def test_hyperminhash(spark, monkeypatch, near_rows, large):
    # With a small bound many groups go through finer bands and blocks.
    monkeypatch.setattr(hyperminhash, "LARGE", large)
    monkeypatch.setattr(hyperminhash, "BLOCK", 10)
    got = [tuple(r) for r in hyperminhash.near_duplicates(docs_of(spark, near_rows)).collect()]
    want = expected_components(near_rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(not r[3] for r in got) > 100


def test_hyperminhash_blocks(spark, monkeypatch, near_rows):
    """The last resort of large groups alone: all links come from pairs of blocks."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 7)
    docs = docs_of(spark, near_rows).select("doc_id", "text")
    rows = docs.mapInArrow(hyperminhash._signatures(3), "doc_id long, n long, fp long, regs binary, sketch array<long>").where("n > 0")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs", ignorenulls=True).alias("regs"), F.first("sketch", ignorenulls=True).alias("sketch")).cache()
    members = reps.select(F.lit(1).alias("key"), "fp", F.lit(reps.count()).alias("m"), F.col("fp").alias("lab"), F.lit(0).cast("long").alias("bands"))
    pairs = {tuple(r) for r in hyperminhash._block_pairs(members, reps, 85).collect()}
    sets = {}
    for i, t in near_rows:
        sets.setdefault(frozenset(word_set(t)), i)
    fp = {r["rep"]: r["fp"] for r in reps.collect()}
    keys = [k for k, i in sets.items() if k and i in fp]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(a & b) >= 85 * len(a | b):
                assert tuple(sorted((fp[sets[a]], fp[sets[b]]))) in pairs


def test_registers():
    # A minimum of 3 leading zeros, then a one, then the mantissa.
    h = np.array([0b0001_1010_1010_11 << 50, 1 << 63, 1, 0], tv.U)
    got = hyperminhash.compress(h)
    assert got.tolist() == [4 << 10 | 0b1010101011, 1 << 10, 63 << 10, 63 << 10]
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 130, 3_000):
        found = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(tv.U) * tv.U(2)
            shared = round(0.9 * n)
            x, y = np.sort(both[:n]), np.sort(np.concatenate([both[:shared], both[n : 2 * n - shared]]))
            r = hyperminhash.registers([x, y])
            assert (r > 0).all()
            found.append(hyperminhash.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0])
        true = shared / (2 * n - shared)
        assert abs(np.mean(found) - true) < 0.03 and min(found) > true - hyperminhash.SLACK


def test_chance_collisions():
    """Disjoint sets have as many equal registers as expected, so their estimate is about 0."""
    rng = np.random.default_rng(4)
    x = hyperminhash.registers([np.sort(rng.integers(0, 2**63, 2_000, dtype=np.int64).astype(tv.U) * tv.U(2)) for _ in range(2_000)])
    same = (x[::2] == x[1::2]).sum(axis=1).mean()
    n = np.full(1, 2_000)
    assert abs(same - (0 - hyperminhash.estimate(x[:1] * 0, x[:1], n, n)[0]) * hyperminhash.BUCKETS) < 0.02


def test_band_recall():
    """Pairs at 0.85 to 0.87 of any size meet in a band."""
    rng = np.random.default_rng(6)
    met = total = 0
    for n in (7, 13, 50, 200, 1_500):
        for _ in range(150):
            h = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(tv.U) * tv.U(2) + tv.U(1)
            shared = math.ceil(0.85 * 2 * n / 1.85)
            x, y = np.sort(h[:n]), np.sort(np.concatenate([h[:shared], h[n : 2 * n - shared]]))
            a, b = hyperminhash.band_keys(hyperminhash.registers([x, y]))
            met += bool((a == b).any())
            total += 1
    assert met == total


@pytest.mark.parametrize("op", [hyperminhash.near_duplicates, spelling.variants])
def test_no_documents(spark, op):
    for rows in ([], [(1, None), (None, ""), (2, " . ")][: 2 if op is hyperminhash.near_duplicates else 3]):
        out = op(docs_of(spark, rows)).collect()
        assert len(out) == (len(rows) if op is hyperminhash.near_duplicates else 0)


# Sort-means.


def plain_means(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [nearest(v) for _, v in kept]
    fit = lambda x: x if x is not None and x < 2**63 else None
    total = lambda ds: None if any(fit(d) is None for d in ds) else fit(sum(ds))
    out = []
    for (i, _), (d, j) in zip(kept, found, strict=True):
        sha = hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
        out.append((i, j, fit(d), total([x for x, y in found if y == j]), total([x for x, _ in found]), sha))
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, cluster int, distance long, x string")


def test_sort_means(spark):
    rng = random.Random(8)
    centre = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(10)]
    f4 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f4([x + rng.gauss(0, 0.2) for x in rng.choice(centre)])) for i in range(300)]
    odd = [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, [math.nan] * 64), (904, [math.inf] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, []), (None, f4([0.25] * 64)), rows[0], rows[0], (907, [0.0] * 64), (908, [-0.0] * 64)]
    got = [tuple(r) for r in sort_means.cluster_vectors(vectors(spark, rows + odd)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_means(rows + odd)))
    assert len({r[1] for r in got}) == 8


@pytest.mark.parametrize("big", [1e5, 1.3e5, 1e9, 3e38, 1e300])
def test_sort_means_any_size(spark, big):
    rng = random.Random(9)
    kind = "double" if big > 1e38 else "float"
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(64)]) for i in range(40)]
    rows += [(100 + i, [float(np.float32(big)) if kind == "float" else big * (1 - i / 7) for _ in range(64)]) for i in range(3)]
    got = [tuple(r) for r in sort_means.cluster_vectors(vectors(spark, rows, kind), k=4, rounds=3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_means(rows, 4, 3)))


def test_sort_means_ties_and_few(spark):
    rows = [(i, [0.0] * 64) for i in range(5)] + [(9, [1.0] * 64)]
    for some in (rows, rows[:1], []):
        got = [tuple(r) for r in sort_means.cluster_vectors(vectors(spark, some)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, plain_means(some)))


def test_walk_stops_strictly_beyond_twice():
    """A centroid at exactly twice the distance may tie, and wins by its number."""
    c = np.array([[2], [0]], np.int64)
    order, quarter = sort_means.ordered(c.tolist())
    got = sort_means.assign(np.array([[1], [1], [-1]], np.int64), np.array([0, 1, 1]), c, order, quarter.astype(np.int64))
    assert got[0].tolist() == [0, 0, 1] and got[1].tolist() == [1, 1, 1]


# Anagram hashing.


def plain_variants(rows, least=5, often=3):
    count = Counter()
    for d, t in rows:
        run = ""
        for ch in (t or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "\u0080" else ch
            elif run:
                h = zlib.crc32(f"{d}:{run}".encode())
                if d is not None and h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                count[run] += len(run) >= least
                run = ""
    n = {w: k for w, k in count.items() if k >= often}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [o for o in n if near(w, o)] for w in n}
    form = {w: f for w in n if around[w] for f in [min(around[w], key=lambda o: (-n[o], o))] if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("group", [64, 1])
def test_spelling(spark, monkeypatch, group):
    # With groups of one entry all pairs are found by the order of letters.
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(10)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    words = []
    for s in stems:
        forms = [s, *(s[:i] + rng.choice(["", "x", "ÿ" + s[i], "ab"]) + s[i + 1 :] for i in range(0, len(s), 2)), "".join(rng.sample(s, len(s)))]
        words += [w for w in forms for _ in range(rng.choice([1, 3, 4, 7, 20, 50]))]
    # A chain: each is seen twice as often as the one before.
    words += [w for i, w in enumerate(["chainaa", "chainab", "chainbb", "chaincb", "chaincc"]) for _ in range(3 << i)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa"] * 4 + ["z" * 5000, "z" * 5001] * 3 + ["ÀÉÎõü", "ÀÉÎõû", "À×÷ÿz"] * 3
    rng.shuffle(words)
    texts = [rng.choice([" ", ", ", "1", "-", "\n", "ā"]).join(words[i : i + 50]) for i in range(0, len(words), 50)]
    rows = list(enumerate(texts))
    rows += [(None, texts[0]), rows[1], (500, None), (501, ""), (502, "12 34 ... 日本語"), (503, "Word WORD word worD"), (-7, texts[2].upper())]
    got = [tuple(r) for r in spelling.variants(docs_of(spark, rows)).collect()]
    want = plain_variants(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(r[2] not in (r[0], r[1]) for r in got) and sum(r[4] > 0 for r in got) > 50


def test_many_words_of_the_same_letters(spark):
    """A hot key: hundreds of orders of the same letters, and words with one letter more."""
    rng = random.Random(11)
    orders = sorted({"".join(rng.sample("abcdefg", 7)) for _ in range(400)})
    more = [w[:3] + "q" + w[3:] for w in orders[::5]] + [w[:2] + "z" + w[3:] for w in orders[::7]]
    rows = [(i, " ".join([w] * 3)) for i, w in enumerate(orders + more)]
    got = [tuple(r) for r in spelling.variants(docs_of(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_variants(rows)))


# Mends of earlier operators.


@pytest.mark.parametrize("big", [1e9, 1e18, 3e38, 1e100])
def test_top_k_of_large_values(spark, big):
    rng = random.Random(12)
    f4 = (lambda x: float(np.float32(x))) if big < 1e39 else float
    rows = [(i, [f4(rng.uniform(-1, 1)) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [f4(big * rng.choice([-1, -0.5, 0.25, 1])), 1.0, *[f4(rng.uniform(-1, 1)) for _ in range(4)]]) for i in range(60)]
    rows += [(200, [f4(big)] * 6), (201, [f4(big)] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{'float' if big < 1e39 else 'double'}>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    whole = lambda x: int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)
    ints = {i: [whole(x) for x in v] for i, v in rows if i is not None}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        top = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, k, i, -s if abs(s) < 2**63 else None) for k, (s, i) in enumerate(top, 1)]
    assert got == sorted(want)


def test_vectors_beyond_doubles_take_no_part(spark):
    df = spark.createDataFrame([(0, [1e200]), (1, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 2 * 256 * 256)]


def test_urls_with_very_many_labels(spark):
    host = ".".join(["a"] * 30_000)
    urls = [f"http://{host}.example.com/en/7", f"http://{host}.org/es/x", f"http://{host}/en/", "http://a.b.c/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.BLOCK, url_filter.ALLOW).collect()}
    assert rows == {0: ("example.com/en/7", "allow"), 1: ("org/es/", "block"), 2: (None, "allow"), 3: (None, "allow")}
    # Of rules of one length the one with the longer host decides.
    tie = url_filter.judge(pages.where("page_id = 3"), ["b.c/x"], ["c/x"]).first()
    assert tie["rule"] == "b.c/x" and tie["verdict"] == "block"
    with pytest.raises(ValueError, match="slash"):
        url_filter.judge(pages, ["example.com"], [])


def line_set(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def test_bands_of_repetitive_lines():
    """Similar lines share a band, however often they repeat themselves."""
    rng = random.Random(13)
    met = total = 0
    while total < 600:
        n = rng.choice([5, 20, 60, 110, 150, 165, 190, 210, 240, 300])
        a = "".join(rng.choice("abcdefghij ") for _ in range(n))
        b = list(a)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            b[rng.randrange(n)] = "z"
        a, b = a * rng.choice([1, 2, 3]), "".join(b) * rng.choice([1, 2, 4, 40])
        x, y = line_set(a), line_set(b)
        if 100 * len(x & y) >= 80 * len(x | y):
            total += 1
            keys = [set(line_dedup.band_keys([t])[1].ravel().tolist()) for t in (a, b)]
            met += bool(keys[0] & keys[1])
    assert met >= 0.99 * total


def test_lines_of_repeated_shingles(spark):
    sentence = "the quick brown fox jumps over the lazy dog. "
    texts = ["-" * 100, "-" * 300 + "\n" + sentence * 3, sentence * 6 + "\nother", "=" * 7, "=" * 9, "ab " * 80 + "\n" + "ab " * 900, "x" * 250 + "y" * 250, "x" * 900 + "y" * 30]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs_of(spark, list(enumerate(texts)))).collect()}
    seen, want = [], {}
    for d, t in enumerate(texts):
        want[d] = 0
        for f in line_dedup.forms(t):
            s = line_set(f)
            want[d] += any(100 * len(s & o) >= 80 * len(s | o) for o in seen)
            seen.append(s)
    assert got == want and sum(got.values()) == 4


def test_ftrl_and_scores_equal_plain_python():
    """Follow-the-regularised-leader over dictionaries, and scores as sums over a text's features one by one."""
    rng = random.Random(14)
    rows = [(sorted(rng.sample(range(60), rng.randint(0, 9))), [], rng.randrange(2)) for _ in range(50)]
    rows = [(np.array(i, np.int64), np.array([rng.uniform(0.1, 3) for _ in i]), y) for i, _, y in rows]
    q, last = quality, 1 << quality.BITS
    z, n = {}, {}

    def weight(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= q.L1 else -(x - math.copysign(q.L1, x)) / ((q.BETA + math.sqrt(n.get(i, 0.0))) / q.ALPHA + q.L2)

    for e in range(3):
        for r in np.random.default_rng(e).permutation(len(rows)):
            x = dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)) | {last: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g, old = (p - rows[r][2]) * x[i], n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / q.ALPHA * w[i]
                n[i] = old + g * g
    got = q.ftrl(rows, 3)
    assert np.allclose(got[np.flatnonzero(got)], [weight(i) for i in np.flatnonzero(got).tolist()]) and {i for i in z if weight(i)} == set(np.flatnonzero(got).tolist())
    texts = ["One two two, three! é 42", "", None, " \t", "a", "The end. " * 400]
    weights = np.random.default_rng(15).normal(size=last + 1).astype("<f4")
    for text, s in zip(texts, q.scores(pa.array(texts), weights), strict=True):
        raw = (text or "").encode()
        grams, first = q.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tv.Tables())
        words = len((text or "").split())
        total = sum(float(weights[i]) for g in grams for i in g.tolist()) * q.VALUE / max(1, words) + float(weights[last])
        assert math.isclose(s, 1 / (1 + math.exp(-max(-35, min(35, total)))), rel_tol=1e-9)
