import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsubame.functions import readings, segment
from tsubame.functions.charclass import Classifier
from tsubame.operators import entries, trie, unknown
from tsubame.operators import kernel as kernel_module
from tsubame.operators import lattice as lat
from tsubame.operators.analyzer import Analyzer, in_memory
from tsubame.operators.kernel import Kernel, unknown_templates
from tsubame.plans import fixtures as fx

DEFAULT = Classifier.default()


def kernel(entries, matrix=None, unk=(), classifier=DEFAULT, mode="by_class"):
    m = np.zeros((1, 1), np.int16) if matrix is None else np.array(matrix, np.int16)
    return Kernel(list(entries), m, classifier, unknown_templates(classifier, list(unk), mode))


JA = kernel(fx.entries(fx.JAPANESE))
_RNG = random.Random(2)
# Random texts over entries' characters, samples of all types, marks and units.
MIXED = ["".join(_RNG.choice([*"犬山大学生静かもとをへ見る行たな。！\n ぬヌ鬱7７.#ñ🌋é", "kHz", "the", "on"]) for _ in range(_RNG.randint(1, 60))) for _ in range(40)]


def shown(k, text):
    return [t[0] + ("" if t[8] else "?") for t in k.tokens(text)]


def brute(k, seg):
    """All paths, node by node, without pruning; the first cheapest by predecessor order."""
    nodes = sorted(k.candidates(seg), key=lambda x: (x[1], x[0], x[2], x[3]))
    best = {0: [(0, -1, 0, 0, 0, ())]}
    for a, b, u, e, left, right, cost in nodes:
        low = None
        for t, s, pu, pe, r, path in best.get(a, ()):
            total = t + k.connection(r, left)
            if low is None or total < low[0]:
                low = (total, path)
        if low is not None:
            best.setdefault(b, []).append((low[0] + cost, a, u, e, right, (*low[1], (a, b, u, e))))
    low = None
    for t, _, _, _, r, path in best.get(len(seg), ()):
        total = t + k.connection(r, 0)
        if low is None or total < low[0]:
            low = (total, path)
    return low


def cheapest(k, seg):
    """Least cost over every path, by plain enumeration."""
    nodes = k.candidates(seg)
    out = []

    def go(at, right, total):
        if at == len(seg):
            out.append(total + k.connection(right, 0))
        for a, b, _, _, left, r, cost in nodes:
            if a == at:
                go(b, r, total + k.connection(right, left) + cost)

    go(0, 0, 0)
    return min(out)


# One character of each type, from the type's range; kana and kanji of no entry.
SAMPLE = {"HIRAGANA": "ぬ", "KATAKANA": "ヌ", "KANJI": "鬱", "ALPHA": "q", "NUMERIC": "7", "NUMERICWIDE": "７", "SYMBOL": "#", "SPACE": " ", "DEFAULT": "ñ"}


@pytest.mark.parametrize("kind", SAMPLE)
@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_runs_of_each_type(kind, n):
    """Unlimited classes stay whole; limited ones hold two at most, the odd one first."""
    ch = SAMPLE[kind]
    want = [ch * n] if kind not in ("HIRAGANA", "KATAKANA", "KANJI") else [ch] * (n % 2) + [ch * 2] * (n // 2)
    assert shown(JA, ch * n) == [w + "?" for w in want]
    # Between other types the run is the same.
    a, b = ("を", "も") if kind == "KANJI" else ("犬", "山")
    assert shown(JA, f"{a}{ch * n}{b}") == [a, *(w + "?" for w in want), b]


@pytest.mark.parametrize("mark", "。！？!?\n")
def test_segments_end_behind_their_mark(mark):
    """What ends a segment is its last token and nothing crosses it, not even an entry that holds it."""
    assert shown(JA, f"山へ{mark}山") == ["山", "へ", mark + "?", "山"]
    k = kernel([(f"山{mark}", 0, 0, -9000, "p", "x", "", ""), (f"{mark}山", 0, 0, -9000, "p", "x", "", "")])
    assert shown(k, f"山{mark}山") == [f"山{mark}", "山?"]
    assert shown(JA, mark * 3) == [mark + "?"] * 3


def test_longer_entries_and_ties():
    two = [("ab", 0, 0, 10, "x", "", "", ""), ("cd", 0, 0, 10, "x", "", "", "")]
    assert shown(kernel(two), "abcd") == ["ab", "cd"]
    # Of equal totals the predecessor that starts first wins, then a known word, then the first entry.
    assert shown(kernel([*two, ("a", 0, 0, 5, "x", "", "", ""), ("b", 0, 0, 5, "x", "", "", "")]), "abcd") == ["ab", "cd"]
    same = kernel([("q", 0, 0, 6000, "second", "", "", ""), ("q", 0, 0, 6000, "third", "", "", "")])
    assert same.tokens("q")[0][3] == "second"
    # An entry may span a border of types and begin inside a run; before it there are single characters only.
    assert shown(kernel([("b1", 0, 0, -20000, "x", "", "", "")]), "aab1") == ["a?", "a?", "b1"]
    assert shown(kernel([("b1", 0, 0, -20000, "x", "", "", "")]), "aab12") == ["a?", "a?", "b1", "2?"]
    assert shown(kernel([("b1", 0, 0, 20000, "x", "", "", "")]), "aab12") == ["aab?", "12?"]


def test_unit_readings_in_context():
    """Each unit is read as such behind a number only."""
    for unit, reading in [*readings.UNITS.items(), *readings.UNIT_LETTERS.items(), *((k.lower(), v) for k, v in readings.UNIT_LETTERS.items())]:
        spelt = "".join(readings.LETTERS[c] for c in unit.upper())
        for number in ("8", "1,024", "３", "0.5"):
            # A comma or full stop is a token of its own that counts as a number.
            assert JA.tokens(number + unit)[-1][5:7] == (reading, reading), unit
        for text in (unit, "8。" + unit, "8 " + unit, "犬" + unit):
            assert JA.tokens(text)[-1][5] == spelt, text


def test_known_letters_lose_their_reading():
    k = kernel([("DOG", 0, 0, -100, "名詞", "DOG", "ドッグ", "ドッグ")])
    assert k.tokens("DOG")[0][5:7] == ("ディーオージー", "ディーオージー")


def test_offsets_have_no_gap():
    for text in MIXED:
        at, raw = 0, text.encode()
        for t in JA.tokens(text):
            assert t[1] == at and raw[t[1] : t[2]].decode() == t[0]
            at = t[2]
        assert at == len(raw)


def test_out_of_range_ids_cost_nothing():
    assert kernel([("a", 9, 9, 1, "p", "a", "", "")], [[5]]).path("a")[0] == 1 + 0
    assert kernel([("a", 0, 0, 1, "p", "a", "", "")], [[5]]).path("a")[0] == 1 + 5 + 5


def test_first_template_counts_and_flat_defaults():
    k = kernel([], unk=[("ALPHA", 1, 1, 7, "x"), ("ALPHA", 1, 1, 1, "y")])
    assert k.tokens("ab")[0][3] == "x" and k.tokens("ab")[0][7] == 7
    assert kernel([], mode="flat").tokens("ab")[0][3] == "名詞,一般,*,*"
    assert kernel([], unk=[("NUMERIC", 0, 0, 3, "n")]).tokens("１")[0][3] == "n"


def test_trie_equals_plain_search():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc日本🌋") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    e = entries.Entries.of([(w, i, i, i, "p", w, "", "") for i, w in enumerate(words)])
    for n in (0, 1, 7, 300):
        text = "".join(rng.choice("abcd日本語🌋") for _ in range(n))
        stop = sorted(rng.sample(range(1, n), n // 9)) + [n] if n > 1 else [n]
        cp = np.array([ord(c) for c in text], np.uint32)
        ends = np.array([min(s for s in stop if s > p) for p in range(n)], np.int64)
        got = [(p, k, int(e.ids[r])) for p, k, lo, hi in zip(*e.trie.matches(cp, ends), strict=True) for r in range(lo, hi)]
        want = [(p, len(w), i) for p in range(n) for w, i in sorted(((w, i) for i, w in enumerate(words) if text.startswith(w, p) and p + len(w) <= ends[p]), key=lambda x: (len(x[0]), x[1]))]
        assert got == want
    assert not len(entries.Entries.of([]).trie.matches(np.array([97], np.uint32), np.array([1]))[0])


def test_memory_follows_a_piece_not_the_batch(spark):
    """Long pages in one batch: tokens cover each of them, and four times the pages take no more memory."""
    page = "<p class=x>the one in 3 km.</p>\n" * 3_000
    a = Analyzer(in_memory(spark, fx.entries(fx.LATIN)))
    a.kernel.token_array(pa.array([page]))
    peaks = []
    for n in (8, 32):
        tracemalloc.start()
        for part in a.tokenize_udf().func(iter([pa.array([page] * n)])):
            assert all("".join(x.field("surface").to_pylist()) == page for x in (s.values for s in part))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_totals_equal_those_of_the_tokens(spark):
    a = Analyzer(in_memory(spark, fx.entries(fx.LATIN), (fx.SIZE, fx.SIZE, fx.LATIN_MATRIX)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*MIXED, None, ""])], "id int, text string")
    cost = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x["word_cost"])
    want = a.tokenize_batch(df).select("id", "text", F.size("tokens").alias("n_tokens"), F.size(F.filter("tokens", lambda x: x["is_known"])).alias("n_known"), cost.alias("word_costs"))
    got = a.totals(df)
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=lambda r: r["id"]) == sorted(want.collect(), key=lambda r: r["id"])


def test_trie_of_parts_equals_the_whole(tmp_path):
    """Parts that begin inside the last surface, with equal surfaces on both sides of a border, or without an own node."""
    rng = random.Random(7)
    words = sorted(("".join(rng.choice("ab日🌋") for _ in range(rng.randint(1, 6))) for _ in range(300)), key=str.encode)
    whole = trie.Trie.of(pa.array(words)).arrays
    for k, cuts in enumerate(([], [1, 2, 3], sorted(rng.sample(range(1, 300), 40)), list(range(1, 300)))):
        (tmp_path / str(k)).mkdir()
        joined = trie.Levels(str(tmp_path / str(k)))
        for a, b in zip([0, *cuts], [*cuts, 300]):
            joined.add(words[a], words[b - 1], b - a, [x.tobytes() for x in trie.levels(pa.array(words[a:b]))])
        made = joined.all()
        out = {f: np.zeros(n, t) for f, (n, t) in trie.shapes(sum(map(len, made))).items()}
        trie.fill(out, made)
        # The first row of a node where none ends tells nothing.
        ends = [x["hi"] > x["lo"] for x in (whole, out)]
        assert (ends[0] == ends[1]).all() and all((whole[f][ends[0]] == out[f][ends[0]]).all() for f in ("lo", "hi"))
        assert all((whole[f] == out[f]).all() for f in ("first", "label", "kids"))


def test_entries_in_a_file_equal_those_in_memory(spark, monkeypatch):
    """Parts of a few entries, made by tasks and joined one by one, mapped without a copy."""
    monkeypatch.setattr(entries, "PART_ENTRIES", 5)
    rng = random.Random(9)
    rows = [("".join(rng.choice("abc日") for _ in range(rng.randint(1, 3))), i % 7, i % 5, i - 30, f"p{i % 3}", None if i % 4 == 0 else "b" * (i % 3), "", "ン") for i in range(60)]
    monkeypatch.setattr("pyspark.sql.DataFrame.toArrow", None)
    for some in (rows, rows[:1], []):
        a, k = Analyzer(in_memory(spark, some)), kernel(some)
        assert [x.tolist() for x in (a.kernel.entries.ids, a.kernel.entries.left, a.kernel.entries.cost)] == [x.tolist() for x in (k.entries.ids, k.entries.left, k.entries.cost)]
        assert a.kernel.entries.surfaces.to_pylist() == k.entries.surfaces.to_pylist()
        if some:
            assert a.kernel.entries.surfaces.buffers()[2].address == a.kernel.entries.arrays["surface"].ctypes.data
        for text in ("abc日cab日日a", "x"):
            assert a.kernel.prefix_array(pa.array([text])) == k.prefix_array(pa.array([text]))
            assert [t[4] for t in a.kernel.tokens(text)] == [t[4] for t in k.tokens(text)]


def test_results_do_not_depend_on_batches(monkeypatch):
    """Texts alone, together, in chunks of any size and from a slice have the same tokens."""
    k = kernel(fx.entries(fx.LATIN), np.array([[(r * 5 + c * 3) % 7 * 100 for c in range(6)] for r in range(6)]))
    once = [k.tokens(t) for t in MIXED]
    for chunk in (1 << 18, 40, 1):
        monkeypatch.setattr(kernel_module, "CHUNK_CHARS", chunk)
        column = pa.array(["skipped", *MIXED, None, "", "x"])[1:]
        got = k.token_array(column).to_pylist()
        assert [None if x is None else [tuple(t.values()) for t in x] for x in got] == [*once, None, [], k.tokens("x")]
    assert k.token_array(pa.array([], pa.string())).to_pylist() == []
    assert pickle.loads(pickle.dumps(k)).tokens(MIXED[0]) == once[0]


def test_large_batches_are_answered_in_pieces(spark):
    """What a worker holds follows the text at a time, not the rows of a batch."""
    a = Analyzer(in_memory(spark, fx.entries(fx.LATIN)))
    texts = pa.array([None, "", *["the one in. " * 2_000] * 40, "x" * 300_000, "on"])
    for udf, whole in ((a.tokenize_udf(), a.kernel.token_array), (a.prefixes_udf(), a.kernel.prefix_array)):
        got = list(udf.func(iter([texts, texts[:0], texts[5:7]])))
        at = np.cumsum([0, *map(len, got)])
        assert at[-1] == len(texts) + 2
        for g, lo, hi in zip(got[:-1], at, at[1:]):
            assert hi - lo == 1 or pc.sum(pc.binary_length(texts[lo:hi])).as_py() <= kernel_module.CHUNK_CHARS
            assert g.equals(whole(texts[lo:hi]))
        assert got[-1].equals(whole(texts[5:7]))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("aあアー漢語1 。é🌋", max_size=14))
def test_unknown_surfaces_equal_the_kernel(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(unknown.text_surfaces(F.col("t"))).first()[0]
    assert got == [t[0] for t in kernel([]).tokens(text)]


def test_long_run_is_linear():
    assert len(kernel([]).tokens("a" * 400_000)) == 1
    # With an entry inside, the run has two candidates at each place.
    k = kernel([("aaaab", 0, 0, -20000, "p", "", "", "")], unk=[("ALPHA", 0, 0, -2, "x")])
    assert [t[0] for t in k.tokens("a" * 5_000 + "b")] == ["a"] * 4_996 + ["aaaab"]


def test_cheap_single_characters_are_preferred_to_runs():
    """A negative cost makes many tokens better than one, so a run must not be taken whole."""
    k = kernel([], unk=[("ALPHA", 0, 0, -1, "x"), ("NUMERIC", 1, 1, 3, "n")], matrix=[[0, 0], [0, -5]])
    assert shown(k, "aaa11") == ["a?", "a?", "a?", "1?", "1?"]
    for seg in ("aaa11", "a1a1", "11", "aa 11"):
        assert (k.path(seg)[0], tuple(n[:4] for n in k.path(seg)[1])) == brute(k, seg)


LEX = st.lists(st.tuples(st.text("abあ1", min_size=1, max_size=3), st.integers(0, 3), st.integers(0, 3), st.integers(-5, 5)), max_size=8)


@pytest.mark.parametrize("bits", [0, 20])
@settings(max_examples=150, deadline=None)
@given(st.text("abあ1漢 ", min_size=1, max_size=7), LEX, st.lists(st.integers(-4, 4), min_size=9, max_size=9))
def test_kernel_equals_brute_force(bits, seg, lex, costs):
    kernel_module.PACKED_BITS = bits
    k = kernel([(s, a, b, c, "p", s, "", "") for s, a, b, c in lex], np.array(costs).reshape(3, 3), unk=[("ALPHA", 1, 2, -3, "u"), ("HIRAGANA", 2, 1, 2, "h")])
    total, path = k.path(seg)
    want = brute(k, seg)
    assert (total, tuple((n[0], n[1], n[2], n[3]) for n in path)) == want
    assert total == cheapest(k, seg)


def test_relational_decoder_equals_kernel(spark):
    lex = in_memory(spark, fx.entries(fx.LATIN), (fx.SIZE, fx.SIZE, fx.LATIN_MATRIX))
    a = Analyzer(lex)
    texts = ["the one. on in 12 re-the", "thee", "inn", "", "en la 3 km!", "と the は"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    segs = segment.split_sentences(df, "text", ["id"])
    nodes = lat.lattice(segs, lex, a.kernel.unknown, ["id", "seg_idx"])
    got = {(r["id"], r["seg_idx"]): (r["total"], [tuple(x) for x in r["path"]]) for r in lat.decode(nodes, lex.matrix, ["id", "seg_idx"]).collect()}
    for r in segs.collect():
        total, path = a.kernel.path(r["seg"])
        assert got[r["id"], r["seg_idx"]] == (total, [n[:4] for n in path])


def test_analyzer_surfaces(spark):
    a = Analyzer(in_memory(spark, fx.entries(fx.JAPANESE)))
    df = spark.createDataFrame([(1, "犬も山へ行く"), (2, ""), (3, None)], "id int, text string")
    rows = {r["id"]: r["tokens"] for r in a.tokenize_batch(df).collect()}
    assert [t["surface"] for t in rows[1]] == ["犬", "も", "山", "へ", "行く"] and rows[2] == [] and rows[3] is None
    assert [t.surface for t in a.tokens_of("山を見た")] == ["山", "を", "見", "た"]
    assert a.clone_for_worker() is a and a.prewarm() is a
    warm, again = a.warm_workers(), a.warm_workers()
    assert len({r["worker"] for r in warm}) >= 2 and {r["entries"] for r in warm} == {len(fx.JAPANESE)}
    assert {r["worker"] for r in again} == {r["worker"] for r in warm}
    assert a.wakachi(df).where("id = 1").first()["output"] == "犬 も 山 へ 行く"
    assert a.to_mecab(df).where("id = 2").first()["output"] == "EOS\n"
    one, eight = (a.tokenize(df.repartition(n)).orderBy("id", "tok_idx").collect() for n in (1, 8))
    assert one == eight


def test_sql_functions(spark):
    Analyzer(in_memory(spark, fx.entries(fx.JAPANESE))).register()
    assert [r[0] for r in spark.sql("SELECT t.surface FROM VALUES ('山を見た') v(x), LATERAL tokens(x) t ORDER BY tok_idx").collect()] == ["山", "を", "見", "た"]
    many = spark.sql("SELECT id, tok_idx, t.surface FROM VALUES (1, '山へ行く'), (2, NULL), (3, ''), (4, '犬を') v(id, x), LATERAL tokens(x) t").collect()
    assert sorted(tuple(r) for r in many) == [(1, 0, "山"), (1, 1, "へ"), (1, 2, "行く"), (4, 0, "犬"), (4, 1, "を")]
    assert spark.sql("SELECT size(tokenize('山を見た'))").first()[0] == 4


def test_matrix_is_used_in_both_ways(spark):
    rows = [("a", 1, 1, 0, "p", "a", "", ""), ("b", 2, 2, 0, "p", "b", "", ""), ("ab", 3, 3, 5, "p", "ab", "", "")]
    for cost, want in ((-10, ["a", "b"]), (100, ["ab"])):
        a = Analyzer(in_memory(spark, rows, (4, 4, {(1, 2): cost})))
        assert [t.surface for t in a.tokens_of("ab")] == want
