import csv
import io
import random

import pytest

from tsubame.session import numbered
from tsubame.sources import definitions as d
from tsubame.sources import lexicon as lx
from tsubame.sources import scan


@pytest.fixture
def narrow(spark):
    """Splits of a few bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")  if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
        if k in old:
            spark.conf.set(k, old[k])


@pytest.mark.parametrize("line", ['a,b', '"a,b', 'x"y,z', '"a""b",c', '"a"b,"c', '', '"', '""', '"""', 'a,"b","c""', '"a",b"c,"d', ',"x', '"x",'])
@pytest.mark.parametrize("quoted", [False, True])
def test_open_fields(line, quoted):
    """Open behind a line exactly where the parser takes the next line into the same record."""
    before = '"begun\n' if quoted else ""
    rows = list(csv.reader(io.StringIO(before + line + "\nMARK", newline="")))
    assert scan.open_after(line, quoted) == (len(rows) == 1)


def random_csv(rng):
    def field():
        x = "".join(rng.choice('ab,"\n犬 ') for _ in range(rng.randint(0, 6)))
        return rng.choice([f'"{x.replace(chr(34), chr(34) * 2)}"', "plain", "pl\"ain", "", f'"long {"l" * rng.randint(0, 90)}\n\n"'])

    return "".join(",".join(field() for _ in range(rng.randint(1, 4))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(30))


def test_csv_in_splits_equals_the_parser(narrow, tmp_path):
    rng = random.Random(3)
    want = {}
    for i in range(4):
        content = random_csv(rng)
        (tmp_path / f"f{i}.csv").write_bytes(content.encode("utf-8" if i % 2 else "euc_jp"))
        want[f"f{i}.csv"] = [(n, r) for n, r in enumerate(csv.reader(io.StringIO(content, newline="")), 1) if r]
    rows = d.csv_fields(narrow, [str(tmp_path / f) for f in want])
    assert scan.lines(narrow, str(tmp_path)).select("file", "block").distinct().count() > 8
    got = {}
    for r in rows.orderBy("file", "idx").collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["idx"], r["f"]))
    # A line break in a quoted field stays what it was.
    assert got == want


def test_one_file_is_several_tasks_and_errors_keep_their_place(narrow, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"w{i},1,1,{i},p\n" for i in range(200)))
    built = lx.LexiconBuilder(narrow).add_csv_dir(str(tmp_path)).build()
    assert [(r["entry_id"], r["surface"]) for r in built.entries.orderBy("entry_id").collect()] == [(i, f"w{i}") for i in range(200)]
    (tmp_path / "a.csv").write_text("".join(f"w{i},1,1,{'x' if i in (150, 180) else i},p\n" for i in range(200)))
    with pytest.raises(d.LexiconError, match="a.csv:151:cost"):
        lx.LexiconBuilder(narrow).add_csv_dir(str(tmp_path))


def test_matrix_in_splits(narrow, tmp_path):
    rng = random.Random(4)
    cells, text = {}, ["7 9"]
    for _ in range(400):
        r, k, c = rng.randrange(9), rng.randrange(7), rng.randint(-32768, 32767)
        cells[r, k] = c
        text.append(rng.choice([f"{r} {k} {c}", f"  {r}\t{k}  {c} more"]))
        text += rng.choice([[], ["# 1 1 1"], ["", "1 2"]])
    path = tmp_path / "matrix.def"
    path.write_text("\n".join(text))
    left, right, rows = scan.matrix(narrow, str(path))
    assert (left, right) == (7, 9) and rows.count() == len(cells)
    assert {(r["right_id"], r["left_id"]): r["cost"] for r in rows.collect()} == cells
    for at, bad, said in ((5, "9 9 1", "outside"), (100, "0 x 1", "'x' is not a number from 0 to 65535"), (300, "0 1 40000", "'40000'")):
        path.write_text("\n".join([*text[:at], bad, *text[at:], "0 y 1"]))
        with pytest.raises(d.LexiconError, match=f"matrix.def:{at + 1}: .*{said}"):
            scan.matrix(narrow, str(path))
    path.write_text("")
    with pytest.raises(d.LexiconError, match="two sizes"):
        scan.matrix(narrow, str(path))
    with pytest.raises(FileNotFoundError):
        scan.matrix(narrow, str(tmp_path / "none.def"))


def test_numbers_are_dense(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS x", "id AS y").repartition(7)
    got = numbered(rows, ["x"], "n").collect()
    assert sorted((r["n"], r["x"]) for r in got) == [(i, i) for i in range(1000)]
    assert numbered(rows.limit(0), ["x"], "n").count() == 0
