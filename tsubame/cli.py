"""Command line: build, merge, recipe, convert, tokenize, compare, bench, info, repair."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tsubame.functions.render import FORMATS
from tsubame.operators.analyzer import Analyzer
from tsubame.operators.compare import agreement, compare, summary
from tsubame.sources import convert
from tsubame.sources import lexicon as lx
from tsubame.sources.text import literal, read_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tsubame", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("build", help="compile a folder of CSV and definition files")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c = sub.add_parser("merge", help="add CSV rows to a lexicon")
    c.add_argument("-d", "--dict", required=True)
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output")
    c.add_argument("--reset-char-def", action="store_true")
    c.add_argument("-x", "--exclude", nargs="*", default=[], help="file names to leave out")
    c = sub.add_parser("recipe", help="compile a folder and merge further ones in order")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-m", "--merge", nargs="*", default=[], help="CSV files or folders")
    c.add_argument("-x", "--exclude", nargs="*", default=[], help="file names to leave out")
    c.add_argument("-o", "--output", required=True)
    c = sub.add_parser("convert", help="convert CSV files of another layout")
    c.add_argument("kind", choices=["unidic", "sudachi", "remap"])
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--matrix", help="matrix file to copy along")
    c = sub.add_parser("tokenize", help="tokenise an argument or the lines of files")
    c.add_argument("-d", "--dict", required=True)
    c.add_argument("-f", "--format", default="mecab", choices=sorted(FORMATS))
    c.add_argument("-i", "--input", help="text files, in place of an argument")
    c.add_argument("-o", "--output", help="folder for the result; else it is printed")
    c.add_argument("text", nargs="?")
    c = sub.add_parser("compare", help="segmentation and readings of two lexicons, and where they agree")
    c.add_argument("-d", "--dict", required=True)
    c.add_argument("-e", "--other", required=True)
    c.add_argument("-i", "--input", help="text files, in place of an argument")
    c.add_argument("text", nargs="?")
    c = sub.add_parser("bench", help="time one text")
    c.add_argument("-d", "--dict", required=True)
    c.add_argument("-n", "--iterations", type=int, default=1000)
    c.add_argument("text")
    c = sub.add_parser("info", help="counts of a lexicon")
    c.add_argument("-d", "--dict", required=True)
    c = sub.add_parser("repair", help="replace pronunciations that are not katakana")
    c.add_argument("-d", "--dict", required=True)
    c.add_argument("-o", "--output", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tsubame {a.command}").getOrCreate()
    if a.command == "build":
        lx.build(spark, a.input).write(a.output)
    elif a.command == "merge":
        print(lx.merge(spark, a.dict, a.input, a.output, a.reset_char_def, a.exclude))
    elif a.command == "recipe":
        print(lx.recipe(spark, a.input, a.merge, a.output, a.exclude))
    elif a.command == "convert":
        done = convert.convert(spark, a.kind, a.input, a.output)
        print(f"{done['converted']} rows converted, {done['skipped']} skipped")
        if a.matrix:
            print("matrix {} x {}".format(*convert.copy_matrix(spark, a.matrix, a.output)))
    elif a.command == "info":
        lx.Lexicon.read(spark, a.dict).info().show(truncate=False)
    elif a.command == "repair":
        fixed, n = lx.Lexicon.read(spark, a.dict).repaired()
        if n:
            fixed.write(a.output)
        print(f"{n} entries repaired")
    elif a.command == "compare":
        texts = read_lines(spark, a.input) if a.input else literal(spark, a.text or "")
        left, right = Analyzer(a.dict, spark), Analyzer(a.other, spark)
        numbered = texts.withColumn("id", F.monotonically_increasing_id())
        summary(numbered, {a.dict: left, a.other: right}, "text", ["id"]).orderBy("id").show(truncate=False)
        agreement(compare(numbered, left, right, "text", ["id"])).show()
    elif a.command == "bench":
        analyzer = Analyzer(a.dict, spark)
        n = max(1, a.iterations)
        for _ in range(100):
            analyzer.kernel.path(a.text)
        began = time.perf_counter()
        for _ in range(n):
            analyzer.kernel.path(a.text)
        print(f"{n / (time.perf_counter() - began):.0f} texts/s")
    else:
        source = read_lines(spark, a.input) if a.input else literal(spark, a.text or "")
        out = Analyzer(a.dict, spark).rendered(source, "text", a.format).select("output")
        if a.output:
            out.write.text(a.output)
        else:
            for row in out.toLocalIterator():
                print(row[0], end="" if a.format == "mecab" else "\n")
    return 0
