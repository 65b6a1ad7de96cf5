"""Main text of HTML pages by boosted trees over DOM nodes and hierarchical decoding.

Every node is ABOVE the article (an ancestor or neutral container), IN it, or OUT of
it. The trees are trained on pages from a seeded generator of layouts, whose labels
are known; they see subtree sizes and densities, attribute tokens, depth, position and
siblings. Decoding finds the most likely labels of the whole tree under these rules:
below OUT all is OUT; below IN nodes are IN or OUT; only below ABOVE may the article
start. So no descendant contradicts an ancestor. Text is taken of IN nodes.

Defined cases: a null or empty html, or one without an article, gives an empty text;
scripts, styles, titles and comments never count as text; broken or unclosed markup is
closed as browsers do; repeated rows are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tsubame.llm.boosting import Booster
from tsubame.llm.dom import RAW, Page
from tsubame.session import arrow_rows, table

ABOVE, IN, OUT = 0, 1, 2
TRAIN_PAGES = 700
SEED = 8
PAGE_ROWS = 256


class Generator:
    """Random pages; an element is written with the label of its node."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels = [ABOVE]

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        text = " ".join("".join(r.choice(["ta", "ro", "mi", "en", "es", "ka", "lu", "por", "st"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))
        out = "".join(c + ("." if c == " " and r.random() < 0.08 else "") for c in text).replace(" .", ". ")
        if r.random() < 0.15:
            out = out.replace(" ", r.choice(["*** ", " &amp; ", "!! ", " | "]))
        return out.capitalize() + ("." if r.random() < 0.8 else "")

    def el(self, tag: str, label: int, body: object = "", attributes: str = "", close: bool = True) -> None:
        self.labels.append(label)
        self.out.append(f"<{tag}{' ' + attributes if attributes else ''}>")
        if callable(body):
            body()
        else:
            self.out.append(str(body))
        if close:
            self.out.append(f"</{tag}>")

    def named(self, words: str) -> str:
        w = self.r.choice(words.split())
        w = self.r.choice([w, f"site-{w}", f"{w}-box", f"{w} wide", f"main {w}" if self.r.random() < 0.1 else w])
        return self.r.choice(["class", "class", "id", "role"]) + f'="{w}"'

    def link_list(self, label: int, lo: int = 2, hi: int = 9) -> None:
        def items() -> None:
            for _ in range(self.r.randint(lo, hi)):
                self.el("li", label, lambda: self.el("a", label, self.words(1, 4), 'href="/x"'))

        self.el(self.r.choice(["ul", "ul", "ol"]), label, items)

    def paragraph(self, label: int) -> None:
        r = self.r

        def body() -> None:
            self.out.append(self.words(1, 12) if r.random() < 0.2 else self.words(10, 120))
            if r.random() < 0.25:
                self.el(r.choice(["a", "em", "b", "strong", "span", "code"]), label, self.words(1, 4))
                self.out.append(" " + self.words(1, 20))

        self.el("p", label, body)

    def boilerplate(self, kind: str) -> None:
        r = self.r
        tags = {"nav": "nav nav div ul", "header": "header header div", "footer": "footer footer div", "aside": "aside aside div", "ad": "div div aside section", "notice": "div div section", "form": "form form div", "comments": "section div div ol"}
        words = {"nav": "nav menu navbar breadcrumb", "header": "header masthead topbar", "footer": "footer copyright legal", "aside": "sidebar related widget", "ad": "ad ads advert sponsored promo", "notice": "cookie notice consent alert newsletter", "form": "search login form contact", "comments": "comments replies discussion respond"}
        tag = r.choice(tags[kind].split())
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        attributes = "" if plain else self.named(words[kind])

        def body() -> None:
            if kind == "nav":
                self.link_list(OUT) if tag != "ul" else [self.el("li", OUT, lambda: self.el("a", OUT, self.words(1, 3))) for _ in range(r.randint(2, 8))]
            elif kind == "header":
                self.el(r.choice(["h1", "div", "a", "p"]), OUT, self.words(1, 6))
                if r.random() < 0.5:
                    self.link_list(OUT)
            elif kind == "footer":
                if r.random() < 0.5:
                    self.out.append("&copy; " + self.words(1, 6) + " &middot; " + self.words(2, 12))
                else:
                    self.el("p", OUT, self.words(3, 30))
                if r.random() < 0.4:
                    self.link_list(OUT)
            elif kind == "aside":
                self.el(r.choice(["h2", "h3", "h4"]), OUT, self.words(1, 4))
                self.link_list(OUT) if r.random() < 0.7 else self.el("p", OUT, self.words(5, 60))
            elif kind in ("ad", "notice"):
                if r.random() < 0.6:
                    self.out.append(self.words(2, 40))
                else:
                    self.el("p", OUT, self.words(4, 50))
                if r.random() < 0.4:
                    self.el(r.choice(["a", "button"]), OUT, self.words(1, 3))
            elif kind == "form":
                self.el("label", OUT, self.words(1, 3))
                self.labels.append(OUT)
                self.out.append('<input name="q">')
                if r.random() < 0.5:
                    self.el("p", OUT, self.words(3, 20))
                self.el("button", OUT, self.words(1, 2))
            else:
                for _ in range(r.randint(1, 6)):
                    one = lambda: (self.el("b", OUT, self.words(1, 2)), self.el("p", OUT, self.words(3, 60)))
                    self.el("li" if tag == "ol" else r.choice(["div", "div", "article"]), OUT, one, self.named("comment reply"))

        self.el(tag, OUT, body, attributes)

    def article(self) -> None:
        r = self.r
        if r.random() < 0.85:
            self.el(r.choice(["h1", "h1", "h2"]), IN, self.words(1, 14))
        unclosed = r.random() < 0.2
        for _ in range(r.choice([0, 1, 2, 3, 6, 12, 20]) if not unclosed else r.randint(1, 8)):
            u = r.random()
            if unclosed and u < 0.3:
                self.labels += [IN, IN, IN]
                self.out.append(f"<p><b>{self.words(1, 40)}<br>")
                self.labels.append(IN)
                self.out.append(f"<p>{self.words(1, 60)}</p>")
            elif u < 0.70:
                self.paragraph(IN)
            elif u < 0.78:
                self.el(r.choice(["h2", "h3"]), IN, self.words(1, 8))
            elif u < 0.83:
                items = lambda: [self.el("li", IN, self.words(2, 25)) for _ in range(r.randint(1, 6))]
                self.el(r.choice(["ul", "ol"]), IN, items)
            elif u < 0.87:
                self.el("blockquote", IN, lambda: self.paragraph(IN))
            elif u < 0.90:
                row = lambda: self.el("tr", IN, lambda: [self.el("td", IN, self.words(1, 5)) for _ in range(r.randint(1, 4))])
                self.el("table", IN, lambda: [row() for _ in range(r.randint(1, 5))])
            elif u < 0.92:
                self.el("div", IN, lambda: [self.paragraph(IN) for _ in range(r.randint(1, 3))])
            elif u < 0.93:
                self.el("pre", IN, self.words(3, 40))
            else:
                self.boilerplate(r.choice(["ad", "ad", "form", "aside", "aside", "notice", "nav", "header"]))
        if r.random() < 0.25:
            self.boilerplate(r.choice(["comments", "footer"]))

    def page(self) -> tuple[str, list[int]]:
        r = self.r

        def head() -> None:
            self.labels.append(OUT)
            self.out.append('<meta charset="utf-8">')
            self.el("title", OUT, self.words(1, 12))
            for t in ("style", "script"):
                if r.random() < 0.7:
                    self.el(t, OUT, "var t=1;")

        def core() -> None:
            tag = r.choice(["article", "article", "article", "main", "div", "section"])
            attributes = "" if tag in ("article", "main") and r.random() < 0.7 else self.named("article content post story entry main")
            self.el(tag, IN, self.article, attributes)
            for k in ("comments", "ad", "aside"):
                if r.random() < 0.2:
                    self.boilerplate(k)

        def wrapped(depth: int) -> None:
            if depth == 0:
                core()
                return
            kinds = ["aside", "ad", "nav", "form"]
            if r.random() < 0.3:
                self.boilerplate(r.choice(kinds))
            self.el(r.choice(["div", "div", "main", "section"]), ABOVE, lambda: wrapped(depth - 1), self.named("wrapper page container main layout content") if r.random() < 0.7 else "")
            if r.random() < 0.3:
                self.boilerplate(r.choice(kinds))

        def body() -> None:
            for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("ad", 0.5), ("form", 0.15)):
                if r.random() < p:
                    self.boilerplate(k)
            if r.random() < 0.95:
                wrapped(r.choice([0, 0, 0, 1, 1, 2, 3]))
            for k, p in (("comments", 0.25), ("aside", 0.35), ("ad", 0.2), ("nav", 0.1), ("footer", 0.8), ("notice", 0.1)):
                if r.random() < p:
                    self.boilerplate(k)
            if r.random() < 0.2:
                self.el("script", OUT, "run();")

        def whole() -> None:
            self.el("head", OUT, head)
            self.el("body", ABOVE, body, close=r.random() < 0.85)

        self.out.append("<!DOCTYPE html>")
        self.el("html", ABOVE, whole, close=r.random() < 0.85)
        return "".join(self.out), self.labels


_TRAINED: dict[tuple[int, int], Booster] = {}


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Booster:
    """The booster, trained on generated pages; once for each driver process."""
    if (pages, seed) in _TRAINED:
        return _TRAINED[pages, seed]
    xs, ys = [], []
    for i in range(pages):
        source, labels = Generator(seed * 100_003 + i).page()
        page = Page(source)
        if len(page.tag) == len(labels):
            xs.append(page.features())
            ys.append(np.array(labels))
    model = _TRAINED[pages, seed] = Booster().fit(np.concatenate(xs), np.concatenate(ys), 3)
    return model


def decode(parent: list[int], logp: np.ndarray) -> list[int]:
    """Most likely labels of all nodes under the rules for parents and children."""
    n = len(parent)
    above, inside, out = (logp[:, k].tolist() for k in (ABOVE, IN, OUT))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        out[p] += out[i]
        inside[p] += max(inside[i], out[i])
        above[p] += max(above[i], inside[i], out[i])
    label = [OUT] * n
    label[0] = ABOVE
    for i in range(1, n):
        p = label[parent[i]]
        if p == OUT:
            continue
        if p == ABOVE and above[i] > inside[i] and above[i] > out[i]:
            label[i] = ABOVE
        elif inside[i] > out[i]:
            label[i] = IN
    return label


def extract(sources: list[str | None], model: Booster) -> list[str]:
    """Main text of each page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    logp = model.log_probabilities(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        labels = decode(p.parent, logp[at : at + n])
        at += n
        out.append(p.text([k == IN and t not in RAW for k, t in zip(labels, p.tag, strict=True)]))
    return out


def _extract(model: Booster) -> Callable:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract(b.column(2).to_pylist(), model)
            cols = [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(cols, schema=schema)

    return run


def extract_pages(pages: DataFrame, model: Booster | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    arrow_rows(pages.sparkSession, PAGE_ROWS)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(model or train()), "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
