"""A forgiving HTML tree in flat lists, and numeric features of its nodes.

Parents come before children, so passes over a page are loops without recursion and
any nesting depth is safe. Only what matters for text is modelled: void elements, raw
text elements, end tags that may be left out, comments and declarations, character
references, and tags cut off at the end of the page (dropped, as browsers do).
"""

from __future__ import annotations

import html
import re

import numpy as np

TOKEN = re.compile(r"""<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?=/?[a-zA-Z])""")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br button select option svg input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

GROUPS = [
    ["html", "body"], ["head", "title", "meta", "link", "base"], ["script", "style", "noscript", "template", "iframe"], ["article"], ["main"], ["section"], ["div"],
    ["nav", "menu"], ["header", "hgroup"], ["footer"], ["aside"], ["form", "fieldset", "input", "select", "option", "button", "textarea", "label"], ["p", "pre", "blockquote"],
    ["h1", "h2", "h3", "h4", "h5", "h6"], ["ul", "ol", "dl"], ["li", "dt", "dd"], ["a"], ["table", "tr", "td", "th", "tbody", "thead"], ["figure", "figcaption", "img"],
]
GROUP_OF = {tag: i + 1 for i, g in enumerate(GROUPS) for tag in g}
# Tokens of class, id and role attributes, by what they hint at.
WORDS = [
    "article content main post story entry body text blog news".split(),
    "nav navigation menu navbar breadcrumb breadcrumbs toolbar tabs pagination pager skip".split(),
    "footer copyright legal colophon bottom".split(),
    "header masthead banner topbar logo brand".split(),
    "sidebar aside related widget rail recommended trending popular secondary complementary".split(),
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense dfp affiliate".split(),
    "cookie cookies consent notice notification alert gdpr popup modal overlay warning subscribe newsletter paywall".split(),
    "comment comments reply replies discussion respond disqus reader feedback".split(),
    "form search login signup share sharing social follow contact poll".split(),
]
WORD_OF = {w: i for i, ws in enumerate(WORDS) for w in ws}


class Page:
    """Nodes of one page: tag, parent, hint bits; and text pieces with their node."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.hints, self.start = ["#root"], [-1], [0], [0]
        # (node, text) pieces; text None marks the start or end of a block or a line break.
        self.pieces: list[tuple[int, str | None]] = []
        self.size = len(source)
        self._parse(source)

    def _open(self, name: str, attributes: str, at: int, parent: int) -> int:
        bits = 0
        for m in ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
            for w in SPLIT.findall(m[2] or m[3] or m[4] or ""):
                i = WORD_OF.get(w.lower())
                if i is not None:
                    bits |= 1 << i
        self.tag.append(name)
        self.parent.append(parent)
        self.hints.append(bits)
        self.start.append(at)
        return len(self.tag) - 1

    def _parse(self, s: str) -> None:
        stack, at, n = [0], 0, len(s)
        counts: dict[str, int] = {}
        pieces, tag = self.pieces, self.tag

        def pop() -> None:
            i = stack.pop()
            counts[tag[i]] -= 1
            if tag[i] not in INLINE:
                pieces.append((i, None))

        while at < n:
            m = TOKEN.search(s, at)
            stop = m.start() if m else n
            if stop > at:
                pieces.append((stack[-1], html.unescape(s[at:stop])))
            if not m:
                break
            opened = m[0]
            if opened == "<!--":
                end = s.find("-->", stop + 2)
                at = n if end < 0 else end + 3
                continue
            if opened in ("<!", "<?"):
                end = s.find(">", stop)
                at = n if end < 0 else end + 1
                continue
            if opened == "<":
                break
            at = m.end()
            name = (m[2] or m[5]).lower()
            if m[1] or m[4]:
                if counts.get(name):
                    while tag[stack[-1]] != name:
                        pop()
                    pop()
                elif name == "p":
                    pieces.append((self._open("p", "", stop, stack[-1]), None))
                continue
            if name in CLOSES_P and counts.get("p"):
                while tag[stack[-1]] != "p":
                    pop()
                pop()
            ends = CLOSES.get(name)
            if ends and any(counts.get(e) for e in ends):
                walls = BARRIER[name]
                for back in range(len(stack) - 1, 0, -1):
                    if tag[stack[back]] in walls:
                        break
                    if tag[stack[back]] in ends:
                        while len(stack) > back:
                            pop()
                        break
            attributes = m[3] if m[2] else m[6]
            i = self._open(name, attributes or "", stop, stack[-1])
            if name == "br":
                pieces.append((stack[-1], " "))
            elif name not in INLINE:
                pieces.append((i, None))
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(s, at)
                at = end.end() if end else n
                continue
            stack.append(i)
            counts[name] = counts.get(name, 0) + 1

    def features(self) -> np.ndarray:
        """One row for each node; see the order of the columns at the end."""
        n = len(self.tag)
        chars, links, marks = [0] * n, [0] * n, [0] * n
        tags, paras, items, anchors = [1] * n, [0] * n, [0] * n, [0] * n
        own = [0] * n
        parent, tag = self.parent, self.tag
        for i, text in self.pieces:
            if text:
                k = len(text) - text.count(" ")
                chars[i] += k
                own[i] += k
                marks[i] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        depth, above, in_link, number, group = [0] * n, [0] * n, [False] * n, [0] * n, [GROUP_OF.get(t, 0) for t in tag]
        seen = [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | self.hints[p] | (1 << (8 + group[p]) << 4)
            in_link[i] = in_link[p] or tag[i] == "a"
            number[i] = seen[p]
            seen[p] += 1
            if in_link[i]:
                links[i] = chars[i]
            paras[i], items[i], anchors[i] = tag[i] == "p", tag[i] == "li", tag[i] == "a"
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (chars, links, marks, tags, paras, items, anchors):
                x[p] += x[i]
        total, size = max(1, chars[0]), max(1, self.size)
        c = np.array(chars, np.float64)
        par = np.array(parent)
        par[0] = 0
        hints, over = np.array(self.hints), np.array(above)
        g = np.array(group)
        columns = [
            g, g[par], np.array(depth), np.log1p(c), c / total, np.array(links) / np.maximum(c, 1), c / np.array(tags), np.array(marks) / np.maximum(c, 1),
            np.log1p(np.array(own)), np.array(number), np.array(seen)[par], np.log1p(np.array(tags)), np.array(paras), np.array(items), np.array(anchors) / np.array(tags),
            np.array(self.start) / size, c / np.maximum(c[par], 1),
        ]
        columns += [(hints >> b) & 1 for b in range(len(WORDS))]
        columns += [(over >> b) & 1 for b in range(len(WORDS))]
        columns += [g == k for k in range(1, len(GROUPS) + 1)]
        columns += [(over >> (12 + k)) & 1 for k in (4, 5, 7, 8, 9, 10, 11, 12)]
        return np.stack([np.asarray(x, np.float32) for x in columns], axis=1)

    def text(self, chosen: list[bool]) -> str:
        """Blocks of the chosen nodes' text in page order."""
        blocks, now = [], []
        for i, piece in self.pieces:
            if piece is None:
                blocks.append("".join(now))
                now = []
            elif chosen[i]:
                now.append(piece)
        blocks.append("".join(now))
        clean = (SPACE.sub(" ", b).strip() for b in blocks)
        return "\n\n".join(b for b in clean if b)
