"""Main-text extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in page order. Each block becomes a
vector of hashed features of its tag path (tags, classes and ids of its ancestors), of its words and of its
shape. A bidirectional LSTM in numpy reads the whole sequence, so a block is labelled in the context of all
others, and the blocks labelled content are the text.

No labelled pages exist, so the labeller is trained on pages that synthetic() builds from templates: an article
between menus, headers, sidebars, notices, adverts, forms and comments, in varying markup, with random words. Markup that
is never content (script, style, head, ...) is left out by the parser.

Defined cases: null, empty and textless html give an empty text; broken markup is read as far as it goes (an unclosed
block ends where the next begins, and an end tag closes what stands open inside it); pages and blocks of any length are
read whole; repeated rows get equal texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option textarea button datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open p.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: What may stand in a head; any other element ends it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Hidden controls that stand in a line of text: one that was never closed ends at the next block.
CONTROLS = frozenset("object canvas audio video select option button datalist".split())
CONTROL_TAGS = re.compile(rf"<(/?)({'|'.join(sorted(CONTROLS))})(?=[\s/>])", re.I)

PATH_BUCKETS = 96
WORD_BUCKETS = 32
SHAPE = 8
INPUT = PATH_BUCKETS + WORD_BUCKETS + SHAPE
HIDDEN_UNITS = 16
PAGES = 600
EPOCHS = 18
SEED = 4
#: Words whose buckets a worker remembers; blocks that are read at a time, in one page or several.
KNOWN_WORDS = 200_000
BLOCKS_AT_ONCE = 4_096
CHARS_AT_ONCE = 4_000_000
SPACE = re.compile(r"\s+")


def bucket(word: str, n: int, salt: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"), salt)
    return h % n, 1.0 if h >> 31 else -1.0


class Hashed:
    """Buckets of words; those seen first, which the frequent ones are, are remembered up to a bound."""

    def __init__(self, n: int, salt: int):
        self.n, self.salt, self.known = n, salt, {}

    def __call__(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            got = bucket(word, self.n, self.salt)
            if len(self.known) < KNOWN_WORDS and len(word) <= 32:
                self.known[word] = got
        return got


@dataclass
class Element:
    """An open element: its place among the open ones, and the path buckets of its tag, classes and ids."""

    tag: str
    place: int
    marks: list[tuple[int, float]]
    open: bool = True


class Blocks(HTMLParser):
    """Leaf blocks of a page: (path vector, text, characters inside links).

    The path vector sums the hashed tags, classes and ids of all open elements that aren't inline; it is kept up to date as
    elements open and close. Elements are looked up by tag and by kind, and one that is closed out of turn is only marked, so a
    page of very many open tags takes no longer for each further one.
    """

    def __init__(self, hashed: Hashed):
        super().__init__(convert_charrefs=True)
        self.hashed = hashed
        self.open: list[Element] = []
        self.by_tag: dict[str, list[Element]] = {}
        #: Open elements by kind: hidden ones; hidden controls; blocks (not inline); all but inline ones and controls.
        self.hidden: list[Element] = []
        self.controls: list[Element] = []
        self.blocks: list[Element] = []
        self.others: list[Element] = []
        self.path = np.zeros(PATH_BUCKETS, np.float32)
        self.ahead: dict[str, list[str]] = {}
        self.ends_ahead: dict[str, int] = {}
        self.found: list[tuple[np.ndarray, str, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def kinds(self, tag: str) -> list[list[Element]]:
        out = [self.by_tag.setdefault(tag, [])]
        if tag in HIDDEN:
            out.append(self.hidden)
        if tag in CONTROLS:
            out.append(self.controls)
        if tag not in INLINE:
            out.append(self.blocks)
            if tag not in CONTROLS:
                out.append(self.others)
        return out

    def push(self, tag: str, marks: list[tuple[int, float]]) -> None:
        e = Element(tag, len(self.open), marks)
        self.open.append(e)
        for kind in self.kinds(tag):
            kind.append(e)
        for k, sign in marks:
            self.path[k] += sign

    def shut(self, e: Element) -> None:
        """Marks one element as closed; the lists lose it as soon as it is their last."""
        e.open = False
        for k, sign in e.marks:
            self.path[k] -= sign
        for kind in [self.open, *self.kinds(e.tag)]:
            while kind and not kind[-1].open:
                kind.pop()

    def pop(self, first: Element) -> None:
        """Closes an element and all that were opened after it."""
        while self.open and self.open[-1].place >= first.place:
            self.shut(self.open[-1])

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.found.append((self.path.copy(), text, self.linked))
            self.parts, self.linked = [], 0

    def feed(self, data):
        for slash, tag in CONTROL_TAGS.findall(data):
            self.ahead.setdefault(tag.lower(), []).append(slash)
        for tag, tags in self.ahead.items():
            tags.reverse()
            self.ends_ahead[tag] = tags.count("/")
        super().feed(data)

    def passed(self, tag: str) -> None:
        if self.ahead.get(tag):
            self.ends_ahead[tag] -= self.ahead[tag].pop() == "/"

    def ends(self, tag: str) -> bool:
        """Whether the next tag of this name is an end tag (of objects, which nest, whether any is)."""
        return self.ends_ahead.get(tag, 0) > 0 if tag == "object" else bool(self.ahead.get(tag)) and self.ahead[tag][-1] == "/"

    def end_hidden(self, tag: str) -> None:
        """Closes an open head, or controls left open, where tag shows that they are over."""
        head = self.by_tag.get("head")
        if head and tag not in IN_HEAD:
            if self.hidden[-1] is head[-1]:  # not inside a noscript or template of the head
                self.pop(head[-1])
        elif tag in ENDS_P or tag in ("body", "li", "tr", "td", "th"):
            after = self.others[-1].place if self.others else -1
            # One whose end tag still comes holds this block, as fallback content say.
            while self.controls and self.controls[-1].place > after and not self.ends(self.controls[-1].tag):
                self.pop(self.controls[-1])

    def handle_starttag(self, tag, attrs):
        self.passed(tag)
        if self.hidden and tag != "head":
            self.end_hidden(tag)
        if tag in VOID:
            if tag == "br" and not self.hidden:
                self.parts.append(" ")
            elif tag not in INLINE:
                self.end_block()
            return
        if tag in INLINE:
            self.push(tag, [])
            return
        self.end_block()
        if tag in ENDS_P and self.blocks and self.blocks[-1].tag == "p":
            self.pop(self.blocks[-1])
        marks = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = value.lower().split()
                marks += [f"{tag}.{w}" for w in words] + [f".{w}" for v in words for w in re.split(r"[^a-z]+", v) if w]
        self.push(tag, [self.hashed(m) for m in marks])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.passed(tag)
        own = self.by_tag.get(tag)
        if tag in VOID or not own:
            return
        if self.blocks and self.blocks[-1].place >= own[-1].place:
            if tag in INLINE:  # an inline end tag doesn't close blocks that it never opened
                self.shut(own[-1])
                return
            self.end_block()
        self.pop(own[-1])

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.by_tag.get("a"):
                self.linked += len(data)


def leaf_blocks(html: str | None, hashed: Hashed | None = None) -> list[tuple[np.ndarray, str, int]]:
    if not html:
        return []
    p = Blocks(hashed or Hashed(PATH_BUCKETS, 1))
    p.feed(html)
    p.close()
    p.end_block()
    return p.found


def features(blocks: list[tuple[np.ndarray, str, int]], hashed: Hashed | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
    """A row for each of the blocks from first to last; shares and places are those in the whole page."""
    word_bucket = hashed or Hashed(WORD_BUCKETS, 2)
    known = word_bucket.known.get
    own = blocks[first:last]
    x = np.zeros((len(own), INPUT), np.float32)
    total = sum(len(t) for _, t, _ in blocks) or 1
    at = PATH_BUCKETS + WORD_BUCKETS
    for i, (path, text, linked) in enumerate(own):
        words = text.split(" ")
        n = len(words)
        got = [known(w) or word_bucket(w) for w in text.lower().split(" ")]
        x[i, :PATH_BUCKETS] = path
        x[i, PATH_BUCKETS:at] = np.bincount([k for k, _ in got], [sign for _, sign in got], WORD_BUCKETS) / n
        x[i, at : at + SHAPE] = (
            np.log1p(n) / 6,
            linked / len(text),
            len(text) / total,
            len(text) / n / 10,
            float(n <= 4),
            float(text[-1] in ".!?…\"'"),
            sum(text.count(c) for c in "©|»·•") / n,
            (first + i) / len(blocks),
        )
    return x


def gates(rng, inputs: int, units: int) -> dict[str, np.ndarray]:
    b = np.zeros(4 * units, np.float32)
    b[units : 2 * units] = 1.0  # forget gates start open
    scale = lambda n, *shape: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
    return {"w": scale(inputs, inputs, 4 * units), "u": scale(units, units, 4 * units), "b": b}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states of sequences x (time, batch, inputs); padded steps carry the state on."""
    return run_steps(p, x @ p["w"] + p["b"], mask, keep)


def run_steps(p: dict, pre: np.ndarray, mask: np.ndarray, keep: bool = False):
    """The same from the inputs' share of the gates (time, batch, 4 * units)."""
    steps, batch, _ = pre.shape
    units = p["u"].shape[0]
    h, c = np.zeros((batch, units), np.float32), np.zeros((batch, units), np.float32)
    out, trace = np.empty((steps, batch, units), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ p["u"]
        i, f, o = (sigmoid(z[:, k * units : (k + 1) * units]) for k in range(3))
        g = np.tanh(z[:, 3 * units :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            trace.append((h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out, trace


def back_lstm(p: dict, x: np.ndarray, trace: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
    steps, batch, _ = x.shape
    units = p["u"].shape[0]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    dh, dc = np.zeros((batch, units), np.float32), np.zeros((batch, units), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = trace[t]
        dh = dh + d_out[t]
        dhm, dcm = dh * m, dc * m
        do = dhm * tc
        dc_new = dcm + dhm * o * (1 - tc**2)
        dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), do * o * (1 - o), dc_new * i * (1 - g**2)], 1)
        grad["w"] += x[t].T @ dz
        grad["u"] += h.T @ dz
        grad["b"] += dz.sum(0)
        dh, dc = dz @ p["u"].T + dh * (1 - m), dc_new * f + dc * (1 - m)
    return grad


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in sequences)
    x, mask = np.zeros((steps, len(sequences), INPUT), np.float32), np.zeros((steps, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


def forward(model: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Log odds of content for each step. Padding stands at the end, so the backward pass only skips it."""
    ahead, ta = run_lstm(model["ahead"], x, mask, keep)
    behind, tb = run_lstm(model["behind"], x[::-1], mask[::-1], keep)
    both = np.concatenate([ahead, behind[::-1]], 2)
    return both @ model["out"]["w"] + model["out"]["b"], both, ta, tb


def train(pages: list[tuple[str, list[bool]]], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A model from (html, content or not for each leaf block), by Adam on the mean cross-entropy."""
    rng = np.random.default_rng(seed)
    model = {
        "ahead": gates(rng, INPUT, HIDDEN_UNITS),
        "behind": gates(rng, INPUT, HIDDEN_UNITS),
        "out": {"w": (rng.standard_normal(2 * HIDDEN_UNITS) / 6).astype(np.float32), "b": np.zeros(1, np.float32)},
    }
    data = [(features(leaf_blocks(html)), np.array(y, np.float32)) for html, y in pages]
    moments = {(a, b): [np.zeros_like(v), np.zeros_like(v)] for a, part in model.items() for b, v in part.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs)
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 16):
            own = [data[k] for k in order[lo : lo + 16]]
            x, mask = pad([s for s, _ in own])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(own):
                y[: len(labels), k] = labels
            odds, both, ta, tb = forward(model, x, mask, keep=True)
            d = (sigmoid(odds) - y) * mask / mask.sum()
            d_both = d[:, :, None] * model["out"]["w"]
            n = HIDDEN_UNITS
            grads = {
                "ahead": back_lstm(model["ahead"], x, ta, d_both[:, :, :n]),
                "behind": back_lstm(model["behind"], x[::-1], tb, d_both[::-1, :, n:]),
                "out": {"w": np.einsum("tb,tbu->u", d, both), "b": np.array([d.sum()], np.float32)},
            }
            step += 1
            for (a, b), (m, v) in moments.items():
                g = grads[a][b]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[a][b] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def synthetic(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages with labels: each template wraps random words in the markup that such a part usually has."""
    rng = random.Random(seed)
    syllables = [a + b + c for a in "bcdfglmnprstv" for b in "aeiouéü" for c in ("", "n", "r", "s")]
    style = [""]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3, 4)))) + style[0]
    line = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda: (s := line(3, 18))[0].upper() + s[1:] + rng.choice(("...!?"))
    pick = rng.choice

    def article() -> tuple[str, int]:
        parts, count, odd = [], 0, pick((0.0, 0.0, 0.0, 0.3, 0.9))
        if rng.random() < 0.85:
            parts.append(f"<h1>{line(2, 10)}</h1>")
            count += 1
        for _ in range(rng.randint(1, pick((2, 8, 14, 20)))):
            kind = rng.random()
            if rng.random() < odd:  # poor prose is prose: one word again and again, or a few words
                parts.append(f"<p>{' '.join([word()] * rng.randint(1, 40)) if rng.random() < 0.5 else line(1, 4)}</p>")
                count += 1
            elif kind < 0.7:
                parts.append(f"<p>{' '.join(sentence() for _ in range(rng.randint(1, 9)))}</p>")
                count += 1
            elif kind < 0.78:
                parts.append(f"<h{(k := pick('234'))}>{line(1, 6)}</h{k}>")
                count += 1
            elif kind < 0.84:
                items = rng.randint(2, 5)
                tag = pick(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{line(1, 14)}</li>" for _ in range(items)) + f"</{tag}>")
                count += items
            elif kind < 0.88:
                parts.append(f"<blockquote>{sentence()}</blockquote>")
                count += 1
            elif kind < 0.91:
                parts.append(f"<table><tr><td>{line(1, 3)}</td><td>{line(1, 3)}</td></tr></table>")
                count += 2
            elif kind < 0.94:
                parts.append(f"<pre>{line(3, 12)}</pre>")
                count += 1
            else:  # an unclosed b and p, as in the wild
                parts.append(f"<p><b>{sentence()}<br>")
                count += 1
        body = "".join(parts)
        wrap = pick(("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post-body">{}</div>', '<div class="entry-content">{}</div>', '<div class="article-body">{}</div>', "<div>{}</div>"))
        return wrap.format(body), count

    def menu() -> tuple[str, int]:
        k = rng.randint(2, 9)
        items = "".join(f'<li><a href="/{word()}">{line(1, 2)}</a></li>' for _ in range(k))
        return pick(("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav">{}</ul>', '<div id="navigation"><ul>{}</ul></div>', '<div class="breadcrumbs"><ul>{}</ul></div>')).format(items), k

    def header() -> tuple[str, int]:
        return pick(("<header><div>{}</div><p>{}</p></header>", '<div class="header"><div class="logo">{}</div><p>{}</p></div>', '<div id="masthead"><h2>{}</h2><p>{}</p></div>')).format(line(1, 3), line(2, 8)), 2

    def footer() -> tuple[str, int]:
        site = pick((word(), f"{word()}.{word()}.com", f"www.{word()}.org", f"{word()} {word()}"))
        inner = pick(("&copy; {} &middot; {}", "&copy; {} {}", "{} | {}", "Copyright {} {}")).format(site, " ".join(sentence() for _ in range(rng.randint(1, 3))))
        return pick(("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>', "<footer><p>{}</p></footer>")).format(inner), 1

    def ad() -> tuple[str, int]:
        return pick(('<div class="ad">{}</div>', '<div class="ads"><p>{}</p></div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="sponsored"><a href="/x">{}</a></div>', '<div class="banner">{}</div>', '<div class="promo">{}</div>', '<aside class="ad">{}</aside>')).format(" ".join(sentence() for _ in range(rng.randint(1, 3)))), 1

    def sidebar() -> tuple[str, int]:
        k = rng.randint(1, 4)
        items = "".join(pick(("<p>{}</p>", "<li><a href='/r'>{}</a></li>")).format(line(2, 12)) for _ in range(k))
        return pick(("<aside><h3>{}</h3>{}</aside>", '<div class="sidebar"><h3>{}</h3>{}</div>', '<div id="sidebar"><h4>{}</h4>{}</div>', '<div class="related"><h3>{}</h3>{}</div>', '<div class="widget"><h3>{}</h3>{}</div>')).format(line(1, 3), items), k + 1

    def notice() -> tuple[str, int]:
        return pick(('<div class="cookie-notice"><p>{}</p></div>', '<div class="cookie-banner">{}</div>', '<div class="notice">{}</div>', '<div id="consent"><p>{}</p></div>', '<div class="alert">{}</div>', '<div class="newsletter"><p>{}</p></div>', '<div class="popup">{}</div>', '<div role="alert">{}</div>')).format(" ".join(sentence() for _ in range(rng.randint(1, 3)))), 1

    def form() -> tuple[str, int]:
        return f'<form><label>{line(1, 3)}</label><input name="q"><p>{line(1, 6)}</p></form>', 2

    def comments() -> tuple[str, int]:
        k = rng.randint(1, 5)
        told = lambda: " ".join(sentence() for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.35:  # a list of them, at times without a heading
            name = pick(("comments", "comment-list", "commentlist", "comments-list", "responses"))
            one = pick(("<li>{}</li>", "<li><p>{}</p></li>", '<li class="comment">{}</li>', '<li class="comment"><div>{}</div></li>'))
            tag, head = pick(("ul", "ol")), pick((f"<h3>{line(1, 3)}</h3>", ""))
            mark = pick((f'class="{name}"', f'id="{name}"'))
            return f"{head}<{tag} {mark}>{''.join(one.format(told()) for _ in range(k))}</{tag}>", k + bool(head)
        one = pick(('<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", '<article class="comment"><p>{}</p></article>', '<div class="comment">{}</div>'))
        items = "".join(one.format(told()) for _ in range(k))
        return pick(('<section class="comments"><h3>{}</h3>{}</section>', '<div id="comments"><h3>{}</h3>{}</div>', '<div class="comment-list"><h2>{}</h2>{}</div>', '<div class="responses comments"><h4>{}</h4>{}</div>', '<section id="reader-comments"><h3>{}</h3>{}</section>')).format(line(1, 3), items), k + 1

    def cells() -> tuple[str, int]:
        """A menu in the cells of a table."""
        k = rng.randint(2, 6)
        if rng.random() < 0.5:
            return f"<table><tr>{''.join(f'<td><a href=/m>{line(1, 2)}</a></td>' for _ in range(k))}</tr></table>", k
        return f"<table>{''.join(f'<tr><td><a href=/m>{line(1, 2)}</a></td></tr>' for _ in range(k))}</table>", k

    def column() -> tuple[str, int]:
        """A menu as one column of a page laid out as a table."""
        if rng.random() < 0.5:
            k = rng.randint(2, 8)
            return f"<td{pick(('', ' class=menu', ' class=left', ' id=nav'))}>{pick(('<br>', ' ', ' | ')).join(f'<a href=/m>{line(1, 2)}</a>' for _ in range(k))}</td>", 1
        html, k = pick((menu, cells))()
        return f"<td>{html}</td>", k

    out = []
    while len(out) < n:
        style[0] = pick(("",) * 6 + ("***", " |", " &middot;", "&amp;&amp;", "!!", " 2024", " &raquo;"))
        before = [f() for f in (header, menu, notice, ad, sidebar) if rng.random() < 0.45]
        if rng.random() < 0.12:
            before.append(cells())
        after = [f() for f in (ad, sidebar, comments, form, menu, notice, footer) if rng.random() < 0.45]
        body, count = article()
        if rng.random() < 0.3:  # an advert or a list of related pages inside the article
            inner, k = pick((ad, sidebar, notice, comments, comments))()
            cut = body.rfind("</")
            body, tail, inside = body[:cut] + inner + body[cut:], [False] * k, True
        else:
            tail, inside = [], False
        if rng.random() < 0.12:  # a page laid out as a table
            left, k = column()
            before.append(("", k))
            body = f"<table><tr>{left}<td>{body}</td></tr></table>"
        labels = [False for _, k in before for _ in range(k)] + [True] * count + (tail if inside else [])
        labels += [False for _, k in after for _ in range(k)]
        html = f"<html><head><title>{line(2, 6)}</title></head><body>{''.join(h for h, _ in before)}{body}{''.join(h for h, _ in after)}</body></html>"
        if len(leaf_blocks(html)) == len(labels):  # an unclosed tag may swallow what follows: no label then
            out.append((html, labels))
    return out


def odds_of(model: dict, pages: list[list], hashed: Hashed) -> np.ndarray:
    """Log odds of content (time, batch). The features of a long page are made and projected in pieces."""
    steps, names = max(map(len, pages)), ("ahead", "behind")
    pre = {k: np.zeros((steps, len(pages), 4 * HIDDEN_UNITS), np.float32) for k in names}
    mask = np.zeros((steps, len(pages)), np.float32)
    for j, blocks in enumerate(pages):
        mask[: len(blocks), j] = 1
        for lo in range(0, len(blocks), BLOCKS_AT_ONCE):
            x = features(blocks, hashed, lo, lo + BLOCKS_AT_ONCE)
            for k in names:
                pre[k][lo : lo + len(x), j] = x @ model[k]["w"] + model[k]["b"]
    n, w = HIDDEN_UNITS, model["out"]["w"]
    ahead = run_steps(model["ahead"], pre["ahead"], mask)[0] @ w[:n]
    behind = run_steps(model["behind"], pre["behind"][::-1], mask[::-1])[0] @ w[n:]
    return ahead + behind[::-1] + model["out"]["b"]


def label(model: dict, pages: list[list], hashed: Hashed | None = None) -> list[np.ndarray]:
    """Content or not for the blocks of each page; pages of like length run through the network together,
    BLOCKS_AT_ONCE blocks of them or a single page."""
    hashed = hashed or Hashed(WORD_BUCKETS, 2)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= BLOCKS_AT_ONCE and len(pages[order[hi]]) <= 1.25 * len(pages[order[lo]]) + 2:
            hi += 1
        odds = odds_of(model, [pages[i] for i in order[lo:hi]], hashed)
        for k, i in enumerate(order[lo:hi]):
            out[i] = odds[: len(pages[i]), k] > 0
        lo = hi
    return out


def texts(model: dict, htmls: list[str | None], hashed: tuple[Hashed, Hashed] | None = None) -> list[str]:
    of_paths, of_words = hashed or (Hashed(PATH_BUCKETS, 1), Hashed(WORD_BUCKETS, 2))
    pages = [leaf_blocks(h, of_paths) for h in htmls]
    return ["\n\n".join(t for (_, t, _), keep in zip(p, kept) if keep) for p, kept in zip(pages, label(model, pages, of_words))]


def portions(htmls: list[str | None]) -> Iterator[list[str | None]]:
    """Some pages at a time, of CHARS_AT_ONCE characters or a single one."""
    out, size = [], 0
    for h in htmls:
        if out and (size + len(h or "") > CHARS_AT_ONCE or len(out) == 256):
            yield out
            out, size = [], 0
        out.append(h)
        size += len(h or "")
    if out:
        yield out


#: Kept in a plain dict: a cached function would be pickled by its name, which executors can't import.
_TRAINED: dict[str, dict] = {}


def trained() -> dict:
    """The labeller of the synthetic pages; trained once in a driver's life."""
    if not _TRAINED:
        _TRAINED["pages"] = train(synthetic())
    return _TRAINED["pages"]


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())  # tens of thousands of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(PATH_BUCKETS, 1), Hashed(WORD_BUCKETS, 2)
        for b in batches:
            out: list[str] = []
            for own in portions(b.column(2).to_pylist()):
                out += texts(held.value, own, hashed)
            columns = [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select("page_id", "url", "html")
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
