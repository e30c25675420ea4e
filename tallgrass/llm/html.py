"""Operator 7, HTML extraction: a bidirectional LSTM in numpy labels each block of a page as main text or not."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, sliced

#: Elements that begin and end a block; all others, unknown ones too, stand within the text.
BLOCK = frozenset("""address article aside audio blockquote body canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav noscript ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul video xmp""".split())
#: Elements whose content is no text; of these, those that take the rest of the page if they aren't closed.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes")}
ENDLESS = frozenset(("script", "style"))
TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])", re.IGNORECASE)
VOID = frozenset("col hr".split())
#: Open elements that these end.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: Up to the end of a tag: quotes hold a > only where a value begins with them. Nothing is tried twice.
ATTRIBUTES = re.compile(r"((?:[^>=]++|=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PIECE = re.compile(r"[a-z]+", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

PATH_DIMS, WORD_DIMS, OTHER_DIMS = 256, 48, 8
#: Units in each direction; pages that are labelled together; pages, passes and seed of the training.
UNITS, TOGETHER, PAGES, PASSES, SEED = 20, 64, 3000, 6, 7
#: Open elements in a path; places for blocks that are labelled together, so that memory doesn't grow with a page's features.
DEPTH, PLACES = 64, 8192
CHUNK = 1 << 20


def paired(page: str) -> dict[int, int]:
    """Where the start tag of a template begins: where its end tag does. Those without an end tag aren't there."""
    out, begun = {}, []
    for m in TEMPLATE.finditer(page):
        if not m[1]:
            begun.append(m.start())
        elif begun:
            out[begun.pop()] = m.start()
    return out


def blocks(page: str) -> list[tuple[str, str, float]]:
    """(path, text, share of its characters in links) of each leaf of a page that has text, in page order.

    A path has a part for each open block element, of the innermost DEPTH: its tag and the words of its class, id and role. Character
    references are decoded; white space is one space. Comments, scripts, styles, templates and markup are no text; nor is a
    tag that the page breaks off in. The page is read once, forward.
    """
    out: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str]] = []
    opened: Counter = Counter()
    text: list[str] = []
    hidden = paired(page) if "<template" in page.lower() else {}
    unclosed: set[str] = set()
    linked = depth = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            words = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if words:
                out.append((" ".join(x[1] for x in stack[-DEPTH:]), words, min(1.0, linked / max(1, len(whole)))))
            text.clear()
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if depth:
                linked += len(part)

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        m = TAG.match(page, begin)
        if not m:
            other = page[begin + 1 : begin + 2]
            say(page[at : begin if other in ("!", "?") else begin + 1])
            at = begin + 1
            if other in ("!", "?"):
                mark = "-->" if page.startswith("<!--", begin) else ">"
                end = page.find(mark, begin + 2)
                at = end + len(mark) if end >= 0 else len(page)
            continue
        say(page[at:begin])
        tag, rest = m[2].lower(), ATTRIBUTES.match(page, m.end())
        at = rest.end() if rest else page.find(">", m.end()) + 1  # a quote that never ends doesn't hold the tag open
        if not at:
            break
        attributes = page[m.end() : at - 1]
        if not m[1] and tag == "template" and begin in hidden:
            end = page.find(">", hidden[begin])
            at = end + 1 if end >= 0 else len(page)
            continue
        if not m[1] and tag in RAW and tag not in unclosed:
            end = RAW[tag].search(page, at)
            if end:
                close = page.find(">", end.end())
                at = close + 1 if close >= 0 else len(page)
            elif tag in ENDLESS:
                break
            else:
                unclosed.add(tag)
            continue
        if tag not in BLOCK:
            if tag == "br":
                say(" ")
            elif tag == "a":
                depth = 0 if m[1] else 1
            continue
        flush()
        if m[1]:
            if opened[tag]:
                depth = 0
                while stack[-1][0] != tag:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
            continue
        if stack and (stack[-1][0] in ENDS.get(tag, ()) or stack[-1][0] == "p" and tag in PARAGRAPH_ENDS):
            opened[stack.pop()[0]] -= 1
        if tag not in VOID and not attributes.endswith("/"):
            names = " ".join(x for found in NAMED.finditer(attributes) for x in PIECE.findall(CAMEL.sub(" ", found[2] or found[3] or found[4] or "")))
            stack.append((tag, f"{tag}.{names.lower().replace(' ', '.')}" if names else tag))
            opened[tag] += 1
    flush()
    return out


@lru_cache(1 << 16)
def hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


@lru_cache(1 << 14)
def path_vector(path: str) -> np.ndarray:
    """Tags and names of a path as signed counts in hashed places; those of the last part once more by themselves."""
    out = np.zeros(PATH_DIMS, dtype=np.float32)
    parts = path.split(" ")
    for i, part in enumerate(parts):
        tag, *names = part.split(".")
        for x in [f"<{tag}", *names, *([f"leaf<{tag}", *(f"leaf {n}" for n in names)] if i == len(parts) - 1 else [])]:
            h = hashed(x)
            out[h % PATH_DIMS] += 1 if h & 0x10000 else -1
    return np.tanh(out)


def features(page: list[tuple[str, str, float]], begin: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each block of a page, or of those from begin to end: path, words hashed, and counts."""
    n = len(page)
    part = page[begin:end]
    out = np.zeros((len(part), PATH_DIMS + WORD_DIMS + OTHER_DIMS), dtype=np.float32)
    for i, (path, text, linked) in enumerate(part, begin):
        row = out[i - begin]
        row[:PATH_DIMS] = path_vector(path)
        words = text.lower().split(" ")
        counts = np.bincount(np.fromiter(map(hashed, words), dtype=np.int64, count=len(words)) % WORD_DIMS, minlength=WORD_DIMS)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.sqrt(counts / len(words))
        row[PATH_DIMS + WORD_DIMS :] = (np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, linked, text[-1] in ".!?…", text[0] in "©", i / n, np.log1p(n) / 6, text.count("|") / len(words))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM layer in each direction and a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        r, d, h = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + OTHER_DIMS, UNITS
        self.w = {f"{k}{i}": (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for i in "fb" for k, s in (("x", (d, 4 * h)), ("h", (h, 4 * h)))}
        self.w |= {f"c{i}": np.repeat(np.float32([0, 1, 0, 0]), h) for i in "fb"}
        self.w |= {"o": (r.normal(size=(2 * h, 1)) / np.sqrt(2 * h)).astype(np.float32), "d": np.zeros(1, dtype=np.float32)}

    def sweep(self, x: np.ndarray, mask: np.ndarray, side: str, kept: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Outputs (time, page, unit) of one direction over inputs (time, page, feature), and the state after the last.

        kept, if given, gets what training needs of each step; state is that of an earlier part of the same pages."""
        n, b, _ = x.shape
        u, k = self.w[f"h{side}"], UNITS
        given = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h, c = state or (np.zeros((b, k), dtype=np.float32),) * 2
        out = np.zeros((n, b, k), dtype=np.float32)
        for t in range(n):
            z = given[t] + h @ u
            gates, g = sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            new = f * c + i * g
            tan = np.tanh(new)
            if kept is not None:
                kept.append((h, c, i, f, o, g, tan))
            m = mask[t]
            h, c = m * (o * tan) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, (h, c)

    def chance(self, both: np.ndarray) -> np.ndarray:
        return sigmoid((both @ self.w["o"])[..., 0] + self.w["d"])

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        kept: list = []
        kept_back: list = []
        ahead, _ = self.sweep(x, mask, "f", kept)
        back, _ = self.sweep(x[::-1], mask[::-1], "b", kept_back)
        both = np.concatenate([ahead, back[::-1]], 2)
        return self.chance(both), both, kept, kept_back

    def unsweep(self, x: np.ndarray, mask: np.ndarray, side: str, kept: list, d_out: np.ndarray, grad: dict) -> None:
        u, k = self.w[f"h{side}"], UNITS
        dh = dc = np.zeros((x.shape[1], k), dtype=np.float32)
        dz_all = np.zeros((*x.shape[:2], 4 * k), dtype=np.float32)
        du = np.zeros_like(u)
        for t in range(len(kept) - 1, -1, -1):
            h, c, i, f, o, g, tan = kept[t]
            m = mask[t]
            dh = dh + d_out[t]
            d_new = m * dc + m * dh * o * (1 - tan * tan)
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), m * dh * tan * o * (1 - o), d_new * i * (1 - g * g)], 1)
            dz_all[t] = dz
            du += h.T @ dz
            dh, dc = (1 - m) * dh + dz @ u.T, (1 - m) * dc + d_new * f
        flat = dz_all.reshape(-1, 4 * k)
        grad[f"x{side}"], grad[f"h{side}"], grad[f"c{side}"] = x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int, seed: int = SEED) -> None:
        noise = np.random.default_rng(seed)
        r, step, most = random.Random(seed), 0, passes * -(-len(pages) // 16)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(passes):
            order = list(range(len(pages)))
            r.shuffle(order)
            order = sorted(order, key=lambda i: len(pages[i][1]) + 4 * r.random())
            batches = [order[i : i + 16] for i in range(0, len(order), 16)]
            r.shuffle(batches)
            for batch in batches:
                x, mask = padded([pages[i][0] for i in batch])
                x[:, :, PATH_DIMS : PATH_DIMS + WORD_DIMS] *= noise.random((*mask.shape[:2], 1)) > 0.5  # the words of made pages say little
                y = np.zeros(mask.shape[:2], dtype=np.float32)
                for j, i in enumerate(batch):
                    y[: len(pages[i][1]), j] = pages[i][1]
                p, both, kept, kept_back = self.forward(x, mask)
                d = ((p - y)[:, :, None] * mask / mask.sum()).astype(np.float32)
                grad = {"o": both.reshape(-1, 2 * UNITS).T @ d.reshape(-1, 1), "d": d.sum((0, 1))}
                d_both = d @ self.w["o"].T
                self.unsweep(x, mask, "f", kept, d_both[:, :, :UNITS], grad)
                self.unsweep(x[::-1], mask[::-1], "b", kept_back, d_both[::-1, :, UNITS:], grad)
                step += 1
                rate = 0.012 * (1 - step / (most + 1)) + 0.0005
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[tuple[str, str, float]]]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages with about as many blocks are labelled together, PLACES in all."""
        out: list = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            most = len(pages[order[-1]])
            if most > PLACES:
                i = order.pop()
                out[i] = self.label_long(pages[i])
                continue
            batch = order[-max(1, min(TOGETHER, PLACES // most)) :]
            del order[-len(batch) :]
            x, mask = padded([features(pages[i]) for i in batch])
            ahead, back = self.sweep(x, mask, "f")[0], self.sweep(x[::-1], mask[::-1], "b")[0][::-1]
            p = self.chance(np.concatenate([ahead, back], 2))
            for j, i in enumerate(batch):
                out[i] = p[: len(pages[i]), j] > 0.5
        return out

    def label_long(self, page: list[tuple[str, str, float]]) -> np.ndarray:
        """The same for a page with very many blocks, whose features are made part by part, once for each direction."""
        n, both, one = len(page), np.zeros((len(page), 2 * UNITS), dtype=np.float32), np.ones((PLACES, 1, 1), dtype=np.float32)
        state = None
        for i in range(0, n, PLACES):
            ahead, state = self.sweep(features(page, i, i + PLACES)[:, None], one, "f", state=state)
            both[i : i + PLACES, :UNITS] = ahead[:, 0]
        state = None
        for i in range((n - 1) // PLACES * PLACES, -1, -PLACES):
            back, state = self.sweep(features(page, i, i + PLACES)[::-1, None], one, "b", state=state)
            both[i : i + PLACES, UNITS:] = back[::-1, 0]
        return self.chance(both) > 0.5


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), pages[0].shape[1]), dtype=np.float32)
    mask = np.zeros((n, len(pages), 1), dtype=np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


#: Marks main text in made pages, until it has become the label.
MAIN = "\ue000"

# Training pages: made by rule, every block with its label. What marks text off is where it stands, not what it says.

FRAMES = [
    ("article", ""), ("article", ""), ("article", "post"), ("article", "entry"), ("article", "article"), ("main", ""), ("main", "content"), ("main", "page"), ("main", "site-main"), ("div", "content"), ("div", "content"), ("div", "article"),
    ("div", "article-body"), ("div", "article-content"), ("div", "post-content"), ("div", "entry-content"), ("div", "post"), ("div", "blog-post"), ("div", "entry"), ("div", "story"), ("div", "main"), ("div", "main-content"), ("section", "article"),
    ("section", "content"), ("div", "text"), ("td", "content"), ("td", "main"), ("div", "page-content"), ("div", "body-text"), ("div", "story-body"),
]
ASIDES = {
    "nav": [("nav", ""), ("nav", "menu"), ("div", "nav"), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "breadcrumbs"), ("nav", "breadcrumb"), ("div", "toc"), ("div", "pagination"), ("td", "menu"), ("td", "nav"), ("div", "links")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "top-bar"), ("div", "banner")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "bottom")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "side"), ("div", "related"), ("div", "widget"), ("section", "related-posts"), ("div", "popular"), ("div", "recommended"), ("div", "share"), ("div", "social"), ("div", "tags"), ("div", "author-box"), ("div", "related-articles"), ("div", "social-share"), ("td", "sidebar"), ("div", "right-column"), ("div", "widget-area")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad"), ("div", "ad-slot"), ("ins", "adsbygoogle"), ("section", "promotion")],
    "notice": [("div", "cookie-banner"), ("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "consent"), ("div", "newsletter"), ("div", "popup"), ("div", "modal"), ("div", "subscribe"), ("section", "gdpr"), ("div", "paywall"), ("div", "disclaimer")],
    "form": [("form", ""), ("form", "search"), ("form", "login"), ("form", "contact-form"), ("form", "signup"), ("div", "search-form")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "reader-comments"), ("div", "discussion"), ("section", "responses"), ("div", "replies"), ("div", "disqus"), ("div", "comments-area"), ("ul", "comments"), ("div", "user-comments")],
}


def made_page(r: random.Random) -> str:
    """A page in which each main block has MAIN in it."""
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "ción", "que", "ch", "eau", "lich", "ung", "é", "ñ", "ß", "ü"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def say(low: int, high: int, is_main: bool = False, end: str | None = None) -> str:
        n = r.randint(low, max(low, high)) if r.random() < 0.7 else low
        words = " ".join(word() for _ in range(n)) + (r.choice([".", ".", ".", "", "!", "?"]) if end is None else end)
        if r.random() < 0.08:
            words = words.replace(" ", " | ")
        words = words[:1].upper() + words[1:] if r.random() < 0.8 else words
        return words + MAIN if is_main else words

    def opened(tag: str, name: str) -> str:
        return f'<{tag} {r.choice(["class", "class", "class", "id"])}="{r.choice([name, name, name.replace("-", "_"), f"{word()} {name}", f"{name}-{r.randint(1, 9)}"])}">' if name else f"<{tag}>"

    def paragraphs(n: int, low: int, high: int, is_main: bool = False) -> str:
        out = []
        for _ in range(n):
            kind = r.random()
            if kind < 0.62 or not is_main and kind < 0.9:
                lead = r.choice(["", "", "", "<b>", "<em>"])
                out.append(f"<p>{lead}{say(low, high, is_main)}{r.choice(['</p>', '</p>', '</p>', '<br>', ''])}")
            elif kind < 0.73:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4', 'h5']))}>{say(1, 8, is_main, '')}</{h}>")
            elif kind < 0.81:
                out.append(f"<{(u := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{say(1, 15, is_main)}</li>" for _ in range(r.randint(1, 4))) + f"</{u}>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{say(3, 30, is_main)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{say(1, 30, is_main)}</blockquote>")
            elif kind < 0.88:
                out.append(f"<pre>{say(1, 30, is_main)}</pre>")
            elif kind < 0.91:
                out.append(f"<figure><img src=x><figcaption>{say(1, 12, is_main)}</figcaption></figure>")
            elif kind < 0.94:
                out.append("<dl>" + "".join(f"<dt>{say(1, 3, is_main, '')}</dt><dd>{say(1, 12, is_main)}</dd>" for _ in range(r.randint(1, 3))) + "</dl>")
            elif kind < 0.97:
                out.append(f"</p>{say(1, 25, is_main)}<p></p>")
            else:
                out.append("<table>" + "".join("<tr>" + "".join(f"<{(c := r.choice(['td', 'td', 'th']))}>{say(1, 6, is_main)}</{c}>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
        return "\n".join(out) if r.random() < 0.5 else "".join(out)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 4, end="")}</a></li>' for _ in range(n)) + "</ul>"

    def aside(kind: str) -> str:
        tag, name = r.choice(ASIDES[kind])
        if kind == "nav" or kind == "side" and r.random() < 0.5:
            body = links(r.randint(1, 7)) if tag != "ul" else links(r.randint(1, 7))[4:-5]
        elif kind == "form":
            body = f"<label>{say(1, 3, end='')}</label><input name=q><button>{say(1, 2, end='')}</button>" + (f"<p>{say(2, 20)}</p>" if r.random() < 0.4 else "")
            if r.random() < 0.3:
                body += "<select>" + "".join(f"<option>{say(1, 2, end='')}</option>" for _ in range(r.randint(1, 5))) + "</select>"
        elif kind == "comments":
            body = "".join(f"<{(t := r.choice(['div', 'li', 'article']))} class={r.choice(['comment', 'reply', 'response'])}><span>{say(1, 2, end='')}</span><p>{say(1, 60)}</p></{t}>" for _ in range(r.randint(1, 5)))
            body = (f"<h3>{say(1, 3, end='')}</h3>" if r.random() < 0.5 else "") + body
        elif kind == "header":
            body = r.choice([f"<h1>{say(1, 4, end='')}</h1>", f"<div>{say(1, 6)}</div>", f"<p>{say(1, 10)}</p>", links(3)])
        elif kind == "footer":
            body = ("&copy; " if r.random() < 0.7 else "") + say(2, 25) if r.random() < 0.6 else f"<p>&copy; {say(2, 15)}</p>" + links(2)
        else:
            body = r.choice([say(1, 30), f"<p>{say(1, 40)}</p>", paragraphs(r.randint(1, 3), 1, 40), f"<h3>{say(1, 4, end='')}</h3><p>{say(2, 40)}</p>"])
        if tag == "td":
            return f"<table><tr>{opened(tag, name)}{body}</td></tr></table>"
        return f"{opened(tag, name)}{body}</{tag}>"

    def inner(inside: str) -> str:
        if r.random() < 0.06:
            return inside
        tag, name = r.choice(FRAMES)
        if tag == "td" and r.random() < 0.5:
            return f"<table><tr><td class=menu>{links(2)}</td>{opened(tag, name)}{inside}</td><td class=sidebar><p>{say(1, 30)}</p></td></tr></table>"
        if tag == "td":
            return f"<table><tr>{opened(tag, name)}{inside}</td></tr></table>"
        return f"{opened(tag, name)}{inside}</{tag}>"

    body = []
    for kind, chance in (("header", 0.45), ("nav", 0.85), ("notice", 0.35), ("ad", 0.5), ("form", 0.25), ("side", 0.2)):
        if r.random() < chance:
            body.append(aside(kind))
    if r.random() < 0.25:
        r.shuffle(body)
    text = f"<h1>{say(1, 12, True, '')}</h1>" if r.random() < 0.7 else ""
    for _ in range(r.choice([1, 1, 1, 2, 3])):
        body_text = paragraphs(r.choice([1, 1, 2, 3, 5, 8, 12]), r.choice([1, 1, 3, 10]), r.choice([4, 20, 60, 150]), True)
        text += f"<section>{body_text}</section>" if r.random() < 0.15 else body_text
        if r.random() < 0.4:
            text += aside(r.choice(["ad", "side", "notice", "form"])) + (paragraphs(1, 1, 20, True) if r.random() < 0.5 else "")
    if r.random() < 0.2:
        text += aside("comments")
    if r.random() < 0.1:
        text = paragraphs(1, 1, r.choice([1, 5, 40]), True)
    main_html = inner(text)
    for _ in range(r.choice([0, 0, 1, 2])):
        main_html = r.choice(["<div>{}</div>", '<div class="wrapper">{}</div>', '<div id="page">{}</div>', '<section class="container">{}</section>', '<div class="row">{}</div>']).format(main_html)
    body.append(main_html)
    for kind, chance in (("comments", 0.35), ("side", 0.45), ("ad", 0.25), ("form", 0.2), ("notice", 0.2), ("nav", 0.15), ("footer", 0.85)):
        if r.random() < chance:
            body.append(aside(kind))
    close = "</body></html>" if r.random() < 0.85 else ""
    return f"<!DOCTYPE html><html><head><title>{word()}</title><script>var t='</p>';</script></head><body>{''.join(body)}{close}"


def made_pages(n: int, seed: int) -> list[tuple[list[tuple[str, str, float]], np.ndarray]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        found = blocks(made_page(r))
        out.append(([(p, t.replace(MAIN, ""), share) for p, t, share in found], np.array([MAIN in t for _, t, _ in found], dtype=np.float32)))
    return out


@lru_cache(4)
def trained(pages: int = PAGES, passes: int = PASSES, seed: int = SEED) -> Labeller:
    """The labeller, trained on so many made pages; the same for the same arguments."""
    out = Labeller(seed)
    out.train([(features(x), y) for x, y in made_pages(pages, seed) if len(x)], passes, seed)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = PAGES) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars. text joins the blocks that the labeller takes for main text, in page order, by one \\n.

    A null or empty page, and one without main text, has the empty text. Whole pages are read; nothing is cut. The
    labeller reads all blocks of a page, from both ends; a very long page is labelled part by part with the state carried over. It is trained by the driver on a bounded number of made pages and
    goes to the tasks with the function (some 140 KB). Repeated rows get a row each; other columns aren't read; an empty table
    gives no rows.
    """
    model = trained(training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html", CHUNK):
            found = [blocks(x or "") for x in batch.column("html").to_pylist()]
            labels = model.label(found)
            texts = ["\n".join(b[1] for b, main in zip(x, y, strict=True) if main) for x, y in zip(found, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
