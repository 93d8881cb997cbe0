"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page falls apart into leaf blocks, runs of text without a block tag between them.  A block's
features are its ancestors' tags, what their class, id and role names speak of, how much of the
page's text and links they hold, and its own text.  A name that speaks of something else counts
apart where its element holds the page: `<body class="has-sidebar">` is no side bar, and an
article named "review" is no comment.
The field has two labels, article and rest; weights and transitions are trained on labelled
pages, which `training_pages` writes from a fixed seed, and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

TRAINING_PAGES = 700
EPOCHS = 60
SEED = 20

#: A tag as nearly all are, without < or > in its attributes; others are looked at one by one.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Their content is no text, to the end of the page if they are not closed.
RAW = frozenset("script style iframe textarea title noembed noframes".split())
#: Their content is no text if they are closed: inert markup, drawings and the controls of forms.
HIDDEN = frozenset("template svg select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: These do not part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math menclose mfrac mi mn mo mover mpadded mroot mrow mspace msqrt mstyle msub msubsup msup mtext munder munderover q semantics rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: These end what is open of themselves.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: What names in class, id and role speak of.
GROUPS = {
    "advert": "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion promoted banner",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pager pagination tabs skip",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more teaser complementary",
    "foot": "footer foot copyright legal colophon contentinfo imprint",
    "head": "header head masthead topbar logo branding site hero",
    "notice": "cookie cookies notice notices consent gdpr alert modal popup overlay paywall warning message info disclaimer",
    "form": "form newsletter subscribe subscription signup login search poll contact",
    "comments": "comment comments commentlist reply replies respond discussion disqus thread review reviews feedback",
    "share": "share sharing social follow tags tagcloud byline author bio",
    "main": "article content main post entry story body text page blog news",
}
_GROUP = {name: group for group, names in GROUPS.items() for name in names.split()}
#: In a compound these tell of a page's state ("has-sidebar", "comments-open"), not of what the element is.
STATES = frozenset("has no with without not is open closed enabled disabled free on off hide show hidden visible".split())
_TAGS = frozenset("article main section nav header footer aside form div ul ol li dl table tr td blockquote pre p h1 h2 h3 h4 h5 h6 figure figcaption address details fieldset center body".split())
_ASIDE = ("nav", "header", "footer", "aside", "form")


@dataclass
class Block:
    text: str
    features: list[str]


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", tag, attributes) of tags and comments, the latter without a tag; in time linear in the page.

    What a search missed once is not searched for again behind that place: a page may hold any
    number of tags and quotes that are never closed.
    """
    missing = dict.fromkeys("\"'>", len(page) + 1)  # from here on there is none

    def find(c: str, at: int) -> int:
        if at >= missing[c]:
            return -1
        found = page.find(c, at)
        if found < 0:
            missing[c] = at
        return found

    at = 0
    while (start := page.find("<", at)) >= 0:
        if m := _PLAIN.match(page, start):
            yield start, m.end(), m[1], m[2].lower(), m[3]
            at = m.end()
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
        elif page.startswith(("<!", "<?"), start):
            end = find(">", start)
            at = start + 1 if end < 0 else end + 1
            if end >= 0:
                yield start, at, "", "", ""
        elif (m := _OPEN.match(page, start)) and (first := find(">", m.end())) >= 0:
            end, p = -1, m.end()
            while end < 0 and (stop := _STOP.search(page, p)):
                if stop[0] == ">":
                    end = stop.start()
                elif (p := find(stop[0], stop.end()) + 1) == 0:
                    break
            end = first if end < 0 else end  # a quote that is not closed: the tag ends at the first >
            at = end + 1
            yield start, at, m[1], m[2].lower(), page[m.end() : end]
        else:
            at = start + 1


def _names(attributes: str) -> tuple[str, ...]:
    """What the names of an element speak of; compounds that tell of a state speak of nothing."""
    found = set()
    for value in _ATTRIBUTE.findall(attributes):
        for name in "".join(value).lower().split():
            parts = _NAME.findall(name)
            if not STATES.intersection(parts):
                found.update(_GROUP[n] for n in parts if n in _GROUP)
    return tuple(found)


@dataclass
class Node:
    """An element: where it is, what its names speak of, and after parsing what it holds."""

    parent: int
    tag: str
    names: tuple[str, ...]
    text: int = 0
    linked: int = 0
    titles: int = 0
    homes: int = 0
    remark: bool = False  # within an element named after readers' comments


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with decoded text and white space as single spaces."""
    nodes = [Node(0, "", ())]
    found: list[tuple[str, int, float, bool]] = []  # text, node, share of links, whether a title came before
    stack = [0]
    unclosed: set[str] = set()
    tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = seen_h1 = 0

    def flush() -> None:
        nonlocal linked, seen_h1
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                node = nodes[stack[-1]]
                node.text += len(text)
                node.linked += min(linked, len(text))
                found.append((text, stack[-1], linked / max(1, sum(map(len, parts))), bool(seen_h1)))
                seen_h1 |= tags["h1"] > 0
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            linked += len(text) if in_link else 0

    def pop_to(tag: str) -> None:
        while len(stack) > 1:
            name = nodes[stack.pop()].tag
            tags[name] -= 1
            if name == tag:
                return

    at = 0
    for start, end, closing, tag, attributes in tokens(page):
        if start < at:
            continue
        add(page[at:start])
        at = end
        if not tag:
            continue
        if not closing and (tag in RAW or tag in HIDDEN):
            close = None if tag in unclosed else _closing(tag).search(page, at)
            if not close:
                unclosed.add(tag)
            if close or tag in RAW:
                at = close.end() if close else len(page)
                if tag in RAW and tag not in ("script", "style"):
                    flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        top = nodes[stack[-1]].tag
        if closing:
            if tags[tag] > 0:
                pop_to(tag)
            continue
        if tag in SELF_CLOSING and top == tag or tags["p"] > 0 and top == "p":
            pop_to(top)
        home, aside = tags["article"] + tags["main"] > 0, sum(tags[t] for t in _ASIDE if t != "header")
        names = _names(attributes) if "=" in attributes else ()
        remark = nodes[stack[-1]].remark or ("comments" in names and tag not in ("html", "body"))
        nodes.append(Node(stack[-1], tag, names, titles=int(tag == "h1" and not aside and (home or not tags["header"])), homes=int(tag in ("article", "main") and not remark), remark=remark))
        stack.append(len(nodes) - 1)
        tags[tag] += 1
    add(page[at:])
    flush()
    around = _surroundings(nodes)
    return [Block(text, [*around[k], *_features(text, share, around[k], title)]) for text, k, share, title in found]


def _surroundings(nodes: list[Node]) -> list[frozenset[str]]:
    """What a block directly in each element has of its ancestors, as features; elements that add nothing share their parent's."""
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.text += node.text
        up.linked += node.linked
        up.titles += node.titles
        up.homes += node.homes
    whole, out, above, inner = nodes[0], [frozenset(["any"])], [0], [()]
    for k, node in enumerate(nodes[1:], 1):
        up = out[node.parent]
        above.append(above[node.parent] + (node.tag in ("article", "main") and not node.remark))
        share = node.text / max(1, whole.text)
        elsewhere = whole.homes - node.homes - above[node.parent] > 0
        holds = (
            node.tag in ("html", "body")
            or (node.tag in ("article", "main") and whole.homes == 1 and node.homes)
            or (share >= 0.5 and whole.titles == node.titles and not elsewhere)
            or (share >= 0.3 and node.titles > 0)
        )
        own = {"main"} & set(node.names) if holds else set(node.names)
        wide = set(node.names) - own
        inner.append(tuple(own) or inner[node.parent])
        more = {f"of:{g}" for g in own} | {f"wide:{g}" for g in wide}
        if node.tag in _TAGS:
            more.add(f"in:{node.tag}")
        out.append(up if more <= up else up | more)
    final = []
    for k, node in enumerate(nodes):
        box = nodes[node.parent]
        density, share = box.linked / max(1, box.text), box.text / max(1, whole.text)
        place = {f"inner:{g}" for g in inner[k]} | {f"tag:{node.tag if node.tag in _TAGS else '-'}", f"box:{'most' if share >= 0.5 else 'some' if share >= 0.1 else 'few'}", f"links:{'no' if density <= 0.1 else 'some' if density < 0.5 else 'all'}"}
        final.append(out[k] | place)
    return final


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I)


def _features(text: str, linked: float, around: frozenset[str], title: bool) -> list[str]:
    """The features of a block that depend on its text."""
    home = "in:article" in around or "in:main" in around
    main = "of:main" in around
    bad = any(f"in:{t}" in around for t in _ASIDE) or any(f"of:{g}" in around for g in GROUPS if g != "main")
    out = [f"home:{home},{bad}", f"named:{main},{bad}", f"head:{'in:header' in around or 'of:head' in around},{home or main}"]
    words = text.count(" ") + 1
    out.append("words:" + ("1" if words == 1 else "4" if words < 5 else "9" if words < 10 else "24" if words < 25 else "more"))
    out.append("linked:" + ("no" if linked <= 0.05 else "some" if linked < 0.5 else "all"))
    out.append(f"end:{text[-1] in '.!?:;…'}")
    out.append(f"long:{words >= 10},{linked < 0.5},{bad}")
    if "©" in text or "(c)" in (lower := text.lower()) or lower.startswith("copyright"):
        out.append(f"copyright:{words < 25}")
    out.append(f"title:{title}")
    return out


_WORDS = "the of and a to in is on that it for was with as by at from this be have or an are not but his they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many before must through".split()
_LABELS = ("rest", "article")


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[list[tuple[list[str], int]]]:
    """Labelled pages: features and label (1: article) of each block.

    Layouts, names, wording and lengths are drawn from a fixed seed.  Every part is written with
    a mark in its text, by which its blocks are labelled after parsing.
    """
    rng = np.random.RandomState(seed)
    pick = lambda xs: xs[rng.randint(len(xs))]

    def words(lo: int, hi: int, mark: str, end: str = ".") -> str:
        return " ".join([mark, *(pick(_WORDS) + ("," if rng.rand() < 0.06 else "") for _ in range(rng.randint(lo, hi)))]) + end

    def named(group: str) -> str:
        names = GROUPS[group].split()
        name = pick(names) if rng.rand() < 0.6 else f"{pick(names)}{pick(['-', '_', ' '])}{pick(['box', 'inner', 'wrap', 'item', 'list', 'block', pick(names)])}"
        return f'{pick(["class", "id", "class"])}="{name}"'

    def state() -> str:
        """Names of wrappers, of which no one tells what a block is."""
        name = lambda: pick(GROUPS[pick(list(GROUPS))].split())
        some = [pick([f"{pick(['has', 'no', 'with'])}-{name()}", f"{name()}-{pick(['open', 'closed', 'fixed', 'area'])}", name(), "single", "home"]) for _ in range(rng.randint(1, 4))]
        return f'class="{" ".join(some)}"'

    def links(mark: str, lo: int = 2, hi: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(0, 3, mark, "")}</a></li>' for k in range(rng.randint(lo, hi))) + "</ul>"

    def junk(group: str, mark: str = "R") -> str:
        tag = {"menu": "nav", "foot": "footer", "head": "header", "side": "aside", "form": "form", "advert": "div", "notice": "div", "comments": "section", "share": "div"}[group]
        bare = group in ("menu", "foot", "head", "side", "form") and rng.rand() < 0.5
        open_ = f"<{tag}>" if bare else f"<{pick([tag, 'div', 'section'])} {named(group)}>"
        body = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randint(5)
            if group == "menu" or kind == 0:
                body.append(links(mark))
            elif group == "head" and kind == 2:
                body.append(f"<h1>{words(0, 6, mark, '')}</h1>")
            elif kind == 1:
                body.append(f"<{(h := pick(['h2', 'h3', 'h4', 'h1' if group == 'head' else 'h3']))}>{words(0, 6, mark, '')}</{h}>")
            elif kind == 2:
                body.append(words(1, 24, mark))
            elif group == "comments" and kind == 3:
                body.append(f'<article class="{pick(["comment", "comment-body", "reply"])}"><p>{words(2, 60, mark)}</p></article>')
            else:
                body.append(f"<p>{words(2, 60 if group in ('comments', 'side', 'notice', 'advert') else 25, mark)}</p>")
        if group == "form":
            body.append(f"<label>{words(0, 3, mark, ':')}</label><input name=q><button>{words(0, 2, mark, '')}</button>")
        if group == "foot":
            body.append(f"<p>&copy; {words(1, 14, mark)}</p>")
        close = open_[1:].split(" ")[0].rstrip(">")
        return f"{open_}{''.join(body)}</{close}>"

    def article(mark: str = "A") -> str:
        title, form = f"<h1>{words(1, 12, mark, '')}</h1>", rng.rand()
        plain = 0.35 <= form < 0.45  # in no element that tells of an article, where a header would be the site's
        body = [f"<header>{title}</header>" if not plain and rng.rand() < 0.25 else title] if rng.rand() < 0.85 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.rand()
            if kind < 0.68:
                body.append(f"<p>{words(0, 90, mark)}</p>" if rng.rand() < 0.8 else f"<p><b>{words(3, 60, mark)}<br>")
            elif kind < 0.76:
                body.append(f"<{(h := pick(['h2', 'h3']))}>{words(0, 8, mark, '')}</{h}>")
            elif kind < 0.82:
                body.append("<ul>" + "".join(f"<li>{words(1, 20, mark)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.86:
                body.append(f"<blockquote>{words(5, 40, mark)}</blockquote>")
            elif kind < 0.89:
                body.append(f"<table><tr><td>{words(0, 4, mark, '')}</td><td>{words(0, 4, mark, '')}</td></tr></table>")
            elif kind < 0.93:
                body.append(words(3, 50, mark))
            else:
                body.append(junk(pick(["advert", "side", "notice", "form", "share"])))
        if rng.rand() < 0.2:
            body.append(junk(pick(["comments", "share", "foot"])))
        inner = "".join(body)
        other = f" {named(pick(list(GROUPS)))}" if rng.rand() < 0.25 else ""  # a name that speaks of something else
        if form < 0.35:
            return f"<article{other}>{inner}</article>"
        if form < 0.42:
            return f"<div>{inner}</div>"
        if form < 0.45:
            return f"<table><tr><td>{inner}</td></tr></table>"
        if form < 0.6:
            return f"<main>{inner}</main>"
        if form < 0.7:
            return f"<main><article {named('main')}>{inner}</article></main>"
        return f"<div {named('main')}>{inner}</div>" if rng.rand() < 0.85 else f"<div{other or ' class=main'}>{inner}</div>"

    def bare(mark: str = "R") -> str:
        """Links and notices of rights without a telling name."""
        some = "".join(f"<td><a href=/{k}>{words(0, 2, mark, '')}</a></td>" for k in range(rng.randint(1, 7)))
        return pick([f"<table><tr>{some}</tr></table>", f"<div>{some.replace('td>', 'span>')}</div>", f"<div>{links(mark)}</div>", f"<p>{pick(['&copy;', 'Copyright', '(c)'])} 2020 {words(0, 6, mark)}</p>"])

    for _ in range(n):
        before = [junk(pick(["menu", "head", "advert", "notice", "menu"])) for _ in range(rng.randint(0, 5))]
        after = [junk(pick(["comments", "side", "foot", "advert", "form", "share", "foot", "notice", "comments"])) for _ in range(rng.randint(0, 6))]
        before += [bare()] if rng.rand() < 0.15 else []
        after += [bare()] if rng.rand() < 0.25 else []
        body = "".join([*before, article(), *after])
        if rng.rand() < 0.25:
            body = f'<div {pick(["class", "id"])}="{pick(["wrapper", "container", "page", "layout", "outer"])}">{body}</div>'
        elif rng.rand() < 0.3:
            body = f"<div {state()}>{body}</div>"
        found = blocks(f"<html><head><title>R</title></head><body{' ' + state() if rng.rand() < 0.4 else ''}>{body}</body></html>")
        if found:
            yield [(b.features, int("A" in b.text)) for b in found]


@dataclass
class Field:
    """Weights of a linear chain over two labels."""

    index: dict[str, int]
    weights: np.ndarray  # feature by label
    moves: np.ndarray  # label by label
    first: np.ndarray

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi; of equal paths the one through `rest`."""
        get, w = self.index.get, self.weights
        e = np.array([w[[i for f in fs if (i := get(f)) is not None]].sum(0) for fs in features])
        m = self.moves.tolist()
        a, b = (self.first + e[0]).tolist()
        back = []
        for x, y in e[1:].tolist():
            from_a, from_b = (a + m[0][0] >= b + m[1][0]), (a + m[0][1] >= b + m[1][1])
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = max(a + m[0][0], b + m[1][0]) + x, max(a + m[0][1], b + m[1][1]) + y
        label = 1 if b > a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


@cache
def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Maximum conditional likelihood by Adam on all pages at once, with an L2 penalty."""
    data = list(training_pages(pages, seed))
    index = {f: i for i, f in enumerate(sorted({f for page in data for fs, _ in page for f in fs}))}
    n, longest, most = len(data), max(map(len, data)), max(len(fs) for page in data for fs, _ in page)
    x = np.full((n, longest, most), len(index))
    y, length = np.zeros((n, longest), int), np.array([len(p) for p in data])
    for p, page in enumerate(data):
        for t, (fs, label) in enumerate(page):
            x[p, t, : len(fs)] = [index[f] for f in fs]
            y[p, t] = label
    real = np.arange(longest)[None] < length[:, None]
    gold, blocks_ = np.eye(2)[y] * real[..., None], real.sum()
    w, m, s = np.zeros((len(index) + 1, 2)), np.zeros((2, 2)), np.zeros(2)
    moment = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, m, s)]
    pair_gold = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for turn in range(1, epochs + 1):
        e = w[x].sum(2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = s + e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + m[None], axis=1) + e[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(m[None] + (e[:, t + 1] + backward[:, t + 1])[:, None], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        at = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        pairs = np.exp(forward[:, :-1, :, None] + m + (e + backward)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        miss = at - gold
        gw = np.zeros_like(w)
        np.add.at(gw, x.ravel(), np.repeat(miss.reshape(-1, 2), most, 0))
        gw[-1] = 0
        for k, (v, g) in enumerate(((w, gw / blocks_ + 1e-4 * w), (m, (pairs.sum((0, 1)) - pair_gold) / blocks_), (s, (at[:, 0] - gold[:, 0]).sum(0) / n))):
            a, b = moment[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= 0.15 * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-8)
    return Field(index, w[:-1], m, s)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return " ".join(b.text for b, label in zip(found, field.decode([b.features for b in found])) if label)


def extract_text(pages: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row (key, url, text, n_chars) for each row of `pages`, from the whole html.

    Null and empty html give an empty text, as does a page without an article; html of any length
    is read whole, in time linear in it, leniently, with unclosed and unknown tags.  Null keys and
    urls stay null; repeated rows are extracted each; empty tables give no rows; other columns,
    whatever their names, are ignored.
    """
    field = field or train()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(h, field) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    out = pages.selectExpr(f"cast({key} as bigint) page_id", f"{url} url", page).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"page_id": key, "url": url})


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op1_page_text": op1_page_text}
