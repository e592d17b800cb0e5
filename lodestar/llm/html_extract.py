"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks, stretches of text between block-level tags. Each block has features: the tags of its
ancestors, the words in their class, id and role, its own tag, length, links and marks, the same of the blocks beside it, and
what share of the page's text and how many links the containers around it hold. The field's two labels (content or not) have
a weight per feature and one per pair of neighbours; it is trained here by gradient ascent on the likelihood of labelled
pages, which a generator makes from layouts of known content (half of them without telling names), and decoded by Viterbi.

Tags are read as HTML's tokenizer does: an attribute's value is quoted only if a quote follows its equals sign, comments end
at --> or --!>, the text of scripts, styles and the like ends at their own end tag only. Unclosed and stray tags are read as
browsers roughly do; where a browser would lose the rest of a page to a hidden element left open, that ends with the block
around it. Buttons count as text, which looks like links.

Rows: null, empty and text-less pages have an empty text; repeated and null ids keep one row each; other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object select textarea canvas audio video datalist noembed noframes".split())
#: Their text ends at their own end tag, whatever else stands in it.
RAW = frozenset("script style textarea title iframe noscript noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of its group within the nearest list or table.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a head may hold; any other start tag ends it, and so does text.
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes script style template".split())
SCOPE = frozenset("ul ol dl table div article section body main aside nav td".split())
CONTAINER = frozenset("html body div section article main aside nav header footer form td center".split())
#: Comments, declarations and bogus comments, and tags: name, and attributes with their quoted values.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)*)(?:>|\Z)""", re.S)
_HEAD_ENDS = re.compile(r"</head\b|<body\b", re.I)
_ATTR = re.compile(r"""(?<![^\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """A leaf block: its text, features of its ancestors, characters in links, and the two containers around it."""

    text: str
    around: list[str]
    linked: int
    inner: int
    outer: int


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def raw_end(tag: str, page: str, pos: int) -> re.Match | None:
    return _end_of(tag).search(page, pos)


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # tag, features, number of the element
    text: list[str] = []
    hidden: list[str] = []  # the open hidden element, and elements open in it
    linked, links, at, pos, made = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                homes = [n for t, _, n in stack if t in CONTAINER][-2:]
                inner = homes[-1] if homes else 0
                out.append(Block(words, [x for _, xs, _ in stack for x in xs] + ["own:" + (stack[-1][0] if stack else "")], linked, inner, homes[0] if homes else 0))
        text.clear()
        linked = 0

    def in_hidden(tag: str, closing: bool, alone: bool) -> bool:
        """Whether the tag is part of the hidden element; if not, that has ended."""
        nonlocal at, pos
        if hidden[0] == "head" and (tag == "body" or (hidden == ["head"] and not closing and tag not in IN_HEAD)):
            hidden.clear()
        elif closing and tag in hidden:
            del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
        elif closing and tag in BLOCK and any(t == tag for t, *_ in stack):
            hidden.clear()
        elif not closing and not alone and hidden[-1] not in RAW and tag not in VOID:
            end = raw_end(tag, page, pos) if tag in RAW else None
            if end and hidden[0] == "head" and tag not in ("script", "style") and _HEAD_ENDS.search(page, pos, end.start()):
                end = None  # left open: the end tag of another one
            if end:
                at = pos = end.end()
            elif tag == "select" and tag in hidden:
                del hidden[hidden.index(tag) + 1 :]
            elif tag in BLOCK or tag in HIDDEN:
                hidden.append(tag)
        else:
            return True
        return bool(hidden) or (closing and tag in HIDDEN)

    while True:
        m = _TAG.search(page, pos)
        piece = page[at : m.start() if m else len(page)]
        if hidden == ["head"] and piece.strip():
            hidden.clear()
        if piece and not hidden:
            text.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if hidden and in_hidden(tag, closing, m[3].endswith("/")):
            continue
        if tag in HIDDEN:
            if not closing and not (m[3].endswith("/") and tag not in RAW):
                end = raw_end(tag, page, pos) if tag in RAW else None
                if end or tag in ("script", "style"):
                    at = pos = end.end() if end else len(page)
                elif tag not in RAW:
                    hidden.append(tag)
            continue
        if tag == "br":
            text.append(" ")
        if tag in ("a", "button"):
            links = max(0, links - 1) if closing else 1 if tag == "a" else links + 1
        if tag not in BLOCK:
            continue
        flush()
        links = 0
        if closing:
            if any(t == tag for t, *_ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
            names = {"in:" + w for a in _ATTR.findall(m[3]) for x in a for w in _WORD.findall(x.lower())}
            made += 1
            stack.append((tag, ("tag:" + tag, *sorted(names)), made))
    flush()
    return out


def _shape(b: Block) -> list[str]:
    """What a block's text alone tells."""
    n, words = len(b.text), b.text.count(" ") + 1
    marks = ["mark:copyright"] if "©" in b.text else []
    marks += ["mark:bar"] if "|" in b.text or "»" in b.text else []
    return [f"chars:{min(9, n.bit_length())}", f"words:{min(7, words.bit_length())}", f"links:{min(3, int(4 * b.linked / max(1, n)))}", "ends:" + ("stop" if b.text[-1] in ".!?…。\"”»" else "none"), f"commas:{min(3, b.text.count(','))}", *marks]


def _tenth(part: float, whole: float) -> int:
    return min(9, int(10 * part / max(1, whole)))


def features(found: list[Block]) -> list[list[str]]:
    """Features of all blocks of a page."""
    total = sum(len(b.text) for b in found)
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in found:
        for home in {b.inner, b.outer}:
            size[home] = size.get(home, 0) + len(b.text)
            linked[home] = linked.get(home, 0) + b.linked
    shapes = [_shape(b) for b in found]
    out = []
    for k, b in enumerate(found):
        own = ["bias", f"page:{min(5, len(found).bit_length())}", *dict.fromkeys(b.around), *shapes[k]]
        own += [f"inner:{_tenth(size[b.inner], total)}", f"outer:{_tenth(size[b.outer], total)}", f"innerlinks:{_tenth(linked[b.inner], size[b.inner]) // 3}", f"outerlinks:{_tenth(linked[b.outer], size[b.outer]) // 3}"]
        own += [f"before:{x}" for x in (shapes[k - 1][:3] if k else ["none"])]
        own += [f"after:{x}" for x in (shapes[k + 1][:3] if k + 1 < len(found) else ["none"])]
        out.append(own)
    return out


# ---- labelled pages ----

_GOOD = "content article post entry story main body text".split()
_BAD = {
    "nav": "nav menu navbar breadcrumb navigation links",
    "header": "header masthead banner top logo",
    "footer": "footer bottom copyright legal",
    "aside": "sidebar aside widget related recommended popular rail promo",
    "ad": "ad ads advert advertisement sponsored sponsor",
    "notice": "notice cookie cookies consent alert popup newsletter subscribe overlay",
    "form": "form search login signup contact",
    "comments": "comment comments replies discussion responses",
}
_PLAIN = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


def labelled_page(r: random.Random) -> str:
    """A page whose content's words all start with "k" and whose other words do not."""
    told, bare = r.random() < 0.5, r.random() < 0.12  # whether names tell what they hold; whether there is nothing but content
    tiny = r.random() < 0.1  # a line or two of content
    joint = r.choice([" | ", " » ", " ** "]) if r.random() < 0.06 else " "

    def sentence(lead: str, n: int) -> str:
        between = joint if lead == "k" else " "
        return (between.join(lead + "".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 9))) + ("," if r.random() < 0.08 else "") for _ in range(n)) + r.choice([".", ".", ".", "!", "?", ""])).strip()

    def prose(lead: str, most: int) -> str:
        return " ".join(sentence(lead, r.randint(1, 24)) for _ in range(r.randint(1, most)))

    def named(tag: str, names: list[str], inner: str, always: bool = False) -> str:
        word = r.choice(names) if (told and r.random() < 0.8) or always else "q" + "".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 7)))
        word = r.choice([word, word, f"{word}-{r.choice('abcwxyz')}{r.randint(1, 9)}", f"{r.choice(['page', 'site', 'the', 'col'])}-{word}"])
        return f"<{tag}>{inner}</{tag}>" if r.random() < 0.2 and not always else f'<{tag} {r.choice(["class", "class", "id"])}="{word}">{inner}</{tag}>'

    def chrome(kind: str) -> str:
        item = lambda: f'<a href="/{r.randint(1, 99)}">{sentence("x", r.randint(1, 5))}</a>'
        count = r.randint(2, 9)
        links = r.choice(["<ul>" + "".join(f"<li>{item()}</li>" for _ in range(count)) + "</ul>", " | ".join(item() for _ in range(count)), "".join(f"<div>{item()}</div>" for _ in range(count))])
        short, long = sentence("x", r.randint(1, 14)), f"<p>{prose('x', 3)}</p>"
        said = "".join(f'<div class="{r.choice(["comment", "reply", "item"])}"><p>{prose("x", 3)}</p></div>' for _ in range(r.randint(1, 4)))
        inner = {"nav": links, "header": r.choice([f"<h1>{short}</h1>", short, links, f"<div>{short}</div>{links}"]), "footer": r.choice(["&copy; " + short, f"<p>{short}</p>", links, "&copy; " + short + " " + links, short]), "aside": r.choice([f"<h3>{short}</h3>" + links, f"<h3>{short}</h3>" + links, long]), "ad": r.choice([short, long, f"<button>{sentence('x', 2)}</button>"]), "notice": r.choice([f"<p>{short}</p>", short, f"{short} <button>{sentence('x', 1)}</button>"]), "form": f'<label>{short}</label><input name="q"><button>{sentence("x", 1)}</button>', "comments": r.choice([f"<h3>{sentence('x', 2)}</h3>", ""]) + said}[kind]
        plain = _PLAIN.get(kind)
        if kind in ("nav", "aside", "footer") and r.random() < 0.15:
            return inner
        if plain and r.random() < 0.4:
            return f"<{plain}>{inner}</{plain}>"
        return named(r.choice(["div", "div", "section", plain or "div"]), _BAD[kind].split(), inner, always=kind in ("comments", "ad", "notice") and r.random() < 0.9)

    para = r.choice(["p", "p", "p", "div", "br"])

    def content(inner: str) -> str:
        return f"<{para}>{inner}</{para}>" if para != "br" else f"{inner}<br><br>"

    body = f"<h1>{sentence('k', r.randint(1, 14))}</h1>" if r.random() < (0.4 if bare else 0.85) else ""
    body += named("div", ["meta", "byline", "date"], sentence("k", r.randint(2, 5))) if r.random() < 0.15 else ""
    for _ in range(r.choice([1, 1, 1, 2, 3] if bare or tiny else [1, 1, 2, 2, 3, 4, 6, 9, 12])):
        x = r.random()
        inner = sentence("k", r.randint(1, 4)) if tiny else prose("k", 5)
        if x < 0.15 and not tiny:
            inner = f'{inner} <a href="/y">{sentence("k", 3)}</a> {sentence("k", 5)}'
        body += f"<h2>{sentence('k', r.randint(1, 6))}</h2>{content(inner)}" if x > 0.9 else "<ul>" + "".join(f"<li>{sentence('k', r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>" if x > 0.84 else f"<blockquote>{inner}</blockquote>" if x > 0.8 else f"<table><tr><td>{inner}</td><td>{sentence('k', 2)}</td></tr></table>" if x > 0.77 else f"<pre>{inner}</pre>" if x > 0.75 else content(inner)
        if r.random() < 0.1 and not bare:
            body += chrome(r.choice(["ad", "aside", "notice", "form"]))
    if r.random() < 0.15 and not bare:
        body += named("section", _BAD["comments"].split(), f"<p>{prose('x', 3)}</p>", always=True)
    layout = r.random()
    main = f"<article>{body}</article>" if layout < 0.3 else f"<main>{body}</main>" if layout < 0.4 else f"<main><article>{body}</article></main>" if layout < 0.5 else named("div", _GOOD, body) if layout < 0.8 else body if layout < 0.94 else f"<td>{body}</td>"
    before = [chrome(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.45]
    after = [chrome(k) for k in ("comments", "aside", "ad", "form", "nav", "notice") if r.random() < 0.35] + [chrome("footer")] * (r.random() < 0.85)
    r.shuffle(before)
    if bare:
        before = after = []
    if main.startswith("<td"):
        main = f"<table><tr><td>{''.join(before)}</td>{main}</tr></table>"
        before = []
    page = f"{''.join(before)}{main}{''.join(after)}"
    page = named("div", ["page", "wrapper", "container", "site"], page) if r.random() < 0.4 else page
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{page}</body></html>"


def is_content(block: Block) -> bool:
    """Label of a block of a labelled page."""
    return block.text.lstrip("& |")[:1] == "k"


class Field:
    """Weights of the field: feature -> score of content against the rest, and a 2 x 2 table of neighbours."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, np.asarray(pairs).tolist()

    def scores(self, found: list[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in own) for own in features(found)]

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks."""
        return self.viterbi(self.scores(found))

    def viterbi(self, scores: list[float]) -> list[bool]:
        """The chain of labels of most weight: a content label's score, and that of each pair of neighbours."""
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pairs
        back, a, b = [], 0.0, scores[0]
        for s in scores[1:]:
            from_a, from_b = a + p01 >= b + p11, a + p00 >= b + p10
            back.append((not from_b, not from_a))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + s
        out = [b > a]
        for x, y in reversed(back):
            out.append(y if out[-1] else x)
        return out[::-1]


def forward_backward(s: np.ndarray, real: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over all labellings, P(content) of each block, joint P of each pair of neighbours) of chains of block
    scores s, padded where not real."""
    node = np.where(real[..., None], np.stack([np.zeros_like(s), s], -1), 0.0)
    alpha, beta = np.zeros_like(node), np.zeros_like(node)
    alpha[:, 0] = node[:, 0]
    for j in range(1, s.shape[1]):
        step = np.logaddexp(alpha[:, j - 1, 0, None] + pairs[0], alpha[:, j - 1, 1, None] + pairs[1]) + node[:, j]
        alpha[:, j] = np.where(real[:, j, None], step, alpha[:, j - 1])
    for j in range(s.shape[1] - 2, -1, -1):
        after = beta[:, j + 1] + node[:, j + 1]
        step = np.logaddexp(pairs[:, 0] + after[:, 0, None], pairs[:, 1] + after[:, 1, None])
        beta[:, j] = np.where(real[:, j + 1, None], step, beta[:, j + 1])
    whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - whole[:, None, None])[..., 1]
    joint = np.exp(alpha[:, :-1, :, None] + pairs + (node + beta)[:, 1:, None, :] - whole[:, None, None, None])
    return whole, p, joint * real[:, 1:, None, None]


@lru_cache(maxsize=2)
def trained(pages: int = 1500, rounds: int = 250, rate: float = 1.0, decay: float = 3e-4, seed: int = 3) -> Field:
    """Maximum likelihood on generated pages, all pages' chains side by side (forward-backward, Adagrad)."""
    r = random.Random(seed)
    made = [blocks(labelled_page(r)) for _ in range(pages)]
    made = [m for m in made if m]
    names: dict[str, int] = {}
    longest = max(map(len, made))
    idx, row = [], []
    gold, real = np.zeros((len(made), longest), np.int64), np.zeros((len(made), longest), bool)
    for i, m in enumerate(made):
        for j, (block, own) in enumerate(zip(m, features(m), strict=True)):
            for f in own:
                idx.append(names.setdefault(f, len(names)))
                row.append(i * longest + j)
            gold[i, j], real[i, j] = is_content(block), True
    idx, row = np.array(idx), np.array(row)
    told = np.array([not n.startswith("in:") for n in names])
    often = told | (np.bincount(idx, minlength=len(names)) >= 60)  # names that only the generator's chance made tell nothing
    keep = often[idx]
    idx, row = idx[keep], row[keep]
    w, pairs, gw, gp = np.zeros(len(names)), np.zeros((2, 2)), np.full(len(names), 1e-3), np.full((2, 2), 1e-3)
    both = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for _ in range(rounds):
        s = np.bincount(row, w[idx], gold.size).reshape(gold.shape)
        _, p, joint = forward_backward(s, real, pairs)
        grad = np.bincount(idx, ((gold - p) * real).reshape(-1)[row], len(w)) / len(made) - decay * w
        grad_p = (seen - joint.sum((0, 1))) / len(made) - decay * pairs
        gw, gp = gw + grad**2, gp + grad_p**2
        w, pairs = w + rate * grad / np.sqrt(gw), pairs + rate * grad_p / np.sqrt(gp)
    return Field({n: float(w[k]) for n, k in names.items() if often[k]}, pairs)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, field.decode(found), strict=True) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = df.sparkSession.sparkContext.broadcast(field or trained())  # a few hundred weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(p, shared.value) for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op4_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
