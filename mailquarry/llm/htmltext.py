"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags; inline tags do not cut, and scripts, styles, heads,
templates, embedded objects and form controls have no blocks. Each block has features of its ancestors (tags, and words of
their class, id and role), of its text, and of its neighbours' size and links. The field has two labels, article and other, one weight for each feature and one
for each pair of neighbouring labels; it is trained on labelled pages by maximum likelihood with gradients from
forward-backward sums, and decoded by Viterbi. The labelled pages are made here from a seed: layouts, containers, names,
lengths and words vary, and each block's label is known as it is written.

Blocks labelled article are joined in page order by a newline, with character references decoded and white space turned into
single spaces; a headline inside the article belongs to it. Null or empty html, and pages without text, give the empty text.
Whole pages are read. Tags that are missing, unclosed, self-closed or of unknown names do no harm: an element without blocks
is passed over only up to its own end tag, and where it has none only its tag is; but a script or style without an end, and a
comment, reach to the end of the page. Reading takes time in proportion to the page, whatever its tags, quotes and nesting are
like. Rows are independent: repeated rows give equal rows, an
empty table an empty result, and further columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.common import table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_UNQUOTED = re.compile(r"[^\"'>]*+")
_COMMENT_END = re.compile(r"--!?>")
#: References to characters whose numbers no parser of integers should have to read.
_FAR = re.compile(r"&#0*([0-9]*);?")
#: Elements whose content is not markup, and those whose content is but has no blocks.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style textarea title iframe noscript noembed noframes".split()}
_SKIPPED = frozenset("template svg math select button object canvas audio video".split())
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening the tag ends an open one of these, up to a tag that holds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ENDS_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "legend", "summary"}


class _Tags:
    """Where tags end, each part of a page being read once however its quotes and brackets stand."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        #: Places outside quotes from which no end is found.
        self.endless: set[int] = set()

    def end(self, at: int) -> int:
        """Behind the first > from here that is not in quotes; -1 if there is none, as where a quote stays open."""
        page, passed = self.page, []
        while at not in self.endless and at <= self.last[">"]:
            passed.append(at)
            at = _UNQUOTED.match(page, at).end()
            if at == len(page):
                break
            quote = page[at]
            if quote == ">":
                return at + 1
            if self.last[quote] <= at:
                break
            at = page.index(quote, at + 1) + 1
        self.endless.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(from, to, slash of an end tag, tag, attributes) of the next piece of markup from here; comments, declarations and
        tags whose quotes stay open have no tag."""
        page = self.page
        while (start := page.find("<" if at < self.last[">"] else "<!--", at)) >= 0:
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    return start, page.index(">", start) + 1, "", "", ""
                end = _COMMENT_END.search(page, start + 4)
                return start, end.end() if end else len(page), "", "", ""
            slash = page[start + 1 : start + 2] == "/"
            name = _NAME.match(page, start + 1 + slash)
            end = self.end(name.end()) if name else -1
            if end >= 0:
                return start, end, "/" * slash, name[0].lower(), page[name.end() : end - 1]
            if (name or page[start + 1 : start + 2] in ("!", "?", "/")) and self.last[">"] > start + 1:
                return start, page.index(">", start + 1) + 1, "", "", ""
            at = start + 1
        return None


def tokens(page: str) -> list[tuple[int, int, str, str, str]]:
    """(from, to, slash of an end tag, tag, attributes) of each piece of markup, whole elements without blocks being one piece
    without a tag."""
    out: list[tuple[int, int, str, str, str]] = []
    opened: dict[str, list[int]] = {}
    tags, endless, at = _Tags(page), set(), 0
    while found := tags.next(at):
        start, at, slash, tag, rest = found
        if tag in _RAW and not slash and tag not in endless and not _self_closed(rest):
            end = _RAW[tag].search(page, at, tags.last[">"] + 1)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
                tag = ""
            else:
                endless.add(tag)
        elif tag in _SKIPPED and not _self_closed(rest):
            if not slash:
                opened.setdefault(tag, []).append(len(out))
            elif opened.get(tag):
                first = opened[tag].pop()
                start = out[first][0]
                for held in opened.values():
                    while held and held[-1] >= first:
                        held.pop()
                del out[first:]
                tag = ""
        out.append((start, at, slash, tag, rest))
    return out


def _self_closed(attributes: str) -> bool:
    left = attributes.rstrip()
    return left.endswith("/") and (len(left) == 1 or left[-2] in "\"'" or left[-2].isspace())


def _decoded(text: str) -> str:
    def near(m: re.Match) -> str:
        return f"&#{m[1]};" if 0 < len(m[1]) < 8 else m[0] if not m[1] and len(m[0]) < 99 else "\ufffd"

    return _html.unescape(_FAR.sub(near, text) if "&#" in text else text)


class Path:
    """An element and those around it. `fresh` are the features that none of those has."""

    __slots__ = ("above", "fresh", "score", "tag")

    def __init__(self, above: Path | None, tag: str, fresh: list[str]):
        self.above, self.tag, self.fresh, self.score = above, tag, fresh, None


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self):
        self.paths: list[Path] = [Path(None, "", [])]
        self.places: dict[str, list[int]] = {}
        self.has: set[str] = set()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first(self, tags, after: int) -> int:
        """The outermost of these tags behind a place, 0 if there is none."""
        found = [at[i] for t in tags if (at := self.places.get(t)) and (i := bisect_right(at, after)) < len(at)]
        return min(found, default=0)

    def close(self, place: int) -> None:
        """End this element and those in it."""
        for path in self.paths[place:]:
            self.places[path.tag].pop()
            self.has.difference_update(path.fresh)
        del self.paths[place:]

    def open(self, tag: str, words: set[str]) -> None:
        fresh = [f for f in (f"in {tag}", *(f"named {w}" for w in sorted(words))) if f not in self.has]
        self.has.update(fresh)
        self.places.setdefault(tag, []).append(len(self.paths))
        self.paths.append(Path(self.paths[-1], tag, fresh))


def blocks(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters of it in links) of each leaf block that is not empty. What is in links counts as it is written."""
    out: list[tuple[Path, str, int]] = []
    held = _Open()
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def close() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join(_decoded("".join(parts)).split())
            if text:
                out.append((held.paths[-1], text, min(linked, len(text))))
            parts, linked = [], 0

    for start, end, slash, tag, attributes in tokens(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = end
        if tag == "a":
            in_link = not slash
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        in_link = False
        if slash:
            if place := held.last((tag,)):
                held.close(place)
            continue
        if tag in _ENDS_P and held.paths[-1].tag == "p":
            held.close(len(held.paths) - 1)
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            if place := held.first(ended, held.last(within)):
                held.close(place)
        if tag != "hr":
            held.open(tag, {w.lower() for a in _NAMED.finditer(attributes) for w in _PART.findall(a[2] or a[3] or a[4] or "")} if "=" in attributes else set())
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def path_features(path: Path) -> list[str]:
    out = ["bias", f"tag {path.tag}"]
    while path:
        out += path.fresh
        path = path.above
    return out


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    out = [f"size {min(n.bit_length(), 10)}", f"links {-(-4 * linked // n)}", f"end {text[-1] if text[-1] in '.!?:,' else 'w'}"]
    out.append(f"commas {min(4, text.count(',') * 100 // n)}")
    out.append(f"sentences {min(3, text.count('. ') + text.count('! ') + text.count('? '))}")
    if "©" in text:
        out.append("copyright")
    if sum(map(str.isdigit, text)) * 5 > n:
        out.append("digits")
    return out


def near_features(found: list[tuple[Path, str, int]], i: int) -> list[str]:
    """Size and links of the neighbours, and whether they stand in the same element."""
    out = []
    for side, j in (("before", i - 1), ("after", i + 1)):
        if 0 <= j < len(found):
            path, text, linked = found[j][:3]
            out += [f"{side} size {min(len(text).bit_length(), 10)}", f"{side} links {-(-4 * linked // len(text))}"]
            if path.above is found[i][0].above:
                out.append(f"{side} beside")
        else:
            out.append(f"{side} none")
    return out


def features(found: list[tuple[Path, str, int]], i: int) -> list[str]:
    return path_features(found[i][0]) + text_features(*found[i][1:3]) + near_features(found, i)


class Field:
    """The trained field: a weight for each feature, for the label article against other, and transitions."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start.tolist(), step.tolist()

    def _path(self, path: Path) -> float:
        todo = []
        while path and path.score is None:
            todo.append(path)
            path = path.above
        score = path.score if path else self.weights.get("bias", 0.0)
        for path in reversed(todo):
            score = path.score = score + sum(self.weights.get(f, 0.0) for f in path.fresh)
        return score

    def scores(self, found: list[tuple[Path, str, int]]) -> list[float]:
        """Each block's weight for the label article. A path is scored once, from the one above it."""
        known = self.weights.get
        return [self._path(b[0]) + known(f"tag {b[0].tag}", 0.0) + sum(known(f, 0.0) for f in text_features(*b[1:3]) + near_features(found, i)) for i, b in enumerate(found)]

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi: the most probable labels."""
        if not scores:
            return []
        (oo, oa), (ao, aa) = self.step
        o, a = self.start[0], self.start[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_o, from_a = o + oa >= a + aa, o + oo >= a + ao
            back.append((from_a, from_o))
            o, a = max(o + oo, a + ao), max(o + oa, a + aa) + s
        out = [a > o]
        for to_o, to_a in reversed(back):
            out.append(not (to_a if out[-1] else to_o))
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        keep = self.decode(self.scores(found))
        return "\n".join([text for (_, text, _), k in zip(found, keep) if k])


def train(pages: list[list[tuple[Path, str, int, bool]]], steps: int = 250, ridge: float = 1.0, rate: float = 0.1) -> Field:
    """Maximum likelihood with a Gaussian prior on (blocks with labels) pages, by Adam on exact gradients."""
    index: dict[str, int] = {}
    rows = [[sorted({index.setdefault(f, len(index)) for f in features(page, i)}) for i in range(len(page))] for page in pages]
    longest, count = max(map(len, rows)), len(rows)
    x = np.zeros((count * longest, len(index)), np.float32)
    y, real = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for i, page in enumerate(rows):
        for j, columns in enumerate(page):
            x[i * longest + j, columns] = 1
            y[i, j], real[i, j] = pages[i][j][3], True
    size = len(index)
    theta = np.zeros(size + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, steps + 1):
        w, start, step = theta[:size], theta[size : size + 2], theta[size + 2 :].reshape(2, 2)
        unary = np.zeros((count, longest, 2))
        unary[:, :, 1] = (x @ w.astype(np.float32)).reshape(count, longest)
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = start + unary[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + step, axis=1) + unary[:, t]
            forward[:, t] = np.where(real[:, t, None], moved, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(step + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], moved, 0)
        one = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        grad = np.zeros_like(theta)
        grad[:size] = x.T @ ((y * real) - one[:, :, 1]).reshape(-1).astype(np.float32)
        grad[size : size + 2] = np.eye(2)[y[:, 0]].sum(0) - one[:, 0].sum(0)
        both = real[:, 1:, None, None] * np.exp(forward[:, :-1, :, None] + step + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        grad[size + 2 :] = (seen - both.sum((0, 1))).reshape(-1)
        grad -= ridge * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta = theta + rate * (mean / (1 - 0.9**it)) / (np.sqrt(square / (1 - 0.999**it)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in index.items()}, theta[size : size + 2], theta[size + 2 :].reshape(2, 2))


def labelled_page(rnd: random.Random) -> tuple[str, str]:
    """A made page and its main text."""
    alphabet = rnd.choice(["abcdefghilmnoprstuv", "aeiounrstlmdkgzwü", "aeioucdlmnprstvéè", "аеиостнрвлкмдп"])

    def word() -> str:
        return "".join(rnd.choice(alphabet) for _ in range(rnd.choice([2, 3, 4, 5, 6, 8, 11])))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(a, b)))

    def sentence() -> str:
        s = words(1, 18).capitalize()
        return (s.replace(" ", ", ", 1) if rnd.random() < 0.4 else s) + rnd.choice("....!?")

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rnd.randint(a, b)))

    main: list[str] = []
    shut = rnd.random() < 0.7  # tags that may stay open

    def end(tag: str) -> str:
        return f"</{tag}>" if shut or tag not in ("p", "li") else ""

    def say(tag: str, text: str, keep: bool, extra: str = "", link: bool = False) -> str:
        if keep:
            main.append(text)
        inner = text
        if link:
            inner = f'<a href="/{word()}">{text}</a>'
        elif keep and rnd.random() < 0.25:
            inner = f"<{(t := rnd.choice(['b', 'em', 'span', 'strong']))}>{text}" + (f"</{t}>" if rnd.random() < 0.8 else "")
        elif keep and len(text) > 80 and rnd.random() < 0.2:
            cut_at = text.index(" ", len(text) // 2) if " " in text[len(text) // 2 :] else None
            if cut_at:
                inner = f'{text[:cut_at]}{rnd.choice(["<br>", " <a href=/x>"])}{text[cut_at + 1:]}</a>' if rnd.random() < 0.5 else text[:cut_at] + "<br>" + text[cut_at + 1 :]
        return f"<{tag}{extra}>{inner}{end(tag)}"

    def links(tag: str = "") -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a>{end("li")}' for _ in range(rnd.randint(2, 9)))
        body = f"<ul>{items}</ul>"
        return f"<{tag}>{body}</{tag.split()[0]}>" if tag else body

    def named(names: str, tag: str = "div") -> str:
        k = rnd.choice(names.split())
        return f'{tag} {rnd.choice(["class", "id"])}="{rnd.choice([k, k + " " + word(), "site-" + k, k + "-wrap"])}"'

    def advert() -> str:
        return f'<{named("ad ads advert advertisement sponsored banner promo")}>{prose(1, 2)}</div>'

    def menu() -> str:
        return links(rnd.choice(["nav", named("menu nav navigation navbar breadcrumb toc", "nav"), named("menu nav navigation navbar breadcrumbs topnav")]))

    def notice() -> str:
        return f'<{named("cookie consent notice alert popup modal newsletter subscribe gdpr")}><p>{prose(1, 2)}{end("p")}<button>{words(1, 2)}</button></div>'

    def form() -> str:
        return f'<form{rnd.choice(["", " class=search", " id=login", " class=newsletter"])}><label>{words(1, 4)}</label><input name=q><p>{prose(1, 1)}{end("p")}<button>{word()}</button></form>'

    def aside() -> str:
        tag = rnd.choice(["aside", named("sidebar related widget recommended popular trending share social")])
        body = rnd.choice([links(), f"<h3>{words(1, 3)}</h3>{links()}", f"<p>{prose(1, 2)}{end('p')}", f"<h4>{words(1, 4)}</h4><p>{prose(1, 3)}{end('p')}"])
        return f"<{tag}>{body}</{tag.split()[0]}>"

    def header() -> str:
        body = rnd.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 6)}{end('p')}", f"<div class=logo>{words(1, 2)}</div>"]) + (menu() if rnd.random() < 0.5 else "")
        tag = rnd.choice(["header", named("header masthead topbar")])
        return f"<{tag}>{body}</{tag.split()[0]}>"

    def footer() -> str:
        tag = rnd.choice(["footer", named("footer copyright bottom legal")])
        body = rnd.choice([f"&copy; {word()}.example &middot; {prose(1, 2)}", f"<p>&copy; 20{rnd.randint(10, 30)} {words(1, 4)}{end('p')}{links()}", f"<p>{prose(1, 2)}{end('p')}", words(3, 12)])
        return f"<{tag}>{body}</{tag.split()[0]}>"

    def comments() -> str:
        tag = rnd.choice(["section", "div"])
        each = "".join(rnd.choice([f'<{named("comment reply")}><b>{word()}</b><p>{prose(1, 4)}{end("p")}</div>', f"<li><p>{prose(1, 3)}{end('p')}{end('li')}"]) for _ in range(rnd.randint(1, 6)))
        opened = named("comments comments replies discussion respond", tag) if rnd.random() < 0.6 else f'{tag} {rnd.choice(["id", "class"])}="{word()}_{word()}"'
        return f'<{opened}>{rnd.choice(["", f"<h3>{words(1, 2)}</h3>"])}{each}</{tag}>'

    def article() -> str:
        out = [say(rnd.choice(["h1", "h1", "h2"]), words(2, 12), True)] if rnd.random() < 0.85 else []
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 14])):
            kind = rnd.random()
            if kind < 0.05:
                out.append("<ul>" + "".join(say("li", words(1, 7), True, link=rnd.random() < 0.9) for _ in range(rnd.randint(2, 6))) + "</ul>")
            elif kind < 0.72:
                out.append(say("p", prose(1, 7), True))
            elif kind < 0.78:
                out.append(say(rnd.choice(["h2", "h3"]), words(1, 7), True))
            elif kind < 0.84:
                out.append("<ul>" + "".join(say("li", rnd.choice([prose(1, 1), words(1, 6)]), True) for _ in range(rnd.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                out.append(f'<blockquote>{say("p", prose(1, 3), True)}</blockquote>')
            elif kind < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(say("td", words(1, 3), True) for _ in range(2)) + "</tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
            elif kind < 0.92:
                out.append(f'<figure><img src=x>{say("figcaption", prose(1, 1), True)}</figure>')
            elif kind < 0.94:
                out.append(say("div", prose(1, 4), True))
            else:
                out.append(rnd.choice([advert, aside, form, notice])())
        tag = rnd.choice(["article", "article", "main", named("content post entry article story main text body page", rnd.choice(["div", "section"])), "main><article", "div"])
        names = [t.split()[0] for t in tag.split("><")]
        return f"<{tag}>" + "".join(out) + "".join(f"</{n}>" for n in reversed(names))

    before = "".join(f() for f in rnd.sample([header, menu, advert, notice, form, aside], rnd.randint(0, 4)))
    middle = article()
    after = "".join(f() for f in [*rnd.sample([aside, comments, form, advert, notice, menu], rnd.randint(0, 3)), *([footer] if rnd.random() < 0.85 else [])])
    if rnd.random() < 0.2 and middle.startswith(("<article", "<main")):
        # a name says little where an article stands in it
        wrap = named("comments comment sidebar widget related menu nav header footer banner share ad popup")
        middle = f"<{wrap}>{middle}</div>"
    if rnd.random() < 0.3:
        wrap = named("wrapper container page site layout")
        before, after = f"<{wrap}>{before}", f"{after}</div>"
    head = f"<head><meta charset=utf-8><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{before}<!-- {word()} -->{middle}{after}" + ("</body></html>" if rnd.random() < 0.9 else ""), "\n".join(main)


def labelled_blocks(page: str, main: str) -> list[tuple[Path, str, int, bool]]:
    """The page's blocks with their labels: those of the main text, in order, are article."""
    wanted, out, k = main.split("\n"), [], 0
    for path, text, linked in blocks(page):
        hit = k < len(wanted) and text == wanted[k]
        k += hit
        out.append((path, text, linked, hit))
    if main and k != len(wanted):
        raise ValueError("a block of the main text is not in the page")
    return out


@cache
def trained(n: int = 500, seed: int = 7) -> Field:
    """The field trained on n made pages, once in a process."""
    rnd = random.Random(seed)
    return train([b for b in (labelled_blocks(*labelled_page(rnd)) for _ in range(n)) if b])


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        for batch in batches:
            texts = [held.value.main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
