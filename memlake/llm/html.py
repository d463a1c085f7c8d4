"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of tags and words. Words score positive and tags negative; how much, and which elements are boilerplate, is learned as log ratios of words in kept and
in dropped parts, by tag, role and token of a class or id, from labelled pages of two kinds: a few composed by rule from names that authors give to parts of pages, and
all pages of the table itself that say by an article or main element which part is the text (learn()). An element's weight is a sum: of its tag's, its
role's and its names', and of what it holds, as lists of links score down. So an unknown name costs nothing, one of several names decides little, and a name
that a further word changes (ad-free, share-price-table) counts for less. An element under BOILERPLATE is dropped, unless nearly all prose of the page is in it.

Words inside a dropped element score nothing, its opening tag scores its weight once, ISLAND at worst; short fragments that are no headings or paragraphs score
slightly down. One linear scan finds the contiguous region with the
largest sum; it is widened to whole blocks, and to the smallest element learned as a content container that holds it. The text is that of
the region's blocks outside dropped elements.

Defined cases: null and empty html give an empty text, as do pages of boilerplate alone; of equal sums the first region counts;
unclosed elements end with their parent or the page; a page where an article, main or content container starts inside boilerplate elements
that are never closed is read again with those ended where it starts, and the reading whose region scores higher counts; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_of

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*(?:>|\Z)|<(?=[a-zA-Z/])[^<>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: Elements whose content is no markup, or nothing that is read.
RAW = {x: re.compile(rf"</{x}\s*[^>]*>", re.I) for x in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "select", "noembed", "noframes", "xmp", "canvas", "audio", "video")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("table td th ul ol dl div article section main aside nav header footer form body html blockquote".split())
KEPT_TAGS = frozenset("html body article main".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd td article main section body html".split())
#: Words that name the shape of a part rather than what it holds: they don't change the word before them.
SHAPES = frozenset("area articles bar block body box button buttons col column container content entries entry feed form group holder inner item items left link links list main outer panel posts region right row section slot stories strip thread top unit wrap wrapper zone".split())
#: Elements that hold no text of an article, however much they hold.
NEVER = frozenset("nav footer aside dialog menu search button label".split())
#: An element under BOILERPLATE is dropped, one over CONTENT is a container; a dropped element inside the text costs ISLAND words at most.
BOILERPLATE, CONTENT, ISLAND = -1.0, 0.5, -2.0
#: Bounds of what one name says, the share left of it where a further word changes it, and what a list of links costs.
LOWEST, HIGHEST, CHANGED, LINKS = -2.5, 1.5, 0.4, -2.0
#: Words of fragments score FRAGMENT; an element with so much (MOST) of a page's prose is no boilerplate.
FRAGMENT, MOST = -0.2, 0.6
#: A feature is learned from the table if it stands on so many of its pages, and on one in 1000.
MIN_PAGES = 20


def labelled_pages() -> list[str]:
    """Pages whose data-keep says what belongs to the main text, composed by rule from names that page authors give to parts of pages."""
    dropped_tags = "nav header footer aside form dialog menu search button label fieldset address".split()
    dropped_names = """ad ads adv advert adverts advertisement adsense sponsor sponsored promo promoted promotion banner sidebar rail menu navbar nav navigation topnav breadcrumb breadcrumbs
        footer foot header masthead topbar cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login share sharing social
        related recommended recommendations trending comment comments commentlist respond reply replies disqus discussion responses feedback widget widgets toolbar pagination pager skip hidden copyright legal paywall
        kommentar kommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicite publicidad menue navigazione seitenleiste fusszeile kopfzeile""".split()
    roles = "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
    kept = [("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "entry"), ("section", "story"), ("div", "text"), ("div", "inhalt"), ("div", "contenu contenido"), ("section", ""), ("div", "")]
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text, links = " ".join(words), "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words[:6])
    pages = []
    drops = [(t, "") for t in dropped_tags] + [("div", f'class="{n}"') for n in dropped_names] + [("section", f'id="{n}"') for n in dropped_names] + [("div", f'role="{r}"') for r in roles]
    for i, (tag, attribute) in enumerate(drops):
        outer, name = kept[i % len(kept)]
        body = f"<ul>{links}</ul>" if i % 2 else f"<p>{text} {text}</p>"
        rows = f"<h1>{text}</h1>" + f"<p>{text} <b>{words[0]}</b> {text} <i>{words[1]}</i></p><ul><li>{text} {text}</li></ul><table><tr><td>{text}</td></tr></table><blockquote>{text} {text}</blockquote>" * 3
        part = f'<{tag} {attribute} data-keep="0">{body}</{tag}>'
        pages.append(f'<html><body data-keep="0">{part}<{outer} class="{name}" data-keep="1">{rows}{part}</{outer}>{part}</body></html>')
    return pages


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def _names(value: str) -> list[list[str]]:
    """The words of each class or id. Names that say what there is none of (no-sidebar, ad-free), or what lies inside (has-sidebar), say nothing of the element."""
    names = [re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower()) for n in value.split()]
    return [n for n in names if n and not {"has", "with", "no", "without", "is", "free", "off"} & set(n)]


@functools.lru_cache(maxsize=65536)
def described(tag: str, rest: str) -> tuple[str, str, tuple[tuple[str, ...], ...], bool]:
    """(tag, role, words of each name, hidden)."""
    if not rest.strip(" /"):
        return tag, "", (), False
    a = _attributes(rest)
    hidden = "hidden" in a or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I)) or a.get("aria-hidden", "").lower() == "true"
    return tag, a.get("role", "").strip().lower(), tuple(map(tuple, _names(a.get("class", "")) + _names(a.get("id", "")))), hidden


def features(tag: str, rest: str) -> list[str]:
    tag, role, names, _ = described(tag, rest)
    return [f"tag {tag}", *([f"role {role}"] if role else []), *(f"name {w}" for w in dict.fromkeys(w for n in names for w in n))]


class Element:
    """An element with sums over all that it holds."""

    __slots__ = ("closed", "features", "in_text", "link_words", "links", "marks", "name", "parent", "prose", "rest", "start", "words")

    def __init__(self, name: str, rest: str, parent: int, start: int):
        self.name, self.rest, self.parent, self.start = name, rest, parent, start
        self.words = self.link_words = self.links = self.prose = self.marks = 0
        self.closed = self.in_text = False


def parsed(page: str) -> tuple[list[tuple], list[Element]]:
    """Events ("open", element), ("pop", element), ("end", name), ("void", name), ("text", text) in page order, and the elements with their sums. Open elements are kept
    by name, so a tag that closes nothing costs nothing."""
    events: list[tuple] = []
    elements: list[Element] = []
    stack: list[int] = []
    places: dict[str, list[int]] = {}  # of open elements, by name
    at = 0

    def text(chunk: str) -> None:
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            events.append(("text", chunk))
            if stack:
                own, n = elements[stack[-1]], len(chunk.split())
                own.words += n
                if places.get("a"):
                    own.link_words += n
                elif n >= 4:
                    own.prose += n

    def pop(closed: bool = False) -> None:
        own = elements[stack.pop()]
        places[own.name].pop()
        own.closed = closed or own.name in CLOSES or own.name == "p"
        events.append(("pop", own))

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    while True:
        m = TAG.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at, name = m.end(), m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            events.append(("end", name))
            if places.get(name):
                while len(stack) - 1 > places[name][-1]:
                    pop()
                pop(True)
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK and places.get("p") and last(SCOPE) < places["p"][-1]:
            while places.get("p") and len(stack) > places["p"][-1] + 1:
                pop()
            pop()
        for other in CLOSES.get(name, ()):
            if places.get(other) and last(SCOPE.difference(CLOSES[name])) < places[other][-1]:
                depth = places[other][-1]
                while len(stack) > depth:
                    pop()
        if name in VOID:
            events.append(("void", name))
            continue
        own = Element(name, m["rest"], stack[-1] if stack else -1, len(elements))
        elements.append(own)
        places.setdefault(name, []).append(len(stack))
        stack.append(own.start)
        events.append(("open", own))
    while stack:
        pop()
    for own in elements:  # parents come before what they hold
        above = elements[own.parent] if own.parent >= 0 else None
        own.features = described(own.name, own.rest)
        own.links += own.name == "a"
        own.in_text = above is not None and (above.in_text or above.name in ("article", "main"))
        own.marks += own.name in ("article", "main", "h1")
    for own in reversed(elements):
        if own.parent >= 0:
            above = elements[own.parent]
            above.words, above.link_words, above.links = above.words + own.words, above.link_words + own.link_words, above.links + own.links
            above.prose, above.marks = above.prose + own.prose, above.marks + own.marks
    return events, elements


def page_counts(page: str, weights: Weights) -> Counter:
    """Words by (feature, kept) of a page that says by an article or main element which part is its text; nothing of other pages. A word speaks for the nearest element that
    has a name, a role or a meaning of its own."""
    events, elements = parsed(page)
    counts: Counter = Counter()
    _, dropped = weights.judged(elements)
    tops = [e for e in elements if e.name in ("article", "main") and not e.in_text and not dropped[e.start]]
    if len(tops) != 1:
        return counts
    known: dict[int, tuple[list[str], int]] = {}
    for own in elements:
        above = known.get(own.parent, ([], 0))
        tag, role, names, _ = own.features
        kept = 1 if own is tops[0] else 0 if dropped[own.start] else above[1]
        known[own.start] = (features(own.name, own.rest) if names or role or f"tag {tag}" in weights.element else above[0], kept)
    inside: list[int] = []
    for event, own in events:
        if event == "open":
            inside.append(own.start)
        elif event == "pop":
            inside.pop()
        elif event == "text" and inside:
            found, kept = known[inside[-1]]
            n = len(own.split())
            for feature in found:
                counts[feature, kept] += n
    return counts


class Weights:
    """What labelled pages say: `element` by feature, above 0 for content; `cost` of a tag, by name; `taught` are the features known from the table alone."""

    def __init__(self, pages: list[str]):
        self.words: tuple[Counter, Counter] = (Counter(), Counter())
        tags: tuple[Counter, Counter] = (Counter(), Counter())
        self.total = [1, 1]
        for page in pages:
            stack, at = [("", [], 0)], 0
            for m in [*TAG.finditer(page), None]:
                n = len(page[at : m.start() if m else None].split())
                keep = stack[-1][2]
                self.total[keep] += n
                for feature in next((fs for _, fs, own in reversed(stack) if fs), ()):
                    self.words[keep][feature] += n
                if m is None or not m["name"]:
                    continue
                at, name = m.end(), m["name"].lower()
                if m["end"]:
                    tags[keep][name] += 1
                    stack.pop()
                else:
                    said = _attributes(m["rest"]).get("data-keep")
                    own = keep if said is None else int(said)
                    tags[own][name] += 1
                    stack.append((name, [] if said is None else features(name, re.sub(r"data-keep=\S*", "", m["rest"])), own))  # a label speaks for its element, not for what lies inside
        self.element = self._ratios(*self.words, *self.total)
        self.taught: frozenset[str] = frozenset()
        self.cost = {t: min(3.0, max(0.05, 0.05 + 0.2 * math.log((tags[0][t] + 1) / self.total[0] * self.total[1] / (tags[1][t] + 1)))) for t in tags[0] | tags[1]}

    @staticmethod
    def _ratios(dropped: Counter, kept: Counter, all_dropped: int, all_kept: int) -> dict[str, float]:
        return {f: math.log((kept[f] + 1) / all_kept * all_dropped / (dropped[f] + 1)) for f in dropped | kept}

    def with_counts(self, counts: dict[str, tuple[int, int]]) -> Weights:
        """These weights and those of further features, from (words dropped, words kept) by feature. What is known already stays."""
        out = Weights([])
        out.words, out.total, out.cost = self.words, self.total, self.cost
        fresh = {f: n for f, n in counts.items() if f not in self.element and f.startswith(("name ", "role "))}
        total = [max(1, sum(n[k] for n in counts.values())) for k in (0, 1)]
        ratios = self._ratios(Counter({f: n[0] for f, n in fresh.items()}), Counter({f: n[1] for f, n in fresh.items()}), *total)
        out.element, out.taught = ratios | self.element, frozenset(ratios)
        return out

    def _name(self, words: tuple[str, ...], taught: bool) -> float:
        """What one name says: its lowest word, or its highest if none is low. A low word that an unknown one follows is changed by it."""
        value = [self.element.get(f"name {w}") if taught or f"name {w}" not in self.taught else None for w in words]
        known = [(v, i) for i, v in enumerate(value) if v is not None]
        if not known:
            return 0.0
        low, at = min(known)
        if low >= BOILERPLATE:
            return min(HIGHEST, max(0.0, max(known)[0]))
        return max(LOWEST, low) * (CHANGED if any(v is None and w not in SHAPES for v, w in zip(value[at + 1 :], words[at + 1 :], strict=True)) else 1)

    def of(self, own: Element) -> float:
        """An element's weight. Under BOILERPLATE: what it holds is no main text. Over CONTENT: it is a container of main text."""
        tag, role, names, hidden = own.features
        if hidden or tag == "head":
            return -9.0
        if tag in ("html", "body"):
            return 0.0
        base = 1.0 if tag in KEPT_TAGS else max(-4.0, min(0.0, self.element.get(f"tag {tag}", 0.0)))
        holds_text = own.marks > (tag in ("article", "main", "h1"))
        said = [self._name(n, not holds_text) for n in names]
        low = min(said, default=0.0)
        total = base + (low + 0.5 * max(0.0, max(said)) if low < BOILERPLATE else max(0.0, max(said, default=0.0)) + min(0.0, low)) + max(-4.0, min(0.0, self.element.get(f"role {role}", 0.0)))
        listed = own.links >= 3 and own.link_words >= 0.6 * own.words and own.prose <= 0.2 * own.words
        if listed and tag in BLOCK and tag not in KEPT_TAGS and (not own.in_text or own.links >= 5 and names):
            total += LINKS
        return total

    def judged(self, elements: list[Element]) -> tuple[list[float], list[bool]]:
        """The weights of all elements of a page, and which are dropped: those under BOILERPLATE, but for one that holds nearly all prose and every article, main and h1."""
        roots = [e for e in elements if e.parent < 0]
        prose, marks = sum(e.prose for e in roots), sum(e.marks for e in roots)
        weight = [self.of(e) for e in elements]
        whole = lambda e: e.prose and e.marks == marks and e.prose >= MOST * prose and not e.features[3] and e.name not in NEVER and e.name != "head"
        return weight, [w < BOILERPLATE and not whole(e) for w, e in zip(weight, elements, strict=True)]


@functools.cache
def learned() -> Weights:
    return Weights(labelled_pages())


def learn(pages: DataFrame) -> Weights:
    """Weights learned from all pages (page_id, url, html) of a table as well: grouped counts of words by feature. The features that come back stand on one page
    in 1000 at least, so their number is bounded by that of the features of 1000 pages."""
    prior = learned()

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: dict[str, list[int]] = {}
            for page in frame["html"]:
                found = page_counts(page, prior)
                for (feature, kept), n in found.items():
                    held.setdefault(feature, [0, 0, 0])[kept] += n
                for feature in {f for f, _ in found}:
                    held[feature][2] += 1
            if held:
                yield pd.DataFrame([(f, *n) for f, n in held.items()], columns=["feature", "dropped", "kept", "pages"])

    small_batches(pages.sparkSession)
    sums = pages.select(text_of("html").alias("html")).mapInPandas(counted, "feature string, dropped long, kept long, pages long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("dropped", "kept", "pages")))
    least = max(MIN_PAGES, pages.count() // 1000)
    return prior.with_counts({r.feature: (r.dropped, r.kept) for r in sums.where(F.col("pages") >= least).collect()})


def _read(events: list[tuple], weight: list[float], dropped: list[bool], costs: dict[str, float], reopened: frozenset[int] | None = frozenset(), fragment: float = FRAGMENT):
    """(blocks, scores, containers, lost): a block is (text, kept, first token, last token); a container (first token, last token); scores are by token.

    lost: the dropped elements that are never closed and alone keep a content element from being read. Those in `reopened` (None: all, for
    article and main) end where such an element starts."""
    blocks: list[tuple[str, bool, int, int]] = []
    scores: list[float] = []
    containers: list[tuple[int, int]] = []
    stack: list[tuple[Element, int | None]] = []  # and where a container began
    bad: list[int] = []  # dropped elements around
    over: set[int] = set()  # dropped elements that were ended before they closed
    around: set[frozenset[int]] = set()
    unclosed: set[int] = set()
    parts: list[str] = []

    def ended() -> None:
        if parts:
            words = "".join(parts).split()
            parts.clear()
            if words:
                tag = next((e.name for e, _ in reversed(stack) if e.name in BLOCK), "body")
                short = len(words) < 6 and tag not in PROSE_TAGS and words[-1][-1] not in ".!?…。！？"
                blocks.append((" ".join(words), not bad, len(scores), len(scores)))
                scores.append(0.0 if bad else len(words) * (fragment if short else 1.0))

    for event, own in events:
        if event == "text":
            parts.append(own)
        elif event == "open":
            if own.name in BLOCK:
                ended()
            if bad and weight[own.start] > CONTENT and not dropped[own.start]:
                around.add(frozenset(bad))
                if reopened is None and own.name in ("article", "main") or reopened and reopened.issuperset(bad):
                    over.update(bad)
                    bad.clear()
            if not bad:
                scores.append(max(min(weight[own.start], 0.0), ISLAND) - costs.get(own.name, 0.05))
            stack.append((own, len(scores) if weight[own.start] > CONTENT and not bad and not dropped[own.start] else None))
            if dropped[own.start]:
                bad.append(own.start)
        elif event == "pop":
            if own.name in BLOCK:
                ended()
            _, began = stack.pop()
            if began is not None:
                containers.append((began, len(scores) - 1))
            if dropped[own.start]:
                if not own.closed:
                    unclosed.add(own.start)
                if own.start not in over:
                    bad.pop()
        elif event == "end":
            if own in BLOCK:
                ended()
            elif own == "br":
                parts.append(" ")
            if not bad:
                scores.append(-costs.get(own, 0.05))
        else:
            if own in BLOCK:
                ended()
            elif own == "br":
                parts.append(" ")
            if not bad:
                scores.append(-costs.get(own, 0.05))
    ended()
    return blocks, scores, containers, frozenset().union(*(x for x in around if x <= unclosed))


def _best(scores: list[float]) -> tuple[float, tuple[int, int] | None]:
    """The largest sum of a contiguous region, and the first region that has it."""
    best = total = 0.0
    region, start = None, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i)
    return best, region


def main_text(page: str | None, weights: Weights | None = None) -> str:
    page, weights = page or "", weights or learned()
    events, elements = parsed(page)
    weight, dropped = weights.judged(elements)
    read = functools.partial(_read, events, weight, dropped, weights.cost)
    blocks, scores, containers, lost = read()
    best, region = _best(scores)
    again = [lost] if lost else []
    if not any(kept for _, kept, _, _ in blocks) and any(e.name in ("article", "main") for e in elements):
        again.append(None)
    for reopened in again:
        other = read(reopened)
        score, found = _best(other[1])
        if score > best:
            best, region, (blocks, scores, containers, _) = score, found, other
    if region is None and any(kept for _, kept, _, _ in blocks):  # a page of fragments alone
        blocks, scores, containers, _ = read(fragment=1.0)
        best, region = _best(scores)
    if region is None:
        return ""
    low, high = region
    around = [c for c in containers if c[0] <= low and high <= c[1]]
    if around:
        low, high = min(around, key=lambda c: c[1] - c[0])
    return "\n".join(t for t, kept, a, b in blocks if kept and b >= low and a <= high)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""
    weights = weights or learn(pages)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: main_text(p, weights))

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", text(text_of("html")).alias("text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
