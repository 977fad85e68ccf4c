"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each under its root-to-leaf path of block elements. Per path the mean text length and the
mean number of punctuation marks of its blocks are taken, smoothed with the paths beside it (same parent), fused into one
product, and paths above a share of the best are selected. The content is what lies under the smallest elements that
together hold all selected text: the descent ends at an article or main, and where text lies directly in an element; where
it forks, every branch with selected text is followed. Headings directly in an element on the way are kept, as is all of
the element around the content (below body) if nothing in it is apart. Paths through elements that are no article by name
(navigation, forms, footers, adverts, comments ...) have the ratio zero. A name counts for nothing if its element holds
main. Names of comments, related articles and adverts count whatever the size; those of frames unless they hold the only
articles; others unless they hold more text than the articles outside such elements and with it an article or ``MOST`` of
the page's text; and no name counts if no text were left. Where an article has ``ANCHOR`` characters, text outside it,
outside main, and outside articles beside it has the ratio zero too.

Nulls and empty pages give an empty text and 0 characters. Character references are decoded, white space within a
block becomes one space, blocks are joined by a line feed. Nothing is cut. Pages are handled one by one in tasks;
there is no shuffle. Repeated rows are handled each for itself.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import in_arrow, slices

# Names of HTML elements, and words in class, id and role that mark what is no article.
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("head nav footer aside form button dialog menu fieldset label legend".split())
TALK = r"comment(?!ar|at)\w*|disqus|replies|reply|respond|related|recommend\w*|sponsor\w*|ads?(?:by\w+|box|slot|unit|wrap\w*|container|block|sense|banner)?|advert\w*|promo\w*"
FRAME = r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|cookies?|consent|newsletter|subscribe|popup|modal|overlay|notices?|skip|search"
OTHER = r"banner|footer|header|masthead|share|sharing|social|tags|toolbar|widget|complementary|contentinfo|alert"
MARKED = re.compile(rf"(?:^|[\s_-])(?:({TALK})|({FRAME})|({OTHER}))(?=$|[\s_-])", re.I)
SPOKEN = re.compile(r"(?:^|[\s_-])(?:comment(?!ar|at)\w*|reply)(?:$|[\s_-])", re.I)
# Names that say what a wrapper has or lacks; and what may stand beside a marked word in the id of an article's part.
WRAPS = re.compile(r"(?<!\S)(?:side-by-side|(?:has|no|with|without)[_-]\S+)", re.I)
GENERIC = re.compile(r"(?:\d+|s|list|section|area|box|posts?|articles?|links?|content|container|wrapper|wrap|widget|block|inner|form|items?|stories|news|top|bottom|left|right|bar|buttons?)$", re.I)
PUNCTUATION = re.compile(r"[^\w\s]")
PARTS = frozenset("tr tbody thead tfoot li".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
THRESHOLD, MOST, ANCHOR = 0.1, 0.8, 200

# A section or quote that nothing closes takes the rest of the page: no later search can then run over it again.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_CLOSES = {k: frozenset(v.split()) for k, v in _CLOSES.items()}


def _marked(name: str, value: str, inside: bool) -> int:
    """How strongly a class, id or role marks its element: 3 talk and adverts, 2 frames of the page, 1 other, 0 not.

    In an article an id must say nothing else (related-posts, not related-work).
    """
    value = WRAPS.sub(" ", value)
    tier = max((3 if m[1] else 2 if m[2] else 1 for m in MARKED.finditer(value)), default=0)
    if tier and inside and name == "id" and not all(MARKED.match(w) or GENERIC.match(w) for w in re.split(r"[\s_-]+", value) if w):
        return 0
    return tier


class Paths:
    """Root-to-leaf paths as numbers: each has a parent with a smaller number, and the name of its last element; 0 is the page."""

    def __init__(self):
        self.parent, self.name, self._known = [0], [""], {}

    def below(self, path: int, name: str) -> int:
        key = (path, name)
        if key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(path)
            self.name.append(name)
        return self._known[key]

    def tag(self, path: int) -> str:
        return self.name[path].split(".")[0]


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, bool]]]:
    """(path, text, apart) of every block with text, in page order."""
    paths = Paths()
    # element, its path, whether it or one above is apart by tag, the innermost element marked by name, whether in an article or main, the outermost article
    stack: list[tuple[str, int, bool, int, bool, int]] = []
    out: list[tuple[int, str, bool, int, bool, int]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    above, tiers, articles, mains = [0], [0], set(), set()  # marked elements are numbered from 1: the marked one above each, how strongly, and what they hold
    beside = [0]  # of each outermost article, numbered from 1, the element that it lies in

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1] if stack else 0, text, *(stack[-1][2:] if stack else (False, 0, False, 0))))

    def close(at: int) -> None:
        if any(x[0] in BLOCK or x[0] == "ins" and tiers[x[3]] == 3 for x in stack[at:]):
            flush()
        opened.subtract(x[0] for x in stack[at:])
        del stack[at:]

    def closing(tag: str, at: int) -> int:
        """Where a raw element ends. Without an end tag scripts and styles take the rest of the page, others only their tag."""
        if tag not in unclosed:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                return end.end()
            unclosed.add(tag)
        return len(page) if tag in ("script", "style") else at

    unclosed: set[str] = set()
    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                at = closing(tag, at)
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block starts
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in _CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        hard, mark, inside, article = stack[-1][2:] if stack else (False, 0, False, 0)
        marks, hard, named, spoken = "", hard or tag in APART and tag != "form", int(tag == "form"), False
        for a in _ATTRIBUTE.finditer(m[3]):
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name in ("class", "id", "role"):
                marks += f".{value}" if name == "class" else ""
                named = max(named, _marked(name, value, inside))
                spoken |= tag == "article" and bool(SPOKEN.search(value))
            elif name == "hidden" or value == "true":
                hard = True
        if tag == "header" and not inside:
            hard = True
        if tag == "main" or tag == "article" and not named:
            (mains if tag == "main" else articles).add(mark)
        if spoken or named and tag not in ("html", "body", "article", "main"):
            above.append(mark)
            tiers.append(named)
            mark = len(above) - 1
        if tag == "ins" and named == 3:  # adverts come as inserted text
            flush()
        path = stack[-1][1] if stack else 0
        if tag == "article" and not article:
            beside.append(path)
            article = len(beside) - 1
        stack.append((tag, paths.below(path, tag + marks) if tag in BLOCK else path, hard, mark, inside or tag in ("article", "main"), article))
        opened[tag] += 1
    held.append(page[at:])
    flush()
    return paths, _resolved(paths, out, above, tiers, articles, mains, beside)


def _resolved(paths: Paths, found, above: list[int], tiers: list[int], articles: set[int], mains: set[int], beside: list[int]) -> list[tuple[int, str, bool]]:
    """The blocks, apart or not, once it is known which marked elements hold the content, and which article is the page's.

    Talk and adverts are content only if they hold the main element, frames also if they hold the only articles; others also
    by their size.
    """
    size, free = [0] * len(above), 0
    for _, text, hard, mark, inside, _ in found:
        if not hard:
            size[mark] += len(text)
            free += len(text) * (inside and not mark)
    holds_article, holds_main = [[i in held for i in range(len(above))] for held in (articles, mains)]
    for i in range(len(above) - 1, 0, -1):  # an element comes after those above it
        size[above[i]] += size[i]
        holds_article[above[i]] |= holds_article[i]
        holds_main[above[i]] |= holds_main[i]
    off = [False] * len(above)
    for i in range(1, len(above)):
        large = size[i] > free and (holds_article[i] or size[i] >= MOST * size[0])
        content = holds_main[i] or (tiers[i] == 1 and large) or (tiers[i] == 2 and holds_article[i] and not free)
        off[i] = off[above[i]] or not content
    for least in (3, 4):  # names that leave nothing count for nothing, those of talk last
        if all(hard or off[mark] for _, _, hard, mark, _, _ in found):
            off = [False] * len(above)
            for i in range(1, len(above)):
                off[i] = off[above[i]] or tiers[i] >= least
    blocks_ = [(path, text, hard or off[mark], inside, article) for path, text, hard, mark, inside, article in found]
    length = [0] * len(beside)
    for _, text, apart, _, article in blocks_:
        length[article] += 0 if apart else len(text)
    length[0] = 0
    first = next((k for k, n in enumerate(length) if n >= ANCHOR), 0)
    if not first:
        return [b[:3] for b in blocks_]
    # beside a page's article only other articles of the same parent, what main holds besides, and headings count
    mine = {k for k in range(1, len(beside)) if beside[k] == beside[first]}
    other = lambda path, inside, article: article not in mine if article else not inside and paths.tag(path) not in HEADINGS
    return [(path, text, apart or other(path, inside, article)) for path, text, apart, inside, article in blocks_]


def _roots(paths: Paths, chosen: set[int]) -> tuple[list[bool], set[int]]:
    """For every path whether it lies under the smallest elements that together hold all chosen paths; and the elements above those."""
    parent, tags = paths.parent, [paths.tag(p) for p in range(len(paths.parent))]
    holder = [0] * len(parent)  # of each path the element it lies in; lists and tables stay whole
    for p in range(1, len(parent)):
        holder[p] = holder[parent[p]] if tags[parent[p]] in PARTS else parent[p]
    holders = chosen | {holder[p] for p in chosen}
    needed = {0}
    for p in chosen:
        while p not in needed:
            needed.add(p)
            p = parent[p]
    under, passed = [False] * len(parent), set()
    for p in range(len(parent)):  # a path comes after its parent
        page = tags[p] in ("", "html", "body")
        root = p in needed and (tags[p] in ("article", "main") or not page and p in holders)
        under[p] = root or under[parent[p]]
        if p in needed and not under[p]:
            passed.add(p)
    return under, passed


def _widen(paths: Paths, under: list[bool], passed: set[int], apart: set[int]) -> None:
    """Short leads and ends stay: an element around the content, below the page's own, counts whole if nothing in it is apart."""
    parent = paths.parent
    roots = {p for p in range(1, len(parent)) if under[p] and not under[parent[p]]}
    around = {parent[p] for p in roots if paths.tag(p) not in ("article", "main") and paths.tag(parent[p]) not in ("", "html", "body")}
    for p in apart:
        while p:
            around.discard(p)
            p = parent[p]
    passed -= around
    for p in range(1, len(parent)):  # a path comes after its parent
        under[p] = under[p] or p in around or under[parent[p]]


def main_text(page: str | None) -> str:
    paths, found = blocks(page or "")
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, apart in found:
        if not apart:
            length[path] += len(text)
            marks[path] += len(PUNCTUATION.findall(text))
            count[path] += 1
    if not count:
        return ""
    parent = paths.parent
    beside = defaultdict(lambda: [0, 0, 0])
    for path, n in count.items():
        sums = beside[parent[path]]
        sums[0] += length[path]
        sums[1] += marks[path]
        sums[2] += n
    fused = {}
    for path, n in count.items():
        near_length, near_marks, near = beside[parent[path]]
        fused[path] = (length[path] / n + near_length / near) / 2 * (1 + (marks[path] / n + near_marks / near) / 2)
    least = THRESHOLD * max(fused.values())
    chosen = {p for p, f in fused.items() if f >= least}
    under, passed = _roots(paths, chosen)
    _widen(paths, under, passed, {p for p, _, apart in found if apart})
    direct = {parent[p] for p in chosen} & passed

    def kept(p: int) -> bool:
        if p in chosen or under[p]:
            return True
        if parent[p] in passed:  # a heading on the way; beside the text of a page without containers, any block
            return paths.tag(p) in HEADINGS or parent[p] in direct
        if parent[p] in chosen:
            return True
        while paths.tag(parent[p]) in LISTS or paths.tag(parent[p]) in PARTS:
            p = parent[p]
        return paths.tag(p) in LISTS and parent[p] in direct

    return "\n".join(t for p, t, apart in found if not apart and kept(p))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the main text, empty if none) and n_chars (its code points) of every row."""

    def run(batches):
        for part in slices(batches, "html"):
            texts = [main_text(h) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": part["page_id"].combine_chunks(), "url": part["url"].combine_chunks(), "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return in_arrow(chosen, run, "page_id long, url string, text string, n_chars long")
