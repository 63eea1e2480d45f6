"""HTML extraction by template deduction with equivalence classes.

Pages of a host are worked on in groups of GROUP at most; a host with more has no group of less than half of that. A page is
a sequence of tokens: the opening and closing of elements and runs of text, each told apart by its path: the names of the open
elements with class, id and role, longer numbers apart. Tokens with the same occurrence vector over the group's distinct pages form a
class. A class is valid if its tokens come in one order at every occurrence and if its occurrences nest in the gaps of larger
classes. The valid classes are the template; what stands between them are slots.

A slot belongs to the nearest element of the template around it that can hold an article. The element whose slots hold most
text of their own over the group, links left out, is the main one. Names break ties: text in an article or main element counts
several times, and such an element around the main one is read in its stead. Elements that are or are named menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments never count and are never read. In a main element of no
such name, blocks that the template repeats on the pages go, unless they are a large part of it, as on near copies of one page; in a
named article nothing else goes. Where a group has fewer than SUPPORT distinct pages, or a page has no element of the
template, names alone decide.

Pages come together by one shuffle on (host, salt) and are sorted by it, so a task streams through groups and holds two at a
time at most. A host of more than HOT pages is salted into parts of half as many, by its own number of pages alone, so a
page's group does not depend on other hosts. Those hosts are broadcast up to LISTED of them and joined by a shuffle beyond.

Defined results: null and empty html give an empty text of 0 characters; html without tags is text; a page without a host belongs to the host
of no name; repeated rows are extracted alike; broken markup is read as browsers do for unclosed and stray tags; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_schema, batch, portions

GROUP, SUPPORT, SIZE = 64, 3, 3
HOT, LISTED = 256, 100_000
#: Of a main element's text on a page, the share that template runs may have to be taken out.
REPEATED = 0.25
#: What the text in an element counts for if a name says that it is the article's.
NAMED = {"article": 8, "main": 4}

# Fixed values of HTML: elements without content, of raw text, that part blocks, and that name what they hold.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math canvas object audio video textarea select option title head".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = RAW | set("nav footer aside form button menu dialog label fieldset".split())
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "caption"}
#: Elements that can be the place of an article.
PLACES = set("article body center div main section table td".split())
#: Names in class, id or role that say what an element is for.
LABELS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsored|promo|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|page-header|topbar|comments?|commentlist|discussion|disqus|respond|replies|reply|share|sharing|social|related|"
    r"recommended|newsletter|subscribe|subscription|signup|login|search|search-form|widget|toolbar|pagination|pager|contentinfo|complementary|skip-link)(?:$|[\s_-])",
    re.I,
)
#: Names such as no-sidebar or has-comments say what is around an element, not what it is.
AROUND = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|not|hide|show)[_-]\S+", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:main|article-body|articlebody|post-content|entry-content|article-content|story-body)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<)", re.S
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d{3,}")

OPEN, CLOSE, TEXT = 0, 1, 2
ROOT = 0


class Paths:
    """The paths of a group's elements by number, with what follows from a path alone. Number 0 is the page."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.tag, self.label, self.up, self.hidden, self.link, self.label_of = [""], [""], [-1], [False], [False], {}

    def of(self, up: int, tag: str, attrs: str) -> int:
        label = self.label_of.get(attrs)
        if label is None:
            label = self.label_of[attrs] = " ".join(next(filter(None, a[1:]), "") for a in _ATTR.findall(attrs))
        key = (up, tag, _DIGITS.sub("0", label) if label else label)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.tag)
            self.tag.append(tag)
            self.label.append(label)
            self.up.append(up)
            self.hidden.append(self.hidden[up] or self._aside(up, tag, label))
            self.link.append(self.link[up] or tag == "a")
        return found

    def _aside(self, up: int, tag: str, label: str) -> bool:
        if tag in ASIDE:
            return True
        if tag == "header":  # an article's own header is part of it
            return not any(self.tag[p] in ("article", "main") for p in self.line(up))
        return bool(label) and tag not in ("html", "body", "article", "main") and bool(LABELS.search(AROUND.sub("", label)))

    def line(self, p: int) -> Iterator[int]:
        """p and what it lies in, without the page."""
        while p > ROOT:
            yield p
            p = self.up[p]

    def named_main(self, p: int) -> bool:
        return self.tag[p] == "main" or bool(self.label[p]) and bool(MAIN.search(self.label[p]))

    def within(self, chosen: set[int]) -> list[bool]:
        """For each path whether it is one of the chosen or inside of one."""
        inside: list[bool] = []
        for p, up in enumerate(self.up):  # an element's number is larger than that of the one around it
            inside.append(p in chosen or up >= 0 and inside[up])
        return inside


def parse(html: str, paths: Paths) -> list[tuple]:
    """The page's tokens: (OPEN or CLOSE, path) and (TEXT, path, text)."""
    tokens: list[tuple] = []
    open_, at, low, end_at = [ROOT], 0, None, len(html)
    tag_of, match = paths.tag, _TOKEN.match

    def close(tag: str, stops: tuple[str, ...] = ()) -> None:
        for k in range(len(open_) - 1, 0, -1):
            here = tag_of[open_[k]]
            if here == tag:
                tokens.append((CLOSE, open_[k]))
                del open_[k:]
                return
            if here in stops:
                return

    while at < end_at and (m := match(html, at)):
        at = m.end()
        end, tag, attrs, text = m.groups()
        if text is not None:
            tokens.append((TEXT, open_[-1], entities.unescape(text) if "&" in text else text))
        elif tag is not None:
            tag = tag.lower()
            if tag in CLOSES_P:
                close("p", ("article", "section", "div", "li", "td", "body", "main"))
            if tag == "li":
                close("li", ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr", "dd", "dt", "option"):
                close(tag, ("table", "dl", "select"))
            p = paths.of(open_[-1], tag, attrs)
            tokens.append((OPEN, p))
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
                low = html.lower() if low is None else low
                stop = low.find(f"</{tag}", at)
                at = end_at if stop < 0 else stop
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                open_.append(p)
        elif end is not None:
            close(end.lower())
    return tokens


def roles(tokens: list[tuple]) -> list[tuple]:
    """The tokens that can be the template's: text is compared without regard to its white space, blank text is none."""
    return [t if t[0] != TEXT else (TEXT, t[1], run) for t in tokens if t[0] != TEXT or (run := " ".join(t[2].split()))]


def template(pages: list[list[tuple]]) -> set[tuple]:
    """The roles of the valid equivalence classes of distinct pages."""
    if len(pages) < SUPPORT:
        return set()
    places: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for p, tokens in enumerate(pages):
        for i, role in enumerate(tokens):
            places[role][p].append(i)
    least = max(SUPPORT, len(pages) // 2)
    by_vector: dict[tuple, list[tuple]] = defaultdict(list)
    for role, where in places.items():
        if len(where) >= least:
            by_vector[tuple((p, len(x)) for p, x in where.items())].append(role)
    valid: set[tuple] = set()
    taken: dict[int, list[list[list[int]]]] = defaultdict(list)  # of each page: the occurrences of each accepted class, as sorted token positions
    for vector, found in sorted(by_vector.items(), key=lambda x: (-len(x[0]), -len(x[1]), x[1])):
        if len(found) < SIZE:
            continue
        kept, spans = _occurrences(places, found, vector)
        if len(kept) < SIZE or spans is None:
            continue
        if all(_nests(o, others) for p, x in spans.items() for others in taken[p] for o in x):
            valid.update(kept)
            for p, x in spans.items():
                taken[p].append(x)
    return valid


def _occurrences(places, found, vector) -> tuple[list[tuple], dict[int, list[list[int]]] | None]:
    """The roles that come in one order on all pages, and their occurrences by page; None if occurrences run into each other."""
    order = sorted(found, key=lambda r: places[r][vector[0][0]][0])
    for p, n in vector:
        for k in range(n):
            order = _rising(order, [places[r][p][k] for r in order])
    spans = {p: [[places[r][p][k] for r in order] for k in range(n)] for p, n in vector}
    for lines in spans.values():
        if any(a[-1] >= b[0] for a, b in zip(lines, lines[1:], strict=False)):
            return order, None
    return order, spans


def _rising(order: list[tuple], at: list[int]) -> list[tuple]:
    """The longest part of order whose positions rise."""
    if all(a < b for a, b in zip(at, at[1:], strict=False)):
        return order
    ends, last, before = [], [], []
    for i, x in enumerate(at):
        k = bisect_left(ends, x)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [x], [i]
    kept, i = [], last[-1]
    while i >= 0:
        kept.append(order[i])
        i = before[i]
    return kept[::-1]


def _nests(span: list[int], others: list[list[int]]) -> bool:
    """Every occurrence of another class (one after the other) leaves this one in a gap, or lies in a gap of it."""
    first, last = span[0], span[-1]
    for o in others[bisect_left(others, first, key=lambda o: o[-1]) :]:  # from the first that does not end before
        if last < o[0]:
            break
        if bisect_right(o, first) == bisect_right(o, last) or bisect_right(span, o[0]) == bisect_right(span, o[-1]):
            continue
        return False
    return True


def main_places(pages: list[list[tuple]], known: set[tuple], paths: Paths) -> list[int]:
    """The template's elements that hold slots with text, that with most of it over all pages first."""
    near = [ROOT]
    for p in range(1, len(paths.tag)):
        near.append(p if paths.tag[p] in PLACES and (OPEN, p) in known and not paths.hidden[p] else near[paths.up[p]])
    size: dict[int, int] = defaultdict(int)
    for tokens in pages:
        for t in tokens:
            if t[0] == TEXT and not paths.hidden[t[1]] and not paths.link[t[1]] and t not in known:
                size[near[t[1]]] += len(t[2])
    ranked = sorted((p for p in size if p != ROOT), key=lambda p: (-size[p] * _weight(p, paths), p))
    return list(dict.fromkeys(_around(p, size, near, paths) for p in ranked))


def _weight(p: int, paths: Paths) -> int:
    named = {"article" if paths.tag[x] == "article" else "main" for x in paths.line(p) if paths.tag[x] == "article" or paths.named_main(x)}
    return NAMED["article" if "article" in named else "main"] if named else 1


def _around(p: int, size: dict[int, int], near: list[int], paths: Paths) -> int:
    """The article or main element around p; without one, the outermost place whose own slots hold text too, below body."""
    line = list(paths.line(p))
    for named in ([x for x in line if paths.tag[x] == "article"], [x for x in line if paths.named_main(x)]):
        if named:
            return named[-1]
    while (up := near[paths.up[p]]) and paths.tag[up] != "body" and size.get(up):
        p = up
    return p


def named_places(opened: set[int], paths: Paths) -> set[int]:
    """The article elements among the opened ones, else what is named as main, else the page."""
    live = [p for p in opened if not paths.hidden[p]]
    return {p for p in live if paths.tag[p] == "article"} or {p for p in live if paths.named_main(p)} or {ROOT}


def read(tokens: list[tuple], inside: list[bool], paths: Paths, known: set[tuple]) -> str:
    """The text in the chosen elements without what is hidden there, and without blocks of known runs alone if they are few."""
    blocks, own = [[]], [False]
    for t in tokens:
        if t[0] == TEXT:
            if inside[t[1]] and not paths.hidden[t[1]]:
                blocks[-1].append(t[2])
                own[-1] = own[-1] or not known or bool(run := " ".join(t[2].split())) and (TEXT, t[1], run) not in known
        elif blocks[-1] and paths.tag[t[1]] in BLOCK:
            blocks.append([])
            own.append(False)
    whole = _joined(blocks)
    if not known:
        return whole
    left = _joined([b for b, o in zip(blocks, own, strict=True) if o])
    return left if len(left) >= (1 - REPEATED) * len(whole) else whole


def _joined(blocks: list[list[str]]) -> str:
    return " ".join(" ".join("".join(b) for b in blocks).split())


def extract_group(htmls: list[str | None]) -> list[str]:
    paths = Paths()
    parsed = {h: parse(h, paths) for h in dict.fromkeys(htmls) if h}
    pages = [roles(tokens) for tokens in parsed.values()]
    known = template(pages)
    ranked = main_places(pages, known, paths) if known else []
    inside: dict[frozenset, list[bool]] = {}
    done = {}
    for h, tokens in parsed.items():
        opened = {t[1] for t in tokens if t[0] == OPEN}
        best = next((p for p in ranked if p in opened), None)
        if best is None or paths.tag[best] == "article":  # a page's articles belong together
            chosen = named_places(opened, paths)
        else:
            chosen = {best}
        key = frozenset(chosen)
        if key not in inside:
            inside[key] = paths.within(chosen)
        plain = best is not None and not any(paths.tag[p] == "article" or paths.named_main(p) for p in chosen)
        done[h] = read(tokens, inside[key], paths, known if plain else set())
    return [done[h] if h else "" for h in htmls]


def host(url: Column) -> Column:
    """The lower-case host of an address, without www. and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))


def runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Groups of rows that follow each other with the same host and salt: the last two of a host are made of equal size."""
    group: list[tuple] = []
    for row in rows:
        if group and row[3:] != group[-1][3:]:
            yield from _halves(group)
            group = []
        elif len(group) == 2 * GROUP:
            yield group[:GROUP]
            group = group[GROUP:]
        group.append(row)
    yield from _halves(group)


def _halves(group: list[tuple]) -> list[list[tuple]]:
    half = -(-len(group) // 2)
    return [group[:half], group[half:]] if len(group) > GROUP else [group] if group else []


def salted(pages: DataFrame) -> DataFrame:
    """pages with a column salt: 0, or one of as many numbers as the host of a page has halves of HOT pages."""
    hot = pages.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("host", F.ceil(F.col("n") * 2 / HOT).alias("parts"))
    hot = F.broadcast(hot) if hot.count() <= LISTED else hot.hint("merge")
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)).cast("int")
    return pages.join(hot, "host", "left").withColumn("salt", salt).drop("parts")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url").cast("string")).alias("host"))
    schema = "page_id long, url string, text string, n_chars long"
    shape = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "html", "host", "salt")
        for rows in runs(row for b in portions(batches) for row in zip(*(b.column(c).to_pylist() for c in names), strict=True)):
            texts = extract_group([r[2] for r in rows])
            yield batch(shape, [r[0] for r in rows], [r[1] for r in rows], texts, [len(t) for t in texts])

    return salted(pages).repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id").mapInArrow(work, schema)
