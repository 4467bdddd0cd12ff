"""Main text of web pages by wrappers inferred from the pages of a host (operator 7).

A page is a stream of tokens: block tags (with their classes) and text slots; inline markup is part of the slots. Runs of equal
groups are folded into a repeated group, which leaves few distinct streams on a host. These are aligned one after the other into the
host's wrapper, a regular expression without unions: where a stream and the wrapper differ, the part becomes optional,
or repeated if its neighbour is the same; slots stay slots. A wrapper that would grow beyond MOST_ITEMS tokens is closed and the host gets
another one, so that every page fits one of its host's wrappers.

Extraction matches each page with its host's wrappers; every tag and slot of the page then has a place in the first that fits. Over
all pages of the host it is counted which places hold the same text everywhere (the template) and how much text the <article> and
<main> elements of each place hold. A page's text is in <main>, with all that stands around its articles; but of the articles only those of the place that holds
most on the host are kept: those of a repeated group share a place, a teaser beside the story has another one. Without <main> it is in
these articles, if they hold at least as much as the text outside of articles does on the host, else in the body. What the template says is left out; so are menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and
reader comments, by tag, class or id, as they vary too. A template needs LEAST_CONTENTS different pages, and never takes
all of a page's text.

Spread: streams are made distinct by host before they are gathered, and merged FAN at a time in rounds, by host and a hash of the
stream; so a host with a third of all pages sends what its pages differ in, and no task gets more than about FAN streams of it. Counts of
places are aggregated before they are shuffled. Profiles are broadcast while they are small, and joined by (host, salt) beyond.

Null or empty html, and pages without main text, give an empty string. Pages without a host (null URL, or no '://') are aligned together. Repeated
rows are extracted one by one. An empty table gives an empty result. Only page_id, url and html are read. Unclosed tags end with
their container or the page; a tag that the end of the page cuts off is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from operator import eq

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import cut
from portolan.llm.urlfilter import host_of

MOST_HOSTS, MOST_BYTES = 50_000, 20 << 20  # profiles that may be broadcast; more are joined by a shuffle
SALTS = 16  # parts of a host in that join
FAN = 64  # streams of a host merged in one task
MOST_ITEMS = 1500  # tokens in a wrapper, but for those that one stream has
LEAST_CONTENTS = 4  # different pages of a host that tell its template
LONGEST = 12  # tokens in a repeated group
KNOWN = 1 << 14  # tags that a worker remembers

# HTML's block elements, those that others end, and those that hold no article text.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th tr pre blockquote figcaption summary hr address caption option legend label title".split())
HOLDERS = frozenset(
    "html head body article main section div nav header footer aside form ul ol dl table thead tbody tfoot fieldset figure details dialog "
    "menu button select textarea iframe svg canvas object video audio noscript template".split()
)
BOILER_TAGS = frozenset(
    "head nav header footer aside form button select textarea iframe svg canvas object video audio noscript template menu dialog fieldset".split()
)
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "footer masthead sidebar aside widget related recommended comment comments discussion replies disqus cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe signup login share sharing social search form pagination pager".split()
)
# Words that mark blocks within articles too, and those that go with a boilerplate word in the name of a widget.
BOILER_LEAVES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs cookie cookies "
    "consent gdpr newsletter subscribe share sharing pagination pager".split()
)
WIDGET_WORDS = frozenset("box bar block list area unit slot links buttons item items site main top bottom left right section".split())
# Words that mark reader comments and adverts in whatever name, but for names that tell a state.
ALWAYS = frozenset("comment comments advert adverts advertisement advertising".split())
STATES = frozenset("has no with without open closed on off enabled disabled".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    # a quote counts directly after '=' only; without its end the tag ends at the next '>'
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=(?!\s*[\"']))*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|</?[a-z!][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

SLOT = "#"


def _named(tag: str, kind: str, value: str) -> bool:
    """Whether a class or id names boilerplate: a whole token is a word, made of words and WIDGET_WORDS only, or has a word of ALWAYS. State classes
    (has-sidebar) aren't, nor those of html, body and main; an article is only by a word alone or last; ids of sections and leaves are anchors."""
    if tag in ("html", "body", "main") or (kind == "id" and (tag in LEAVES or tag in ("article", "section"))):
        return False
    known = BOILER_LEAVES if tag in LEAVES else BOILER_WORDS
    for token in value.split():
        parts = re.findall(r"[a-z]+", token)
        hits = [w in known for w in parts]
        if not ALWAYS.isdisjoint(parts[-1:] if tag == "article" else parts) and STATES.isdisjoint(parts):
            return True
        if any(hits) and (len(parts) == 1 or (tag != "article" and all(h or w in WIDGET_WORDS for h, w in zip(hits, parts, strict=True)))):
            return True
    return False


@lru_cache(KNOWN)
def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """The token of a block tag (with its classes and id, without digits), and whether it holds no article text."""
    names, boiler = [], tag in BOILER_TAGS
    for m in _ATTR.finditer(attrs) if "=" in attrs else ():
        if m[1].lower() not in ("class", "id", "role"):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        words = re.findall(r"[a-z]+", value)
        boiler = boiler or (not BOILER_ROLES.isdisjoint(words) if m[1].lower() == "role" else _named(tag, m[1].lower(), value))
        names += words
    return ".".join([tag, *sorted(set(names))]), boiler


def blocks(page: str | None) -> Iterator[tuple[str, tuple, bool, str]]:
    """The page's tokens: (token, holders, in boiler, text). A slot has its text, decoded and with single spaces for white space, and
    its holders: (tag, number of the token that opened it) of the elements around it."""
    stack: list[tuple[str, int, bool]] = []  # tag, token number, boiler
    text: list[str] = []
    leaf_boiler, n = False, 0

    def flush() -> list[tuple[str, tuple, bool, str]]:
        found = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        return [(SLOT, tuple(h[:2] for h in stack), leaf_boiler or any(h[2] for h in stack), found)] if found else []

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif tag in LEAVES or tag in HOLDERS:
            slot = flush()
            yield from slot
            n += len(slot)
            leaf_boiler = False
            if not closing:
                token, boiler = _label(tag, attrs)
                if tag in LEAVES:
                    leaf_boiler = boiler
                else:
                    if tag == "body":  # ends an open head
                        while stack and stack[-1][0] == "head":
                            stack.pop()
                    if not attrs.rstrip().endswith("/"):
                        stack.append((tag, n, boiler))
                yield f"<{token}>", (), False, ""
                n += 1
            elif tag in HOLDERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        yield f"</{tag}>", (), False, ""
                        n += 1
                        break
    text.append(page[at:])
    yield from flush()


# A wrapper is a tuple of items: a token, ("+", items) for a repeated group, ("?", items) for an optional one.


def fold(items: tuple) -> tuple:
    """Runs of equal groups become repeated groups, until there are none."""
    items = list(items)
    grouped = any(isinstance(x, tuple) and x[0] == "+" for x in items)
    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST + 1):
            # where an item equals the one that comes `size` later; that many in a row are a group and its copy
            same, run = bytes(map(eq, items, items[size:])), b"\1" * size
            at, i = same.find(run), 0
            out: list = []
            while at >= 0:
                out += items[i:at]
                group, i = tuple(items[at : at + size]), at + size
                if size == 1 and isinstance(group[0], tuple) and group[0][0] == "?":
                    out.append(group[0])
                else:
                    while same[i - size : i] == run:
                        i += size
                    out.append(group[0] if size == 1 and isinstance(group[0], tuple) else ("+", group))
                    grouped = changed = True
                at = same.find(run, i)
            out += items[i:]
            items = _absorb(out) if grouped else out
    return tuple(items)


def _absorb(items: list) -> list:
    """X+ takes in copies of X on either side of it."""
    out: list = []
    last = -1  # where the last repeated group is
    for item in items:
        out.append(item)
        if isinstance(item, tuple) and item[0] == "+":
            n = len(item[1])
            while tuple(out[-1 - n : -1]) == item[1]:
                del out[-1 - n : -1]
            if len(out) > 1 and out[-2] == item:
                out.pop()
            last = len(out) - 1
        elif last >= 0 and len(out) - 1 - last == len(out[last][1]) <= LONGEST and tuple(out[last + 1 :]) == out[last][1]:
            del out[last + 1 :]
    return out


def _groups(items: tuple) -> set:
    return {x[1] for x in items if isinstance(x, tuple) and x[0] == "+"}


def _repeated(items: tuple, groups: set) -> tuple:
    """Copies of the other side's repeated groups become repeated groups here too."""
    items = list(items)
    for group in sorted(groups, key=lambda g: (-len(g), str(g))):
        n, i = len(group), 0
        while i + n <= len(items):
            if tuple(items[i : i + n]) == group:
                items[i : i + n] = [("+", group)]
            i += 1
    return fold(tuple(_absorb(items)))


def _flat(items: tuple) -> list[tuple[object, int]]:
    """Items without optional groups, each with the number of the group it was in (-1: none). Nested groups become one each item."""
    out: list[tuple[object, int]] = []
    for n, x in enumerate(items):
        if not (isinstance(x, tuple) and x[0] == "?"):
            out.append((x, -1))
        elif any(isinstance(y, tuple) and y[0] == "?" for y in x[1]):
            out += [(y, (n << 16) + k) for k, (y, _) in enumerate(_flat(x[1]))]
        else:
            out += [(y, n << 16) for y in x[1]]
    return out


def _runs(groups: list[int], lo: int, hi: int) -> Iterator[tuple[int, int, bool]]:
    """Cuts [lo, hi) where the group changes: start, end, whether it is optional. A group that goes on beyond is cut into its items."""
    i = lo
    while i < hi:
        j = i + 1
        while j < hi and groups[j] == groups[i]:
            j += 1
        g = groups[i]
        part = g >= 0 and ((i > 0 and groups[i - 1] == g) or (j < len(groups) and groups[j] == g))
        if part:
            yield from ((k, k + 1, True) for k in range(i, j))
        else:
            yield i, j, g >= 0
        i = j


def align(a: tuple, b: tuple) -> tuple:
    """The wrapper of two: common items stay; what only one has becomes optional. It accepts whatever one of the two accepts."""
    if a == b:
        return a
    a, b = _repeated(a, _groups(b)), _repeated(b, _groups(a))
    (fa, ga), (fb, gb) = ([list(x) for x in zip(*_flat(items), strict=True)] or [[], []] for items in (a, b))
    key = lambda x: ("+", x[1][0]) if isinstance(x, tuple) else x  # noqa: E731  groups that begin alike are aligned
    out: list = []

    def optional(items: list, groups: list[int], lo: int, hi: int) -> None:
        part = [("?", tuple(items[i:j])) if maybe else tuple(items[i:j]) for i, j, maybe in _runs(groups, lo, hi)]
        inner = tuple(y for x in part for y in ((x,) if x[0] == "?" else x))
        out.extend(inner if all(isinstance(x, tuple) and x[0] == "?" for x in inner) else [("?", inner)])

    for op, i, j, k, m in SequenceMatcher(None, [key(x) for x in fa], [key(x) for x in fb], autojunk=False).get_opcodes():
        if op == "equal":
            both = [x if x == y else ("+", align(x[1], y[1])) for x, y in zip(fa[i:j], fb[k:m], strict=True)]
            # each side's optional runs as a mark for each item: where it begins, or -1
            marks = []
            for groups, lo, hi in ((ga, i, j), (gb, k, m)):
                marks.append([(s - lo if maybe else -1) for s, e, maybe in _runs(groups, lo, hi) for _ in range(s, e)])
            at = 0
            while at < len(both):
                x, y = marks[0][at], marks[1][at]
                end = at + 1
                if x < 0 and y < 0:
                    out.append(both[at])
                else:
                    while end < len(both) and (marks[0][end], marks[1][end]) == (x, y):
                        end += 1
                    # a run that one side keeps whole stays a group only if the other has all or nothing of it optional
                    whole = all(v < 0 or (v == at and (end == len(both) or mark[end] != v)) for v, mark in ((x, marks[0]), (y, marks[1])))
                    out.extend([("?", tuple(both[at:end]))] if whole else [("?", (z,)) for z in both[at:end]])
                at = end
        else:
            optional(fa, ga, i, j)
            optional(fb, gb, k, m)
    return fold(tuple(out))


def pattern(items: tuple) -> str:
    """The wrapper as a regular expression over tokens."""
    return " ".join(x if isinstance(x, str) else f"({pattern(x[1])}){x[0]}" for x in items)


def parsed(text: str) -> tuple:
    """The wrapper of a `pattern`."""
    out: list[list] = [[]]
    for m in re.finditer(r"\(|\)[+?]|[^\s()]+", text):
        if m[0] == "(":
            out.append([])
        elif m[0][0] == ")":
            inner = tuple(out.pop())
            out[-1].append((m[0][1], inner))
        else:
            out[-1].append(m[0])
    return tuple(out[0])


@lru_cache(KNOWN)
def _token(token: str) -> str:
    return re.sub(r"[\s()]", "_", token)


def stream(page: str | None) -> str:
    return pattern(fold(tuple(_token(token) for token, _, _, _ in blocks(page))))


class Automaton:
    """A wrapper as an automaton whose places are the wrapper's tokens."""

    def __init__(self, items: tuple):
        self.symbol: list[str] = []  # of each place
        self.after: list[int] = []  # the node that a place leads to
        self.free: list[list[int]] = [[]]  # nodes reached from a node without a token
        self.of: list[list[int]] = [[]]  # places that begin at a node
        self.known: dict[int, tuple[dict[str, list[int]], bool]] = {}
        self.end = self._add(items, 0)

    def _node(self, *sources: int) -> int:
        self.free.append([])
        self.of.append([])
        for source in sources:
            self.free[source].append(len(self.free) - 1)
        return len(self.free) - 1

    def _add(self, items: tuple, at: int) -> int:
        for x in items:
            if isinstance(x, str):
                self.of[at].append(len(self.symbol))
                self.symbol.append(x)
                at = self._node()
                self.after.append(at)
            else:
                first = self._node(at)
                last = self._add(x[1], first)
                if x[0] == "+":
                    self.free[last].append(first)
                    at = self._node(last)
                else:
                    at = self._node(last, at)
        return at

    def following(self, node: int) -> tuple[dict[str, list[int]], bool]:
        """Token -> the places that can take it next; and whether the wrapper may end here."""
        if node not in self.known:
            seen, todo, places = {node}, [node], {}
            while todo:
                at = todo.pop()
                for p in self.of[at]:
                    places.setdefault(self.symbol[p], []).append(p)
                new = [x for x in self.free[at] if x not in seen]
                seen.update(new)
                todo += new
            self.known[node] = places, self.end in seen
        return self.known[node]

    def places(self, tokens: list[str]) -> list[int] | None:
        """The place of each token; None if the wrapper doesn't fit."""
        steps: list[dict[int, int]] = []
        now = {-1: -1}
        for token in tokens:
            found: dict[int, int] = {}
            for p in now:
                for q in self.following(self.after[p] if p >= 0 else 0)[0].get(token, ()):
                    found.setdefault(q, p)
            if not found:
                return None
            steps.append(found)
            now = found
        last = next((p for p in now if self.following(self.after[p] if p >= 0 else 0)[1]), None)
        if last is None:
            return None
        out = []
        for step in reversed(steps):
            out.append(last)
            last = step[last]
        return out[::-1]


class Wrappers(dict):
    """pattern -> its automaton; a worker keeps some."""

    def __missing__(self, text: str) -> Automaton:
        if len(self) >= 256:
            self.clear()
        made = self[text] = Automaton(parsed(text))
        return made

    def place(self, found: list, patterns: list[str]) -> tuple[int, list[int]]:
        """The first wrapper that takes the tokens (-1: none), and their places."""
        tokens = [_token(b[0]) for b in found]
        for no, text in enumerate(patterns):
            places = self[text].places(tokens)
            if places is not None:
                return no, places
        return -1, [-1] * len(tokens)


def _regions(found: list, region: str) -> dict[int, list[int]]:
    """Token number of each outermost element of this tag -> the slots in it outside boilerplate."""
    out: dict[int, list[int]] = {}
    for i, (token, holders, boiler, _) in enumerate(found):
        if token == SLOT and not boiler:
            at = next((n for tag, n in holders if tag == region), None)
            if at is not None:
                out.setdefault(at, []).append(i)
    return out


OUTSIDE = -2  # the place under which the text outside of articles is counted


def main_slots(found: list, places: list[int], weight: dict[int, int], template: frozenset[int]) -> list[int]:
    """The slots of a page's main text, as token numbers. weight: text of the <article> and <main> elements of each place, and of what is OUTSIDE,
    on the host; where the wrapper doesn't tell, that of the page itself counts."""
    slots = [i for i, b in enumerate(found) if b[0] == SLOT and not b[2]]
    mains, articles = _regions(found, "main"), _regions(found, "article")
    heaviest = lambda elements: max((places[at] for at in elements), key=lambda p: (weight.get(p, 0), -p))
    if mains:
        best = heaviest(mains)
        slots = sorted(i for at, inside in mains.items() if places[at] == best for i in inside)
        # a story and what stands around it, without the teasers beside it
        article = {i: at for at, inside in articles.items() for i in inside}
        within = {article[i] for i in slots if i in article}
        if within:
            best = heaviest(within)
            slots = [i for i in slots if i not in article or places[article[i]] == best]
    elif articles:
        best = heaviest(articles)
        story = sorted(i for at, inside in articles.items() if places[at] == best for i in inside)
        length = lambda chosen: sum(len(found[i][3]) for i in chosen)
        around = set(slots).difference(*articles.values())
        if (weight[best] >= weight.get(OUTSIDE, 0)) if best in weight else length(story) >= length(around):
            slots = story
    return [i for i in slots if places[i] not in template] or slots


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))


def _size(items: tuple) -> int:
    return sum(1 if isinstance(x, str) else _size(x[1]) for x in items)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, n_pages, wrapper: one row for each host, but for those whose pages need several."""
    return _wrappers(_hosted(pages))


def _wrappers(rows: DataFrame, fan: int = FAN) -> DataFrame:
    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([stream(page) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("host"), found], ["host", "wrapper"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        done: list[list] = []
        for text, n in sorted(zip(group["wrapper"], group["n_pages"], strict=True)):
            items = parsed(text)
            if done:
                both = align(done[-1][0], items)
                if _size(both) <= max(MOST_ITEMS, _size(done[-1][0]), _size(items)):
                    done[-1] = [both, done[-1][1] + n]
                    continue
            done.append([items, n])
        return pd.DataFrame({"host": [group["host"].iloc[0]] * len(done), "n_pages": [int(n) for _, n in done], "wrapper": [pattern(x) for x, _ in done]})

    schema = "host string, n_pages long, wrapper string"
    now = cut(rows.select("host", "html").mapInArrow(streams, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n_pages")))
    before, turn = None, 0
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= 1 or total == before:
            return now
        salt = F.pmod(F.xxhash64("wrapper", F.lit(turn)), F.ceil(F.col("n") / fan))
        now = cut(now.join(sizes, "host").withColumn("salt", salt).groupBy("host", "salt").applyInPandas(merged, schema))
        if most <= fan:
            return now
        before, turn = total, turn + 1


def _dealt(rows: DataFrame, profiles: DataFrame, small: bool) -> DataFrame:
    """rows with their host's profile."""
    if small:
        return rows.join(F.broadcast(profiles), "host", "left")
    salted = profiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _counted(rows: DataFrame) -> DataFrame:
    """host, no, place, mark, chars: for each page and each place of its slots the texts there; for each <article> and <main> the characters
    in it, and what is OUTSIDE of articles; with place -1 the page, whose mark stands for all its text. Rows come with `patterns`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wrappers()
        for batch in batches:
            out: list[tuple] = []
            for host, page, patterns in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "patterns")), strict=True):
                found = list(blocks(page))
                no, places = known.place(found, patterns or [])
                texts: dict[int, list[str]] = {}
                for (token, _, boiler, text), place in zip(found, places, strict=True):
                    if token == SLOT and not boiler:
                        texts.setdefault(place, []).append(text)
                if no < 0 or not texts:
                    continue
                out += [(host, no, place, _hash("\n".join(t)), 0) for place, t in texts.items()]
                out.append((host, no, -1, _hash("\n".join(t for ts in texts.values() for t in ts)), 0))
                mains, articles = _regions(found, "main"), _regions(found, "article")
                out += [(host, no, places[at], -1, sum(len(found[i][3]) for i in inside)) for at, inside in (*articles.items(), *mains.items())]
                if articles and not mains:
                    told = {i for inside in articles.values() for i in inside}
                    out.append((host, no, OUTSIDE, -1, sum(len(b[3]) for i, b in enumerate(found) if b[0] == SLOT and not b[2] and i not in told)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "no", "place", "mark", "chars"])

    return rows.select("host", "html", "patterns").mapInArrow(run, "host string, no int, place int, mark long, chars long")


def extracted(pages: DataFrame, most_hosts: int = MOST_HOSTS) -> DataFrame:
    """page_id, url, text."""
    rows = _hosted(pages)
    lists = cut(_wrappers(rows).groupBy("host").agg(F.sort_array(F.collect_list("wrapper")).alias("patterns")))
    hosts, size = lists.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json("patterns"))), F.lit(0))).first()
    small = hosts <= most_hosts and size <= MOST_BYTES
    found = _counted(_dealt(rows, lists, small))
    by_place = cut(found.groupBy("host", "no", "place", F.when(F.col("place") == -1, F.col("mark")).alias("page")).agg(
        F.count("*").alias("n"), F.min("mark").alias("least"), F.max("mark").alias("most"), F.sum("chars").alias("chars")
    ))
    totals = by_place.where("place = -1").groupBy("host").agg(F.sum("n").alias("n_pages"), F.count("*").alias("contents"))
    kept = by_place.where("place <> -1").join(totals, "host").select(
        "host", F.struct("no", "place", "chars", ((F.col("least") >= 0) & (F.col("least") == F.col("most")) & (F.col("n") == F.col("n_pages"))
                                                   & (F.col("contents") >= LEAST_CONTENTS)).alias("fixed")).alias("p")
    ).where("p.fixed or p.chars > 0")
    profiles = cut(lists.join(kept.groupBy("host").agg(F.collect_list("p").alias("places")), "host", "left"))
    size = profiles.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("patterns", "places")))), F.lit(0))).first()[0]
    small = hosts <= most_hosts and size <= MOST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wrappers()
        for batch in batches:
            texts = []
            for page, patterns, facts in zip(*(batch.column(c).to_pylist() for c in ("html", "patterns", "places")), strict=True):
                tokens = list(blocks(page))
                no, places = known.place(tokens, patterns or [])
                mine = [f for f in facts or () if f["no"] == no]
                weight, template = {f["place"]: f["chars"] for f in mine if f["chars"]}, frozenset(f["place"] for f in mine if f["fixed"])
                texts.append("\n\n".join(tokens[i][3] for i in main_slots(tokens, places, weight, template)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    joined = _dealt(rows, profiles, small).select("page_id", "url", "html", "patterns", "places")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
