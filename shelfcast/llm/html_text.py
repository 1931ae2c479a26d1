"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

Words score positive, tags negative.  A tag's weight comes from labelled pages: pages whose own
markup names the article show how often each kind of tag stands outside it.  A linear scan finds
the contiguous stretch with the largest sum; its blocks are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = re.compile(r"</?[a-zA-Z]")
NAME_END = re.compile(r"[\s/>]")
QUOTE_OR_END = re.compile(r"[\"'>]")
# elements whose content is no text of the page
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I)
           for name in ("script", "style", "template", "textarea", "iframe")}
ZEROS = re.compile(r"&#0{20,}")
HUGE = re.compile(r"&#[0-9]{1000,};?")
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = frozenset(["article", "main"])
OUTSIDE_TAGS = frozenset(
    "head title nav aside footer header form button select menu dialog fieldset search".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices popup promo promoted related reply replies respond search share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget".split())
# tags that may stand around a whole page, its article included
AROUND = frozenset(["form", "fieldset"])
# tags that HTML ends without an end tag, so that one left open needn't hold what follows
OPTIONAL_END = frozenset(
    "p li dt dd option optgroup tr td th thead tbody tfoot colgroup caption rp rt".split())
OPENERS = re.compile(r"[^a-z0-9]+")


def kind(name: str, attrs: str) -> tuple[str, bool]:
    """The key under which a tag is weighed, and whether names in it mark page furniture."""
    words = [w for m in MARKED.finditer(attrs)
             for w in OPENERS.split(m[1].strip("\"'").lower()) if w] if attrs else []
    key = f"{name}.{words[0]}" if words else name
    return key, any(w in OUTSIDE_NAMES for w in words)


class TagEnds:
    """Ends of a page's tags, found in time proportional to the page however it is broken.

    A ">" inside quotes doesn't end a tag, unless the quotes leave none to end it: then the next
    ">" does.  Quotes from which no end was found are remembered and not followed again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.name_end = -1
        self.special = -1
        self.dead: set[int] = set()

    def find(self, at: int) -> tuple[int, int]:
        """For a tag whose name starts at this place: the ends of its name and of its attributes;
        (-1, -1) if nothing ends it.  Places must not go back from call to call."""
        if at > self.last:
            return -1, -1
        if self.name_end < at:
            self.name_end = NAME_END.search(self.page, at).start()
        end = self._outside_quotes(self.name_end)
        return self.name_end, end if end >= 0 else self.page.find(">", self.name_end)

    def _outside_quotes(self, at: int) -> int:
        if self.special < at:
            self.special = QUOTE_OR_END.search(self.page, at).start()
        place, followed = self.special, []
        while self.page[place] != ">":
            if place in self.dead:
                break
            followed.append(place)
            closing = self.page.find(self.page[place], place + 1)
            if closing < 0 or closing >= self.last:
                break
            place = QUOTE_OR_END.search(self.page, closing + 1).start()
        else:
            return place
        self.dead.update(followed)
        return -1


def scan(page: str):
    """Items of a page: (text, None, ...) or (None, name, key, is_end, is_furniture, is_void)."""
    ends = TagEnds(page)
    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            then = page.find("<", at)
            then = size if then < 0 else then
            yield page[at:then], None, None, False, False, False
            at = then
            continue
        if page.startswith("<!--", at):
            then = page.find("-->", at + 4)
            at = size if then < 0 else then + 3
            continue
        tag = TAG.match(page, at)
        name_end, end = ends.find(tag.end() - 1) if tag else (-1, -1)
        if end < 0:
            if page[at + 1:at + 2] in ("!", "?", "/"):
                then = page.find(">", at)
                at = size if then < 0 else then + 1
            else:
                yield "<", None, None, False, False, False
                at += 1
            continue
        is_end = page[at + 1] == "/"
        name = page[tag.end() - 1:name_end].lower()
        attrs = page[name_end:end]
        at = end + 1
        if name in RAW_END and not is_end:
            closing = RAW_END[name].search(page, at)
            at = closing.end() if closing else size
            continue
        key, marked = kind(name, attrs)
        yield (None, name, key, is_end, marked and name not in ("html", "body"),
               name in VOID or attrs.endswith("/"))


def closed_tags(items: list) -> dict[int, int]:
    """Places of the start tags that an end tag of their own closes, with the place of that."""
    stack: list[tuple[str, int]] = []
    n_open: Counter[str] = Counter()
    closed = {}
    for i, (text, name, _, is_end, _, is_void) in enumerate(items):
        if text is not None or is_void:
            continue
        if not is_end:
            stack.append((name, i))
            n_open[name] += 1
        elif n_open[name]:
            while True:
                opened, start = stack.pop()
                n_open[opened] -= 1
                if opened == name:
                    break
            closed[start] = i
    return closed


def marked_article(items: list) -> str | None:
    """The element that holds the article, where a page's markup names exactly one."""
    n = {name: sum(1 for t, x, _, end, marked, _ in items
                   if x == name and not end and not marked) for name in ARTICLE}
    return next((name for name in ("article", "main") if n[name] == 1), None)


def around_article(items: list, closed: dict[int, int], holder: str | None
                   ) -> tuple[int, int, set[int]]:
    """Start and end of the marked article, and the places of the start tags around it."""
    if holder is None:
        return -1, -1, set()
    first = next(i for i, (_, name, _, is_end, marked, _) in enumerate(items)
                 if name == holder and not is_end and not marked)
    around = set()
    for i in range(first):
        text, name, _, is_end, _, is_void = items[i]
        if text is None and not is_end and not is_void and (
                closed[i] > first if i in closed else name not in OPTIONAL_END):
            around.add(i)
    return first, closed.get(first, len(items)), around


def furniture(items: list, outside_keys: frozenset[str] = frozenset()) -> list[bool]:
    """For each item whether it is page furniture: in an element whose tag, names or learned kind
    say so, or outside the one element that the page marks as its article.  Names and learned
    kinds don't speak for elements that hold that article, nor for html and body."""
    closed, holder = closed_tags(items), marked_article(items)
    around = around_article(items, closed, holder)[2]
    found = []
    stack: list[tuple[str, bool, bool]] = []
    n_open: Counter[str] = Counter()
    depth = in_article = 0          # furniture elements and article elements around this place
    open_ended = False              # in furniture that is never closed: lasts to the next block
    for i, (text, name, key, is_end, marked, is_void) in enumerate(items):
        if text is None and name in BLOCKS:
            open_ended = False
        shut = depth > 0 or open_ended or (holder is not None and not in_article)
        if text is not None or is_void:
            found.append(shut)
            continue
        if is_end:
            found.append(shut)
            while n_open[name]:
                opened, was_own, was_article = stack.pop()
                n_open[opened] -= 1
                depth -= was_own
                in_article -= was_article
                if opened == name:
                    break
            continue
        own = name in OUTSIDE_TAGS and not (name == "header" and in_article) and not (
            name in AROUND and i in around)
        if i not in around and name not in ("html", "body"):
            own = own or marked or key in outside_keys
        if own and i not in closed:
            found.append(True)
            open_ended = True
            continue
        if i in closed or name == holder:
            own_article = name == holder and not marked
            stack.append((name, own, own_article))
            n_open[name] += 1
            depth += own
            in_article += own_article
        found.append(shut or own)
    return found


def tag_counts(page: str) -> dict[str, list[int]] | None:
    """Tags inside and outside the article of a labelled page, without those inside furniture
    known by its name, and under the empty key the words of the longest text outside; None for a
    page that isn't labelled.  Tags around the article are not outside: those with a class, id or
    role count as inside, bare ones not at all."""
    items = list(scan(page))
    holder = marked_article(items)
    if holder is None:
        return None
    found: dict[str, list[int]] = {"": [0, 0]}
    first, last, around = around_article(items, closed_tags(items), holder)
    hidden: list[str] = []
    for i, (text, name, key, is_end, _, is_void) in enumerate(items):
        inside = first < i < last
        if text is not None:
            if not inside:
                found[""][1] = max(found[""][1], len(text.split()))
        elif i in (first, last) or name in ("html", "body"):
            continue
        elif i in around:
            if "." in key:
                found.setdefault(key, [0, 0])[0] += 1
        elif hidden and not inside:
            if name == hidden[-1] and is_end:
                hidden.pop()
        elif not is_end:
            found.setdefault(key, [0, 0])[0 if inside else 1] += 1
            if name in OUTSIDE_TAGS and not inside and not is_void:
                hidden.append(name)
    return found


def learn_weights(pages: DataFrame, html_column: str = "html", id_column: str = "page_id",
                  most_pages: int = 2000, url_column: str = "url") -> dict[str, float]:
    """Weights by kind of tag from the labelled ones of ``most_pages`` pages in hash order.

    A kind of tag that always stands outside weighs one more than the longest text seen there; one
    that always stands inside weighs next to nothing.
    """

    def count(batches):
        for batch in batches:
            rows = [(k, *v) for p in batch.column(0).to_pylist() if p
                    for k, v in (tag_counts(p) or {}).items()]
            keys, n_in, n_out = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(n_in, pa.int64()),
                 pa.array(n_out, pa.int64())], names=["key", "n_in", "n_out"])

    # the hash that the sample ends at is found on narrow rows; html is read for the sample alone
    order = F.xxhash64(F.col(id_column).cast("string"), F.col(url_column).cast("string"))
    last = pages.select(order.alias("order")).orderBy("order").limit(most_pages).agg(
        F.max("order")).first()[0]
    sample = pages.filter(order <= F.lit(last).cast("long")).select(
        F.col(html_column).cast("string").alias("html")).limit(most_pages)
    rows = sample.mapInArrow(count, "key string, n_in long, n_out long").groupBy("key").agg(
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"),
        F.max("n_out").alias("longest")).collect()          # the tags of that many pages
    most = 1.0 + max([r.longest for r in rows if r.key == ""], default=24)
    return {"": most} | {
        r.key: 0.01 + most * (r.n_out / (r.n_in + r.n_out)) ** 2 for r in rows if r.key}


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers too long to read are no character."""
    return entities.unescape(HUGE.sub("\ufffd", ZEROS.sub("&#0", text)))


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page."""
    if not page:
        return ""
    most = weights.get("", 25.0)
    items = list(scan(page))
    # only kinds with a class, id or role of their own: bare tags serve articles as well
    outside = furniture(items, frozenset(
        k for k, w in weights.items() if "." in k and w >= 0.75 * most))
    best = total = 0.0
    begin = first = 0
    last = -1
    for i, (text, name, key, _, _, _) in enumerate(items):
        if text is not None:
            score = 0.0 if outside[i] else float(len(text.split()))
        elif outside[i]:
            # its words are cut out below, so that passing it costs no more than a plain tag
            score = -0.25 if i == 0 or not outside[i - 1] else 0.0
        else:
            score = -min(weights.get(key, 0.25), most)
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, first, last = total, begin, i
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        block = " ".join(decoded("".join(held)).split())
        if block:
            blocks.append(block)
        held.clear()

    for i in range(first, last + 1):
        text, name = items[i][0], items[i][1]
        if text is not None:
            if not outside[i]:
                held.append(text)
        elif name in BLOCKS:
            flush()
        elif name == "br":
            held.append(" ")
    flush()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                  html_column: str = "html", weights: dict[str, float] | None = None,
                  most_labelled: int = 2000) -> DataFrame:
    """One row per input row: page_id, url, text and n_chars (its code points).

    Null and empty html, and pages without words outside page furniture, give an empty text.  Of
    stretches with equal sums the first is taken.  Null ids and repeated rows pass through; an
    empty table gives an empty result; other columns are not read; texts have no length limit.
    """
    known = weights if weights is not None else learn_weights(
        pages, html_column, id_column, most_labelled, url_column)

    def run(batches):
        for batch in batches:
            texts = [extract(p.as_py(), known) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
