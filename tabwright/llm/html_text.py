"""Main text of web pages by template deduction from equivalence classes.

A page is a run of tokens: tags with their path of elements, and short texts with their path. On a host, a token's occurrence
vector is how often it occurs on each page; tokens with the same vector form an equivalence class, and classes on enough of
the pages are the template's. Vectors are never built: every page adds a keyed hash of (page, count) to its tokens, so equal
vectors are equal sums, and a host may hold any share of the pages. Classes nest by their paths into the host's template;
what remains between template tokens are slots, and the article's slots, without those of menus, adverts and the like, are
the text. The pages that do not fit a host's template are fitted again among themselves, so a host may have several. A page
that fits none, or of a host with too few pages, falls back on the page's own elements.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.bpe import blocks
from tabwright.llm.common import hot_join, row_id, store

#: A class belongs to the template if it is on this share of a host's pages, on so many pages at least, with so many tokens.
SUPPORT, LEAST_PAGES, LEAST_TOKENS = 0.5, 3, 2
#: The text's container holds this share of the text outside boilerplate, where no element says that it is the article.
TEXT_SHARE = 0.6
#: The template's texts inside the article's container are its, unless they make up more than this share of the text there: then
#: the pages are issues of one article.
COPIED_SHARE = 0.25
#: Elements beyond this depth add nothing to a path.
DEPTH = 40
#: Tokens a task sums before it hands them on.
SUMMED_TOKENS = 200_000
#: Longer class, id and role values are shortened to so many characters and a hash of the whole.
SHOWN_VALUE = 60

#: Element names of the HTML standard by their part in a page. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rb rp rt s samp small"
    " span strike strong sub sup time tt u var wbr img input br area base col embed link meta param source track".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption option legend summary hr address pre".split())
HIDDEN = ("script", "style", "noscript", "template", "iframe", "svg", "math", "select", "textarea", "object", "title")
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words of classes, ids and roles that mark boilerplate, and the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent"
    " contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices"
    " overlay pager pagination popup promo recommended related reply replies search share sharing sidebar signup social"
    " sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Of these, words for other people's or other articles' text, which may well be longer than the article.
FOREIGN_WORDS = frozenset("comment comments disqus recommended related replies reply teaser".split())
ARTICLE_WORDS = frozenset("article articlebody content entry main maincontent post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(HIDDEN)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/>]|$)|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")


def host_of(url: str | None) -> str:
    """Lower-case host of a URL, without user and port; empty if there is none."""
    match = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return match.group(1).rpartition("@")[2].partition(":")[0].lower() if match else ""


def _shown(value: str) -> str:
    value = re.sub(r"\d+", "0", value)
    if len(value) <= SHOWN_VALUE:
        return value
    return value[:SHOWN_VALUE] + "~" + hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _label(name: str, attributes: str) -> tuple[str, int, bool, frozenset[str]]:
    """An element's label in paths, whether it is boilerplate (2 by name or hidden, 1 by a word), whether it may be the article,
    and its boilerplate words."""
    words: list[str] = []
    shown = name
    if "=" in attributes:
        for key, *values in _NAMED.findall(attributes):
            value = "".join(values)
            words += [w.lower() for w in _WORD.findall(value)]
            shown += {"class": ".", "id": "#", "role": "@"}[key.lower()] + _shown(value)
    article = name in ("article", "main") or (name not in BOILERPLATE and not ARTICLE_WORDS.isdisjoint(words))
    found = BOILERPLATE_WORDS.intersection(words)
    boilerplate = 2 if name in BOILERPLATE or _HIDDEN.search(attributes) else int(bool(found))
    return shown, boilerplate, article and boilerplate < 2, found


def events(page: str):
    """('open', path, boilerplate, article, words), ('close', path), ('leaf', path, name, hidden) and ('text', path, text) of a
    page in order.

    Paths are tuples of labels. Hidden elements and comments are left out. Paragraphs and the like are leaves: they need no end
    tag and do not nest. An end tag closes the innermost element of its name, and what is open inside; a stray one is nothing.
    """
    stack: list[str] = []
    names: list[str] = []
    waiting: Counter = Counter()
    path: tuple[str, ...] = ()
    at = 0
    for match in _TOKEN.finditer(page):
        if match.start() > at:
            yield ("text", path, page[at : match.start()])
        at = match.end()
        name = (match.group(3) or match.group(6) or "").lower()
        if not name:
            if match.group(1):
                yield ("leaf", path, match.group(1).lower(), False)
            continue
        if name in INLINE:
            if name in ("br", "input", "img"):
                yield ("text", path, " ")
            continue
        closing = match.group(2) or match.group(5)
        attributes = match.group(4) or match.group(7) or ""
        if name in LEAVES or name in HIDDEN:
            yield ("leaf", path, ("/" if closing else "") + name, not closing and bool(_HIDDEN.search(attributes)))
            continue
        if closing:
            if waiting[name]:
                while True:
                    last = names.pop()
                    waiting[last] -= 1
                    stack.pop()
                    yield ("close", path)
                    path = tuple(stack[:DEPTH])
                    if last == name:
                        break
            else:
                yield ("leaf", path, "/" + name, False)
            continue
        shown, boilerplate, article, words = _label(name, attributes)
        names.append(name)
        waiting[name] += 1
        stack.append(shown)
        path = tuple(stack[:DEPTH])
        yield ("open", path, boilerplate, article, words)
        if attributes.rstrip().endswith("/"):
            names.pop()
            waiting[name] -= 1
            stack.pop()
            yield ("close", path)
            path = tuple(stack[:DEPTH])
    if at < len(page):
        yield ("text", path, page[at:])


class _Elements:
    """A page's elements in the order of their start tags, with their parents and the letters of text inside each."""

    def __init__(self, stream: list[tuple]):
        self.paths: list[str] = []
        self.parent: list[int] = []
        self.boilerplate: list[int] = []
        self.article: list[bool] = []
        self.words: list[frozenset[str]] = []
        self.mass: list[int] = []
        self.whole = 0
        open_: list[int] = []
        hard = 0
        hidden = False
        for kind, path, *more in stream:
            if kind == "text":
                if not hard and not hidden:
                    n = len(plain(more[0]))
                    self.whole += n
                    if open_:
                        self.mass[open_[-1]] += n
                continue
            hidden = kind == "leaf" and more[1]
            if kind == "open":
                self.parent.append(open_[-1] if open_ else -1)
                self.paths.append(">".join(path))
                self.boilerplate.append(more[0])
                self.article.append(more[1])
                root = path[-1].split(".")[0].split("#")[0].split("@")[0] in ("html", "body")
                self.words.append(more[2] if more[0] == 1 and not root else frozenset())
                self.mass.append(0)
                open_.append(len(self.paths) - 1)
                hard += more[0] == 2
            elif kind == "close" and open_:
                hard -= self.boilerplate[open_.pop()] == 2
        for e in range(len(self.paths) - 1, -1, -1):
            if self.parent[e] >= 0:
                self.mass[self.parent[e]] += self.mass[e]

    def handed_down(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it has the property."""
        out: list[bool] = []
        for e, has in enumerate(own):
            out.append(has or (self.parent[e] >= 0 and out[self.parent[e]]))
        return out

    def innermost(self, some: set[int]) -> set[int]:
        """Those that hold no other of them."""
        holding: set[int] = set()
        for e in sorted(some, reverse=True):
            up = self.parent[e]
            while up >= 0 and up not in holding:
                holding.add(up)
                up = self.parent[up]
        return some - holding

    def around(self, some: set[int]) -> set[int]:
        """These elements and all around them."""
        out: set[int] = set()
        for e in some:
            while e >= 0 and e not in out:
                out.add(e)
                e = self.parent[e]
        return out


def marks(stream: list[tuple], container: str = "") -> tuple[set[int], set[int]]:
    """The numbers of a page's articles, and of the elements that a word closes as boilerplate, in the order of start tags.

    The template's container, if the page has it, is the article. A word never closes html, body, or what is around the
    article. An article with such a word is one if it holds most text of the page, or of the article around it; on a page
    with no other article, any element that holds most text stays open. Inside the article, or on a page without one, a word
    that would close most of the text closes nothing, unless it is a word for other people's or other articles' text.
    """
    page = _Elements(stream)
    numbers = range(len(page.paths))
    closed = {e for e in numbers if page.words[e]}
    named = {e for e in numbers if page.article[e]}
    free = {e for e in numbers if container and page.paths[e] == container}
    if not free:
        under = page.handed_down([e in closed for e in numbers])
        free = page.innermost({e for e in named if not under[e]})
    closed -= page.around(free)
    if free:
        own = [e in free for e in numbers]
        holder: list[int] = []
        for e in numbers:
            holder.append(e if own[e] else holder[page.parent[e]] if page.parent[e] >= 0 else -1)
        most = {e for e in closed & named if holder[e] >= 0 and page.mass[e] >= TEXT_SHARE * page.mass[holder[e]]}
        closed -= page.around(most)
    else:
        holder = [-1] * len(page.paths)
        closed -= {e for e in closed if page.whole and page.mass[e] >= TEXT_SHARE * page.whole}
        under = page.handed_down([e in closed for e in numbers])
        free = page.innermost({e for e in named if not under[e]})
    return free, _trusted(page, closed, holder)


def _trusted(page: _Elements, closed: set[int], holder: list[int]) -> set[int]:
    """Of the closed elements those with a word that closes only a smaller part of the article, or of the page, that holds them."""
    sums: dict[tuple[int, str], int] = {}
    above: dict[int, frozenset[str]] = {}  # the words of closed elements from an element upwards
    for e in range(len(page.paths)):
        words = above.get(page.parent[e], frozenset())
        if e in closed:
            for word in page.words[e] - words:
                sums[(holder[e], word)] = sums.get((holder[e], word), 0) + page.mass[e]
            words = words | page.words[e]
        if words:
            above[e] = words

    def closes(e: int, word: str) -> bool:
        within = page.mass[holder[e]] if holder[e] >= 0 else page.whole
        return word in FOREIGN_WORDS or sums.get((holder[e], word), 0) < TEXT_SHARE * within

    return {e for e in closed if any(closes(e, word) for word in page.words[e])}


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def text_token(path: tuple[str, ...], text: str) -> str:
    return ">".join(path) + "|" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def page_tokens(page: str) -> tuple[Counter, dict[str, int], dict[str, int]]:
    """A page's tokens with their counts, their first places, and the letters of text right under each path and of each text."""
    counts: Counter = Counter()
    first: dict[str, int] = {}
    letters: dict[str, int] = {}
    shut, kinds = 0, []  # closed elements around a place, and whether each open element is one
    parts: list[str] = []
    where: tuple[str, ...] = ()

    def add(token: str, place: int):
        counts[token] += 1
        first.setdefault(token, place)

    def flush(place: int):
        text = plain("".join(parts))
        parts.clear()
        if text:
            token = text_token(where, text)
            add(token, place)
            if not shut:
                for name in (">".join(where) + "=", token):
                    letters[name] = letters.get(name, 0) + len(text)

    # blocks of text are those of slots(): what stands between tags that are not inline
    place, number, hidden = 0, 0, False
    stream = list(events(page))
    named, closed = marks(stream)
    for place, (kind, path, *more) in enumerate(stream):
        if kind == "text":
            if not hidden:
                parts.append(more[0])
            where = path
            continue
        flush(place)
        hidden = kind == "leaf" and more[1]
        if kind == "leaf":
            add(">".join(path) + ">" + more[0], place)
        elif kind == "open":
            shut += more[0] == 2 or number in closed
            kinds.append(more[0] == 2 or number in closed)
            add(">".join(path) + ("+*" if number in named else "+"), place)
            number += 1
        else:
            add(">".join(path) + "-", place)
            if kinds:
                shut -= kinds.pop()
        where = path
    flush(place)
    return counts, first, letters


def _mixed(row: int, count: int) -> int:
    digest = hashlib.blake2b(f"{row}|{count}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def fits(page: str, containers: list[str]) -> int:
    """The first of the containers that a page has, -1 if there is none."""
    if not containers:
        return -1
    paths = {">".join(e[1]) for e in events(page) if e[0] == "open"}
    return next((i for i, c in enumerate(containers) if c in paths), -1)


def token_sums(pages: DataFrame) -> DataFrame:
    """(host, token, pages, total, vector, place, letters) summed per task; the token '' counts a host's pages.

    Pages that have one of their host's `_containers`, if such a column is there, are left out.
    """
    known = "_containers" in pages.columns
    schema = "host string, token string, pages long, total long, vector long, place long, letters long"

    def run(batches):
        sums: dict[tuple[str, str], list[int]] = {}

        def flushed():
            hosts, tokens = zip(*sums.keys())
            columns = list(zip(*sums.values()))
            arrays = [pa.array(hosts, pa.string()), pa.array(tokens, pa.string()), *[pa.array(c, pa.int64()) for c in columns]]
            return pa.RecordBatch.from_arrays(arrays, names=["host", "token", "pages", "total", "vector", "place", "letters"])

        def add(host, token, total, vector, place, letters):
            old = sums.get((host, token))
            if old is None:
                sums[(host, token)] = [1 if total else 0, total, vector, place, letters]
            else:
                old[0] += 1 if total else 0
                old[1] += total
                old[2] ^= vector
                old[3] += place
                old[4] += letters

        for whole in batches:
            for batch in blocks(whole, "_html"):
                containers = batch.column("_containers").to_pylist() if known else [None] * batch.num_rows
                rows = zip(*(batch.column(c).to_pylist() for c in ("_row", "_host", "_html")), containers)
                for row, host, page, found in rows:
                    if fits(page, found or []) >= 0:
                        continue
                    counts, first, letters = page_tokens(page)
                    vectors: dict[int, int] = {}
                    add(host, "", 1, 0, 0, 0)
                    for token, n in counts.items():
                        if n not in vectors:
                            vectors[n] = _mixed(row, n)
                        add(host, token, n, vectors[n], first[token], letters.pop(token, 0))
                    for path, n in letters.items():
                        add(host, path, 0, 0, 0, n)
                    if len(sums) > SUMMED_TOKENS:
                        yield flushed()
                        sums.clear()
        if sums:
            yield flushed()

    summed = pages.mapInArrow(run, schema)
    return summed.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"),
        F.sum("total").alias("total"),
        F.bit_xor("vector").alias("vector"),
        F.sum("place").alias("place"),
        F.sum("letters").alias("letters"),
    )


def main_container(tokens: list[str], once: set[str], letters: dict[str, int]) -> str:
    """The path of the article's container in a template: tokens in order, `once` those that each page has once."""
    opened = [t for t in tokens if t.rstrip("*").endswith("+") and t in once]
    mass = {t.rstrip("*")[:-1]: 0 for t in opened}
    for q, n in letters.items():
        steps = q.split(">")
        for i in range(1, len(steps) + 1):
            p = ">".join(steps[:i])
            if p in mass:
                mass[p] += n
    total = sum(letters.values())
    best = ""
    for path, inside in mass.items():
        if total and inside >= TEXT_SHARE * total and len(path) > len(best):
            best = path
    paths = [t[:-2] for t in opened if t.endswith("*")]
    around = {p.rsplit(">", i)[0] for p in paths for i in range(1, p.count(">") + 1)}
    inner = [p for p in paths if p not in around]
    # a mark decides how wide the container is, unless the text is elsewhere
    inner = [p for p in inner if p == best or p.startswith(best + ">") or best.startswith(p + ">") or not best]
    return max(inner, key=lambda p: (mass[p], p)) if inner else best


def templates(sums: DataFrame) -> DataFrame:
    """(host, pages, container, fixed, template): a host's container of the article and its template's texts, hosts with a template only.

    Classes are the tokens of a host with the same pages, total and vector. A class is valid if it is frequent and large
    enough. A host's tokens of valid classes are at most the pages' mean length over SUPPORT.
    """
    hosts = sums.filter("token = ''").select("host", F.col("pages").alias("host_pages"))
    frequent = sums.filter((F.col("pages") >= LEAST_PAGES) & (F.col("token") != "")).join(hosts, "host")
    frequent = frequent.filter(F.col("pages") >= F.col("host_pages") * SUPPORT)
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "letters")
    classes = frequent.groupBy("host", "host_pages", "pages", "total", "vector").agg(F.collect_list(member).alias("members"))
    classes = classes.filter(F.size("members") >= LEAST_TOKENS)
    classes = classes.groupBy("host", "host_pages").agg(
        F.collect_list(F.struct("members", "pages", (F.col("total") == F.col("pages")).alias("once"))).alias("classes")
    )
    # a path carries text on few pages or many; a host has at most as many paths with open tags in its template
    mass = sums.filter("letters > 0 AND token LIKE '%='").join(hosts, "host").filter(F.col("letters") >= F.col("host_pages"))
    mass = mass.groupBy("host").agg(F.collect_list(F.struct("token", "letters")).alias("mass"))
    made = "host string, pages long, container string, fixed array<string>, template string"

    def nest(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                members = sorted(((m["place"], m["token"], c["once"]) for c in row["classes"] for m in c["members"]))
                tokens = [t for _, t, _ in members]
                once = {t for _, t, o in members if o}
                letters = {m["token"][:-1]: m["letters"] for m in row["mass"] or []}
                container = main_container(tokens, once, letters)
                inside = lambda path: path == container or path.startswith(container + ">")
                texts = [(m["token"], m["letters"]) for c in row["classes"] for m in c["members"] if "|" in m["token"]]
                fixed = [t for t, _ in texts if not inside(t.rpartition("|")[0])]
                own = [(t, n) for t, n in texts if inside(t.rpartition("|")[0])]
                if sum(n for _, n in own) <= COPIED_SHARE * sum(n for p, n in letters.items() if inside(p)):
                    fixed += [t for t, _ in own]
                fixed.sort()
                rows.append((row["host"], row["host_pages"], container, fixed, "\n".join(tokens)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("host", "pages", "container", "fixed", "template"), r)) for r in rows],
                schema=pa.schema(
                    [("host", pa.string()), ("pages", pa.int64()), ("container", pa.string()), ("fixed", pa.list_(pa.string())), ("template", pa.string())]
                ),
            )

    return classes.join(mass, "host", "left").mapInArrow(nest, made)


def slots(page: str, container: str, fixed: frozenset[str]) -> list[tuple[str, str, bool]]:
    """(path, text, article) of a page's blocks in order: article says whether the block is part of the text.

    Blocks are what stands between tags that are not inline; text of the template is no slot.
    """
    found: list[tuple[str, str, bool]] = []
    stream = list(events(page))
    marked, closed = marks(stream, container)
    parts: list[str] = []
    kinds: list[bool] = []
    own: list[int] = []
    inside = shut = number = 0
    hidden = False
    where: tuple[str, ...] = ()

    def flush():
        text = plain("".join(parts))
        parts.clear()
        if text:
            boilerplate = shut > 0 or (not inside and bool(marked))
            kept = not boilerplate and text_token(where, text) not in fixed
            found.append((">".join(where), text, kept))
            if inside and not boilerplate:
                own.append(len(found) - 1)

    for kind, path, *more in stream:
        if kind == "text":
            if not hidden:
                parts.append(more[0])
            where = path
            continue
        flush()
        hidden = kind == "leaf" and more[1]
        if kind == "open":
            if inside or number in marked:
                inside += 1
            # a header of the page is boilerplate, the header of the article is not
            header = path[-1].split(".")[0].split("#")[0] == "header" and not inside
            kinds.append(more[0] == 2 or number in closed or header)
            shut += kinds[-1]
            number += 1
        elif kind == "close":
            if kinds:
                shut -= kinds.pop()
            inside = max(0, inside - 1)
        where = path
    flush()
    if not any(article for _, _, article in found):  # nothing but the template: what is in the container stands
        for at in own:
            found[at] = (*found[at][:2], True)
    return found


def main_text(page: str, container: str = "", fixed: frozenset[str] = frozenset()) -> str:
    return "\n".join(text for _, text, article in slots(page, container, fixed) if article)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, container of every row of (page_id, url, html).

    Null html is an empty page: empty text, 0 characters. Pages with no host (null or relative urls) share the host ''. Rows
    with the same page id are rows of their own. Pages without any marked article and without a template give all text
    outside boilerplate. Other columns are not looked at.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    rows = pages.select(
        "page_id", "url", host.alias("_host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"), row_id().alias("_row")
    )
    total = rows.count()

    def with_templates(found: DataFrame, *columns: str) -> DataFrame:
        return hot_join(rows, found, ["_host"], "_pages", total).select(*columns)

    found, left, n = None, rows.select("_row", "_host", "_html"), 0
    while True:
        # a container is on half of the pages left at least, so each round halves a host's pages that fit none
        new = templates(store(token_sums(left), "html-tokens"))
        new = new.withColumn("round", F.lit(n))
        if found is not None:  # a host goes on only while it finds containers
            new = new.filter("container <> ''")
        new = store(new, "html-templates")
        grown = not new.filter("container <> ''").isEmpty()
        found = new if found is None else found.unionByName(new)
        if not grown:
            break
        n += 1
        hosts = found.groupBy(F.col("host").alias("_host")).agg(
            F.max("pages").alias("_pages"), F.array_sort(F.collect_list(F.when(F.col("container") != "", F.struct("round", "container")))).alias("_found")
        )
        going = new.filter("container <> ''").select(F.col("host").alias("_host"))
        hosts = hosts.join(going, "_host", "left_semi").select("_host", "_pages", F.col("_found.container").alias("_containers"))
        left = with_templates(store(hosts, "html-hosts"), "_row", "_host", "_html", "_containers").filter("_containers IS NOT NULL")
    kinds = F.array_sort(F.collect_list(F.struct("round", "container", "fixed")))
    hosts = found.groupBy(F.col("host").alias("_host")).agg(F.max("pages").alias("_pages"), kinds.alias("_kinds"))
    hosts = hosts.select("_host", "_pages", F.col("_kinds.container").alias("containers"), F.col("_kinds.fixed").alias("fixed"))
    joined = with_templates(store(hosts, "html-hosts"), "page_id", "url", "_host", "_html", "containers", "fixed")
    made = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("container", T.StringType())]
    kept = [joined.schema["page_id"], joined.schema["url"]]

    def run(batches):
        sets: dict[str, tuple[list[frozenset[str]], frozenset[str]]] = {}
        for whole in batches:
            for batch in blocks(whole, "_html"):
                texts, used = [], []
                names = ("_host", "_html", "containers", "fixed")
                for host, page, containers, fixed in zip(*(batch.column(c).to_pylist() for c in names)):
                    if host not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        own = [frozenset(texts_of) for texts_of in fixed or []]
                        sets[host] = (own, frozenset().union(*own))
                    at = fits(page, containers or [])
                    used.append(containers[at] if at >= 0 else "" if containers else None)
                    texts.append(main_text(page, used[-1] or "", sets[host][0][at] if at >= 0 else sets[host][1]))
                columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
                columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "container"])

    return joined.mapInArrow(run, T.StructType(kept + made))
