"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, stored

#: Elements nested deeper count as part of the one at this depth; their text is kept there.
DEPTH = 200
#: Expressions of one host aligned in one task.
ALIGNED = 32
#: Pages a host needs before a text they share is taken for its template.
PAGES = 3
#: Wrappers are sent to all executors only if their stored table is no larger; otherwise they are joined.
BROADCAST_BYTES = 8 << 20

# How elements behave in HTML, and the words by which pages mark what is not the article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody
    td template textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset("""aside audio button canvas datalist dialog footer form head header iframe input label map menu nav noscript object
    script search select style svg template textarea title video""".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
           "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies copyright discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay
    pager pagination popup promo promoted promotion recommended related replies responses search share sharing sidebar signup social
    sponsor sponsored subscribe toolbar widget""".split())
# Words that add nothing to a mark beside them: "ad-box" is as sure as "ad", "share-price" is not.
NEUTRAL = frozenset("""area bar bars block bottom box button buttons container count form group inner item items left link links list panel right row
    section small thread title top wrap wrapper""".split())
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")

TEXT = "#"


#: How sure it is that an element is no part of an article: a class word of a text element is only a vote (WEAK).
WEAK, SURE = 1, 2


def _describe(tag: str, attributes: str) -> tuple[str, int]:
    """The token of an element, its tag with class and id without numbers, and how surely it is marked as no part of an article."""
    level = SURE if tag in NOT_ARTICLE else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag, level
    names = []
    for m in _NAMED.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id"):
            names += [re.sub("[0-9]+", "0", v) for v in value.split()]
            if tag in ("html", "body", "article", "main"):
                continue
            for v in value.split():
                parts = {p.lower() for p in _PART.findall(v)}
                if parts & MARKS:
                    level = max(level, WEAK if tag in PROSE and parts - MARKS - NEUTRAL else SURE)
        elif name == "role":
            level = SURE if value.lower() in ROLES else level
        elif name == "style":
            level = SURE if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else level
        elif name == "hidden" or value.lower() == "true":
            level = SURE
    return ".".join([tag, *sorted(set(names))]), level


def path_of(above: int, token: str) -> int:
    return xxhash.xxh64_intdigest(f"{above:x}>{token}".encode("utf-8", "surrogatepass"))


def text_digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def literal(digest: int) -> str:
    """The node of a text that belongs to the template."""
    return f"={digest:016x}"


def parse(page: str | None, seen: dict | None = None, constants: frozenset = frozenset()) -> tuple[list, list, bool]:
    """(tree, blocks, has_article) of a page.

    The tree holds [token, children] of block elements with TEXT for texts, or
    their ``literal`` where ``constants`` hold (path, digest). Each block is
    (path, level, in article, in main, text, beside): how surely it is marked,
    and the path above its element or, if marked, above the marked one. Missing
    end tags are implied as in HTML, text and marked inline elements keep their
    place. ``seen`` keeps what start tags mean from one page to the next.
    """
    seen = {} if seen is None or len(seen) > 100_000 else seen
    tree: list = ["", []]
    # open elements: tag, node, path, level, in article, in main, beside
    stack = [("", tree, 0, 0, False, False, 0)]
    blocks: list = []
    parts: list[str] = []
    has_article = False

    def flush():
        nonlocal parts
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            parts = []
            if text:
                _, node, path, level, article, main, beside = stack[-1]
                token = TEXT
                if constants and (path, digest := text_digest(text)) in constants:
                    token = literal(digest)
                if not node[1] or node[1][-1] != token:
                    node[1].append(token)
                blocks.append((path, level, article, main, text, beside))

    def close(i: int):
        flush()
        del stack[i:]

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            if m.group()[:9] == "<![CDATA[":
                parts.append(m.group()[9:-3] if m.group()[-3:] == "]]>" else m.group()[9:])
            continue
        if m.group(2) or m.group(5):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if tag not in ("option", "optgroup"):  # a paragraph ends where a block begins
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in HOLDERS.get(tag, ()):
                    break
                if stack[i][0] in CLOSES.get(tag, ()):
                    close(i)
                    if tag in ("td", "th", "li", "dt", "dd", "option"):
                        break
        if tag in VOID:
            continue
        start = (tag, m.group(4) or m.group(7) or "")
        if start not in seen:
            seen[start] = _describe(*start)
        token, level = seen[start]
        if m.group()[-2:] == "/>" and not block:
            continue
        if not block and not level:
            continue
        flush()
        _, node, path, was, article, main, beside = stack[-1]
        beside = beside if was >= max(level, WEAK) else path
        level = max(was, level)
        has_article = has_article or tag == "article" and not level
        if len(stack) >= DEPTH:
            stack.append((tag, node, path, level, article, main, beside))
            continue
        child: list = [token, []]
        node[1].append(child)
        if (path, token) not in seen:
            seen[path, token] = path_of(path, token)
        stack.append((tag, child, seen[path, token], level, article or tag == "article" and not level, main or tag == "main" and not level, beside))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return tree, blocks, has_article


# An expression is a list of nodes: TEXT for a slot, a literal for a text of the template, [token, nodes], ["+", nodes] for one or more
# times, ["?", nodes] for at most once.

def _key(node) -> str:
    """What a node starts with, for alignment: repeats and options count as what they hold, an element that is one literal as that."""
    while not isinstance(node, str) and node[0] in ("+", "?"):
        node = node[1][0]
    if isinstance(node, str):
        return node
    only = node[1][0] if len(node[1]) == 1 else TEXT
    return node[0] + only if isinstance(only, str) and only != TEXT else node[0]


def _joined(a, b):
    """The least general node for two nodes of one key."""
    kinds = [n[0] if not isinstance(n, str) and n[0] in ("+", "?") else "" for n in (a, b)]
    if not any(kinds):
        return a if isinstance(a, str) else [a[0], align(a[1], b[1])]
    bodies = [n[1] if k else [n] for n, k in zip((a, b), kinds)]
    body = align(*bodies) if len(bodies[0]) != 1 or len(bodies[1]) != 1 else [_joined(bodies[0][0], bodies[1][0])]
    if len(body) == 1 and not isinstance(body[0], str) and body[0][0] in ("+", "?"):
        return body[0]
    return ["+" if "+" in kinds else "?", body]


def fold(nodes: list) -> list:
    """Neighbouring runs of one, two or three nodes that start alike become one repeated group."""
    for period in (1, 2, 3):
        out: list = []
        for node in nodes:
            out.append(node)
            last = out[-period:]
            keys = [_key(n) for n in last]
            if len(out) <= period or period > 1 and len(set(keys)) == 1:
                continue
            group, before = out[-period - 1], out[-2 * period:-period]
            if period > 1 and not isinstance(group, str) and group[0] == "+" and [_key(n) for n in group[1]] == keys:
                out[-period - 1:] = [["+", [_joined(x, y) for x, y in zip(group[1], last)]]]
            elif len(before) == period and [_key(n) for n in before] == keys:
                both = [_joined(x, y) for x, y in zip(before, last)]
                if period > 1 or not isinstance(both[0], str) and both[0][0] not in ("+", "?"):
                    both = [["+", both]]
                elif not isinstance(both[0], str):
                    both = [["+", both[0][1]]]
                out[-2 * period:] = both
        nodes = out
    return nodes


def generalise(tree: list) -> list:
    """The expression of one page: its tree with repeated siblings folded."""
    return fold([n if isinstance(n, str) else [n[0], generalise(n[1])] for n in tree])


def align(a: list, b: list) -> list:
    """The expression of two: nodes of one key are joined, what only one side has becomes optional, then repeats are folded."""
    if a == b:
        return a
    out = []
    for what, i, j, k, n in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:j], b[k:n])]
        else:
            out += [x if not isinstance(x, str) and x[0] == "?" else ["?", [x]] for x in (*a[i:j], *b[k:n])]
    return fold(out)


def regular_expression(nodes: list) -> str:
    """An expression as text, for reading and for tests."""
    def one(n):
        if isinstance(n, str):
            return n
        inner = regular_expression(n[1])
        return f"({inner}){n[0]}" if n[0] in ("+", "?") else f"<{n[0]}>{inner}</>"

    return "".join(map(one, nodes))


def matches(nodes: list, tree: list) -> bool:
    """Whether an expression generates the children of ``tree``, checked with the possible positions after each node."""
    def after(node, seq, starts):
        if isinstance(node, str):
            return {i + 1 for i in starts if i < len(seq) and seq[i] == node}
        if node[0] == "?":
            return starts | through(node[1], seq, starts)
        if node[0] == "+":
            done, new = set(), through(node[1], seq, starts)
            while new - done:
                done |= new
                new = through(node[1], seq, new)
            return done
        return {i + 1 for i in starts if i < len(seq) and not isinstance(seq[i], str) and seq[i][0] == node[0] and matches(node[1], seq[i])}

    def through(body, seq, starts):
        for node in body:
            starts = after(node, seq, starts)
        return starts

    return len(tree[1]) in through(nodes, tree[1], {0})


def texts_of(nodes: list, above: int = 0, out: dict | None = None) -> dict[int, set]:
    """For the path of every text of an expression its nodes there: TEXT if it has a slot, and literals."""
    out = {} if out is None else out
    for n in nodes:
        if isinstance(n, str):
            out.setdefault(above, set()).add(n)
        else:
            texts_of(n[1], above if n[0] in ("+", "?") else path_of(above, n[0]), out)
    return out


def constants_of(texts: dict[int, set]) -> frozenset:
    """(path, digest) of the literals of a wrapper."""
    return frozenset((path, int(n[1:], 16)) for path, nodes in texts.items() for n in nodes if n != TEXT)


def page_texts(blocks: list) -> list[tuple[int, int, int, int, int]]:
    """(path, level, beside, digest, chars) of the different texts of a page."""
    return sorted({(path, level, beside, text_digest(text), len(text)) for path, level, _, _, text, beside in blocks})


def kept_paths(slots: pd.DataFrame) -> list[int]:
    """Paths whose slots hold article text, of (path, level, beside, texts, pages) of one host.

    Slots that nothing marks are kept, surely marked ones are not. A class word
    in a text element is one vote against it; the wrapper outvotes it where the
    text varies over three or more pages and so does a slot beside it that
    nothing marks. On hosts of fewer pages the class word decides.
    """
    free = slots[slots["level"] == 0]
    varying = set(free["beside"][free["texts"] > 1])
    outvoted = (slots["level"] == WEAK) & (slots["texts"] > 1) & (slots["pages"] >= PAGES) & slots["beside"].isin(varying)
    return sorted({*free["path"], *slots["path"][outvoted]})


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _unsigned(x: int) -> int:
    return x & (1 << 64) - 1


def _as_json(nodes: list) -> str:
    return json.dumps(nodes, separators=(",", ":"))


def _fact_batches(batches):
    """Per page: host, expression, its different texts, and a digest of those that are not surely marked."""
    slot = pa.list_(pa.struct([(n, pa.int64()) for n in ("path", "level", "beside", "digest", "chars")]))
    seen: dict = {}
    for batch in batches:
        hosts, shapes, slots, texts = [], [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree, blocks, _ = parse(page, seen)
            of = page_texts(blocks)
            hosts.append(host_of(url))
            shapes.append(_as_json(generalise(tree[1])))
            slots.append([{"path": _signed(p), "level": n, "beside": _signed(b), "digest": _signed(d), "chars": c} for p, n, b, d, c in of])
            texts.append(_signed(xxhash.xxh64_intdigest(repr([(p, d) for p, n, _, d, _ in of if n < SURE]).encode())))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(slots, slot), pa.array(texts, pa.int64())],
                                         names=["host", "shape", "slots", "texts"])


def _shape_batches(batches):
    """Per page its host and its expression with the constants of the host as literals."""
    seen: dict = {}
    for batch in batches:
        shapes = [_as_json(generalise(parse(page, seen, frozenset((_unsigned(c["path"]), _unsigned(c["digest"])) for c in constants))[0][1]))
                  for page, constants in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], names=["host", "shape"])


def _constants(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """(host, constants): the texts of a host's template, of hosts that have any.

    A text is constant if all pages that have its path have it there, three or
    more pages and at least half of the host's. Where constants are more than
    half of what the pages say, the pages are versions of one article, and
    nothing is. There are no more constants than a page has texts, so the list is short.
    """
    here = texts.where(F.col("level") < SURE).join(paths, ["host", "path"])
    constant = (F.col("n") == F.col("pages")) & (F.col("n") >= PAGES) & (2 * F.col("n") >= F.col("host_pages"))
    return (here.groupBy("host").agg(F.sum("chars").alias("all"), F.coalesce(F.sum(F.when(constant, F.col("chars"))), F.lit(0)).alias("same"),
                                     F.collect_set(F.when(constant, F.struct("path", "digest"))).alias("constants"))
            .where((2 * F.col("same") <= F.col("all")) & (F.size("constants") > 0)).select("host", "constants"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, slots): the inferred expression of each host as JSON, and the paths whose slots hold article text.

    Texts that are the same on all pages become literals of the expression, all
    others slots, so a line that every page of a site repeats is told from the paragraphs around it.
    Pages of a host with one expression count once, so a host with a third of all
    pages moves no more rows than it has different expressions per task. These are aligned in groups of at most
    about ALIGNED until one is left, so no task gets a whole host. Pages with the same texts are one page for the slots.
    """
    facts = stored(pages.select("url", "html").mapInArrow(
        _fact_batches, "host string, shape string, slots array<struct<path: long, level: long, beside: long, digest: long, chars: long>>, texts long"), "facts")
    different = stored(facts.groupBy("host", "texts").agg(F.min("slots").alias("slots")).select("host", "slots"), "different")
    host_pages = different.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    paths = (different.select("host", F.explode(F.array_distinct(F.transform("slots", lambda s: s["path"]))).alias("path"))
             .groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")).join(host_pages, "host"))
    texts = stored(different.select("host", F.inline("slots")).groupBy("host", "path", "level", "beside", "digest")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "texts")
    constants = stored(_constants(texts, paths), "constants")

    marked = pages.select(_host().alias("host"), "html").join(constants, "host").select("host", "html", "constants")
    shapes = facts.select("host", "shape").join(constants, "host", "left_anti").unionAll(marked.mapInArrow(_shape_batches, "host string, shape string"))

    def merged(key, part):
        out = json.loads(part["shape"].min())
        for shape in sorted(set(part["shape"])):
            out = align(out, json.loads(shape))
        return pd.DataFrame({"host": [key[0]], "shape": [_as_json(out)]})

    left = stored(shapes.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages")).select("host", "shape"), "expressions")
    while True:
        counts = left.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / ALIGNED).alias("groups"))
        many = not counts.where("groups > 1").isEmpty()
        dealt = left.join(counts, "host").withColumn("g", F.pmod(F.xxhash64("shape"), F.col("groups")))
        left = stored(dealt.groupBy("host", "g").applyInPandas(merged, "host string, shape string"), "expressions")
        if not many:
            break
    slots = texts.groupBy("host", "path", "level", "beside").agg(F.count(F.lit(1)).alias("texts")).join(paths, ["host", "path"])

    def ruled(key, expression, part):
        nodes = json.loads(expression["shape"].iloc[0]) if len(expression) else []
        return pd.DataFrame({"host": [key[0]], "wrapper": [_as_json(nodes)], "slots": [kept_paths(part)]})

    return left.groupBy("host").cogroup(slots.groupBy("host")).applyInPandas(ruled, "host string, wrapper string, slots array<long>")


def main_text(page: str | None, texts: dict[int, set], kept: set[int], seen: dict | None = None, constants: frozenset | None = None) -> str:
    """The blocks of a page that its wrapper places in the article, joined by an empty line.

    ``texts`` are the ``texts_of`` the wrapper. A block counts if it fills a slot
    of the wrapper, is none of its literals, and the path is one of ``kept``.
    An article element, else a main element, narrows this to what is below it.
    """
    _, blocks, has_article = parse(page, seen)
    constants = constants_of(texts) if constants is None else constants
    free = [b for b in blocks if b[1] < SURE and b[0] in kept and TEXT in texts.get(b[0], ())
            and not (constants and (b[0], text_digest(b[4])) in constants)]
    if has_article:
        free = [b for b in free if b[2]]
    elif any(b[3] for b in blocks):
        free = [b for b in free if b[3]]
    return "\n\n".join(b[4] for b in free)


def _text_batches(batches):
    known: dict[str, tuple] = {}
    seen: dict = {}
    for batch in batches:
        out = []
        for page, wrapper, slots in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            if wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                texts = texts_of(json.loads(wrapper))
                known[wrapper] = texts, constants_of(texts)
            texts, constants = known[wrapper]
            out.append(main_text(page, texts, {_unsigned(p) for p in slots}, seen, constants))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))


def extract(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``.

    ``rules`` are ``wrappers`` of these pages unless given. Null and empty pages
    have an empty text, pages without a host share the wrapper of the empty
    host. Copies of a page count once, so a host of nothing but copies, or of one or two pages,
    has no template text. Repeated rows and null ids stay; further columns are ignored. Wrappers
    are sent to the pages if their stored table is small, else joined by host,
    which adaptive execution may split where one host has most pages.
    """
    bound_batches(pages.sparkSession)
    rules = stored(wrappers(pages) if rules is None else rules, "wrappers")
    size = rules.agg(F.coalesce(F.sum(F.length("wrapper") + 8 * F.size("slots") + F.length("host")), F.lit(0))).first()[0]
    joined = pages.select("page_id", "url", "html", _host().alias("host")).join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host", "left")
    return joined.select("page_id", "url", "html", F.coalesce("wrapper", F.lit("[]")), F.coalesce("slots", F.array().cast("array<long>"))).mapInArrow(
        _text_batches, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")
