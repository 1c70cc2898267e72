"""Main text of web pages by consensus host paths.

Each page is cut into blocks of text with their tag paths. A path names every open element by tag
and classes with digits and long tokens generalised. A page votes for the container path that
scores best by its text, links and paragraphs; votes are summed per host in Spark. The host's path is
widened while its parent adds text that is not mostly links, and the page is extracted again with
it, or with its own best path, widened likewise, where the host's covers little of the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import stored

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object",
       "math", "canvas", "select", "option", "xmp", "noembed", "noframes")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr nobr".split())
DROPPED = frozenset("nav header footer aside button dialog menu head fieldset input".split())
# Words of class names and ids that mark what is not main text, words that go with them without
# meaning anything, and words that make a name a flag of the layout around it.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice "
    "notices popup modal newsletter subscribe signup share sharing social related recommended comment "
    "comments commentlist disqus discussion reply replies respond responses widget toolbar pagination pager "
    "login "
    "search alert toc skip copyright legal disclaimer".split())
PLAIN = frozenset(
    "area bar block bottom box button buttons center col column container content form group icon icons "
    "inner item items label left link links list main module outer overlay panel posts right row section "
    "slot thread title to top unit wrap wrapper".split())
FLAGS = frozenset("has no with without".split())
# Words that name what readers have written, however much of the page it is.
READERS = frozenset("comments commentlist disqus replies respond responses".split())
STRONG, WEAK = 0.95, 0.5
LINKED, COVERED = 0.25, 0.1
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert "
                  "alertdialog menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(
    r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}
# An opening tag that ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 "
                   "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol dl table div article section main aside nav form body".split())
SPACE = re.compile(r"\s+")


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """``tag.class.class`` with digits as 0 and classes sorted; long or hashed tokens are left out.
    """
    names = sorted({re.sub(r"\d+", "0", c.lower()) for c in attributes.get("class", "").split()
                    if len(c) <= 30})
    return ".".join([tag, *names[:4]])


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


def marked(tag: str, attributes: dict[str, str]) -> tuple[bool, str] | None:
    """Whether the class or id of an element says that it is not main text: (surely, its name).

    Surely where one name says nothing else (``comment-list``); not surely where other words go with
    the mark (``legal-news``). Names like ``has-sidebar`` are flags of the layout. A form is marked,
    not surely, whatever its name: it may be one around the whole page.
    """
    if tag in ("body", "html", "main", "article"):
        return None
    found = [False] if tag == "form" else []
    for key in ("class", "id"):
        for name in attributes.get(key, "").lower().replace("side-bar", "sidebar").split():
            words = [w for w in re.split(r"[-_\d]+", name) if w]
            if MARKS.intersection(words) and words[0] not in FLAGS:
                found.append(all(w in MARKS or w in PLAIN for w in words))
    if not found:
        return None
    name = re.sub(r"\d+", "0", attributes.get("id", ""))
    return any(found), f"{generalised(tag, attributes)}#{name}"


def readers(attributes: dict[str, str]) -> bool:
    """Whether a class or id says that readers have written what is in an element.

    The name begins or ends with the word for it, other words (``user-comments``, ``comments-area``)
    aside from flags (``has-comments``, ``comments-open``).
    """
    for key in ("class", "id"):
        for name in attributes.get(key, "").lower().split():
            words = [w for w in re.split(r"[-_\d]+", name) if w]
            if words and words[0] not in FLAGS and (words[-1] in READERS or (
                    words[0] in READERS and all(w in MARKS or w in PLAIN for w in words))):
                return True
    return False


def dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element and all in it is not main text."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if tag != "a":
        return tag not in INLINE and readers(attributes)
    mark = marked(tag, attributes)
    return mark is not None and mark[0]


class Block:
    """A piece of text between block boundaries: path of its elements, text, text inside links, marks
    of its elements."""

    __slots__ = ("path", "text", "linked", "tag", "marks")

    def __init__(self, path, text, linked, tag, marks):
        self.path, self.text, self.linked, self.tag, self.marks = path, text, linked, tag, marks


def without_marked(blocks: list[Block]) -> list[Block]:
    """Blocks without those in marked elements, unless these hold the page's text.

    Elements of one name count together. They stay when they hold more than ``STRONG`` of the text
    outside links, or, where the mark is not sure, more than ``WEAK`` of what is left then.
    """
    for sure, least in ((True, STRONG), (False, WEAK)):
        held: dict[tuple[bool, str], int] = defaultdict(int)
        total = 0
        for block in blocks:
            total += len(block.text) - block.linked
            for mark in block.marks:
                held[mark] += len(block.text) - block.linked
        gone = {mark for mark, n in held.items() if mark[0] == sure and n <= least * total}
        if gone:
            blocks = [b for b in blocks if gone.isdisjoint(b.marks)]
    return blocks


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, without dropped elements, scripts and markup."""
    out: list[Block] = []
    stack: list[tuple[str, str, tuple[bool, str] | None]] = []  # tag, generalised name, mark
    path: tuple[str, ...] = ()
    gone = 0  # depth from which on everything is dropped; 0: nothing
    parts: list[str] = []
    links = 0
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(path, text, min(linked, len(text)),
                                 stack[-1][0] if stack else "",
                                 frozenset(mark for _, _, mark in stack if mark)))
            parts.clear()
        linked = 0

    def close(depth: int):
        nonlocal path, gone, links
        flush()
        for tag, _, _ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]
        path = tuple(name for tag, name, _ in stack if tag not in INLINE)
        if gone > depth:
            gone = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not gone:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE:
                        links -= tag == "a"
                        if gone == k + 1:
                            gone = 0
                            del stack[k:]
                        elif not gone or gone > k + 1:
                            del stack[k]
                            if gone:
                                gone -= 1
                        else:
                            del stack[k]
                    else:
                        close(k)
                    break
                if stack[k][0] in SCOPE and tag in ("p", "li", "td", "th", "tr", "dt", "dd"):
                    break
                if stack[k][0] in ("article", "main", "body") and tag in ("div", "section", "span"):
                    break
            if tag == "br":
                flush()
            continue
        if tag in RAW:
            found = ENDS[tag].search(page, at)
            if not m.group(0).endswith("/>"):
                at = found.end() if found else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in ENDS_P or tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                own = stack[k][0]
                if (own == "p" and tag in ENDS_P) or own in CLOSES.get(tag, ()):
                    close(k)
                    break
                if own in SCOPE or (own not in INLINE and own not in CLOSES):
                    break
        attributes = _attributes(m.group(3)) if m.group(3).strip() else {}
        if tag not in INLINE:
            flush()
        mark = None
        if tag not in INLINE and (attributes or tag == "form"):
            mark = marked(tag, attributes)
        stack.append((tag, generalised(tag, attributes), mark))
        links += tag == "a"
        if tag not in INLINE:
            path = (*path, stack[-1][1])
        if not gone and dropped(tag, attributes, any(t in ("article", "main") for t, _, _ in stack[:-1])):
            gone = len(stack)
    flush()
    return without_marked(out)


def best_path(blocks: list[Block]) -> tuple[str, float]:
    """The container path whose text scores best: text outside links of its paragraphs, less links.

    Each block counts for its container and, less with each level, for those above, so that a
    container of many paragraphs beats a single one and a tight one beats the whole page. An
    element named article or main counts double. Ties go to the path that sorts first.
    """
    scores: dict[tuple[str, ...], float] = defaultdict(float)
    for block in blocks:
        own = block.path
        if own and own[-1].split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre",
                                             "blockquote", "td", "dd", "dt"):
            own = own[:-1]
        value = len(block.text) - 2.0 * block.linked
        for up in range(len(own)):
            scores[own[:len(own) - up]] += value * 0.8 ** up
    for path in scores:
        if path[-1].split(".")[0] in ("article", "main"):
            scores[path] *= 2
    if not scores:
        return "", 0.0
    path, score = min(scores.items(), key=lambda kv: (-kv[1], kv[0]))
    return (" ".join(path), score) if score > 0 else ("", 0.0)


def beside(blocks: list[Block], path: str) -> dict[int, tuple[int, int]]:
    """Per level above ``path``: text outside and inside links that it adds to the level below."""
    wanted = tuple(path.split(" "))
    out: dict[int, tuple[int, int]] = {}
    for block in blocks:
        depth = 0
        for own, name in zip(block.path, wanted):
            if own != name:
                break
            depth += 1
        if depth < len(wanted):
            plain, linked = out.get(len(wanted) - depth, (0, 0))
            out[len(wanted) - depth] = (
                plain + len(block.text) - block.linked, linked + block.linked)
    return out


def widened(path: str, added: dict[int, tuple[int, int]]) -> str:
    """The path, cut while the level above adds text of which at most ``LINKED`` is in links.

    Not beyond an article or main element. Empty: all blocks of a page.
    """
    names = path.split(" ")
    keep = len(names)
    for up in range(1, len(names) + 1):
        if names[len(names) - up].split(".")[0] in ("article", "main"):
            break
        plain, linked = added.get(up, (0, 0))
        if linked > LINKED * (plain + linked):
            break
        if plain:
            keep = len(names) - up
    return " ".join(names[:keep])


def main_path(blocks: list[Block], hosts: str | None) -> str:
    """The path to read a page with, given that of its host."""
    own, _ = best_path(blocks)
    if own:
        own = widened(own, beside(blocks, own))
    if hosts is None:
        return own
    covered = plain_under(blocks, hosts)
    return hosts if covered and covered >= COVERED * plain_under(blocks, own) else own


def plain_under(blocks: list[Block], path: str) -> int:
    wanted = tuple(path.split(" ")) if path else ()
    return sum(len(b.text) - b.linked for b in blocks if b.path[:len(wanted)] == wanted)


def text_under(blocks: list[Block], path: str) -> str:
    wanted = tuple(path.split(" ")) if path else ()
    return " ".join(b.text for b in blocks if b.path[:len(wanted)] == wanted)


def host(url) -> F.Column:
    """Host of a url in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1),
                              F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """Per host: the container path with the most votes, widened.

    A page's vote weighs the square root of its score. Votes, and what the levels above the path add
    on the pages that vote for it, are summed inside each batch before they are shuffled, so a host
    with most of the pages costs one row per path, level and batch. Ties go to the path that sorts
    first. The path is empty where it is widened to the whole page.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str, int], list[int]] = defaultdict(lambda: [0, 0, 0])
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks = blocks_of(page.as_py() or "")
                path, score = best_path(blocks)
                if path:
                    votes[name, path, 0][0] += round(score ** 0.5)
                    for up, (plain, linked) in beside(blocks, path).items():
                        own = votes[name, path, up]
                        own[1] += plain
                        own[2] += linked
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes], pa.string()),
                 pa.array([k[1] for k in votes], pa.string()),
                 pa.array([k[2] for k in votes], pa.int32()),
                 *(pa.array([v[i] for v in votes.values()], pa.int64()) for i in range(3))],
                names=["host", "path", "up", "votes", "plain", "linked"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [widened(r["path"], {x["up"]: (x["plain"], x["linked"]) for x in r["added"]})
                     for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(
        vote, "host string, path string, up int, votes long, plain long, linked long")
    names = ("votes", "plain", "linked")
    levels = votes.groupBy("host", "path", "up").agg(*(F.sum(c).alias(c) for c in names))
    sums = levels.groupBy("host", "path").agg(
        F.sum("votes").alias("votes"), F.collect_list(F.struct("up", "plain", "linked")).alias("added"))
    chosen = sums.groupBy("host").agg(F.min_by(
        F.struct("path", "added"), F.struct((-F.col("votes")).alias("v"), "path")).alias("best"))
    return chosen.mapInArrow(widen, "host string, path string")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, the path used.

    NULL html is an empty page: empty text. A page that has under its host's path less than
    ``COVERED`` of the text outside links that its own best path holds, or none, is read with its
    own, and with all its blocks when it has none. Pages without a host vote
    together under the empty name. Repeated rows give repeated rows.
    """
    chosen = stored(host_paths(pages))
    # One row per host; left to the optimizer, which broadcasts it only when it is small.
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    joined = rows.join(chosen.withColumnRenamed("host", "_own"), F.col("_host") == F.col("_own"),
                       "left").select("page_id", "url", "html", F.col("path").alias("_path"))

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for page, path in zip(batch.column(2), batch.column(3).to_pylist()):
                blocks = blocks_of(page.as_py() or "")
                used.append(main_path(blocks, path))
                texts.append(text_under(blocks, used[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(
        main_text, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, "
        "path string")
