"""Main text of web pages by tag-path ratios.

A page is read as text nodes, each with the path of block elements from the root to it. Text length, punctuation and
nodes are added up for each path; text per node and punctuation per node are smoothed along the page and fused into one
score, and nodes of a path that passes a threshold are content. The innermost element that holds all content nodes is
the article; everything in it is returned, so short paragraphs and headings beside content nodes stay. Elements that
markup declares to be no content (navigation, forms, adverts, comments, ...) are not nodes at all.

Every page is on its own, so nothing is shuffled and a lost executor only repeats its pages. Defined results: a null or
empty page gives the empty text; unclosed, crossing and cut-off tags are closed where HTML closes them; rows come back
once each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Share of the mean fused score that makes a path content.
THRESHOLD = 0.35
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_NEVER = frozenset("head nav footer aside button select svg math object audio video canvas dialog menu template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body html td th blockquote".split())
# Words of class, id and role that mark what is no article.
_CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe subscription signup sidebar complementary comment "
    "comments disqus respond replies nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer "
    "contentinfo share sharing social related recommended widget toolbar search login hidden".split())
_PAGE_HEAD = frozenset("header masthead topbar".split())
# Words that say where or what kind of box an element is, beside a word that says what for.
_BOX = frozenset(
    "bar block body bottom box col column container content fixed global group holder inner item items js left link links list main module outer "
    "page panel primary right secondary section site sticky text the top unit widget wrap wrapper area".split())
#: Elements whose names count; text elements inside an article are judged by their paths alone.
_NAMED = frozenset("div section ul ol dl table td th tr fieldset details figure span form dd p".split())
#: A marked element that holds this share of a page's text is the page, whatever its name says.
MOST = 0.5


def _says_chrome(value: str, words: frozenset) -> bool:
    """Whether one of the names in a class, id or role speaks of chrome: all its parts but those of boxes do."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [p for p in re.findall(r"[a-z]+", name)]
        told = [p for p in parts if p not in _BOX or p in words]
        if told and all(p in words for p in told):
            return True
    return False


def _excluded(tag: str, attributes: str, in_article: bool) -> str:
    """``never`` for what is no article wherever it stands, ``marked`` for what its name or kind speaks against."""
    if tag in _NEVER or (tag == "header" and not in_article):
        return "never"
    marked = "marked" if tag == "form" else ""
    if tag in ("html", "body", "article", "main") or not attributes:
        return marked
    words = _CHROME if in_article else _CHROME | _PAGE_HEAD
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            if tag in _NAMED and (tag != "p" or len(value.split()) == 1) and _says_chrome(value, words):
                marked = "marked"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "never"
    return marked


def text_nodes(page: str) -> list[tuple[tuple[tuple[int, str], ...], str]]:
    """Blocks of a page in order: the chain of open block elements, each with its number, and the block's text.

    What is never article is left out; so is a marked element, unless it holds most of the text that is left and no
    article or main element has text outside marked ones.
    """
    nodes = _parsed(page)
    if any(not marks and any(tag in ("article", "main") for _, tag in chain) for chain, _, marks in nodes):
        return [(chain, words) for chain, words, marks in nodes if not marks]
    inside: dict[int, int] = {}
    for _, words, marks in nodes:
        for number in marks:
            inside[number] = inside.get(number, 0) + len(words)
    whole = sum(len(words) for _, words, _ in nodes)
    gone = {number for number, size in inside.items() if size < MOST * whole}
    return [(chain, words) for chain, words, marks in nodes if not gone.intersection(marks)]


def _parsed(page: str) -> list[tuple[tuple[tuple[int, str], ...], str, tuple[int, ...]]]:
    """Chain, text and marked elements around it of each block outside what is never article."""
    stack: list[tuple[int, str]] = []
    chain: tuple[tuple[int, str], ...] = ()
    marked: list[tuple[int, int]] = []  # length of the stack inside a marked element, and its number
    nodes, held = [], []
    skip_depth, done, number = 0, 0, 0  # skip_depth: length of the stack inside an excluded element

    def flush():
        if held:
            words = " ".join("".join(held).split())
            if words:
                nodes.append((chain, words, tuple(number for _, number in marked)))
            held.clear()

    def cut(depth: int):
        nonlocal skip_depth
        del stack[depth:]
        if skip_depth > depth:
            skip_depth = 0
        while marked and marked[-1][0] > depth:
            marked.pop()

    for match in _TOKEN.finditer(page):
        if match.start() < done:
            continue
        if not skip_depth and match.start() > done:
            held.append(html.unescape(page[done : match.start()]))
        done = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
        if match[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] == tag:
                    if tag in _BLOCK or not any(t in _BLOCK for _, t in stack[depth:]):
                        if tag in _BLOCK or (marked and marked[-1][0] > depth):
                            flush()
                        cut(depth)
                    break
        elif tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, done)
            done = end.end() if end else len(page)
        else:
            if tag in _BLOCK:
                flush()
                closes = _CLOSES.get(tag, set()) | {"p"}
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][1] in closes:
                        cut(depth)
                    elif stack[depth][1] in _SCOPE and stack[depth][1] not in closes:
                        break
            if tag not in _VOID and not match[3].endswith("/"):
                number += 1
                stack.append((number, tag))
                if not skip_depth:
                    kind = _excluded(tag, match[3], any(t in ("article", "main") for _, t in stack))
                    if kind == "never":
                        skip_depth = len(stack)
                    elif kind:
                        if tag not in _BLOCK:
                            flush()
                        marked.append((len(stack), number))
        if tag in _BLOCK:
            chain = tuple(e for e in stack if e[1] in _BLOCK)
    if not skip_depth and done < len(page):
        held.append(html.unescape(page[done:]))
    flush()
    return nodes


def path_scores(nodes: list) -> np.ndarray:
    """Score of each node: text and punctuation per node of its tag path, fused with the same smoothed over neighbours."""
    paths = {}
    index = np.array([paths.setdefault("/".join(t for _, t in chain), len(paths)) for chain, _ in nodes])
    count = np.bincount(index)
    length = np.bincount(index, [len(t) for _, t in nodes]) / count
    marks = np.bincount(index, [len(_PUNCTUATION.findall(t)) for _, t in nodes]) / count
    window = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), window / window.sum(), "valid")
    own, near = length[index] * (1 + marks[index]), smooth(length[index]) * (1 + smooth(marks[index]))
    return np.sqrt(np.sqrt(own * near))


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, joined by two line feeds."""
    nodes = text_nodes(page or "")
    if not nodes:
        return ""
    score = path_scores(nodes)
    paths = ["/".join(t for _, t in chain) for chain, _ in nodes]
    passing = {path for path, own in zip(paths, score) if own >= THRESHOLD * score.mean()}
    content = [chain for (chain, _), path in zip(nodes, paths) if path in passing]
    depth = 0
    while all(len(c) > depth and c[depth] == content[0][depth] and c[depth][1] in _SCOPE for c in content):
        depth += 1  # down to the innermost element that leaves no content node outside
    beside = {chain[:-1] for chain in content}
    inside = {chain[:k] for chain in content for k in range(depth, len(chain) + 1)}

    def kept(chain, path) -> bool:
        """Content, what stands beside content in one element, lists beside it, and all of an article element."""
        if chain[:depth] != content[0][:depth]:
            return False
        if path in passing or chain[:-1] in beside or chain[:-2] in beside or chain in inside:
            return True
        return any(tag in ("article", "main") and chain[:k] in inside for k, (_, tag) in enumerate(chain, 1))

    return "\n\n".join(text for (chain, text), path in zip(nodes, paths) if kept(chain, path))


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each whole page and ``n_chars``, its code points."""

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    kept = [f"`{c}`" for c in df.columns if c not in (out, "n_chars")]
    made = df.select(*kept, text(F.coalesce(F.col(page), F.lit(""))).alias(out))
    return made.withColumn("n_chars", F.length(out).cast("long"))
