"""Clean text and structure out of documents with HTML, Markdown, wiki or LaTeX markup.

The page's content is located by composite text density: every DOM node gets its characters
per tag, adjusted for link text; a node's density sum adds up its children's densities; the
subtree with the largest sum is the core of the content, and the least density on the path from it
to ``body`` is the threshold that other blocks must reach to be content. What is content is then
read in whatever markup it is written.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMS = ("heading", "list_item", "code_block", "formula")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_VOID = frozenset("br hr img meta link input wbr col area base source".split())
_INLINE = frozenset("a b i em strong u s sup sub span code font tt small big ref math mi mo mn mfrac msup msqrt munderover mrow".split())
_FLOW = frozenset("body article main section div td blockquote form".split())
_FRAME = frozenset("html body article main".split())
_ENDS_P = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol pre table section article main nav footer header blockquote form dl".split())
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE_MAIN = re.compile(r"\b(?:role\s*=\s*[\"']?main|id\s*=\s*[\"']?main-content)\b", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    start: int
    inner: int
    parent: int
    end: int = -1
    own: int = 0
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0
    children: list[int] = field(default_factory=list)

    def classes(self) -> list[str]:
        m = _CLASS.search(self.attrs)
        return (m[1] or m[2] or m[3] or "").lower().split() if m else []


def parse(page: str) -> list[Node]:
    """Block-level DOM of a page in document order, node 0 a root around it. Inline tags are
    counted in their block but make no node; unclosed paragraphs and items end as HTML ends them."""
    nodes = [Node("html", "", 0, 0, -1)]
    stack, at, in_link = [0], 0, 0

    def close(to: int, inner_end: int) -> None:
        while len(stack) > to:
            i = stack.pop()
            node = nodes[i]
            node.end = inner_end
            if stack:
                up = nodes[stack[-1]]
                up.chars += node.chars
                up.link_chars += node.link_chars
                up.tags += node.tags + 1
                up.link_tags += node.link_tags

    for m in _TAG.finditer(page):
        start, end = m.span()
        if start > at:
            n = len(page[at:start].strip())
            if n:
                top = nodes[stack[-1]]
                top.chars += n
                top.own += n
                if in_link:
                    top.link_chars += n
        at = end
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if tag in _INLINE or tag in _VOID:
            if not m[1]:
                nodes[stack[-1]].tags += 1
            if tag == "a":
                if not m[1]:
                    nodes[stack[-1]].link_tags += 1
                in_link = 0 if m[1] else 1
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k, start)
                    break
            continue
        top_tag = nodes[stack[-1]].tag
        if (top_tag == "p" and tag in _ENDS_P) or (top_tag == "li" and tag == "li"):
            close(len(stack) - 1, start)
        i = len(nodes)
        nodes.append(Node(tag, m[3], start, end, stack[-1]))
        nodes[stack[-1]].children.append(i)
        stack.append(i)
    if at < len(page):
        top, n = nodes[stack[-1]], len(page[at:].strip())
        top.chars += n
        top.own += n
    close(0, len(page))
    return nodes


def score(nodes: list[Node]) -> None:
    """Composite text density and density sum of every node. Text that stands in a node itself
    counts in its sum as a leaf of its own."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    body_ratio = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if not n.chars:
            continue
        tags = n.tags or 1
        links, link_tags, rest = n.link_chars or 1, n.link_tags or 1, (n.chars - n.link_chars) or 1
        base = math.log(n.chars / rest * n.link_chars + body_ratio * n.chars + math.e)
        n.density = n.chars / tags * max(0.0, math.log(max(n.chars / links * tags / link_tags, 1.0001))) / max(math.log(base + 1.0), 0.1)
    for n in nodes:
        n.density_sum = n.own + sum(nodes[c].density for c in n.children)


def _frame(node: Node) -> bool:
    return node.tag in _FRAME or bool(_ROLE_MAIN.search(node.attrs))


def _content(nodes: list[Node], frames: bool = True) -> tuple[int, list[int], float]:
    """The node with the largest density sum, the path from it to the body, and the threshold: the
    least density on that path. Without ``frames``, blocks that frame a whole page are out of the question if there are others."""
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    flow = [i for i, n in enumerate(nodes) if i >= body and n.tag in _FLOW and n.chars]
    if not frames:
        flow = [i for i in flow if not _frame(nodes[i])] or flow
    if not flow:
        return body, [body], 0.0
    best = max(flow, key=lambda i: nodes[i].density_sum)
    path, i = [best], best
    while i != body and nodes[i].parent >= 0:
        i = nodes[i].parent
        path.append(i)
    return best, path, min(nodes[i].density for i in path)


def content_root(nodes: list[Node]) -> int:
    """The subtree that holds the page's content; the whole page when it has no block."""
    best, path, least = _content(nodes)
    if not nodes[best].chars:
        return best
    if not _frame(nodes[best]):
        return [i for i in path if not _frame(nodes[i])][-1]
    while True:  # the frame won: go down while one block holds most of its text
        inner = [c for c in nodes[best].children if nodes[c].tag in _FLOW and 2 * nodes[c].chars > nodes[best].chars]
        if not inner:
            return best
        best = inner[0]
        if not _frame(nodes[best]):
            return best


_CODE_MD = re.compile(r"^[ ]{0,3}(```+|~~~+)[^\n]*\n.*?^[ ]{0,3}\1[ \t]*$|\\begin\{(lstlisting|verbatim)\*?\}.*?\\end\{\2\*?\}|`[^`\n]+`", re.S | re.M)
_ESCAPED = re.compile(r"&lt;/?(?:p|h[1-6]|ul|ol|li|div|pre|a|script|sup|b|i|em|font|br|span|code|math|table)(?:\s[^<>]*?)?/?&gt;", re.I)
_SPECIAL = re.compile(r"[<$\\`~%]")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_CODE_TAG = re.compile(r"<(pre|syntaxhighlight|source)(?=[\s>])[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_INLINE_CODE = re.compile(r"<code\b[^>]*>.*?</code\s*>|`[^`\n]+`", re.S | re.I)
_FENCE = re.compile(r"(```+|~~~+)[^\n]*\n.*?(?:^[ ]{0,3}\1[ \t]*$|\Z)", re.S | re.M)
_TEX_CODE = re.compile(r"\\begin\{(lstlisting|verbatim|minted)\*?\}.*?\\end\{\1\*?\}", re.S)
_MATH_TAG = re.compile(r"<math\b[^>]*>.*?</math\s*>", re.S | re.I)
_TEX_MATH = re.compile(
    r"\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{((?:equation|displaymath|math|align|gather|multline|eqnarray)\*?)\}.*?\\end\{\1\}",
    re.S,
)
_DOLLARS = re.compile(r"\$\$.+?\$\$|\$(?=[^\s\d$])(?:[^$\n\\]|\\[^\n])+?(?<=\S)\$(?![\w$])", re.S)
_BY_CHAR = {
    "<": (("skip", _COMMENT), ("code_block", _CODE_TAG), ("inline", _INLINE_CODE), ("formula", _MATH_TAG)),
    "`": (("inline", _INLINE_CODE),),
    "\\": (("code_block", _TEX_CODE), ("formula", _TEX_MATH)),
    "$": (("formula", _DOLLARS),),
    "~": (),
}
_TAG_START = re.compile(r"<(?:!--|script|style|pre|syntaxhighlight|source|code|math)(?![a-z])", re.I)


def opaque_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans in which no other markup is read, as ``(start, end, kind)`` in order; ``kind`` is
    ``skip`` for what is not shown (comments, scripts), ``code_block``, ``inline`` or ``formula``."""
    out: list[tuple[int, int, str]] = []
    at = 0
    for m in _SPECIAL.finditer(text):
        i = m.start()
        if i < at:
            continue
        c = m[0]
        if c in "`~%":
            j = text.rfind("\n", 0, i) + 1
            if i - j <= 3 and not text[j:i].strip(" "):
                if c == "%":
                    end = text.find("\n", i)
                    out.append((i, at := len(text) if end < 0 else end, "skip"))
                    continue
                if f := _FENCE.match(text, i):
                    out.append((i, at := f.end(), "code_block"))
                    continue
        elif c == "\\":
            if text[i + 1 : i + 2] not in ("b", "[", "("):
                at = i + 2  # an escaped character opens nothing
                continue
        elif c == "<" and not _TAG_START.match(text, i):
            continue
        elif c == "$" and i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            continue
        for kind, pattern in _BY_CHAR.get(c, ()):
            if f := pattern.match(text, i):
                out.append((i, at := f.end(), kind))
                break
        else:
            if c == "$" and text.startswith("$$", i):
                at = i + 2
    return out


def _without(text: str, put) -> str:
    """``text`` with ``put(kind, source)`` in place of each opaque span."""
    parts, at = [], 0
    for start, end, kind in opaque_spans(text):
        parts.append(text[at:start])
        parts.append(put(kind, text[start:end]))
        at = end
    parts.append(text[at:])
    return "".join(parts)


_HEAD_TAG = re.compile(r"<h[1-6](?=[\s>])|<[a-z][a-z0-9]*\s[^<>]*\brole\s*=\s*[\"']?heading\b", re.I)
_ITEM_TAG = re.compile(r"<li(?=[\s>/])", re.I)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]\n]*\]\s*)?\{")
_TEX_ITEM = re.compile(r"\\item(?![a-zA-Z])")
_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+\S")
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*[^=\s](?:.*[^=\s])?[ \t]*\1[ \t]*$")
_UNDER = re.compile(r"^[ ]{0,3}(?:=+|-+)[ \t]*$")
_BULLET = re.compile(r"^[ \t]*(?:[-+]|\d{1,9}[.)]|\*)[ \t]+\S")
_WIKI_ITEM = re.compile(r"^[*#:;]*[*#][ \t]+\S")
_MARKDOWN = re.compile(r"^#{2,6}[ \t]|^(?:```|~~~)|\[[^\]\n]+\]\([^)\s]+\)", re.M)


def unescape_block(block: str) -> str:
    """The block one level less escaped when all of its markup is escaped, else as it is. A block
    that begins with an escaped tag may hold a few plain tags, as of a note put in later."""
    if "&lt;" not in block:
        return block
    plain = sum(1 for m in _TAG.finditer(block) if m[2])
    if plain and not _ESCAPED.match(block.lstrip()):
        return block
    escaped = len(_ESCAPED.findall(_CODE_MD.sub(" ", block)))
    return html.unescape(block) if escaped > plain else block


def _line_kinds(lines: list[str], markdown: bool) -> list[str]:
    """For each line ``heading``, ``rule`` (the underline of a heading), ``list_item`` or nothing."""
    kinds = [""] * len(lines)
    for k, line in enumerate(lines):
        if not line:
            continue
        c = line[0]
        if c == "#" or c == " " and line.lstrip()[:1] == "#":
            m = _ATX.match(line)
            if not m:
                if _WIKI_ITEM.match(line):
                    kinds[k] = "list_item"
                continue
            near = (k and lines[k - 1][:1] in ("#", "*")) or (k + 1 < len(lines) and lines[k + 1][:1] in ("#", "*"))
            one = len(m[1]) == 1
            kinds[k] = "list_item" if c == "#" and (near or one and not markdown) else "heading"
        elif c == "=" and _WIKI_HEAD.match(line):
            kinds[k] = "heading"
        elif c in "=- " and _UNDER.match(line):
            if k and lines[k - 1].strip() and not kinds[k - 1]:
                kinds[k - 1], kinds[k] = "heading", "rule"
        elif _BULLET.match(line) or c in "*#:;" and _WIKI_ITEM.match(line):
            kinds[k] = "list_item"
    return kinds


def structure(block: str) -> dict[str, int]:
    """How many headings, list items, code blocks and formulas stand in a block's source."""
    found = dict.fromkeys(ELEMS, 0)
    block = unescape_block(block)

    def put(kind: str, source: str) -> str:
        if kind in found:
            found[kind] += 1
        return "" if kind == "skip" else " x "

    rest = _without(block, put)
    if "<" in rest:
        found["heading"] += len(_HEAD_TAG.findall(rest))
        found["list_item"] += len(_ITEM_TAG.findall(rest))
    if "\\" in rest:
        found["heading"] += len(_TEX_HEAD.findall(rest))
        found["list_item"] += len(_TEX_ITEM.findall(rest))
    markdown = bool(_MARKDOWN.search(block))
    for kind in _line_kinds(rest.split("\n"), markdown):
        if kind == "heading" or kind == "list_item":
            found[kind] += 1
    return found


_CUTS = re.compile(
    r"<sup\b[^>]*>.*?</sup\s*>|<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/>|\{\{.*?\}\}|\[\[(?:File|Image):[^\]]*\]\]"
    r"|<a\b[^>]*>\s*\[\d+\]\s*</a\s*>|~?\\(?:cite|ref|label)\w*\*?\{[^}]*\}|<br\s*/?>\s*\*[^\n<]*",
    re.S | re.I,
)
_TEX_TEXT = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|section\*?|subsection\*?|subsubsection\*?)\{([^{}]*)\}")
_WIKI_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]")
_MD_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)")
_ANY_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_BREAKS = re.compile(r"</?(?:p|div|ul|ol|table|tr|blockquote|section|article)\b[^>]*>|<br\s*/?>|</(?:h[1-6]|li)\s*>", re.I)
_H = re.compile(r"<h([1-6])(?=[\s>])[^>]*>(.*?)</h\1\s*>|<(?P<t>[a-z][a-z0-9]*)\s[^<>]*\brole\s*=\s*[\"']?heading\b[^<>]*>(?P<b>.*?)</(?P=t)\s*>", re.S | re.I)
_MARKS = re.compile(r"'{2,5}|\*\*|__|(?<!\w)\*(?=\S)|(?<=\S)\*(?!\w)")
_SLOT = re.compile("\x01(\\d+)\x02")


def render(block: str) -> str:
    """Clean text of a block. Headings become lines ``# …``, list items ``- …``, code blocks
    stand between lines of three backticks, formulas between ``$``."""
    block = unescape_block(block)
    markdown = bool(_MARKDOWN.search(block))
    kept: list[str] = []

    def put(kind: str, source: str) -> str:
        if kind == "skip":
            return ""
        if kind == "code_block":
            if source.lstrip().startswith(("```", "~~~")):
                body = "\n".join(source.strip().split("\n")[1:-1])
            elif source.startswith("\\"):
                body = re.sub(r"\A\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}\Z", "", source)
            else:
                body = _ANY_TAG.sub("", source)
            kept.append("\n```\n" + html.unescape(body).strip("\n") + "\n```\n")
        elif kind == "formula":
            body = re.sub(r"\A(?:\$\$|\$|\\\[|\\\(|\\begin\{[^}]*\})|(?:\$\$|\$|\\\]|\\\)|\\end\{[^}]*\})\Z", "", source)
            kept.append("$" + " ".join(html.unescape(_ANY_TAG.sub(" ", body)).split()) + "$")
        else:
            kept.append(html.unescape(_ANY_TAG.sub("", source)).strip("`"))
        return f"\x01{len(kept) - 1}\x02"

    rest = _CUTS.sub(" ", _without(block, put))
    rest = _TEX_HEAD.sub(lambda m: "\n\x03" + m[0], rest)
    rest = _TEX_ITEM.sub("\n\x04", re.sub(r"\\item\[[^\]\n]*\]", "\\\\item ", rest))
    rest = _H.sub(lambda m: "\n\x03" + " ".join((m[2] or m["b"] or "").split()) + "\n", rest)
    rest = _BREAKS.sub("\n", re.sub(r"<li\b[^>]*>", "\n\x04", rest, flags=re.I))
    rest = re.sub(r"\\(?:begin|end)\{\w+\*?\}", "\n", _ANY_TAG.sub("", rest))
    out: list[str] = []
    lines = rest.split("\n")
    for line, kind in zip(lines, _line_kinds(lines, markdown), strict=True):
        mark = ""
        if line.startswith("\x03") or kind == "heading":
            mark = "# "
            line = line.strip("\x03 \t#=")
        elif line.startswith("\x04") or kind == "list_item":
            mark = "- "
            line = re.sub(r"\A[ \t]*(?:[-+]|\d{1,9}[.)]|[*#:;]*[*#])[ \t]+", "", line.lstrip("\x04"))
        elif kind == "rule":
            continue
        line = _TEX_TEXT.sub(r"\1", line)
        line = _MD_LINK.sub(r"\1", _WIKI_LINK.sub(r"\1", line))
        line = html.unescape(_MARKS.sub("", line)).replace("\\$", "$").replace("\\%", "%")
        line = " ".join(re.sub(r"\A>\s*", "", line).split())
        if line:
            out.append(mark + line)
    return _SLOT.sub(lambda m: kept[int(m[1])], "\n".join(out)).strip()


def blocks(page: str, classes: frozenset[str] = frozenset()) -> list[str]:
    """Source of the page's content. Of several blocks the one is content that holds the largest
    density sum, and with ``classes`` those of that class whose density reaches the threshold,
    wherever they stand: a box of links of the same class doesn't. A page without a block of that
    class has the content that density alone finds."""
    nodes = parse(page)
    if classes:
        flow = [n for n in nodes if n.tag in _FLOW and n.chars and not _frame(n)]
        if len(flow) == 1 and classes.intersection(flow[0].classes()):
            return [page[flow[0].inner : flow[0].end]]  # alone it is the block with the largest density sum
    score(nodes)
    if classes:
        best, path, least = _content(nodes, frames=False)
        near, out, until, named = set(path), [], -1, False
        for i, n in enumerate(nodes):
            if n.start < until or n.tag not in _FLOW or not classes.intersection(n.classes()):
                continue
            named = True
            if i in near or n.density >= least or n.start <= nodes[best].start < n.end:
                out.append(page[n.inner : n.end])
                until = n.end
        if named:
            return out
    top = nodes[content_root(nodes)]
    return [page[top.inner : top.end]]


STUDY_TEXT = frozenset({"abstract", "description"})


def _counts(pages: pd.Series, classes: frozenset[str]) -> pd.DataFrame:
    rows = []
    for page in pages:
        total = dict.fromkeys(ELEMS, 0)
        if page:
            for block in blocks(page, classes):
                for k, v in structure(block).items():
                    total[k] += v
        rows.append(tuple(total.values()))
    return pd.DataFrame(rows, columns=list(ELEMS))


def element_counts(page: Column, classes: frozenset[str] = frozenset()) -> Column:
    """Struct of the number of elements of each kind in the page's content. Null and empty pages have none."""

    @F.pandas_udf(", ".join(f"{e} int" for e in ELEMS))
    def count(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in it:
            yield _counts(pages, classes)

    return count(page)


def clean_text(page: Column, classes: frozenset[str] = frozenset()) -> Column:
    """The page's content as clean text; null for null, empty for a page without text."""

    @F.pandas_udf("string")
    def clean(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in it:
            yield pd.Series([None if p is None else "\n\n".join(render(b) for b in blocks(p, classes)) for p in pages], dtype=object)

    return clean(page)


def elements(df: DataFrame, key: str, page: str, classes: frozenset[str] = frozenset()) -> DataFrame:
    """One row ``(key, elem, seq)`` for each structural element of the page's content; ``seq``
    counts from 1 within key and kind. Repeated input rows give repeated elements."""
    n = df.select(F.col(key), element_counts(F.col(page), classes).alias("n"))
    kinds = F.array(*[F.struct(F.lit(e).alias("elem"), F.col(f"n.{e}").alias("c")) for e in ELEMS])
    n = n.select(key, F.explode(F.filter(kinds, lambda k: k.c > 0)).alias("k"))
    return n.select(key, F.col("k.elem").alias("elem"), F.explode(F.sequence(F.lit(1), F.col("k.c"))).alias("seq"))


_WORD = re.compile(r"\w+|[.!?](?=\s|\Z)|\n")
#: Stands between the sentences of :func:`prose`.
STOPS = frozenset(".!?\n")
_OUT_HTML = re.compile(
    r"<(sup|ref|a|h[1-6]|li)(?=[\s>])(?:[^>]*/>|[^>]*>.*?(?:</\1\s*>|(?=<li(?=[\s>]))|(?=</[uo]l\s*>)|\Z))|<br\s*/?>\s*\*[^\n<]*", re.S | re.I
)
_OUT_ROLE = re.compile(r"<([a-z][a-z0-9]*)\s[^<>]*\brole\s*=\s*[\"']?heading\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_OUT_TEX = re.compile(r"~?\\(?:(?:sub){0,2}section\*?|cite|ref|label)\{[^}]*\}|^[ \t]*\\(?:item|begin|end)\b[^\n]*$", re.M)
_OUT_LINKS = re.compile(r"\{\{.*?\}\}|\[\[[^\]]*\]\]|!?\[[^\]\n]*\]\([^)\s]*\)", re.S)


def prose(block: str) -> list[str]:
    """Words, in lower case, of a block's running text: without headings, list items, code,
    formulas, links, notes and references. Between sentences stands one of STOPS."""
    block = unescape_block(block)
    rest = _without(block, lambda kind, source: "")
    if "<" in rest:
        if "role" in rest:
            rest = _OUT_ROLE.sub("\n", rest)
        rest = _ANY_TAG.sub("", _OUT_HTML.sub("\n", rest))
    if "\\" in rest:
        rest = _TEX_TEXT.sub(r"\1", _OUT_TEX.sub("", rest))
    if "{{" in rest or "[" in rest:
        rest = _OUT_LINKS.sub("", rest)
    lines = rest.split("\n")
    markdown = "#" in block and bool(_MARKDOWN.search(block))
    rest = "\n".join(line for line, kind in zip(lines, _line_kinds(lines, markdown), strict=True) if not kind)
    if "&" in rest:
        rest = html.unescape(rest)
    return _WORD.findall(rest.lower())


def study_prose(page: str | None) -> list[str]:
    return [w for b in blocks(page, STUDY_TEXT) for w in [*prose(b), "\n"]] if page else []
