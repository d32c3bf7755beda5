"""Main text of web pages by equivalence-class template deduction (operator 3).

1. Every page becomes tag tokens, told apart by role: a tag with its class or
   id under its path of structural ancestors. For each host, tokens are given
   their occurrence vector over the host's pages as a signature, the sum of
   ``count * hash(page)``, with which equal vectors are equal and which adds up
   over batches and tasks. So a host with a third of all pages costs a few rows
   a batch.
2. Tokens of one host with the same vector form an equivalence class. Classes
   whose tokens come once a page, on half the host's pages at least, are valid
   if their order by mean place agrees with their nesting; the classes on all
   pages are the template's skeleton, the others nest in its slots.
3. A slot whose whole text is the same on all pages, ``fixed_pages`` at least,
   belongs to the template and is no main text (unless no slot varies). Of those that vary, one is main text
   if its path leads into an article or main element and not through a menu,
   header, footer, sidebar, form or the like, which vary too; a host without
   such an element gets the slots with the most text and few links.
4. A page is cut at its template's tokens, in order, and the text of its main
   slots is returned by blocks.

A host's pages fall into layouts by the article and main elements they hold.
Each layout of ``min_pages`` pages has a template of its own; pages of rarer
layouts use the template of the whole host, those of hosts with fewer than
``min_pages`` pages the template of all pages. A page that meets none of its
template's main slots is judged by step 3 on its own text alone. The templates
are broadcast only if their measured size is small, else joined.

Cases: null or empty html, or none that is main text, gives an empty text; a
null or odd url has host ""; unclosed elements, comments and entities at the
end of cut pages are read as far as they go; pages of any length are read whole; repeated rows give equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
#: HTML elements by their part in a page.
STRUCTURE = frozenset("html head body main article section div nav header footer aside form ul ol table tr td figure dialog menu details title button select".split())
VOID = frozenset("br img input meta link hr wbr source col area base embed track param".split())
DEPTH = 64
BLOCK = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd pre blockquote figcaption address hr thead tbody tfoot th caption summary option".split())
ASIDE = frozenset("head title nav header footer aside form menu dialog button select".split())
_ASIDE_NAME = re.compile(r"(?:^|[^a-z])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget\w*|footer|header|masthead|comments?|replies|respond|disqus\w*|share|social|related|newsletter|subscribe|login|search|copyright)(?:$|[^a-z])")


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#:]", rest, maxsplit=1)[0].lower()


def _step(tag: str, attributes: str) -> str:
    names = " ".join(sorted(_DIGITS.sub("#", a or b or c).lower() for a, b, c in _NAME.findall(attributes))) if attributes else ""
    return f"{tag}[{names}]" if names else tag


def events(page: str):
    """(token, path after it, tag or "", text before it) in page order; the path is that of open structural elements.

    All open elements are tracked, but a path spells out ``DEPTH`` of them: below, it ends in the innermost element,
    or in the marginal one (menu, form, ...) that holds it. So paths stay short however deep a page is nested.
    """
    stack, at, held = [("", "")], 0, {}
    for m in _TOKEN.finditer(page):
        text, at = page[at : m.start()], m.end()
        tag = (m.group(3) or "").lower()
        path = stack[-1][1]
        if not tag:
            if text:
                yield "", path, "", text
        elif m.group(2):
            if held.get(tag):
                last = ""
                while last != tag:
                    last, path = stack.pop()
                    held[last] -= 1
            yield f"{path}>/{tag}", stack[-1][1], "/" + tag, text
        else:
            step = _step(tag, m.group(4))
            if tag in STRUCTURE:
                trunk = stack[DEPTH - 1][1] if len(stack) >= DEPTH else path
                marginal = len(stack) > DEPTH and _aside(path[len(trunk) :])
                stack.append((tag, path if marginal else f"{trunk}/{step}"))
                held[tag] = held.get(tag, 0) + 1
            yield f"{path}>{step}", stack[-1][1], tag, text
    if at < len(page):
        yield "", stack[-1][1], "", page[at:]


def _holds_main(path: str) -> bool:
    return any(s.partition("[")[0] in ("article", "main") for s in path.split("/"))


def _layout_step(path: str, before: str, tag: str) -> str:
    """The step of an article or main element that opens outside of others and of marginal parts, else ""."""
    return path.rpartition("/")[2] if tag in ("article", "main") and path != before and not _holds_main(before) and not _aside(path) else ""


def layout_of(page: str) -> str:
    steps, before = set(), ""
    for _, path, tag, _ in events(page):
        steps.add(_layout_step(path, before, tag))
        before = path
    return " ".join(sorted(steps - {""}))


def _aside(path: str) -> bool:
    for step in path.split("/"):
        tag, _, names = step.partition("[")
        if tag in ASIDE or (names and _ASIDE_NAME.search(names)):
            return True
    return False


def _mix(x: int) -> int:
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D & 0xFFFFFFFFFFFFFFFF


def observe(pages: DataFrame) -> DataFrame:
    """host, kind (0 token, 1 path, 2 pages), key, pages, total, signature, place, chars, linked, least, most: sums over pages.

    A path's chars, linked chars and the range of its text hashes are of all
    text below it, so that a path on most pages needs no rows of rarer ones. Rows of a host's layout have it behind the host, after a line break.
    """

    def run(rows):
        seed = 0
        for rb in rows:
            sums: dict[tuple, list] = {}

            def add(host, kind, key, pages, total, sig, place, chars, linked, mark):
                s = sums.setdefault((host, kind, key), [0, 0, 0, 0.0, 0, 0, mark, mark])
                s[0] += pages
                s[1] += total
                s[2] = (s[2] + sig) & 0xFFFFFFFFFFFFFFFF
                s[3] += place
                s[4] += chars
                s[5] += linked
                s[6], s[7] = min(s[6], mark), max(s[7], mark)

            for page_id, url, page in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                seed += 1
                weight = _mix(_mix((page_id or 0) & 0xFFFFFFFFFFFFFFFF) + len(page or ""))
                tokens: dict[str, list] = {}
                paths: dict[str, list] = {}
                n, link, before, steps, above = 0, 0, "", set(), {}
                for token, path, tag, text in events(page or ""):
                    text = text.strip()
                    if text:
                        size, mark = len(text), xxhash.xxh3_64_intdigest(text)
                        for q in above.get(before) or above.setdefault(before, [before, *_above(before)]):
                            p = paths.setdefault(q, [0, 0, 0])
                            p[0] += size
                            p[1] += size if link else 0
                            p[2] = (p[2] + mark) & 0x7FFFFFFFFFFFFFFF
                    steps.add(_layout_step(path, before, tag))
                    before = path
                    if tag == "a":
                        link = 1
                    elif tag == "/a":
                        link = 0
                    if token:
                        t = tokens.setdefault(token, [0, n])
                        t[0] += 1
                        n += 1
                own = host_of(url)
                for host in (own, "*", f"{own}\n{' '.join(sorted(steps - {''}))}"):
                    add(host, 2, "", 1, 1, weight, 0.0, 0, 0, 0)
                    for k, (c, first) in tokens.items():
                        add(host, 0, k, 1, c, c * weight, first / n, 0, 0, 0)
                    for k, (c, linked, mark) in paths.items():
                        add(host, 1, k, 1, 1, 0, 0.0, c, linked, mark)
            keys, vals = list(sums), list(sums.values())
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            cols += [pa.array([v[0] for v in vals], pa.int64()), pa.array([v[1] for v in vals], pa.int64()), pa.array([v[2] - (1 << 64) * (v[2] >> 63) for v in vals], pa.int64())]
            cols += [pa.array([v[i] for v in vals], t) for i, t in ((3, pa.float64()), (4, pa.int64()), (5, pa.int64()), (6, pa.int64()), (7, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["host", "kind", "key", "pages", "total", "signature", "place", "chars", "linked", "least", "most"])

    each = pages.mapInArrow(run, "host string, kind int, key string, pages long, total long, signature long, place double, chars long, linked long, least long, most long")
    # the signature is a sum modulo 2^64: its halves are summed as decimals and folded again
    low, high = F.pmod("signature", F.lit(1 << 32)), F.pmod(F.shiftright("signature", 32), F.lit(1 << 32))
    sums = each.groupBy("host", "kind", "key").agg(
        *(F.sum(c).alias(c) for c in ("pages", "total", "place", "chars", "linked")), F.sum(low).alias("low"), F.sum(high).alias("high"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    return sums.withColumn("signature", F.concat_ws(":", F.pmod(F.col("high") + F.floor(F.col("low") / (1 << 32)), F.lit(1 << 32)), F.pmod("low", F.lit(1 << 32))))


def _structural(key: str) -> bool:
    return key.rpartition(">")[2].partition("[")[0].lstrip("/") in STRUCTURE


def _above(path: str):
    """The paths of all ancestors."""
    return (path[:i] for i, x in enumerate(path) if x == "/")


def _main_paths(slots: set[str], text: dict[str, tuple[int, int]]) -> set[str]:
    """Those of ``slots`` that are main text, given the characters and linked characters below each path."""
    found = {p for p in slots if _holds_main(p) and not _aside(p)}
    if found:
        return found
    # no article element: the paths with the most text, few links and no marginal part
    own, linked = ({p: text.get(p, (0, 0))[k] for p in slots} for k in (0, 1))
    good = {p for p in slots if not _aside(p) and own[p] > 0 and linked[p] < 0.5 * own[p]}
    below: dict[str, int] = {}
    for q in good:
        for p in set(_above(q)) - {q}:
            below[p] = max(below.get(p, 0), own[q])
    deepest = {p for p in good if below.get(p, 0) < 0.6 * own[p]}
    most = max((own[p] for p in deepest), default=0)
    return {p for p in deepest if own[p] >= 0.25 * most}


def deduce(stats: pd.DataFrame, fixed_pages: int) -> dict:
    """One host's template: its tokens in order and, for the slot after each, whether it is main text."""
    pages = int(stats.loc[stats["kind"] == 2, "pages"].max())
    once = stats[(stats["kind"] == 0) & (stats["total"] == stats["pages"]) & (2 * stats["pages"] >= pages)].copy()
    once["mean"] = once["place"] / once["pages"]
    once = once.sort_values(["mean", "key"])
    kept: list[str] = []
    # classes of equal vectors; in a valid one every opening tag has its closing tag behind it, so that it nests in one slot
    for _, cls in once[once["key"].map(_structural)].groupby(["pages", "signature"], sort=False):
        mean = dict(zip(cls["key"], cls["mean"], strict=True))
        for k in mean:
            path, _, tag = k.rpartition(">")
            if not tag.startswith("/"):
                end = f"{path}/{tag}>/{tag.partition('[')[0]}"
                if end in mean and mean[end] > mean[k]:
                    kept += [k, end]
    place = dict(zip(once["key"], once["mean"], strict=True))
    kept.sort(key=lambda k: (place[k], k))
    after = []
    for k in kept:
        path, _, tag = k.rpartition(">")
        after.append(path.rpartition("/")[0] if tag.startswith("/") else f"{path}/{tag}")
    paths = stats[stats["kind"] == 1]
    text = {p: (c, linked) for p, c, linked in zip(paths["key"], paths["chars"], paths["linked"], strict=True)}
    fixed = set(paths.loc[(paths["least"] == paths["most"]) & (paths["pages"] >= fixed_pages), "key"])
    good = _main_paths(set(after) - fixed, text) or _main_paths(set(after), text)
    main = [p in good for p in after]
    return {"tokens": kept, "main": main}


def templates(pages: DataFrame, min_pages: int = 3, fixed_pages: int = 5) -> DataFrame:
    """host, template (JSON) of hosts and layouts with ``min_pages`` pages, and of all pages under "*"."""
    stats = cut(observe(pages))
    sizes = stats.where("kind = 2").select("host", F.col("pages").alias("of"))
    some = stats.join(sizes, "host").where((F.col("of") >= min_pages) | (F.col("host") == "*"))
    # a template has tokens on half the pages at least, and its slots are paths on as many: a host's rest is a page's worth of rows
    some = some.where((F.col("kind") == 2) | (2 * F.col("pages") >= F.col("of")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [json.dumps(deduce(pdf, fixed_pages))]})

    return cut(some.groupBy("host").applyInPandas(one, "host string, template string"))


def _joined(pieces: list) -> str:
    """Blocks of text from pieces; None ends a block."""
    blocks, parts = [], []
    for x in [*pieces, None]:
        if x is not None:
            parts.append(x)
        elif parts:
            blocks.append(" ".join(entities.unescape("".join(parts)).split()))
            parts = []
    return "\n\n".join(b for b in blocks if b)


def own_text(page: str) -> str:
    """The main text of a page judged by itself."""
    seen, text, before, link = list(events(page)), {}, "", 0
    for _, path, tag, t in seen:
        size = len(t.strip())
        if size:
            for q in (before, *_above(before)):
                c, x = text.get(q, (0, 0))
                text[q] = c + size, x + (size if link else 0)
        before = path
        link = 1 if tag == "a" else 0 if tag == "/a" else link
    good = _main_paths(set(text), text)
    wanted = {q: not _aside(q) and not good.isdisjoint((q, *_above(q))) for q in text}
    pieces, before = [], ""
    for _, path, tag, t in seen:
        if wanted.get(before) and t:
            pieces.append(t)
        before = path
        if tag.lstrip("/") in BLOCK:
            pieces.append(None)
        elif tag == "br":
            pieces.append(" ")
    return _joined(pieces)


def main_text(page: str, template: dict) -> str:
    place = template["place"]
    main, at, pieces, skip, met = template["main"], -1, [], "", not place
    inside = template["all"]
    for token, path, tag, text in events(page):
        if inside and not skip and text:
            pieces.append(text)
        if not tag:
            continue
        name = tag.lstrip("/")
        if name in BLOCK:
            pieces.append(None)
        elif name == "br" and pieces and pieces[-1] is not None:
            pieces.append(" ")
        i = place.get(token, -1)
        if i > at:
            pieces.append(None)
            at, inside, skip = i, main[i], ""
            met = met or inside
        elif inside and name in STRUCTURE:
            if skip and not f"{path}/".startswith(f"{skip}/"):
                skip = ""
            if not skip and tag[0] != "/" and _aside(path[path.rfind("/") :]):
                skip = path
    return _joined(pieces) if met else own_text(page)


def extract_main_text(pages: DataFrame, min_pages: int = 3, fixed_pages: int = 5, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = templates(p, min_pages, fixed_pages)
    common = known.where("host = '*'").first()
    fallback = common["template"] if common else json.dumps({"tokens": [], "main": []})
    hosts, layouts = known.where("host <> '*' AND NOT contains(host, '\n')"), known.where("contains(host, '\n')")

    def looked_up(rows):
        for rb in rows:
            urls = rb.column("url").to_pylist()
            own = [host_of(u) for u in urls]
            each = [f"{h}\n{layout_of(x or '')}" for h, x in zip(own, rb.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(own, pa.string()), pa.array(each, pa.string())], [*rb.schema.names, "host", "layout"])

    joined = p.mapInArrow(looked_up, "page_id long, url string, html string, host string, layout string")
    for one, c in ((hosts, "host"), (layouts, "layout")):
        size = one.agg(F.sum(F.octet_length("template"))).first()[0] or 0
        one = one.select(F.col("host").alias(c), F.col("template").alias(f"{c}_template"))
        joined = joined.join(F.broadcast(one) if size <= broadcast_bytes else one, c, "left")
    joined = joined.select("page_id", "url", "html", F.coalesce("layout_template", "host_template").alias("template"))

    def run(rows):
        ready: dict = {}

        def of(x):
            if x not in ready:
                t = json.loads(x or fallback)
                ready[x] = t | {"place": {k: i for i, k in enumerate(t["tokens"])}, "all": not any(t["main"])}
            return ready[x]

        for rb in rows:
            text = [main_text(h or "", of(t)) for h, t in zip(rb.column("html").to_pylist(), rb.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
