"""Main text of web pages by equivalence-class template deduction.

A token is a tag in its place (its path of open elements).  Tokens of one host that occur equally often in every page have
the same occurrence vector and form an equivalence class.  Classes that most
pages of the host share, and whose places nest, are the template; what the
template leaves open are its slots.  The slot of the article or main element
around most of the text, or else the innermost that holds all of it, is where
the host keeps its articles; the main text of a page is read from there.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import batches_of
from tablewright.storage import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: What an opened element closes: an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text belongs to the page and not to its article.
FURNITURE = frozenset("head nav footer aside form button select dialog menu fieldset".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|side-?bar|widget|menu|nav\w*|"
    r"breadcrumbs?|footer|header|masthead|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|login|signup|search|navigation|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Share of a host's pages that template tokens are found in, and the fewest pages a template is deduced from.
SUPPORT, LEAST_PAGES = 0.5, 3
TASK_TOKENS = 200_000
POOLED = "*"


def blocks(page: str):
    """("open", path, ignored, "") for each block element, ("text", path, ignored, raw) for each piece of text.

    Inline elements do not count as places; unclosed and wrongly nested
    elements are closed where HTML closes them.
    """
    stack: list[tuple[str, str, bool]] = []  # tag, path with it, inside furniture
    for m in TOKEN.finditer(page):
        raw, slash, tag, attributes, text = m.group(1), m.group(2), m.group(3), m.group(4), m.group(5)
        path, ignored = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        if text is not None:
            yield "text", path, ignored, text
        elif tag is not None:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    yield "text", path, ignored, " "
                continue
            if slash:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if at is not None:
                    del stack[at:]
                yield "break", stack[-1][1] if stack else "", False, ""
                continue
            if tag in VOID:
                if tag == "hr":
                    yield "break", path, ignored, ""
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            closes = CLOSES.get(tag)
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            path, ignored = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            name = " ".join(next(filter(None, g), "") for g in NAMED.findall(attributes)) if "=" in attributes else ""
            inside = any(t in ("article", "main") for t, _, _ in stack)
            furniture = tag in FURNITURE or (tag == "header" and not inside) or (tag not in ("html", "body", "article", "main") and bool(name and FURNITURE_NAME.search(name)))
            label = tag + ("." + re.sub(r"[\s\d]+", "_", name) if name else "")
            stack.append((tag, f"{path}/{label}", ignored or furniture))
            yield "open", stack[-1][1], stack[-1][2], ""
        elif raw is not None:
            continue


def page_tokens(page: str) -> dict[str, tuple[int, int]]:
    """token -> (times, characters of text in its slot); text inside page furniture does not count."""
    found: dict[str, list[int]] = {}
    for kind, path, ignored, raw in blocks(page):
        if kind == "open":
            found.setdefault(path, [0, 0])[0] += 1
        elif kind == "text" and not ignored and not raw.isspace():
            while path:  # text counts for every element around it
                found.setdefault(path, [0, 0])[1] += len(raw.strip())
                path = path[: path.rfind("/")]
    return {k: (v[0], v[1]) for k, v in found.items()}


def host_of(url: Column) -> Column:
    """The host of a url in lower case; null or odd urls share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, times, chars, mark_a, mark_b): occurrence vectors, as support and two sums that tell them apart.

    Every page adds a hash of itself and its count to the sums, so two tokens
    have equal marks if they occur equally often in the same pages.
    """
    schema = pa.schema([("host", pa.string()), ("token", pa.string())] + [(n, pa.int64()) for n in ("pages", "times", "chars", "mark_a", "mark_b")])

    def count(batches):
        held: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = xxhash.xxh64_intdigest(page)
                for token, (times, chars) in page_tokens(page).items():
                    mark = xxhash.xxh64_intdigest(b"%d" % times, own)
                    for key in ((host, token), (POOLED, token)):
                        sums = held.setdefault(key, [0, 0, 0, 0, 0])
                        for i, v in enumerate((1, times, chars, mark & 0xFFFFFFF, mark >> 36)):
                            sums[i] += v
            if len(held) > TASK_TOKENS:
                yield from batches_of(((*k, *v) for k, v in held.items()), schema)
                held = {}
        yield from batches_of(((*k, *v) for k, v in held.items()), schema)

    names = ("pages", "times", "chars", "mark_a", "mark_b")
    found = pages.select("host", "html").mapInArrow(count, "host string, token string, pages bigint, times bigint, chars bigint, mark_a bigint, mark_b bigint")
    return found.groupBy("host", "token").agg(*[F.sum(n).alias(n) for n in names])


def classes(vectors_: DataFrame) -> DataFrame:
    """(host, pages, times, tokens): equivalence classes with the support of a template.

    A token needs SUPPORT of its host's pages, so a page's length bounds how
    many tokens a host's classes hold together.
    """
    hosts = vectors_.groupBy("host").agg(F.max("pages").alias("host_pages"))
    common = vectors_.join(hosts, "host").where((F.col("host_pages") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("host_pages")))
    token = F.struct("token", "chars")
    return common.groupBy("host", "host_pages", "pages", "times", "mark_a", "mark_b").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def templates(classes_: DataFrame) -> DataFrame:
    """(host, slots): the place of a host's articles in its template.

    A class is valid if it occurs once in each of its pages and its places
    nest.  Most of the text points at the article; its slot is the outermost
    article or main element around that, or else the innermost place that
    leaves no text out, so a heading or lead beside the body stays.
    """
    schema = pa.schema([("host", pa.string()), ("slots", pa.list_(pa.string()))])

    def deduce(key, table):
        chars: dict[str, int] = {}
        skeleton: set[str] = set()
        for row in table.to_pylist():
            once = row["times"] == row["pages"]
            for t in row["tokens"]:
                chars[t["token"]] = t["chars"]
                if once:
                    skeleton.add(t["token"])
        # A place nests only if all places around it belong to the template too.
        nested = {p for p in skeleton if all(p[:i] in chars for i in range(1, len(p)) if p[i] == "/")}
        slots = []
        if nested:
            most = max(chars[p] for p in nested)
            if most > 0:
                holders = [p for p in nested if chars[p] >= 0.6 * most]
                inner = max(holders, key=lambda p: (p.count("/"), chars[p], p))
                around = [p for p in nested if (inner + "/").startswith(p + "/") and p.rsplit("/", 1)[-1].split(".")[0] in ("article", "main")]
                whole = [p for p in nested if chars[p] == most]
                slots = [min(around, key=len) if around else max(whole, key=lambda p: (p.count("/"), p))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([slots], pa.list_(pa.string()))], schema=schema)

    return classes_.groupBy("host").applyInArrow(deduce, "host string, slots array<string>")


def own_slot(page: str) -> str | None:
    """For a page that no template fits: its article or main element, or else its body."""
    found: dict[str, int] = {}
    for kind, path, ignored, _ in blocks(page):
        if kind == "open" and not ignored:
            last = path.rsplit("/", 1)[-1].split(".")[0]
            rank = {"article": 3, "main": 2, "body": 1}.get(last)
            if rank:
                found.setdefault(path, rank)
    return max(found, key=lambda p: (found[p], -len(p)), default=None)


def text_in(page: str, slot: str) -> str | None:
    """The blocks inside the slot, one to a line; None if the page has no such place."""
    lines, parts, seen, at = [], [], False, None
    for kind, path, ignored, raw in blocks(page):
        within = path == slot or path.startswith(slot + "/")
        seen = seen or (kind == "open" and path == slot)
        if kind != "text" or path != at:
            if parts:
                line = " ".join(references.unescape("".join(parts)).split())
                if line:
                    lines.append(line)
                parts = []
            at = path
        if kind == "text" and within and not ignored:
            parts.append(raw)
    if parts:
        line = " ".join(references.unescape("".join(parts)).split())
        if line:
            lines.append(line)
    return "\n".join(lines) if seen else None


def main_text(page: str, slots: list[str], pooled: list[str]) -> str:
    """The page's article by its host's template, or the one of all hosts, or its own elements."""
    for slot in [*slots, *pooled]:
        found = text_in(page, slot)
        if found is not None:
            return found
    slot = own_slot(page)
    return (text_in(page, slot) if slot else text_in("<body>" + page, "/body")) or ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points).

    Null html is empty and gives an empty text.  Hosts with fewer than
    LEAST_PAGES pages, and pages that their host's template does not fit, use
    the template deduced over all hosts, or else their own article, main or
    body element.  Repeated rows give repeated results; broken markup is read
    as far as it goes.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), F.coalesce(pages[body_col], F.lit("")).alias("html"))
    known = cut_lineage(templates(classes(vectors(rows))), "templates")
    pooled = [s for r in known.where(F.col("host") == POOLED).select("slots").collect() for s in r[0]]  # one row

    def compute(batches):
        for batch in batches:
            texts = [main_text(page, slots or [], pooled) for page, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    joined = rows.join(known.where(F.col("host") != POOLED), "host", "left")
    out = joined.select("id", "url", "html", "slots").mapInArrow(compute, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
