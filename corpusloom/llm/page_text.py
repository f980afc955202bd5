"""Main text of pages by element paths that equivalence classes of markup select.

Pages of a host are compared by their markup tokens: an element's start or end, told apart by the path of elements around
it. A token's occurrence vector has its count on every page of the host; tokens with the same vector form a class. A class
is valid if its tokens come in the same order on all pages and if it is not a single token; the elements of valid classes
that a tenth of the host's pages have, and two of them, are its template, which may be one of several layouts. The ones named as an article are the host's content. Without one, each
element is a slot whose text differs between pages: content are the headlines and the slots that hold a tenth or more of
what the fullest holds. A page's text is what lies in its host's content.

This is less than the method of equivalence classes in two places: classes are not nested, as the paths of their tokens
nest them already, and words are no tokens, so that text repeated inside a content slot stays.

A vector is never gathered: it is compared by sums of hashes of (page, count), which Spark adds up before the shuffle.
A host of any size therefore gives a few rows for each of its tokens, and pages are parsed where they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import pieces, released, require
from corpusloom.session import cut_lineage, key_bytes, may_broadcast

LAYOUT = 0.1  # share of a host's pages that one of its layouts has; a template's class is found on so many, and on two
WRAPS = 3  # times the text outside of it that a dropped element holds if it is a wrapper of the page
SLOT_SHARE = 0.1  # of the fullest slot's text that another one holds if it is content
MAX_PATH = 40  # elements of a path that tell tokens apart; deeper ones count as one

# Elements of the markup language by what they mean for the text.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template iframe svg textarea title".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("nav header footer aside form button select option dialog menu head".split()) | RAW
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = BLOCK - {"body", "html", "head"}
SCOPE = set("article aside body blockquote div dl fieldset footer form header html li main nav ol section table td th ul".split())
# Words of class, id and role attributes that name what is not the article.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices popup modal overlay newsletter"
    " subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies"
    " social share sharing related recommended widget toolbar pagination pager contentinfo complementary search dialog alert alertdialog skip".split()
)
# Words that go with them, and the elements of an article that they may name.
FRAME = set(
    "area articles bar block box button buttons container count form group icons inner item items links list posts section signup slot stories tools"
    " unit wrap wrapper".split()
)
CONTAINERS = set("article div section ul ol dl table details figure".split())
CONTENT = set("articlebody article-body post-content entry-content article-content story-body main-content".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-hidden|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
INNER = r">(p|h1|h2|h3|li|pre|blockquote|b|i|a|em|strong|span)$"  # part of the slot around it
_HEADLINE = r">h1(\.[^>]*)?$"
_WORD = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")


_NEVER = ("",)  # around what is dropped whatever it holds


def parsed(page: str) -> Iterator[tuple[str, str, str, str, tuple[str, ...]]]:
    """The page as (`kind`, `path`, `name`, `text`, `dropped`) in page order.

    Kinds are `open`, `close`, `text` and `break` (the border of a block); `path` leads to the element, names joined by
    `>`, with class and id where given; `dropped` has the paths of the elements, this or around it, that only a form or a
    word of their attributes names as not the article's, or _NEVER inside elements like menus; it is empty for the others.
    Inside an article only a whole class, id or role names a part as something else, and only a part like a div or a list.
    Elements left open are closed where the next one ends them, or at the end of the one around them.
    """
    stack: list[tuple[str, str, tuple[str, ...]]] = [("", "", ())]
    inside: list[int] = []  # depths of the articles that are open
    at, n = 0, len(page)

    def close(down_to: int) -> Iterator[tuple[str, str, str, str, tuple[str, ...]]]:
        while len(stack) > down_to:
            name, path, dropped = stack.pop()
            if inside and inside[-1] > len(stack):
                inside.pop()
            yield "close", path, name, "", dropped
            if name in BLOCK:
                yield "break", path, name, "", stack[-1][2]

    while at < n:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at:
            yield "text", stack[-1][1], stack[-1][0], page[at:stop], stack[-1][2]
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            down = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if down and not any(stack[k][0] in SCOPE for k in range(down + 1, len(stack))) or down and name in SCOPE:
                yield from close(down)
            elif name in BLOCK:
                yield "break", stack[-1][1], name, "", stack[-1][2]
            continue
        if name == "br":
            yield "text", stack[-1][1], stack[-1][0], " ", stack[-1][2]
            continue
        ended = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if ended:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    yield from close(k)
                    break
                if stack[k][0] in SCOPE and stack[k][0] not in ended:
                    break
        given = {a.lower(): (x or y or z) for a, x, y, z in _ATTRIBUTE.findall(found[3])} if found[3] else {}
        label = " ".join(given.get(a, "") for a in ("class", "id")).strip().lower()
        step = name + ("." + ".".join(sorted(set(label.split()))) if label else "")
        path = stack[-1][1] + ">" + step if len(stack) <= MAX_PATH else stack[-1][1]
        if inside:
            other = name in CONTAINERS and _names_other(f"{label} {given.get('role', '').lower()}")
        else:
            other = not BOILERPLATE.isdisjoint(_WORD.findall(f"{label} {given.get('role', '').lower()}"))
        content = _is_content(name, label, given)
        dropped = stack[-1][2]
        if name in DROPPED and name != "form":
            dropped = _NEVER
        elif dropped != _NEVER and (name == "form" or name not in ("html", "body", "main") and other and not content):
            dropped = (*dropped, path)
        if name in BLOCK:
            yield "break", path, name, "", dropped
        yield "open", path, name, "content" if content else "", dropped
        if name in VOID or found[3].endswith("/"):
            continue
        stack.append((name, path, dropped))
        if content and not dropped:
            inside.append(len(stack))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            yield from close(len(stack) - 1)
    yield from close(1)


def _names_other(label: str) -> bool:
    """Whether a class, id or role is made of words for what is not the article, and says nothing else."""
    for token in label.split():
        parts = set(_WORD.findall(token))
        if not parts.isdisjoint(BOILERPLATE) and parts <= BOILERPLATE | FRAME:
            return True
    return False


def _is_content(name: str, label: str, given: dict[str, str]) -> bool:
    """Whether an element is named as the article."""
    if name in ("article", "main") or given.get("role", "").lower() in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
        return not set(_WORD.findall(label)) & {"comment", "comments", "reply", "ad", "ads", "related", "sponsored", "promo"}
    return bool(set(label.split()) & CONTENT)


def judged(page: str) -> list[tuple[str, str, str, str, tuple[str, ...]]]:
    """`parsed`, in which an element that holds the page's article does not drop it.

    As long as no article lies outside of dropped elements, the outermost one that holds WRAPS times the text outside of
    all of them is a wrapper of the page; what is dropped inside it is judged after it.
    """
    found = list(parsed(page))
    chains: dict[tuple[str, ...], int] = {}
    named = set()
    for kind, _, _, text, dropped in found:
        if kind == "text" and dropped != _NEVER:
            chains[dropped] = chains.get(dropped, 0) + len(text.strip())
        elif kind == "open" and text == "content" and dropped != _NEVER:
            named.add(dropped)
    free: set[str] = set()
    while not any(free.issuperset(chain) for chain in named):
        outside, inside = 0, {}
        for chain, size in chains.items():
            first = next((x for x in chain if x not in free), None)
            if first is None:
                outside += size
            else:
                inside[first] = inside.get(first, 0) + size
        most = max(inside, key=lambda x: (inside[x], x), default=None)
        if most is None or inside[most] <= WRAPS * outside:
            break
        free.add(most)
    if not free:
        return found
    return [(*x[:4], x[4] if x[4] == _NEVER else tuple(w for w in x[4] if w not in free)) for x in found]


def tokens_of(page: str) -> dict[str, list]:
    """Each markup token of a page with its count, its first place, whether it opens content, is dropped, and the
    characters of text right inside and their checksum."""
    return _token_table(judged(page))


def _token_table(page: list[tuple]) -> dict[str, list]:
    out: dict[str, list] = {}
    place = 0
    for kind, path, _, text, dropped in page:
        if kind == "open" or kind == "close":
            key = path if kind == "open" else "/" + path
            place += 1
            seen = out.setdefault(key, [0, place, text == "content", bool(dropped), 0, 0])
            seen[0] += 1
        elif kind == "text" and path in out:
            said = text.strip()
            out[path][4] += len(said)
            out[path][5] = crc32(said.encode("utf-8", "surrogatepass"), out[path][5])
    return out


def main_text(page: str, slots: set[str]) -> str:
    """The text of a page that lies in the template's content slots, one line for each block."""
    return _slot_text(judged(page), slots)


def _slot_text(page: list[tuple], slots: set[str]) -> str:
    """The text of a `judged` page that lies in the template's content slots, one line for each block."""
    blocks: list[str] = []
    now: list[str] = []
    inside: list[str] = []

    def end() -> None:
        line = _BLANKS.sub(" ", entities.unescape("".join(now))).strip()
        if line:
            blocks.append(line)
        now.clear()

    for kind, path, _, text, dropped in page:
        if kind == "open" and path in slots and not dropped and (not inside or path == inside[-1]):
            end()
            inside.append(path)
        elif kind == "close" and inside and path == inside[-1]:
            end()
            inside.pop()
        elif kind == "break":
            end()
        elif kind == "text" and inside and not dropped:
            now.append(text)
    end()
    return "\n".join(blocks)


def own_slots(tokens: dict[str, list]) -> set[str]:
    """The content slots of a page taken for itself: its articles, else its headlines and where most of its text is."""
    named = {t for t, x in tokens.items() if x[2] and not x[3]}
    if named:
        return named
    weight: dict[str, int] = {}
    heads = set()
    for token, x in tokens.items():
        if not x[3] and not token.startswith("/") and x[4]:
            around = re.sub(INNER, "", token) if token.count(">") > 2 else token
            weight[around] = weight.get(around, 0) + x[4]
            if re.search(_HEADLINE, token):
                heads.add(token)
    most = max(weight.values(), default=0)
    return heads | {t for t, n in weight.items() if n >= SLOT_SHARE * most}


def host_of(url: str) -> Column:
    """The host of an address in lower case; empty for null and odd ones."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """(`host`, `page`, `token`, `n`, `place`, `content`, `dropped`, `chars`, `said`) of `pages` (`host`, `page`, `html`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "token", "n", "place", "content", "dropped", "chars", "said"]
        for batch in pieces(batches, "html"):
            rows: list[tuple] = []
            for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                rows += [(host, page, token, *x) for token, x in tokens_of(text or "").items()]
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pages.mapInArrow(released(run), "host string, page long, token string, n long, place int, content boolean, dropped boolean, chars long, said long")


def templates(tokens: DataFrame) -> DataFrame:
    """(`host`, `slots`): the paths of each host's content slots, from the tokens of its pages."""
    tokens = tokens.withColumn("mark", F.xxhash64("page", "n"))
    pages = tokens.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    vectors = tokens.groupBy("host", "token").agg(
        F.sum(F.col("mark").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("found"), F.max("content").alias("content"),
        (F.avg(F.col("dropped").cast("int")) > 0.5).alias("dropped"), F.sum("chars").alias("chars"), (F.min("said") != F.max("said")).alias("varies"),
    )
    frequent = vectors.join(pages, "host").filter(F.col("found") >= F.greatest(LAYOUT * F.col("pages"), F.least(F.lit(2), "pages")))
    sized = frequent.groupBy("host", "vector").agg(F.count("*").alias("tokens"))
    classes = cut_lineage(frequent.join(sized.filter("tokens > 1"), ["host", "vector"]), "classes")

    # valid: the class's tokens in the same order on each page, compared by hashes of the ordered list
    count, size = classes.agg(F.count("*"), F.coalesce(F.sum(key_bytes("host", "token", "vector")), F.lit(0))).first()
    member = classes.select("host", "token", "vector")
    lists = tokens.select("host", "page", "token", "place").join(F.broadcast(member) if may_broadcast(count, size) else member, ["host", "token"])
    lists = lists.groupBy("host", "vector", "page").agg(F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])).alias("order"))
    orders = lists.groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b"))
    valid = classes.join(orders.filter("a = b").select("host", "vector"), ["host", "vector"], "left_semi")
    starts = valid.filter(~F.col("token").startswith("/") & ~F.col("dropped"))
    named = F.collect_set(F.when(F.col("content"), F.col("token")))
    # without an article: the text of p and the like belongs to the element around, text that never differs to the
    # frame, unless no text of the host differs
    filled = starts.filter("chars > 0").withColumn("slot", F.regexp_replace("token", INNER, ""))
    heads = F.collect_set(F.when(F.col("token").rlike(_HEADLINE), F.struct("varies", "token")))
    slots = filled.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.max("varies").alias("varies"), heads.alias("heads"))
    filled = slots.groupBy("host").agg(F.collect_list(F.struct("varies", "chars", "slot")).alias("all"), F.flatten(F.collect_list("heads")).alias("heads"))
    filled = filled.withColumn("most", F.array_max("all"))  # a varying one if there is any
    alike = [F.filter(c, lambda x: x["varies"] == F.col("most.varies")) for c in ("all", "heads")]
    fuller = F.filter(alike[0], lambda x: x["chars"] >= SLOT_SHARE * F.col("most.chars"))
    content = F.array_union(F.transform(alike[1], lambda x: x["token"]), F.transform(fuller, lambda x: x["slot"]))
    per_host = starts.groupBy("host").agg(named.alias("named")).join(filled.select("host", content.alias("unnamed")), "host", "left")
    fallback = F.coalesce("unnamed", F.array().cast("array<string>"))
    return per_host.select("host", F.when(F.size("named") > 0, F.col("named")).otherwise(fallback).alias("slots"))


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row (`id`, `url`, `text`, `n_chars`) for each row of `pages`.

    `text` is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    comments; character references are decoded, white space inside a block is one blank, blocks are lines. A page that has
    none of its host's slots is taken for itself, as is a host's only page. A host may have several layouts: the slots of
    each that a tenth of its pages have are the host's. A null or empty page has an empty text. Ids and
    addresses may be null or repeat, rows are parsed each by itself; pages without a host share one template; an empty
    table gives an empty one; other columns play no part.
    """
    require(pages, id, url, html)
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    numbered = rows.select("host", F.xxhash64("id", "url", "html").alias("page"), "html")
    tokens = cut_lineage(page_tokens(numbered), "page-tokens")
    found = cut_lineage(templates(tokens), "templates")
    count, size = found.agg(F.count("*"), F.coalesce(F.sum(key_bytes("host") + F.length(F.array_join("slots", " "))), F.lit(0))).first()
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = []
            for page, slots in zip(batch.column("html").to_pylist(), batch.column("slots").to_pylist()):
                events = judged(page or "")
                mine = set(slots or ())
                if mine and not any(kind == "open" and path in mine and not dropped for kind, path, _, _, dropped in events):
                    mine = set()
                texts.append(_slot_text(events, mine or own_slots(_token_table(events))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["id", "url", "text", "n_chars"]
            )

    placed = rows.join(F.broadcast(found) if may_broadcast(count, size) else found, "host", "left").select("id", "url", "html", "slots")
    out = placed.mapInArrow(released(run), f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id, "url": url})
