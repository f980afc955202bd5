"""Text, key and slug expressions. Everything here is a `Column -> Column` function that stays in
the JVM, apart from `nfc`, for which Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points Python's str.strip and str.split treat as whitespace.
_WS_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WS_TEXT = "".join(map(chr, _WS_POINTS))
# the same set as the inside of a Java character class
WS_CHARS = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_CHARS}]"
WORD = r"[\p{L}\p{N}_]"

# Index tokens, and the search/snippet text limits.
TOKEN_PATTERN = "[a-z0-9]+"
SNIPPET_CHARS = 120

# Characters a wiki URL keeps as they are, with the form `url_encode` gives them.
URL_KEEP = {
    "%2F": "/", "%3A": ":", "%40": "@", "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(",
    "%29": ")", "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "=", "%7E": "~",
}


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Bind `value` once for use at several places of `body`.

    The optimizer inlines projected aliases into lambdas, where they would be evaluated once per
    element; a one-element array keeps the binding.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column | str) -> Column:
    """Unicode strip; `trim` with a character set is several times cheaper than a regex."""
    return F.trim(col(text), F.lit(WS_TEXT))


def collapse_whitespace(text: Column | str) -> Column:
    """Blank runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(text), f"{WS}+", " "))


def visible_chars(text: Column | str) -> Column:
    return F.length(F.translate(col(text), WS_TEXT, ""))


def tokenize(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def sha256_hex(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def _slug_chars(text: Column, default: str) -> Column:
    squeezed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(squeezed, F.lit("_")), F.lit("")), F.lit(default))


def path_name(path: Column | str) -> Column:
    """Last path component, ignoring trailing slashes and `.` components."""
    trimmed = F.regexp_replace(col(path), r"(?:/+\.?)+\z", "")
    return F.regexp_extract(trimmed, r"([^/]*)\z", 1)


def path_stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading-dot name and a trailing dot are no suffix."""
    return F.regexp_replace(path_name(path), r"(?s)(?<=.)\.[^.]+\z", "")


def source_slug(source: Column | str) -> Column:
    return _slug_chars(path_stem(source), "source")


def document_slug(document_id: Column | str) -> Column:
    return _slug_chars(col(document_id), "document")


def chunk_id(slug: Column | str, chunk_index: Column | str, sha256: Column | str) -> Column:
    number = F.format_string("%06d", col(chunk_index))
    return F.concat_ws(":", col(slug), number, F.substring(col(sha256), 1, 12))


def document_id(supplied: Column | str, source_key: Column | str, text: Column | str) -> Column:
    """The supplied id with odd characters replaced, else one derived from key and text."""
    cleaned = F.regexp_replace(strip(supplied), rf"[^\p{{L}}\p{{N}}_:-]", "_")
    derived = F.concat(
        F.lit("doc-"), F.substring(F.sha2(F.concat_ws("\n", col(source_key), col(text)), 256), 1, 16)
    )
    return F.coalesce(F.nullif(cleaned, F.lit("")), derived)


def index_slug(name: Column | str) -> Column:
    """Slug of an index name, null where the name leaves nothing."""
    dashed = F.regexp_replace(F.lower(strip(name)), f"{WS}+", "-")
    cleaned = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9_-]+", ""), "-+", "-")
    return F.nullif(F.regexp_replace(cleaned, r"\A[-_]+|[-_]+\z", ""), F.lit(""))


def index_name_error(name: Column | str) -> Column:
    """Why a name cannot become an index, null when it can."""
    stripped = strip(name)
    return (
        F.when(col(name).isNull() | (stripped == ""), "empty")
        .when(stripped.contains("..") | stripped.contains("/") | stripped.contains("\\"), "traversal")
        .when(index_slug(name).isNull(), "empty_slug")
    )


def snippet(text: Column | str, limit: int = SNIPPET_CHARS) -> Column:
    """At most `limit` characters, the ellipsis counted in."""
    text = col(text)
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def article_url(base_url: str, title: Column | str) -> Column:
    base = base_url if base_url.endswith("/") else base_url + "/"
    # url_encode writes '*', '-', '.', '_' as they are and a space as '+'; titles have none left
    encoded = F.url_encode(F.replace(col(title), F.lit(" "), F.lit("_")))
    for escaped, plain in URL_KEEP.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return F.concat(F.lit(base), encoded)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, vectorised over an Arrow batch."""
    return text.map(lambda value: unicodedata.normalize("NFC", value), na_action="ignore")
