"""Column functions over text, urls, sets and labels."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.vocabulary import BODY_URL, HIDDEN_KEYWORDS, NOISE_KEYWORDS, STOPWORDS, TITLE_STOPWORDS


def domain(url: Column, needs_scheme: bool = True) -> Column:
    """Lower-case host with port, less a leading www.; empty where there is none."""
    full = url if needs_scheme else F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def body_url(text: Column) -> Column:
    """First url in a text, null where there is none."""
    return F.nullif(F.regexp_extract(text, f"({BODY_URL})", 1), F.lit(""))


def keyword_pattern(keyword: str, prefixes: set[str] | frozenset = frozenset()) -> str:
    """A keyword as a whole word in any case; of prefix roots, the start of a word."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", keyword)
    return rf"(?iU)\b{quoted}" + ("" if keyword in prefixes else r"\b")


def crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def camel_split(tag: Column) -> Column:
    return F.regexp_replace(tag, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def tokens(text: Column, stop: set[str] = STOPWORDS) -> Column:
    """Lower-case words of three or more a-z letters that no digit, underscore or other letter adjoins, less stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*sorted(stop))) if stop else found


def title_tokens(title: Column, most: int = 10) -> Column:
    """Distinct words of three letters or more of a title, in order, less title stop words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[a-zA-Z][a-zA-Z0-9]*"), F.lit(0)), F.lower)
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*TITLE_STOPWORDS))), 1, most)


#: Names that are looked for first.
COMMON_NAMES = ["lt;", "gt;", "amp;", "quot;", "nbsp;", "apos;", "copy;", "reg;", "middot;", "bull;", "hellip;", "mdash;", "ndash;", "laquo;", "raquo;", "lsquo;", "rsquo;", "ldquo;", "rdquo;", "times;", "euro;", "pound;", "trade;", "deg;"]


def _numbered() -> dict[int, str]:
    """What references to numbers stand for where that is not the code point: HTML reads 128 to 159 as Windows letters, and some as none."""
    out = {0: "\ufffd", 13: "\r"}
    for code in range(128, 160):
        try:
            out[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            out[code] = chr(code)
    return out


def _no_characters(code: Column) -> Column:
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    return control | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column, closed: bool = False) -> Column:
    """Character references of markup as characters: numbers, and all names HTML has, those that may lack the semicolon too.

    With closed, only what ends in a semicolon is a reference.
    """
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    start = "^(#[xX][0-9a-fA-F]+;|#[0-9]+;|[A-Za-z][A-Za-z0-9]*;)" if closed else rf"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|{'|'.join(bare)})"
    lookup = lambda of: F.from_json(F.lit(json.dumps({n: html5[n] for n in of})), "map<string,string>")  # noqa: E731 (one literal, read when the query is planned)
    usual, all_names = lookup(COMMON_NAMES), lookup(sorted(html5))
    named_as = lambda name: F.coalesce(F.element_at(usual, name), F.element_at(all_names, name))  # noqa: E731 (a map is searched from its start)
    numbers = F.create_map(*[F.lit(x) for pair in _numbered().items() for x in pair])

    def numbered(found: Column) -> Column:
        digits = F.regexp_extract(found, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
        base = lambda d, n: F.conv(F.when(d == "", "0").otherwise(d), n, 10).cast("long")
        code = lambda d: F.when(F.length(d) > 8, 0x110000).when(found.rlike("^#[xX]"), base(d, 16)).otherwise(base(d, 10))
        return let(digits, lambda d: let(code(d), character))

    def character(code: Column) -> Column:
        made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        odd = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(_no_characters(code), "").otherwise(made)
        return F.coalesce(F.element_at(numbers, code.cast("int")), odd)

    def read(p: Column, found: Column) -> Column:
        rest = lambda used: F.substr(p, F.length(used) + 1)
        short = F.lit("") if closed else F.regexp_extract(p, rf"^({'|'.join(bare)})", 1)  # a name with a semicolon that HTML lacks may begin with one that it has
        by_name = let(named_as(found), lambda named: F.when(named.isNotNull(), F.concat(named, rest(found))).otherwise(let(short, lambda s: F.when(s == "", F.concat(F.lit("&"), p)).otherwise(F.concat(named_as(s), rest(s))))))
        return F.when(found == "", F.concat(F.lit("&"), p)).when(found.startswith("#"), F.concat(numbered(found), rest(found))).otherwise(by_name)

    piece = lambda p, i: F.when(i == 0, p).otherwise(let(F.regexp_extract(p, start, 1), lambda found: read(p, found)))
    return let(text, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&"), piece), "")).otherwise(t))


def html_text(html: Column, closed: bool = False) -> Column:
    """Text of markup: tags and comments become gaps, references characters, white space one blank; what then still reads as a reference becomes one too.

    With closed, a reference has its semicolon and is read once: a cut or a quoted one stays as it is.
    """
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->|<![^>]*>", " "), r"(?s)</?[A-Za-z][^>]*>", " ")
    text = F.trim(F.regexp_replace(unescape(bare, closed), r"(?U)\s+", " "))
    return text if closed else unescape(text)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common values among all; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def simpson(a: Column, b: Column) -> Column:
    """Share of common values in the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def topical(keywords: Column) -> Column:
    return F.filter(keywords, lambda k: ~k.isin(*NOISE_KEYWORDS))


def displayed(keywords: Column) -> Column:
    return F.filter(keywords, lambda k: ~k.isin(*HIDDEN_KEYWORDS))


def utc(seconds: Column, form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), form)


def duration_kind(candidates: Column, minutes: Column) -> Column:
    return F.when(candidates == 1, "isolated").when(minutes < 120, "flash").when(minutes < 240, "developing").otherwise("sustained")


def duration_bucket(minutes: Column) -> Column:
    return F.when(minutes < 30, "<30m").when(minutes < 120, "30m-2h").when(minutes <= 360, "2h-6h").otherwise(">6h")


def suggested_action(unmatched: Column, total: Column) -> Column:
    rate = F.when(total > 0, F.round(unmatched / total, 4)).otherwise(0.0)
    return F.when((rate >= 0.8) & (total >= 50), "review_for_addition").when(rate >= 0.5, "monitor").otherwise("ok")


def confidence(total: Column, authors: Column) -> Column:
    return F.when((total >= 1000) & (authors >= 50), "high").when(total >= 100, "medium").otherwise("low")


def suggested_channel(channels: Column) -> Column:
    """The channel most counts of a map name, ties by spelling; unknown without any."""
    best = F.array_min(F.transform(F.map_entries(channels), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"))))
    return F.coalesce(best["key"], F.lit("unknown"))


#: What a window keeps of an item, by short names.
MEMBER = "t string, sid long, st string, d string, it string, iid long, ca long, uri string, ruri string, a string, h array<string>, kw array<string>, rs double, rr string, rm double, rb string"
_MEMBER_NAMES = "text story_id story_title domain item_type item_id created_at platform_uri root_uri author hashtags matched_keywords route_score route_runner route_margin route_boost".split()


def encode_member(**fields: Column) -> Column:
    """JSON of an item's fields (names as decode_member gives them); texts are cut to 120 characters, absent fields left out."""
    short = dict(zip(_MEMBER_NAMES, (x.split()[0] for x in MEMBER.split(", ")), strict=True))
    own = {n: (F.substring(c, 1, 120) if n == "text" else c) for n, c in fields.items()}
    return F.to_json(F.struct(*[c.alias(short[n]) for n, c in own.items()]))


def decode_member(member: Column) -> Column:
    """A struct of an item's fields; what is missing is empty or 0, and what is no JSON is the text itself."""
    got = F.from_json(member, MEMBER)
    empty = {"string": F.lit(""), "long": F.lit(0).cast("long"), "double": F.lit(0.0), "array<string>": F.array().cast("array<string>")}
    broken = F.get_json_object(member, "$").isNull()
    out = []
    for name, field in zip(_MEMBER_NAMES, MEMBER.split(", "), strict=True):
        short, kind = field.split()
        blank = member if name == "text" else empty[kind]
        out.append(F.when(broken, blank).otherwise(F.coalesce(got[short], empty[kind])).alias(name))
    return F.struct(*out)
