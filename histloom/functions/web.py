"""Web pages: text, meta tags, linked data, URL rules, element scores."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions.nested import valid_json
from histloom.functions.text import normalize_text, strip
from histloom.operators.skew import lookup_join
from histloom.session import written

GRAM = 8
_ENTITIES = json.dumps({f"&{name}": text for name, text in html5.items() if name.endswith(";") and text != "&"})
_AMPERSANDS = ["&amp;", "&AMP;", "&#38;", "&#x26;", "&#X26;"]
_TAG = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def unescape(c: Column) -> Column:
    """Text with its character references replaced; each one found is replaced once per text."""
    found = F.regexp_extract_all(
        c, F.lit("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), F.lit(0)
    )
    names = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def character(ref: Column) -> Column:
        hexed = F.nullif(F.regexp_extract(ref, "^&#[xX](.*);$", 1), F.lit(""))
        decimal = F.nullif(F.regexp_extract(ref, "^&#([0-9]+);$", 1), F.lit("")).cast("long")
        code = F.coalesce(hexed, F.hex(decimal))
        known = F.conv(code, 16, 10).cast("long").between(1, 0x10FFFF)
        numeric = F.when(known, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        return F.coalesce(numeric, F.try_element_at(names, ref), ref)

    others = F.array_except(found, F.array(*[F.lit(a) for a in _AMPERSANDS]))
    out = F.aggregate(others, c, lambda acc, ref: F.replace(acc, ref, character(ref)))
    for amp in _AMPERSANDS:
        out = F.replace(out, F.lit(amp), F.lit("&"))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def page_text(html: Column) -> Column:
    """The text of a page body: no scripts, styles or comments, a line per block, no blank lines."""
    body = F.regexp_extract(html, f"(?is)<body(?=[ >]){_TAG}>(.*)", 1)
    text = F.when(body != "", body).otherwise(html)
    text = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, f"[{K.SPACE}]+", " ")
    text = F.regexp_replace(text, f"(?i)</?(?:{'|'.join(K.BLOCK_TAGS)})(?=[\\s/>]){_TAG}>", "\n")
    text = unescape(F.regexp_replace(text, f"</?[A-Za-z!]{_TAG}>", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return strip(F.concat_ws("\n", lines))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag; null if it is not there."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.when(F.rlike(tag, F.lit(pattern)), value)


def meta_tags(html: Column) -> Column:
    """Content of the meta tags by `name`, else by `property`; a later tag wins."""
    tags = F.regexp_extract_all(html, F.lit(f"(?i)<meta(?=[\\s/]){_TAG}>"), F.lit(0))
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            F.coalesce(attribute(t, "name"), attribute(t, "property")).alias("key"),
            unescape(attribute(t, "content")).alias("value"),
        ),
    )
    full = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    return F.aggregate(
        full,
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])
        ),
    )


def linked_data(html: Column) -> Column:
    """The JSON-LD blocks of a page, each with whether it could be parsed.

    Only a single block is parsed; with more of them all stay raw text.
    """
    pattern = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda b: strip(b))
    return F.transform(
        blocks,
        lambda b: F.struct(b.alias("block"), ((F.size(blocks) == 1) & valid_json(b)).alias("parsed")),
    )


def url_rules(statuses: dict[str, str], blocked: Iterable[str] = ()) -> Column:
    """URL rules in order of entry; the block list overrides. They become part of the plan: hand
    long lists to `allowed_by_table` as a table."""
    merged = {**statuses, **{url: "blocked" for url in blocked}}
    rows = [F.struct(F.lit(u).alias("url"), F.lit(s).alias("status")) for u, s in merged.items()]
    return F.array(*rows) if rows else F.array().cast("array<struct<url:string,status:string>>")


def _pieces(text: Column, size: Column | int) -> Column:
    """The distinct pieces of `size` characters of a text; none of a shorter text."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size))))


def rarest_pieces(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """`rules` (_rule, _size and more) with `_gram`: of the pieces of a rule, that which the
    fewest URLs hold. A rule with a piece that no URL holds is part of none and left out.

    Pieces are counted over all URLs first, map-side, so a piece that most of them share is one
    row; it becomes a key only where a rule has no rarer one."""
    sizes = rules.agg(F.collect_set("_size").alias("s")).scalar()  # at most GRAM numbers
    grams = url_pieces(urls, url, sizes)
    counts = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = rules.select("_rule", F.explode(_pieces(F.col("_rule"), F.col("_size"))).alias("_gram"))
    counted = own.join(counts, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    best = counted.groupBy("_rule").agg(F.min(F.struct("_n", "_gram")).alias("_best")).filter(F.col("_best._n") > 0)
    return rules.join(best.select("_rule", F.col("_best._gram").alias("_gram")), "_rule")


def url_pieces(urls: DataFrame, url: str, sizes: Column) -> DataFrame:
    """(url, _gram) for the pieces of every size in `sizes` of every URL."""
    at = F.col(url)
    lists = F.transform(F.col("_sizes"), lambda n: F.coalesce(_pieces(at, n), F.array().cast("array<string>")))
    with_sizes = urls.select(url).withColumn("_sizes", sizes)
    return with_sizes.select(url, F.explode(F.array_distinct(F.flatten(lists))).alias("_gram"))


def allowed_by_table(pages: DataFrame, url: str, row_id: str, rules: DataFrame) -> DataFrame:
    """`pages` with `allowed`, by a table of rules (url, status, ord) of any size.

    The latest status of a rule's URL counts, at the place where the URL came first. The rule for
    exactly the page's URL decides, else the first rule whose text is part of it, else it is
    allowed. Rules are indexed by their rarest piece of GRAM characters (see `rarest_pieces`;
    shorter rules by their whole text): URLs and rules meet by equality of that piece, and only
    pairs that do are compared in full. A piece that many URLs share all the same is spread.
    """
    merged = rules.groupBy("url").agg(F.min("ord").alias("ord"), F.max_by("status", "ord").alias("status"))
    size = F.least(F.length("url"), F.lit(GRAM)).alias("_size")
    known = merged.filter(F.length("url") > 0).select(F.col("url").alias("_rule"), "ord", "status", size)
    known = written(known, "url-rules")
    at = F.col(url)
    distinct = written(pages.select(url).filter(at.isNotNull()).distinct(), "urls")
    indexed = written(rarest_pieces(distinct, url, known), "rule-pieces")
    grams = url_pieces(distinct, url, indexed.agg(F.collect_set("_size").alias("s")).scalar())
    mine = grams.join(indexed.select("_gram").distinct(), "_gram", "left_semi")
    met = lookup_join(mine, indexed, ["_gram"], "inner", spread_by=[url]).filter(F.contains(at, F.col("_rule")))
    first = met.groupBy(url).agg(F.min(F.struct("ord", "status")).alias("_first"))
    exact = known.select(F.col("_rule").alias(url), F.col("status").alias("_exact"))
    found = lookup_join(pages, first.join(exact, url, "full"), [url], "left", spread_by=[row_id])
    blank = merged.filter(F.length("url") == 0).select("ord", "status").first()  # part of every URL
    everywhere = F.col("_first")
    if blank is not None:
        rule = F.struct(F.lit(blank["ord"]).cast(merged.schema["ord"].dataType).alias("ord"), F.lit(blank["status"]).alias("status"))
        everywhere = F.when(at.isNotNull(), rule)
    status = F.coalesce("_exact", F.least("_first", everywhere)["status"])
    return found.withColumn("allowed", F.coalesce(status == "allowed", F.lit(True))).drop("_exact", "_first")


def url_allowed(url: Column, rules: Column) -> Column:
    """Whether a URL may be opened: by the rule for exactly this URL, else by the first rule
    whose text is part of the URL, else yes."""
    exact = F.try_element_at(F.filter(rules, lambda r: r["url"] == url), F.lit(1))
    partly = F.try_element_at(F.filter(rules, lambda r: F.contains(url, r["url"])), F.lit(1))
    status = F.coalesce(exact["status"], partly["status"])
    return F.coalesce(status == "allowed", F.lit(True))


def is_pdf(url: Column) -> Column:
    return F.endswith(F.lower(url), F.lit(".pdf"))


def element_text(text: Column, aria_label: Column) -> Column:
    """The normalised, shortened text of an element, else its label."""
    return normalize_text(F.coalesce(F.nullif(text, F.lit("")), aria_label), K.ELEMENT_TEXT_CHARS)


def _is_search(text: Column) -> Column:
    return F.contains(text, F.lit("search")) | text.isin(K.SEARCH_TEXTS)


def salience_score() -> Column:
    """How much an element matters, from its columns."""
    tag, role = F.col("tag"), F.col("role")
    text = element_text(F.col("text"), F.col("aria_label"))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    field = (tag == "input") & (role == "textbox")
    words = "|".join(re.escape(w) for w in K.ACTION_WORDS)
    return (
        points(role.isin("button", "link", "textbox"), 3)
        + points(tag.isin("button", "input", "select"), 2)
        + points(F.col("in_form"), 2)
        + points(F.col("focused"), 2)
        + points(F.col("cta"), 2)
        + points(text.rlike(words), 3)
        + F.when(field & _is_search(text), 10).when(field, 5).otherwise(0)
        + points(F.coalesce("visible", F.lit(True)) & F.col("interactive"), 1)
    )


def element_hint(tag: Column, role: Column, text: Column) -> Column:
    """The hint that follows the tag in an element line."""
    return (
        F.when((tag == "input") & (role == "textbox") & _is_search(F.lower(text)), " 🔍SEARCH")
        .when((tag == "input") & (role == "textbox"), " INPUT")
        .when(tag == "button", " BTN")
        .when((tag == "select") & (role == "combobox"), " DROPDOWN")
        .when((tag == "a") & (role == "link"), " LINK")
        .when(tag == "textarea", " TEXTAREA")
        .otherwise("")
    )
