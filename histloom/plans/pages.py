"""Jobs over page tables: microdata, reading linked pages, ranking page elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import web as W
from histloom.operators.skew import first_per_group, lookup_join

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MICRODATA = "page_id long, item int, parent int, parent_prop string, item_type string, prop string, pos int, value string"


class _Items(HTMLParser):
    """Collects microdata items: for each its type, its parent and its properties in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.open = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        around = next((f for f in reversed(self.open) if f["item"] is not None), None)
        owner = around["item"] if around else None
        names = (attrs.get("itemprop") or "").split()
        frame = {"tag": tag, "item": None, "values": []}
        if "itemscope" in attrs:
            inside = owner if names else None
            frame["item"] = len(self.items)
            self.items.append({"type": attrs.get("itemtype"), "in": inside, "as": names, "props": []})
        elif owner is not None and names:
            for name in names:
                link = attrs.get("href") or "" if name == "url" else None
                slot = {"name": name, "text": [], "link": link, "content": attrs.get("content"), "src": attrs.get("src")}
                self.items[owner]["props"].append(slot)
                frame["values"].append(slot)
        if tag not in VOID:
            self.open.append(frame)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(f["tag"] == tag for f in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        for frame in self.open:
            for slot in frame["values"]:
                slot["text"].append(data)


def _item_rows(page_id: int, html: str) -> Iterator[tuple]:
    parser = _Items()
    parser.feed(html)
    parser.close()
    for number, item in enumerate(parser.items):
        head = (page_id, number, item["in"], " ".join(item["as"]) or None, item["type"])
        if not item["props"]:
            yield (*head, None, None, None)
        for pos, p in enumerate(item["props"]):
            value = p["link"]
            if value is None:
                value = p["content"] or "".join(p["text"]) or p["src"] or ""
            yield (*head, p["name"], pos, re.sub(r"\s", " ", value).strip())


def _parse_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MICRODATA.split(", ")]
    for batch in batches:
        rows = [r for page, html in zip(batch["page_id"], batch["html"]) for r in _item_rows(page, html)]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        yield out


def microdata(pages: DataFrame) -> DataFrame:
    """One row per microdata property; nested items point to their parent item and property.

    Only pages with an `itemscope` reach the parser. Repeated properties are rows of their own.
    """
    marked = pages.filter(F.contains("html", F.lit("itemscope"))).select("page_id", "html")
    return marked.mapInPandas(_parse_pages, MICRODATA)


def read_pages(requests: DataFrame, pages: DataFrame, limit: int = K.LINKS_PER_REQUEST) -> DataFrame:
    """The labelled texts of the first `limit` links of each request (request_id, links).

    A popular page may be in a third of all requests, so the lookup spreads hot links.
    """
    links = requests.select(
        "request_id", F.posexplode(F.slice("links", 1, limit)).alias("pos", "url")
    )
    texts = pages.select("url", W.page_text(F.col("html")).alias("body"))
    found = lookup_join(links, texts, ["url"], "left", spread_by=["request_id", "pos"])
    body = F.coalesce("body", F.lit("Error: page not found"))
    labelled = F.concat(F.lit("--- Content from "), F.col("url"), F.lit(" ---\n"), body, F.lit("\n\n"))
    part = F.when(body != "", labelled).otherwise("")
    return found.groupBy("request_id").agg(
        F.concat_ws(
            "", F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"])
        ).alias("text")
    )


def top_elements(elements: DataFrame, k: int = K.TOP_ELEMENTS) -> DataFrame:
    """The `k` most salient visible elements of each page, earlier ones first on ties."""
    scored = elements.filter("visible").withColumn("score", W.salience_score())
    order = [F.col("score").desc(), F.col("pos")]
    top = first_per_group(scored, ["page_id"], order, k)

    def code(column, codes):
        known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
        return F.coalesce(F.try_element_at(known, F.col(column)), F.lit(-1))

    text = W.element_text(F.col("text"), F.col("aria_label"))
    return top.select(
        "page_id", "rn", "id", "score",
        code("tag", K.TAG_CODES).alias("tag_code"),
        code("role", K.ROLE_CODES).alias("role_code"),
        text.alias("text"),
        F.left(F.md5(text), F.lit(3)).alias("hash"),
    )


def element_lines(top: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """The top elements of each page as lines of text, after the ids that came and went.

    `delta` has the columns page_id, added, removed (sorted arrays of ids).
    """

    def name(column, codes):
        known = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (v, k)])
        return F.coalesce(F.try_element_at(known, F.col(column)), F.lit("?"))

    tag, role = name("tag_code", K.TAG_CODES), name("role_code", K.ROLE_CODES)
    shown = F.concat(F.lit(", '"), F.left("text", F.lit(K.ELEMENT_LINE_CHARS)), F.lit("'"))
    line = F.concat(
        F.col("id").cast("string"), F.lit(": "), tag, W.element_hint(tag, role, F.col("text")),
        F.when(F.col("text") != "", shown).otherwise(""),
    )
    pages = top.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("_lines")
    )
    head = [F.lit("ELEMENTS (use numbered markers in screenshot):")]
    if delta is not None:
        pages = pages.join(delta, "page_id", "left")
        for label, ids in (("NEW", "added"), ("REMOVED", "removed")):
            listed = F.concat(F.lit(f"{label}: ["), F.concat_ws(", ", F.col(ids).cast("array<string>")), F.lit("]"))
            head.append(F.when(F.size(ids) > 0, listed))
    body = F.transform("_lines", lambda x: x["line"])
    return pages.select("page_id", F.concat_ws("\n", *head, body).alias("text"))
