"""Nested JSON columns: product lists, page metadata, surveys.

Elements are kept as raw JSON text until they are known to be objects, so one odd element does
not turn a whole list into null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom import constants as K

_MAP = "map<string,string>"


STRICT = {"allowSingleQuotes": "false"}


def _within(c: Column, first: str, last: str) -> Column:
    """Whether the text starts and ends with these marks, so that nothing follows the value."""
    return F.coalesce(
        F.startswith(F.ltrim(c, F.lit(K.SPACES)), F.lit(first))
        & F.endswith(F.rtrim(c, F.lit(K.SPACES)), F.lit(last)),
        F.lit(False),
    )


def json_object(c: Column) -> Column:
    """A JSON object as map of texts (nested values as JSON text); null for anything else."""
    return F.when(_within(c, "{", "}"), F.from_json(c, _MAP, STRICT))


def json_list(c: Column) -> Column:
    """The elements of a JSON array as texts; an empty list for anything else."""
    items = F.when(_within(c, "[", "]"), F.from_json(c, "array<string>", STRICT))
    return F.coalesce(items, F.array().cast("array<string>"))


def json_objects(c: Column) -> Column:
    """The objects in a JSON array, each as map of texts; other elements are left out."""
    return F.filter(F.transform(json_list(c), json_object), lambda m: m.isNotNull())


def get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def has(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))


def _no_objects() -> Column:
    return F.array().cast(f"array<{_MAP}>")


def with_products(
    df: DataFrame,
    into: str,
    products: str = "products",
    page_meta: str = "page_meta",
    click_type: str = "click_type",
) -> DataFrame:
    """Add the products of an action: its own list, else the cart or search data of its page.

    A cart action falls back to the cart of the page. A product link falls back to the cart if
    the page has one, else to its search results, which may be an object, a list, or either of
    them inside a JSON string, and count only with an item id. The page is parsed once per row,
    and only for rows without an own list.
    """
    own = json_objects(F.col(products))
    staged = df.withColumn("_own", own).withColumn(
        "_meta", F.when(F.size("_own") == 0, json_object(F.col(page_meta)))
    )
    meta, click = F.col("_meta"), F.col(click_type)
    has_cart = has(meta, "cart_items")
    searched = F.coalesce(_truthy(get(meta, "search_results")), get(meta, "data"))
    staged = staged.withColumn("_cart", F.when(has_cart, json_objects(get(meta, "cart_items"))))
    staged = staged.withColumn("_found", F.when((click == "product_link") & ~has_cart, searched))
    staged = staged.withColumn("_one", json_object(F.col("_found")))
    one = F.col("_one")
    listed = F.filter(json_objects(F.col("_found")), lambda m: has(m, "asin"))
    value = (
        F.when(F.size("_own") > 0, F.col("_own"))
        .when(click.isin("cart_side_bar", "product_link") & F.col("_cart").isNotNull(), F.col("_cart"))
        .when(has(one, "asin"), F.array(one))
        .when(F.col("_found").isNotNull(), listed)
        .otherwise(_no_objects())
    )
    return staged.withColumn(into, value).drop("_own", "_meta", "_cart", "_found", "_one")


def _truthy(c: Column) -> Column:
    return F.when(~F.trim(c).isin("", "[]", "{}", "0", "false"), c)


def product_fields(p: Column) -> list[Column]:
    """Item fields with defaults for absent keys only: a key that holds null stays null."""

    def field(key: str, default: Column) -> Column:
        return F.when(has(p, key), get(p, key)).otherwise(default).alias(key)

    return [
        field("asin", F.lit(K.MISSING_ITEM_ID)),
        field("title", F.lit(K.MISSING_TITLE)),
        field("price", F.lit(K.MISSING_PRICE)),
        field("options", F.lit(None).cast("string")),
    ]


def merged_objects(c: Column) -> Column:
    """An object, or the objects of a list merged with later keys winning, as map of texts."""
    empty = F.create_map().cast(_MAP)

    def merge(acc: Column, m: Column) -> Column:
        return F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(m, k)), m)

    return F.coalesce(json_object(c), F.aggregate(json_objects(c), empty, merge))


def product_details(page_meta: Column) -> Column:
    """`product_details` of a page as one map; an empty one where it is absent."""
    return merged_objects(get(json_object(page_meta), "product_details"))


def survey_fields(c: Column) -> Column:
    """A survey as map: a JSON object, else the text under `raw_survey`; null stays null."""
    raw = F.create_map(F.lit("raw_survey"), c)
    return F.when(c.isNotNull(), F.coalesce(F.when(valid_json(c), json_object(c)), raw))


def valid_json(c: Column) -> Column:
    """Whether the text is one JSON value; blank text is none. The parser stops after a first
    value; as the only entry of a list it must not be followed by anything."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    blank = F.trim(c, F.lit(K.SPACES)) == ""
    return ~blank & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()


def survey_text(survey: Column) -> Column:
    """A survey map as headed text, in fixed section order, with one more level of nesting."""

    def lines(section: Column, nested: bool) -> Column:
        def entry(e: Column) -> Column:
            inner = json_object(e["value"])
            flat = F.concat(F.lit("- "), e["key"], F.lit(": "), _shown(e["value"]))
            if not nested:
                return F.array(flat)
            deep = F.transform(
                F.map_entries(inner),
                lambda i: F.concat(F.lit("  - "), i["key"], F.lit(": "), _shown(i["value"])),
            )
            head = F.array(F.concat(F.lit("- "), e["key"], F.lit(":")))
            return F.when(inner.isNotNull(), F.concat(head, deep)).otherwise(F.array(flat))

        as_map = json_object(section)
        return F.when(
            as_map.isNotNull(), F.flatten(F.transform(F.map_entries(as_map), entry))
        ).otherwise(F.array(F.concat(F.lit("- "), _shown(section))))

    nothing = F.array().cast("array<string>")
    parts = [F.array(F.lit(K.SURVEY_TITLE))]
    for name, heading in K.SURVEY_SECTIONS.items():
        nested = name in ("Shopping Preference", "Personality")
        body = lines(get(survey, name), nested)
        parts.append(
            F.when(has(survey, name), F.concat(F.array(F.lit("\n" + heading)), body)).otherwise(nothing)
        )
    raw = F.array(F.lit("\n" + K.RAW_SURVEY_HEADING), _shown(get(survey, "raw_survey")))
    parts.append(F.when(has(survey, "raw_survey"), raw).otherwise(nothing))
    empty = F.coalesce(F.size(survey), F.lit(0)) <= 0
    return F.when(empty, "").otherwise(F.concat_ws("\n", F.concat(*parts)))


def _shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("None"))
