"""Products in the data stream of a page: chunks of text pushed by scripts, joined, cut into rows that refer to each other.

A Python table function reads a page: chunks are string literals of JSON, rows of the joined text are `id:value`, and a
value `$id` or `$Lid` stands for that row. Objects are walked with their references; what looks like a product comes out as a row.
Everything after that is done with column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.names import catalogue_price_cents
from .pages import gtin

PUSH = re.compile(r'self\.__next_f\.push\(\[\s*1\s*,\s*(?=")')
ROW = re.compile(r"^([0-9a-f]+):([\[{\"].*)$", re.M)
REFERENCE = re.compile(r"\$L?([0-9a-f]+)$")
#: Levels of nesting that a walk follows, references included; those in a circle end there.
DEEPEST = 60


def joined_chunks(html: str) -> str:
    """The pushed texts of a page one after another; what is no string literal is passed over."""
    decoder, out = json.JSONDecoder(), []
    for m in PUSH.finditer(html):
        try:
            out.append(decoder.raw_decode(html, m.end())[0])
        except ValueError:
            continue
    return "".join(x for x in out if isinstance(x, str))


def rows_of(text: str) -> dict[str, object]:
    """The rows of a joined text that are JSON, by id."""
    found = {}
    for m in ROW.finditer(text):
        try:
            found[m.group(1)] = json.loads(m.group(2))
        except ValueError:
            continue
    return found


def resolve(value: object, rows: dict[str, object], depth: int = 0) -> object:
    """The value with the rows that it refers to in place of their names."""
    if depth > DEEPEST:
        return None
    if isinstance(value, str) and (m := REFERENCE.match(value)) and m.group(1) in rows:
        return resolve(rows[m.group(1)], rows, depth + 1)
    if isinstance(value, dict):
        return {k: resolve(v, rows, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, rows, depth + 1) for v in value]
    return value


def objects(value: object) -> Iterator[dict]:
    """Every object in a value, outer ones first; a text that is itself JSON with types is read too."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from objects(v)
    elif isinstance(value, list):
        for v in value:
            yield from objects(v)
    elif isinstance(value, str) and '"@type"' in value:
        try:
            yield from objects(json.loads(value))
        except ValueError:
            return


def is_product(o: dict) -> bool:
    return o.get("@type") == "Product" or ("id" in o and "price" in o and bool(str(o.get("name") or "").strip()))


def text_of(value: object) -> str | None:
    if isinstance(value, dict):
        value = value.get("name")
    return None if value is None or isinstance(value, (dict, list)) else str(value)


@udtf(returnType="external_id string, name string, price string, old_price string, quantity string, brand string, availability string, object string, current_page int, last_page int")
class FlightProducts:
    """One row for each different product of a page; one with nulls for a page that has none but says which page it is."""

    def eval(self, html: str):
        text = joined_chunks(html or "")
        pages = [([int(x) for x in re.findall(rf'"{k}"\s*:\s*(\d{{1,9}})', text)] or [None])[-1] for k in ("currentPage", "lastPage")]
        rows, seen = rows_of(text), set()
        for value in rows.values():
            for o in objects(resolve(value, rows)):
                if not is_product(o):
                    continue
                offer = o.get("offers")
                offer = offer[0] if isinstance(offer, list) and offer else offer if isinstance(offer, dict) else {}
                made = (text_of(o.get("id", o.get("sku"))), text_of(o.get("name")), text_of(o.get("price", offer.get("price"))), text_of(o.get("old_price")), text_of(o.get("quantity")), text_of(o.get("brand")), text_of(offer.get("availability")))
                if made[:2] in seen:
                    continue
                seen.add(made[:2])
                yield *made, json.dumps(o), *pages
        if not seen and pages != [None, None]:
            yield *[None] * 8, *pages


def flight_products(pages: DataFrame) -> DataFrame:
    """The columns of the pages (with html) but that one, and external_id, name, brand, price_cents, discount_cents, gtin, in_stock,
    current_page and last_page of each product in their streams.

    An old price above the price makes that the discount. in_stock follows from the quantity, else from the availability; null
    if neither says. Pages without a stream give no rows."""
    rest = [c for c in pages.columns if c != "html"]
    found = pages.lateralJoin(FlightProducts(F.col("html").outer()))
    price, old = catalogue_price_cents(F.col("price")), catalogue_price_cents(F.col("old_price"))
    on_sale = F.coalesce(old > price, F.lit(False))
    quantity = F.col("quantity").try_cast("double")
    stock = F.when(quantity.isNotNull(), quantity > 0).when(F.col("availability").isNotNull(), F.contains("availability", F.lit("InStock")))
    return found.select(*rest, "external_id", F.trim("name").alias("name"), "brand", F.when(on_sale, old).otherwise(price).alias("price_cents"), F.when(on_sale, price).alias("discount_cents"), gtin(F.col("object")).alias("gtin"), stock.alias("in_stock"), "current_page", "last_page")


def whole_listings(found: DataFrame, site: str = "site") -> DataFrame:
    """site, pages, last_page, products, complete: whether every page of a site's listing was read."""
    g = found.groupBy(site).agg(F.count_distinct("current_page").alias("pages"), F.max("last_page").alias("last_page"), F.count_distinct("external_id").alias("products"))
    return g.withColumn("complete", F.coalesce(F.col("pages") == F.col("last_page"), F.lit(False)))
