"""Products and addresses out of pages, feeds and links, as expressions over columns of text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import catalogue_price_cents

# What marks a product page, and fields of a bar code, the most exact first.
MARKERS = ('itemtype="http://schema.org/Product"', 'itemtype="https://schema.org/Product"', '"@type":"Product"', 'property="og:type" content="product"', 'property="product:price:amount"', "data-price", 'name="twitter:label1" content="Price"')
GTIN_FIELDS = ("gtin13", "gtin14", "gtin12", "gtin8", "gtin")
#: Letters of a page that are looked at for markers.
LOOKED_AT = 30_000


def looks_like_product(html: Column) -> Column:
    """Whether the head of a page has a mark of a product."""
    head = F.substring(html, 1, LOOKED_AT)
    found = F.lit(False)
    for m in MARKERS:
        found = found | F.contains(head, F.lit(m))
    return F.coalesce(found, F.lit(False))


def gtin(obj: Column) -> Column:
    """The bar code of a JSON text: the first of the fields with 8 to 14 digits, blanks and strokes left out."""
    each = [F.regexp_replace(F.get_json_object(obj, f"$.{f}"), r"[\s-]", "") for f in GTIN_FIELDS]
    return F.coalesce(*(F.when(v.rlike(r"^\d{8,14}$"), v) for v in each))


def json_ld(html: Column) -> Column:
    """The JSON-LD objects of a page as texts, those of a graph one by one."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    graph = lambda b: F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>")
    listed = lambda b: F.from_json(b, "array<string>")
    each = F.transform(blocks, lambda b: F.coalesce(F.when(F.startswith(F.trim(b), F.lit("[")), listed(b)), graph(b), F.array(b)))
    return F.flatten(each)


def ld_product(html: Column) -> Column:
    """name, price_cents, gtin and in_stock of a page with exactly one product that says whether it is available; else null."""
    kind = lambda o: F.get_json_object(o, "$['@type']")
    stock = lambda o: F.coalesce(F.get_json_object(o, "$.offers.availability"), F.get_json_object(o, "$.offers[0].availability"))
    found = F.filter(json_ld(html), lambda o: (kind(o) == "Product") & stock(o).isNotNull())
    one = F.get(found, F.lit(0))
    price = F.coalesce(F.get_json_object(one, "$.offers.price"), F.get_json_object(one, "$.offers[0].price"))
    made = F.struct(F.get_json_object(one, "$.name").alias("name"), catalogue_price_cents(price).alias("price_cents"), gtin(one).alias("gtin"), F.contains(stock(one), F.lit("InStock")).alias("in_stock"))
    return F.when(F.size(found) == 1, made)


def turbo_value(text: str) -> str | None:
    """A turbo-stream answer as plain JSON: a flat array in its first line, in which objects and lists hold places of it."""
    try:
        flat = json.loads(text.split("\n", 1)[0])
    except ValueError:
        return None
    if not isinstance(flat, list) or not flat:
        return None
    open_now: set[int] = set()

    def at(i):
        if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < len(flat) or i in open_now:
            return None
        v = flat[i]
        if isinstance(v, list):
            if v and isinstance(v[0], str):
                return None
            open_now.add(i)
            out = [at(x) for x in v]
            open_now.discard(i)
            return out
        if isinstance(v, dict):
            open_now.add(i)
            named = {flat[int(k[1:])]: at(x) for k, x in v.items() if k[:1] == "_" and k[1:].isdigit() and int(k[1:]) < len(flat) and isinstance(flat[int(k[1:])], str)}
            open_now.discard(i)
            return named
        return v

    return json.dumps(at(0), ensure_ascii=False, sort_keys=True)


@F.pandas_udf(StringType())
def turbo_stream(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else turbo_value(t))


def cards(pages: DataFrame, mark: str = 'class="product-card') -> DataFrame:
    """page_id, at, name, url, price_cents, in_stock of each card of list pages (page_id, html): what lies between two marks."""
    parts = F.split("html", F.lit(mark))
    each = pages.select("page_id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("at", "c"))
    name = F.trim(F.regexp_extract("c", r'(?s)<[^>]*class="[^"]*name[^"]*"[^>]*>([^<]*)<', 1))
    price = F.regexp_extract("c", r'(?s)<[^>]*class="[^"]*price[^"]*"[^>]*>([^<]*)<', 1)
    out = each.select("page_id", "at", name.alias("name"), F.regexp_extract("c", r'href="([^"]*)"', 1).alias("url"), catalogue_price_cents(price).alias("price_cents"), (~F.contains("c", F.lit("out-of-stock"))).alias("in_stock"))
    return out.where("name <> ''")


def listed(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Products of JSON lists (page_id, body): fields gives the path in an item of each column."""
    item = F.explode(F.from_json(F.get_json_object("body", "$.items"), "array<string>")).alias("item")
    return pages.select("page_id", item).select("page_id", *(F.get_json_object("item", path).alias(c) for c, path in fields.items()))


def sitemap(maps: DataFrame, most: int = 50_000) -> DataFrame:
    """Different addresses of sitemaps (body). Raises if there are more than is plausible: a cut list would hide products."""
    found = maps.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} addresses")
    return found


def witnessed(sitemap_urls: DataFrame, source_urls: DataFrame, least_permille: int = 990, most_missing: int = 50) -> DataFrame:
    """addresses, missing, witnessed: whether a source has (nearly) all that the sitemap names."""
    both = sitemap_urls.select("url").distinct().join(source_urls.select("url", F.lit(1).alias("has")).distinct(), "url", "left")
    a = both.agg(F.count("*").alias("addresses"), F.count_if(F.col("has").isNull()).alias("missing"))
    return a.withColumn("witnessed", (F.col("addresses") > 0) & (F.col("missing") <= most_missing) & ((F.col("addresses") - F.col("missing")) * 1000 >= least_permille * F.col("addresses")))


def category_links(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """site, slug of each line (at, line) that a site's pattern (one group) knows, decoded; of a site the last one. Lines nobody knows
    come with a null site."""
    text = F.trim("line")
    site = slug = None
    for s, p in patterns.items():
        part = F.regexp_replace(F.try_url_decode(F.regexp_extract(text, p, 1)), "/+$", "")
        hit = F.regexp_extract(text, p, 1) != ""
        site, slug = (F.when(hit, s), F.when(hit, part)) if site is None else (site.when(hit, s), slug.when(hit, part))
    known = lines.where(text != "").select("at", "line", site.alias("site"), slug.alias("slug"))
    last = known.where("site is not null").groupBy("site").agg(F.max_by("slug", "at").alias("slug"))
    return last.unionByName(known.where("site is null").select("site", F.col("line").alias("slug")))


def clean_text(html: Column) -> Column:
    """Text of a fragment: no tags, entities read, blanks run together."""
    x = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</\\1>|<[^>]*>", " ")
    for entity, letter in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def slug_number(url: Column) -> Column:
    """The number that a product's address ends in, null if it has none."""
    return F.nullif(F.regexp_extract(url, r"[-/](\d+)/?(?:[?#].*)?$", 1), F.lit("")).cast("long")


def canonical_url(url: Column) -> Column:
    """An address without scheme, 'www.', query, fragment and last strokes, in lower case but for its path."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))


def pushed(batch: DataFrame, kind: str) -> DataFrame:
    """Rows of an ERP's JSON push (body: {"rows": [...]}) as stock (sku, qty) or prices (sku, supplier_name, cost_cents)."""
    schema = "rows array<struct<sku: string, qty: string, supplier_name: string, purchase_price: string>>"
    r = batch.select(F.explode(F.from_json("body", schema)["rows"]).alias("r")).select("r.*").where("sku is not null")
    if kind == "stock":
        return r.select("sku", F.coalesce(F.replace("qty", F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)).alias("qty"))
    return r.select("sku", "supplier_name", catalogue_price_cents(F.col("purchase_price")).alias("cost_cents")).where("cost_cents > 0")


def demo(spark: SparkSession, products: int = 40, sites: tuple[str, ...] = ("client", "rival_a", "rival_b")) -> DataFrame:
    """Made-up observations of two runs a day apart: every product at each site but for each fourth at the last, prices that move by up
    to two per cent, and one in ten in a promotion of fifteen per cent in the second run."""
    base = spark.range(products).select(F.col("id").alias("match_id"), (500 + F.col("id") * 37 % 900).alias("base"))
    site = F.posexplode(F.array(*map(F.lit, sites))).alias("s", "site")
    rows = base.select("match_id", "base", site).where(f"s < {len(sites) - 1} or match_id % 4 <> 0").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id"))
    price = F.expr("base + base * (pmod(xxhash64(match_id, s, run_id), 5) - 2) div 100")
    out = rows.select((F.col("match_id") * len(sites) + F.col("s")).alias("product_id"), "match_id", "site", "run_id", price.alias("price_cents"))
    return out.withColumn("discount_cents", F.when((F.col("run_id") == 2) & (F.col("match_id") % 10 == 0), F.expr("price_cents * 85 div 100")))
