"""What names, prices and counts say, read from texts that follow from the tables; the oracles work from what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import brands, digest, electronics, guards, intake, taxonomy
from ..sources import files
from ..sources.adapter import events, table
from ..sources.lineage import PRODUCTS_SQL, products
from ..sources.listings import LISTINGS_SQL, MAKERS, listings
from ..sources.shared import stored
from .registry import query

LISTED = f"{PRODUCTS_SQL},{LISTINGS_SQL}"
FORM = "CASE form WHEN 'krem' THEN 'cream' ELSE form END"


@query(f"SELECT product_id, replace(dose, ' ', '') AS dosage, 'n' || (10 + match_id % 2 * 10) AS pack, {FORM} AS form, norm AS normalized, 10 + match_id % 2 * 10 AS pieces, true AS sure FROM listings", LISTED)
def amounts_of_listings(spark, d):
    """Dose, pack, form and searchable name of every listing."""
    n = F.col("name")
    read = listings(spark, d).select("product_id", names.dosage(n).alias("dosage"), names.pack_size(n).alias("pack"), names.form(n).alias("form"), names.normalized(n).alias("normalized"), names.pack_count(F.lit(None).cast("string"), n).alias("p"))
    return read.select("product_id", "dosage", "pack", "form", "normalized", F.col("p.count").alias("pieces"), "p.sure")


DOSES = "CASE WHEN match_id % 6 = 5 THEN [5, 10] ELSE [[100], [200], [400]][match_id % 3 + 1] END"


@query(f"SELECT a.product_id AS a, b.product_id AS b, a.form IS NOT NULL AND b.form IS NOT NULL AND a.form <> b.form AS form, a.match_id % 2 <> b.match_id % 2 AS pack_count, a.doses <> b.doses AS dose, a.maker IS NOT NULL AND b.maker IS NOT NULL AND false AS route FROM (SELECT *, {DOSES} AS doses FROM listings) a JOIN (SELECT *, {DOSES} AS doses FROM listings) b ON b.match_id IN (a.match_id + 1, a.match_id + 2) AND a.site <> b.site", LISTED)
def guards_of_listings(spark, d):
    """Whether form, count, dose and route tell listings of neighbouring parts apart."""
    p = stored(listings(spark, d).select("product_id", "match_id", "site", "name"))
    f = stored(guards.features(p.select("name").distinct()))
    one = p.select(F.col("product_id").alias("a"), F.col("site").alias("s1"), F.col("name").alias("a_name"), F.explode(F.array(F.col("match_id") + 1, F.col("match_id") + 2)).alias("m"))
    two = p.select(F.col("product_id").alias("b"), F.col("site").alias("s2"), F.col("name").alias("b_name"), F.col("match_id").alias("m"))
    pairs = one.join(two, "m").where("s1 <> s2").join(guards.side(f, "a_"), "a_name").join(guards.side(f, "b_"), "b_name")
    return pairs.select("a", "b", *(F.coalesce(guards.GUARDS[g]("a_", "b_"), F.lit(False)).alias(g) for g in ("form", "pack_count", "dose", "route")))


@query("SELECT product_id, price_cents AS regular, final, price_cents AS price, CASE WHEN final < price_cents THEN final END AS discount, CASE WHEN final < price_cents THEN round((1 - final / price_cents) * 100, 1) END AS percent, final < price_cents AS on_sale FROM (SELECT product_id, price_cents, price_cents * (80 + product_id % 41) // 100 AS final FROM products)", PRODUCTS_SQL)
def sales_of_products(spark, d):
    """Regular and final prices as price, discount and percentage."""
    p = products(spark, d).select("product_id", F.col("price_cents").alias("regular"), F.expr("price_cents * (80 + product_id % 41) div 100").alias("final"))
    return p.select("product_id", "regular", "final", files.sale_fields(F.col("regular"), F.col("final")).alias("f")).select("product_id", "regular", "final", "f.*")


@query("SELECT product_id, price_cents - CASE WHEN product_id % 4 = 3 THEN price_cents % 100 ELSE 0 END AS cents FROM products", PRODUCTS_SQL)
def prices_as_written(spark, d):
    """Prices written with commas, points, thousands in groups, and without cents, read again."""
    p = products(spark, d).select("product_id", (F.expr("price_cents div 100")).alias("w"), F.lpad((F.col("price_cents") % 100).cast("string"), 2, "0").alias("f"))
    grouped = F.when(F.col("w") >= 1000, F.concat_ws(" ", F.expr("w div 1000").cast("string"), F.lpad((F.col("w") % 1000).cast("string"), 3, "0"))).otherwise(F.col("w").cast("string"))
    whole = F.col("w").cast("string")
    text = F.element_at(F.array(F.concat(whole, F.lit(","), "f", F.lit(" ₼")), F.concat(whole, F.lit("."), "f", F.lit(" AZN")), F.concat(F.lit("cəmi "), grouped, F.lit(","), "f"), F.concat(grouped, F.lit(" man"))), (F.col("product_id") % 4 + 1).cast("int"))
    return p.select("product_id", names.catalogue_price_cents(text).alias("cents"))


@query("SELECT product_id, CASE product_id % 5 WHEN 2 THEN 'out_of_stock' WHEN 3 THEN 'in_stock' ELSE 'unknown' END AS status, CASE product_id % 5 WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN (product_id + 1)::DOUBLE END AS quantity FROM products", PRODUCTS_SQL)
def stock_of_products(spark, d):
    """Counts as texts: negative ones, words, none, nothing at all, and good ones."""
    raw = F.expr("case product_id % 5 when 0 then '-1' when 1 then 'many' when 2 then '0' when 3 then cast(product_id + 1 as string) end")
    return products(spark, d).select("product_id", intake.stock_of_quantity(raw).alias("x")).select("product_id", "x.*")


@query("SELECT coalesce(o.product_id, n.product_id) AS product_id, CASE WHEN n.product_id IS NULL THEN o.name ELSE n.name END AS name, coalesce(nullif(n.brand, ''), o.brand) AS brand, coalesce(nullif(o.barcode, ''), n.barcode) AS barcode FROM (SELECT product_id, name, brand, CASE WHEN product_id % 4 = 0 THEN '' ELSE barcode END AS barcode FROM products WHERE product_id % 3 <> 0) o FULL JOIN (SELECT product_id, name || ' new' AS name, CASE WHEN product_id % 5 = 0 THEN '' ELSE brand || '+' END AS brand, '9' || product_id AS barcode FROM products WHERE product_id % 2 = 0) n USING (product_id)", PRODUCTS_SQL)
def upserts_of_products(spark, d):
    """A batch merged into what is stored: names always, brands if given, bar codes if there are none."""
    p = products(spark, d)
    old = p.where("product_id % 3 <> 0").select("product_id", "name", "brand", F.when(F.col("product_id") % 4 == 0, "").otherwise(F.col("barcode")).alias("barcode"))
    new = p.where("product_id % 2 = 0").select("product_id", F.concat("name", F.lit(" new")).alias("name"), F.when(F.col("product_id") % 5 == 0, "").otherwise(F.concat("brand", F.lit("+"))).alias("brand"), F.concat(F.lit("9"), "product_id").alias("barcode"))
    return intake.upserted(old, new, ["product_id"], ["name"], ["brand"], ["barcode"])


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN hour(ts) >= 22 OR hour(ts) < 8 WHEN 1 THEN hour(ts) >= 9 AND hour(ts) < 18 ELSE false END AS quiet FROM events", prelude=False)
def quiet_events(spark, d):
    """Events within quiet hours over midnight, within a day, and by hours that can't be read."""
    hours = F.element_at(F.array(*map(F.lit, ("22-08", "09-18", "bad"))), (F.col("event_id") % 3 + 1).cast("int"))
    return events(spark, d).select("event_id", digest.is_quiet(hours, F.col("ts")).alias("quiet"))


NATIONS = {"az": "AZE", "tr": "Türkiyə", "ru": "россия", "de": "GERMANY", "fr": "France", "it": "Italiya", "pl": "polsa", "jp": "Japan"}


@query("SELECT c_custkey, CASE c_custkey % 10 WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE ['" + "', '".join(NATIONS) + "'][c_custkey % 10 + 1] END AS code, CASE c_custkey % 10 WHEN 8 THEN 'ambiguous' WHEN 9 THEN 'invalid' ELSE 'resolved' END AS status FROM customer", prelude=False)
def countries_of_customers(spark, d):
    """Countries as sources write them: codes and names in several languages, numbers, and words that name none."""
    raw = F.element_at(F.array(*map(F.lit, (*NATIONS.values(), "17", "Atlantis"))), (F.col("c_custkey") % 10 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", taxonomy.country(raw).alias("c")).select("c_custkey", "c.*")




@query("SELECT product_id, coalesce(upper(maker), string_split(words, ' ')[1]) AS brand, CASE WHEN maker IS NOT NULL THEN 'known' ELSE 'first_word' END AS how FROM listings", LISTED)
def brands_of_listings(spark, d):
    """Makers known by their names, else the first word of the listing."""
    known = spark.createDataFrame([(m, m.upper()) for m in MAKERS], "alias string, brand string")
    return brands.resolved(listings(spark, d).select("product_id", "name"), known)


@query("SELECT product_id, upper(maker) AS brand FROM listings WHERE maker IS NOT NULL AND product_id % 2 = 0", LISTED)
def brands_in_addresses(spark, d):
    """Makers in the last part of an address; half of the addresses have numbers there."""
    known = spark.createDataFrame([(m, m.upper()) for m in MAKERS], "alias string, brand string")
    slug = F.when(F.col("product_id") % 2 == 0, F.regexp_replace("norm", " ", "-")).otherwise(F.col("product_id").cast("string"))
    return brands.of_address(listings(spark, d).select("product_id", F.concat(F.lit("https://x.example/p/"), slug, F.lit("/?a=1")).alias("url")), known)


@query("SELECT 2 * p_partkey AS a, 2 * p_partkey + 1 AS b, 'code' AS strategy FROM part WHERE p_size % 4 <> 0", prelude=False)
def electronics_of_parts(spark, d):
    """Parts sold at two shops by code, a quarter of them at prices too far apart, and names that nothing tells by."""
    part = table(spark, d, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    sold = part.select((2 * F.col("p_partkey")).alias("product_id"), F.lit("a").alias("site"), F.concat(F.lit("Boss WAT"), "p_partkey", F.lit(" pralka white")).alias("name"), cents.alias("price_cents"))
    other = part.select((2 * F.col("p_partkey") + 1).alias("product_id"), F.lit("b").alias("site"), F.concat(F.lit("Boss WAT"), "p_partkey", F.lit(" white pralka")).alias("name"), (cents * F.when(F.col("p_size") % 4 == 0, 2).otherwise(1)).alias("price_cents"))
    plain = part.select((-1 - F.col("p_partkey")).alias("product_id"), F.concat(F.lit("s"), F.col("p_partkey") % 2).alias("site"), F.lit("Boss").alias("name"), cents.alias("price_cents"))
    return electronics.pairs(sold.union(other).union(plain))


@query("SELECT DISTINCT site, CASE match_id % 4 WHEN 0 THEN 'goz-xestelikleri-' || match_id WHEN 1 THEN 'tabletler' WHEN 2 THEN 'other-' || match_id ELSE 'seker-vitaminleri-' || match_id END AS slug, CASE match_id % 4 WHEN 0 THEN 'eye' END AS key, CASE match_id % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'blocked_dosage_form' WHEN 2 THEN 'no_signal' ELSE 'ambiguous' END AS reason FROM products", PRODUCTS_SQL)
def sections_of_products(spark, d):
    """Sections with one signal, with two, with none, and those that only name a form."""
    slug = F.expr("case match_id % 4 when 0 then concat('goz-xestelikleri-', match_id) when 1 then 'tabletler' when 2 then concat('other-', match_id) else concat('seker-vitaminleri-', match_id) end")
    sections = products(spark, d).select("site", slug.alias("slug"), F.lit(None).cast("string").alias("label_ru"), F.lit(None).cast("string").alias("label_az")).distinct()
    rules = spark.createDataFrame([("e", "eye", "goz xest", "prefix", None, False), ("v", "vitamins", "vitamin", "prefix", None, False), ("d", "diabetes", "seker", "prefix", None, False)], "id string, key string, signal string, mode string, supersedes string, segment_override boolean")
    return taxonomy.classified(sections, rules, spark.createDataFrame([], "site string, slug string"), "baby")
