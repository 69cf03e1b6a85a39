"""Catalogue, stock and cost files in; reports out; parsers of pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, text
from .workbooks import read_workbook

# Header names that catalogue files use, after folding, words for stock, and the longest value of a field.
HEADERS = {
    "name": "name title productname product ad adi mehsul mehsulunadi название наименование товар",
    "url": "url link href producturl productlink kecid ссылка адрес",
    "price": "price currentprice qiymet qiymeti цена",
    "sale_price": "saleprice finalprice discountprice specialprice yeniqiymet endirimliqiymet endirimqiymeti ценасоскидкой новаяцена ценапоакции",
    "old_price": "oldprice regularprice listprice originalprice kohneqiymet evvelkiqiymet стараяцена ценабезскидки",
    "sku": "sku code productcode kod mehsulkodu артикул код кодтовара",
    "category": "category kateqoriya bolme категория раздел",
    "availability": "availability stock instock movcudluq stok наличие",
}
PRICE_WORDS = ("price", "qiymet", "цена", "endirim", "скидк")
IN_STOCK, OUT_OF_STOCK = "1 true yes var stokdavar movcuddur да есть вналичии instock", "0 false no yoxdur stokdayoxdur bitib нет нетвналичии outofstock"
LONGEST = {"external_id": 200, "url": 500, "name": 500, "category": 100}
REQUIRED, SEPARATORS, SHOWN = ("name", "url", "price"), ",;\t|", 50


class BadFile(ValueError):
    """A catalogue file that is refused as a whole."""


def header_key(title: str) -> str:
    """A header as aliases name it: lower case, without accents and anything but letters and digits."""
    plain = title.lstrip("\ufeff").translate(str.maketrans(names.AZ, names.AZ_PLAIN)).lower()
    return "".join(c for c in plain if c.isalnum())


def separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most of."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(SEPARATORS, key=lambda c: (line.count(c), -SEPARATORS.index(c)))


def columns_of(titles: list[str]) -> dict[str, str]:
    """Which column has which role. Refused if two have one, a needed one is missing, or one looks like a price that nobody knows."""
    roles = {alias: role for role, aliases in HEADERS.items() for alias in aliases.split()}
    found: dict[str, str] = {}
    for t in titles:
        role = roles.get(header_key(t))
        if role is None:
            if any(w in header_key(t) for w in PRICE_WORDS):
                raise BadFile(f"a price that is not known: {t!r}")
        elif role in found:
            raise BadFile(f"two columns for {role}: {found[role]!r} and {t!r}")
        else:
            found[role] = t
    if missing := [r for r in REQUIRED if r not in found]:
        raise BadFile(f"columns not found: {missing}; the header is {titles}")
    return found


def read_catalogue(spark: SparkSession, path: str, site: str) -> tuple[DataFrame, DataFrame]:
    """products and problems of a catalogue file in CSV or of a workbook with one sheet.

    products: external_id, url, name, category, price_cents, discount_cents, availability, copies (equal rows). problems:
    external_id, problem, for every row that has one: no name or address, an address or a price that can't be read, a
    value that is too long, or an id that stands for different rows."""
    if path.lower().endswith(".xlsx"):
        raw = read_workbook(spark, path)
    else:
        raw = spark.read.option("header", True).option("sep", separator(spark, path)).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    role = columns_of(raw.columns)
    cell = lambda r: F.trim(F.regexp_replace(F.coalesce(raw[role[r]], F.lit("")), r"\s+", " ")) if r in role else F.lit("")
    df = raw.select(*(cell(r).alias(r) for r in HEADERS)).where("concat(name, url, price, sku) <> ''")
    path_of = F.trim(F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "^/+|/+$", ""))
    query_of = F.try_parse_url("url", F.lit("QUERY"))
    from_url = F.when(F.col("url").rlike("^https?://[^/]+/") & (path_of != ""), F.concat(path_of, F.coalesce(F.concat(F.lit("?"), query_of), F.lit(""))))
    df = df.withColumn("from_url", from_url).withColumn("external_id", F.coalesce(F.nullif("sku", F.lit("")), "from_url"))
    amounts = {r: names.catalogue_price_cents(F.col(r)) for r in ("price", "sale_price", "old_price")}
    given = lambda r: F.col(r) != "" if r == "price" else F.regexp_replace(r, "[-–— 0.,]", "") != ""
    unread = F.lit(False)
    for r, cents in amounts.items():
        unread = unread | (given(r) & cents.isNull())
    current = F.coalesce(amounts["sale_price"], amounts["price"])
    higher = F.greatest(*(F.when(amounts[r] > current, amounts[r]) for r in ("old_price", "price")))
    long = F.lit(False)
    for c, n in LONGEST.items():
        long = long | (F.length(c) > n)
    problem = F.when((F.col("name") == "") | (F.col("url") == ""), "no name or address").when(F.col("from_url").isNull(), "the address can't be read").when(long, "a value is too long").when(unread, "a price can't be read")
    stock = F.regexp_replace(F.lower(names.strip_accents(F.col("availability"))), r"[^\p{L}\p{N}]", "")
    state = F.when(stock.isin(*IN_STOCK.split()), "in_stock").when(stock.isin(*OUT_OF_STOCK.split()), "out_of_stock").otherwise("unknown")
    df = df.withColumn("category", F.when(F.col("category") == "", "file").otherwise(F.col("category")))
    made = df.select("external_id", "url", "name", "category", F.coalesce(higher, current).alias("price_cents"), F.when(higher.isNotNull(), current).alias("discount_cents"), state.alias("availability"), problem.alias("problem"), F.lit(site).alias("site"))
    good = made.where("problem is null").drop("problem")
    alike = good.groupBy("external_id", "name", "price_cents", "discount_cents").agg(F.first("url").alias("url"), F.first("category").alias("category"), F.first("availability").alias("availability"), F.first("site").alias("site"), F.count("*").alias("copies"))
    clash = alike.groupBy("external_id").agg(F.count("*").alias("n")).where("n > 1").select("external_id", F.lit("the id stands for different rows").alias("problem"))
    problems = made.where("problem is not null").select("external_id", "problem").unionByName(clash)
    return alike, problems


def catalogue(spark: SparkSession, path: str, site: str) -> DataFrame:
    """The products of a catalogue file, which is refused as a whole if any row has a problem."""
    products, problems = read_catalogue(spark, path, site)
    if shown := problems.limit(SHOWN).collect():
        raise BadFile("; ".join(f"{r.external_id}: {r.problem}" for r in shown))
    return products


def shrunk(new_rows: int, last_rows: int, least: float = 0.9) -> bool:
    """Whether a load has so much less than the last accepted one that it must be refused."""
    return last_rows > 0 and new_rows < least * last_rows


def stock_file(spark: SparkSession, path: str) -> DataFrame:
    """sku, qty, in_stock: a comma is a decimal point, an unreadable quantity 0."""
    raw = spark.read.option("header", True).csv(path)
    qty = F.coalesce(F.replace("qty", F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    return raw.select("sku", qty.alias("qty"), (qty > 0).alias("in_stock"))


def replaced(stored: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """stored stock with all rows of one source replaced by new ones."""
    return stored.where(F.col("source") != source).unionByName(new.withColumn("source", F.lit(source)).select(stored.columns))


def supplier_prices(spark: SparkSession, path: str) -> DataFrame:
    """sku, supplier_name, cost_cents: of several rows the last in the file; prices that are unreadable or not above zero are left out.

    A file's lines are in the order of its rows' numbers, which Spark gives within and across its pieces."""
    raw = spark.read.option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    cents = raw.withColumn("cost_cents", names.price_cents(F.col("purchase_price"))).where("cost_cents > 0")
    return cents.groupBy("sku", "supplier_name").agg(F.max_by("cost_cents", "line").alias("cost_cents"))


def upserted_costs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Costs by (sku, supplier_name), those of new over those stored."""
    return stored.join(new.select("sku", "supplier_name"), ["sku", "supplier_name"], "left_anti").unionByName(new.select(stored.columns))


def bound_skus(rows: DataFrame, products: DataFrame, site: str, least: float = 85.0) -> DataFrame:
    """sku, product_id, how: the site's product of that id, else the one whose name is likest, from 85 on, among those that begin with
    the same word."""
    own = products.where(F.col("site") == site)
    exact = rows.join(own.select(F.col("external_id").alias("sku"), "product_id"), "sku").select("sku", "product_id", F.lit("id").alias("how"))
    words = lambda df, p: df.withColumn("w", text.tokens(names.fold(names.normalized(F.col("name"))))).select(*df.columns, F.col("w").alias(f"{p}_w"), F.get(F.split(names.fold(names.normalized(F.col("name"))), " "), F.lit(0)).alias("block"))
    left = words(rows.join(exact.select("sku"), "sku", "left_anti").select("sku", "name"), "a").select("sku", "a_w", "block")
    right = words(own.select("product_id", "name"), "b").select("product_id", "b_w", "block")
    met = left.join(right, "block").where(text.token_set_bound(F.col("a_w"), F.col("b_w")) >= least).withColumn("score", text.token_set_ratio(F.col("a_w"), F.col("b_w"))).where(F.col("score") >= least)
    best = met.groupBy("sku").agg(F.min_by("product_id", F.struct((-F.col("score")).alias("s"), "product_id")).alias("product_id"))
    return exact.unionByName(best.select("sku", "product_id", F.lit("name").alias("how")))


def cost_faults(raw: DataFrame) -> DataFrame:
    """line, fault of a cost file (line, sku, supplier_name, purchase_price): nothing named, prices that can't be, and pairs that come twice."""
    n = F.count("*").over(Window.partitionBy("sku", "supplier_name"))
    cents = names.price_cents(F.col("purchase_price"))
    fault = F.when(F.coalesce("sku", F.lit("")) == "", "no sku").when(F.coalesce("supplier_name", F.lit("")) == "", "no supplier").when(cents.isNull(), "price can't be read").when(cents <= 0, "price is not above zero").when(n > 1, "comes twice")
    return raw.withColumn("fault", fault).where("fault is not null").select("line", "fault")


def cost_plan(costs: DataFrame, current: DataFrame) -> DataFrame:
    """A dry run of a cost import: sku, supplier_name, before, after, change."""
    both = costs.join(current.withColumnRenamed("cost_cents", "before"), ["sku", "supplier_name"], "left")
    change = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("cost_cents"), "same").otherwise("changed")
    return both.select("sku", "supplier_name", "before", F.col("cost_cents").alias("after"), change.alias("change"))


def last_batch(batches: DataFrame, batch_id: int) -> None:
    """Raises unless the batch is the newest that stands: imports are undone in reverse order."""
    newest = batches.where("not rolled_back").agg(F.max("batch_id")).first()[0]
    if newest != batch_id:
        raise ValueError(f"batch {newest} has to be undone first")


def rolled_back(now: DataFrame, batch: DataFrame) -> DataFrame:
    """Costs with a batch undone. Raises if a cost is no longer what the batch made it."""
    moved = batch.join(now, ["sku", "supplier_name"], "left").where(~F.col("after").eqNullSafe(F.col("cost_cents")))
    if not moved.isEmpty():
        raise ValueError("costs changed since the batch")
    restored = batch.where("before is not null").select("sku", "supplier_name", F.col("before").alias("cost_cents"))
    return now.join(batch, ["sku", "supplier_name"], "left_anti").unionByName(restored)


def sale_fields(regular: Column, final: Column) -> Column:
    """price, discount, percent (to a tenth) and on_sale; a discount only if the final price is below the regular one.
    A single price is the regular one."""
    sale = F.coalesce(final < regular, F.lit(False))
    return F.struct(F.coalesce(regular, final).alias("price"), F.when(sale, final).alias("discount"), F.when(sale, F.round((1 - final / regular) * 100, 1)).alias("percent"), sale.alias("on_sale"))


def link_state(status: Column) -> Column:
    """dead for gone pages, alive for good ones; other answers are errors and change nothing."""
    return F.when(status.isin(404, 410), "dead").when(status.between(200, 399), "alive").otherwise("error")


def url_parts(url: Column) -> list[Column]:
    """host and the last part of the path, decoded."""
    last = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "([^/]*)/?$", 1)
    return [F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"), F.coalesce(F.try_url_decode(last), last).alias("slug")]


def page_text(html: Column) -> Column:
    """A page's text without tags, blanks run together."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def safe_cell(value: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def write_report(sheets: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder for each sheet."""
    for name, df in sheets.items():
        kinds = dict(df.dtypes)
        df.select(*(safe_cell(F.col(c)).alias(c) if kinds[c] == "string" else c for c in df.columns)).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def watchlist(spark: SparkSession, path: str, sites: tuple[str, ...]) -> DataFrame:
    """name, site, url of a watchlist in CSV with a column of addresses for each site; rows without a name or address are left out."""
    raw = spark.read.option("header", True).csv(path)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("site"), F.trim(raw[s]).alias("url")) for s in sites if s in raw.columns)))
    return raw.select(F.trim("name").alias("name"), each.alias("x")).select("name", "x.*").where("name <> '' and url <> ''").distinct()


def write_watchlist(tracked: DataFrame, sites: tuple[str, ...], folder: str) -> None:
    """One row a name, one column a site."""
    tracked.groupBy("name").pivot("site", list(sites)).agg(F.first("url")).write.mode("overwrite").option("header", True).csv(folder)


def run_report(undercuts: DataFrame, changes: DataFrame, new: DataFrame, promos: DataFrame, folder: str) -> None:
    """The four sheets of a run."""
    write_report({"undercuts": undercuts, "changes": changes, "new": new, "promos": promos}, folder)


def as_html(df: DataFrame, top: int = 100) -> str:
    """The first rows as a table in HTML, with every value escaped."""
    from html import escape

    cells = lambda tag, values: "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in df.limit(top).collect())
    return f"<table><tr>{cells('th', df.columns)}</tr>{body}</table>"
