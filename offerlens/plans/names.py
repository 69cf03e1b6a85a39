"""Queries about names: made-up names with what must come of them, beside those of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..sources import files
from ..sources.adapter import observations
from .literal import rows, values
from .registry import query


def product_names(spark, d):
    return observations(spark, d).select("name").distinct()


FOLDED = [
    ("Cefalox 500", "sefaloks 500"), ("Sefalox 500", "sefaloks 500"), ("Quetavin", "kvetavin"), ("Allerga forte", "alerga forte"), ("Vitamin C", "vitamin c"),
    ("Vitamin K", "vitamin k"), ("Creonal", "kreonal"), ("Цинк плюс", "sink plius"), ("Витамин С", "vitamin c"), ("В6 forte", "b6 forte"), ("Thiophosphal", "tiofosfal"),
    ("Şəkər № 5", "seker 5"), ("İynə--Yod!", "ine iod"), ("Ячмень", "iakmen"), ("", ""),
]


@query(f"SELECT DISTINCT name, {text.fold_sql('name')} AS key FROM s UNION ALL SELECT * FROM {values(FOLDED, 'name, key')}")
def fold_spelling(spark, d):
    every = product_names(spark, d).union(rows(spark, [(n,) for n, _ in FOLDED], "name string"))
    return every.select("name", names.fold(F.col("name")).alias("key"))


PACKS = [
    ("n30", "Lorem N10", 30, True), (None, "Ipsum 10x2 tab", 20, True), (None, "Dolor 50 ml", 1, False), ("", "Gauze 5 x 10 sm", 1, False), (None, "Mask 54 əd", 54, True),
    ("№10", None, 10, True), (None, "Sit No. 28 (caps)", 28, True), (None, "Amet n 20 ml", 1, False), (None, "Elit 12 pieces", 12, True), ("100ml", "Sed N4 x 5", 20, True),
]


@query(f"SELECT DISTINCT CAST(NULL AS VARCHAR) AS pack, name, 1 AS count, false AS sure FROM s UNION ALL SELECT * FROM {values(PACKS, 'pack, name, count, sure')}")
def pack_count_extract(spark, d):
    every = product_names(spark, d).select(F.lit(None).cast("string").alias("pack"), "name").union(rows(spark, [r[:2] for r in PACKS], "pack string, name string"))
    return every.select("pack", "name", names.pack_count(F.col("pack"), F.col("name")).alias("x")).select("pack", "name", "x.count", "x.sure")


AMOUNTS = [
    # name, dosage, pack, volume, form, doses in mg
    ("Loremol 500mg 30 tab", "500mg", "n30", None, "tablet", [500.0]),
    ("Vitamin Z 2000 IU", "2000iu", None, None, None, []),
    ("Ipsumox 250mg/5ml şərbət 100 ml", "250mg/5ml", "100ml", "100ml", "syrup", [250.0]),
    ("Dolorin 50.000 TV No. 28 (Capsules)", "50000tv", "n28", None, "capsule", []),
    ("Krem Sitamet 0,05% 15 q", "0.05%", "15q", "15q", "cream", [15000.0]),
    ("Ametix 1.0 mq №7", "1mq", "n7", None, None, [1.0]),
    ("Elitan (40+10mq) n10", "40mq/10mq", "n10", None, None, [10.0, 40.0]),
    ("Tempor 20/5/12.5 mq", "20mq/5mq/12.5mq", None, None, None, [5.0, 12.5, 20.0]),
    ("Labora 100 mkq", "100mkq", None, None, None, [0.1]),
    ("Magna 0.25, 0.5 mq/doza", "0.25mq/0.5mq/doza", None, None, None, [0.25, 0.5]),
    ("Aliqua yağı 1,5 ml", "1.5ml", "1.5ml", "1.5ml", "oil", []),
    ("Minim 8-14 kq 54 əd", None, "n54", "14kg", None, []),
    ("Veniam (Həb)", None, None, None, None, []),
    ("Quis 200mq/5ml 15ml", "200mq/5ml", "15ml", "15ml", None, [200.0]),
    ("Nostrud 1 000 000 BV", "1000000bv", None, None, None, []),
]


@query(f"SELECT name, dosage, pack, volume, form, '[' || array_to_string(doses, ',') || ']' AS doses FROM {values(AMOUNTS, 'name, dosage, pack, volume, form, doses')}", prelude=False)
def amounts_of_names(spark, d):
    n = F.col("name")
    made = rows(spark, [r[:1] for r in AMOUNTS], "name string")
    doses = F.concat(F.lit("["), F.array_join(F.transform(names.doses_mg(n), lambda x: x.cast("string")), ","), F.lit("]"))
    return made.select("name", names.dosage(n).alias("dosage"), names.pack_size(n).alias("pack"), names.total_volume(n).alias("volume"), names.form(n).alias("form"), doses.alias("doses"))


NUMBERS = [("0,005%", "0.005%"), ("1,5 ml", "1.5 ml"), ("50.000 TV", "50000 TV"), ("2.500.000", "2500000"), ("3.500 ED", "3500 ED"), ("0.025%", "0.025%"), ("1.500 mq", "1.500 mq"), ("500 000 BV", "500000 BV"), ("PH 5.5 200 ml", "PH 5.5 200 ml"), ("120,000", "120000")]


@query(f"SELECT * FROM {values(NUMBERS, 'written, canonical')}", prelude=False)
def canonical_numbers(spark, d):
    made = rows(spark, [r[:1] for r in NUMBERS], "written string")
    return made.select("written", names.numbers(names.spaced_thousands(F.col("written"))).alias("canonical"))


NORMAL = [
    ("Loremol 500mg N20 tabletlər", "loremol"), ("Çay ağacı efir yağı 10 ml", "cayagaci efir"), ("Ipsum 40 mg No. 28 (Capsules) (Turkey)", "ipsum"),
    ("Südlü qarışıq Frisolak Gold 2", "frisolac gold 2"), ("Dolor 100 ml (xarici məhlul)", "dolor"), ("Sit-Amet (forte) gel", "sit amet forte"), ("Elit Almaniya", "elit"), ("", ""),
]


@query(f"SELECT DISTINCT name, lower(name) AS normalized FROM s UNION ALL SELECT * FROM {values(NORMAL, 'name, normalized')}")
def normalized_names(spark, d):
    every = product_names(spark, d).union(rows(spark, [r[:1] for r in NORMAL], "name string"))
    return every.select("name", names.normalized(F.col("name")).alias("normalized"))


PRICES = [("24,50 ₼", 2450, 2450), ("1.234,56", 123456, 123456), ("1,234.56", 123456, 123456), ("22 AZN317 AZN", 2200, 2200), ("foo", None, None), ("1.234.56", 123456, 123456), ("12", 1200, 1200), ("1,299", 130, 129900), ("0", 0, None), (None, None, None)]


@query(f"SELECT written, CAST(cents AS BIGINT) AS cents, CAST(listed AS BIGINT) AS listed FROM {values(PRICES, 'written, cents, listed')}", prelude=False)
def parsed_prices(spark, d):
    made = rows(spark, [r[:1] for r in PRICES], "written string")
    return made.select("written", names.price_cents(F.col("written")).alias("cents"), names.catalogue_price_cents(F.col("written")).alias("listed"))


SALES = [(1000, 800, 1000, 800, 20.0, True), (1000, 1000, 1000, None, None, False), (None, 700, 700, None, None, False), (900, None, 900, None, None, False), (1000, 1100, 1000, None, None, False)]


@query(f"SELECT regular, final, price, discount, percent, on_sale FROM {values(SALES, 'regular, final, price, discount, percent, on_sale')}", prelude=False)
def sale_fields(spark, d):
    made = rows(spark, [r[:2] for r in SALES], "regular long, final long")
    return made.select("regular", "final", files.sale_fields(F.col("regular"), F.col("final")).alias("f")).select("regular", "final", "f.*")


LIKE = [("fuzzy wuzzy was a bear", "was fuzzy bear here", 84.848485), ("alpha beta", "beta alpha", 100.0), ("alpha beta", "alpha beta gamma", 100.0), ("abcd", "abxd", 75.0), ("", "x", 0.0), ("aa bb", "cc dd", 20.0)]


@query(f"SELECT * FROM {values(LIKE, 'a, b, likeness')}", prelude=False)
def word_set_likeness(spark, d):
    made = rows(spark, [r[:2] for r in LIKE], "a string, b string").withColumns({"x": text.tokens(F.col("a")), "y": text.tokens(F.col("b"))})
    return made.select("a", "b", F.round(text.token_set_ratio(F.col("x"), F.col("y")), 6).alias("likeness"))
