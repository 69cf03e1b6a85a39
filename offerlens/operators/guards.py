"""Whether two products are different ones: features of names, read once, and rules over pairs of them.

A feature is a set (a sorted array) or a scalar, so that every rule is a built-in expression over two rows. Rules are
symmetric; what one side does not say never speaks against a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text

# Words that tell variants of a product apart, and forms that may stand for each other.
MODIFIERS = "h n d hd nd plus forte neo extra sr mr xr xl cr retard depot long mite ar pre hipertonik urso"
VARIANTS = "plyus plus forte fort bronxo bronho pain izotonik izotonic isotonik isotonic hipertonik hipertonic hypertonik hypertonic laktat"
MALE, FEMALE = "oglan oglanlar boy boys erkek", "qiz qizlar girl girls qadin"
COMPATIBLE = (("ampoule", "solution"), ("ampoule", "powder"), ("powder", "sachet"), ("sachet", "solution"), ("sachet", "syrup"), ("gel", "sachet"))
MILLIMETRES = {"mm": 1.0, "sm": 10.0, "cm": 10.0, "m": 1000.0}


def _all(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def _set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def _words(x: Column, words: str) -> Column:
    return F.array_sort(F.array_intersect(x, F.array(*map(F.lit, words.split()))))


def _dimensions(low: Column) -> Column:
    """Sizes like '10 x 30 sm' in millimetres, the smaller side first."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(mm|sm|cm|m)?\s*[x×х*]\s*(\d+(?:[.,]\d+)?)\s*(mm|sm|cm|m)(?![a-z])"
    unit = F.create_map(*(F.lit(v) for pair in MILLIMETRES.items() for v in pair))
    found = F.arrays_zip(*(_all(low, pattern, i).alias(n) for i, n in enumerate("abcd", 1)))
    number = lambda v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double")

    def sides(x: Column) -> Column:
        one = F.round(number(x["a"]) * F.element_at(unit, F.when(x["b"] == "", x["d"]).otherwise(x["b"])), 1)
        two = F.round(number(x["c"]) * F.element_at(unit, x["d"]), 1)
        return F.concat_ws("x", F.least(one, two).cast("string"), F.greatest(one, two).cast("string"))

    return _set(F.transform(found, sides))


def features(products: DataFrame) -> DataFrame:
    """The columns of products, of which name is read, with their features. Country is read if there is one."""
    raw = F.col("name")
    df = products.withColumns({"norm": names.normalized(raw), "low": F.lower(names.strip_accents(raw)), "said": names.quantities(raw)})
    df = df.withColumns({"words": text.tokens(F.col("norm")), "key": text.tokens(names.fold(F.col("norm")))})
    df = df.withColumns({"pack": names.pack_count(F.lit(None).cast("string"), raw), "volume": names.volume_of(F.col("said"))})
    low, words = F.col("low"), F.col("words")
    plain = F.regexp_replace(F.regexp_replace(low, r"(\d)\s+(\d{3})(?!\d)", "$1$2"), r"№\s*\d+|#\s*\d+|\bn(?:o\.?)?\s*\d+", " ")
    bare = F.regexp_replace(plain, rf"\d+(?:[.,]\d+)?\s*(?:{names.DOSE_UNITS}|{names.VOLUME})\b", " ")
    marks = F.concat(
        F.when(low.rlike("g[u]m[u]s|silver|серебро") | (low.rlike(r"\bag\b") & ~low.rlike(r"\b(?:antigen|test|rapid)\b")), F.array(F.lit("ag"))).otherwise(F.array().cast("array<string>")),
        F.transform(_all(low, r"\bcu\s*(\d{2,4})\b"), lambda n: F.concat(F.lit("cu"), n)),
        F.transform(F.concat(_all(low, r"(?U)\b(?:tip|type|тип)[\s-]*(\d{1,2})\b"), _all(low, r"(?U)\b(\d{1,2})[\s-]*(?:tip|type|тип)\b")), lambda n: F.concat(F.lit("t"), n)),
    )
    single_mg = F.transform(_all(low, r"(?<![\d.,])([1-9])\s*(?:mg|mq)\b"), lambda n: F.concat(n, F.lit("mg")))
    return df.withColumns({
        "form": names.form(raw),
        "routes": names.routes(raw),
        "doses": names.doses_of(F.col("said")),
        "series": F.filter(words, lambda w: w.rlike("^[1-9]$")),
        "long_words": F.filter(words, lambda w: F.length(w) >= 4),
        "numbers": _set(_all(F.col("norm"), r"\b(\d{2,})\b")),
        "raw_numbers": _set(_all(plain, r"(\d{2,})")),
        "modifiers": _words(words, MODIFIERS),
        "variants": _words(F.split(low, r"\s+"), VARIANTS),
        "male": F.arrays_overlap(words, F.array(*map(F.lit, MALE.split()))),
        "female": F.arrays_overlap(words, F.array(*map(F.lit, FEMALE.split()))),
        "tokens": F.filter("key", lambda w: (F.length(w) >= 3) & ~w.rlike(r"\d")),
        "atoms": _set(F.concat(F.filter(F.split(bare, "[^a-z0-9]+"), lambda w: w.rlike("^(?:[1-9]|[a-z])$")), single_mg)),
        "markers": _set(marks),
        "strengths": _set(_all(plain, r"(?<![\d.])(\d{4,7})(?![\d.])")),
        "sizes_mm": _dimensions(low),
        "percents": _set(F.transform(_all(raw, r"(\d+(?:[.,]\d+)?)\s*%"), lambda p: F.round(F.replace(p, F.lit(","), F.lit(".")).cast("double"), 3))),
        "codes": _set(_all(F.lower("norm"), r"\b([dkb]\d{1,2})\b")),
        "letters": _set(F.filter(F.split(low, "[^a-z]+"), lambda w: w.isin("xs", "s", "m", "l", "xl", "xxl", "xxxl"))),
        "amount": F.regexp_extract("volume", r"^(\d+(?:\.\d+)?)(?:ml|q|g)$", 1).try_cast("double"),
        "measure": F.when(F.col("volume").endswith("ml"), "ml").otherwise("g"),
    }).drop("low", "said")


def _said(c: str, a: str, b: str) -> tuple[Column, Column]:
    return F.col(a + c), F.col(b + c)


def _both_and_differ(c: str) -> Callable[[str, str], Column]:
    def rule(a: str, b: str) -> Column:
        x, y = _said(c, a, b)
        return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)

    return rule


def _each_has_its_own(c: str) -> Callable[[str, str], Column]:
    return lambda a, b: text.one_sided(*_said(c, a, b))


def series(a: str, b: str) -> Column:
    """Steps of a series: both say one and differ, or one says none but has a long word of its own."""
    x, y = _said("series", a, b)
    alone = lambda p, q: F.size(F.array_except(F.col(p + "long_words"), F.col(q + "words"))) > 0
    return F.when((F.size(x) > 0) & (F.size(y) > 0), x != y).when(F.size(x) > 0, alone(b, a)).when(F.size(y) > 0, alone(a, b)).otherwise(False)


def form(a: str, b: str) -> Column:
    x, y = _said("form", a, b)
    pair = F.concat_ws("+", F.least(x, y), F.greatest(x, y))
    return F.coalesce((x != y) & ~pair.isin(*("+".join(p) for p in COMPATIBLE)), F.lit(False))


def orphan_number(a: str, b: str) -> Column:
    """A number of two digits or more in one name that the other does not have at all."""
    left = F.array_except(F.array_except(F.col(a + "numbers"), F.col(b + "numbers")), F.col(b + "raw_numbers"))
    right = F.array_except(F.array_except(F.col(b + "numbers"), F.col(a + "numbers")), F.col(a + "raw_numbers"))
    return (F.size(left) > 0) | (F.size(right) > 0)


def stub(a: str, b: str) -> Column:
    """One name is only the beginning of what a longer one says: few of its words, and too few in common."""
    x, y = F.size(F.col(a + "words")), F.size(F.col(b + "words"))
    shared = F.size(F.array_intersect(F.col(a + "tokens"), F.col(b + "tokens")))
    return (F.least(x, y) < 0.4 * F.greatest(x, y)) & (F.greatest(x, y) >= 3) & (shared < F.when(F.least(x, y) <= 1, 1).otherwise(2))


def gender(a: str, b: str) -> Column:
    return (F.col(a + "male") & F.col(b + "female")) | (F.col(a + "female") & F.col(b + "male"))


def country(a: str, b: str) -> Column:
    x, y = _said("country_code", a, b)
    return F.coalesce(x != y, F.lit(False))


def volume(a: str, b: str) -> Column:
    x, y = _said("amount", a, b)
    return F.coalesce((F.col(a + "measure") == F.col(b + "measure")) & (x != y), F.lit(False))


def pack_count(a: str, b: str) -> Column:
    x, y = _said("pack", a, b)
    return x["sure"] & y["sure"] & (x["count"] != y["count"])


def dose(a: str, b: str) -> Column:
    """Doses differ, unless those of one add up to the only one of the other."""
    x, y = _said("doses", a, b)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, d: s + d)
    summed = ((F.size(x) == 1) & (F.size(y) > 1) | (F.size(y) == 1) & (F.size(x) > 1)) & (F.abs(total(x) - total(y)) < 1e-6)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y) & ~summed


GUARDS: dict[str, Callable[[str, str], Column]] = {
    "series": series,
    "form": form,
    "route": lambda a, b: (F.size(F.col(a + "routes")) > 0) & (F.size(F.col(b + "routes")) > 0) & ~F.arrays_overlap(F.col(a + "routes"), F.col(b + "routes")),
    "orphan_number": orphan_number,
    "stub": stub,
    "modifier": lambda a, b: F.col(a + "modifiers") != F.col(b + "modifiers"),
    "gender": gender,
    "variant_token": _each_has_its_own("tokens"),
    "atom": _each_has_its_own("atoms"),
    "marker": _each_has_its_own("markers"),
    "strength": _both_and_differ("strengths"),
    "dimension": _both_and_differ("sizes_mm"),
    "concentration": _both_and_differ("percents"),
    "code": _both_and_differ("codes"),
    "variant_word": lambda a, b: F.col(a + "variants") != F.col(b + "variants"),
    "volume": volume,
    "pack_count": pack_count,
    "dose": dose,
}
#: What keeps a pair apart before names are compared, and what breaks a pair that was made.
HARD = ("code", "variant_word", "pack_count", "volume", "dose", "form", "route", "gender", "series", "orphan_number", "atom", "strength", "marker", "variant_token", "modifier", "stub")
SPEC = ("code", "variant_word", "pack_count", "volume", "dose", "marker", "atom", "strength", "dimension", "concentration")


def conflict(a: str, b: str, rules: tuple[str, ...] = HARD, with_country: bool = False) -> Column:
    """Whether any of the rules tells two rows of features (prefixes of their columns) apart."""
    found = country(a, b) if with_country else F.lit(False)
    for r in rules:
        found = found | GUARDS[r](a, b)
    return F.coalesce(found, F.lit(False))


def same_in_all(a: str, b: str) -> Column:
    """Equal in every respect that is read: safe to join without a look."""
    equal = F.lit(True)
    for c in ("tokens", "letters", "codes", "doses", "form", "variants", "volume"):
        equal = equal & F.col(a + c).eqNullSafe(F.col(b + c))
    return equal & F.col(a + "pack")["count"].eqNullSafe(F.col(b + "pack")["count"])


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def judged(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: names) with one column a rule, and ultra: equal in all respects."""
    named = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "name")
    f = features(named)
    both = pairs.join(side(f, "a_"), F.col("a") == F.col("a_name")).join(side(f, "b_"), F.col("b") == F.col("b_name"))
    return both.select(*pairs.columns, *(g("a_", "b_").alias(n) for n, g in GUARDS.items()), same_in_all("a_", "b_").alias("ultra"))
