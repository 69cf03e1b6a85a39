"""Product names as column expressions: letters, numbers, doses, forms, packs and the searchable name.

All are built-in functions, so names are read in generated code. Java's regular expressions need (?U) to know
letters beyond ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the region and what they become.
AZ, AZ_PLAIN = "əƏıİşŞçÇğĞöÖüÜ", "eEiIsScCgGoOuU"
FOLDED, FOLDED_TO = "ıəğşçöüабвгдеёжзийклмнопрстуфхцчшщыэәғҝөүһҹј№ъь", "iegscouabvgdeejziiklmnoprstufxscssieeggouhcy "

# Words for the form of a product, by the form that they mean. Words of the last line say nothing about it.
FORMS = {
    "tablet": "tablet tab tabletka tabletlər tabletkalar tablets tableti dragee draje sorma",
    "capsule": "kapsul capsule kaps kapsullar kapsulalar kapsulları capsules kapsula kapsulu",
    "cream": "krem cream kremi",
    "ointment": "məlhəm ointment maz məlhəmi",
    "spray": "spreyi spray sprey",
    "drops": "drops damci kapli damcı damcısı damlalar damcılar damla damcıları",
    "solution": "məhlul solution raztvor məhlulu",
    "gel": "gel geli",
    "powder": "powder poroshok toz",
    "suppository": "suppoziter suppository suppositories svecha şam şamlar suppozitorlar suppozitorları",
    "syrup": "siropla syrup şərbət sirop şərbəti",
    "ampoule": "ampul ampoule amp ampulalar ampullar ampulları ampoules",
    "oil": "yağı yağ yag oil",
    "sachet": "saşe paket",
    "": "həb həblər pastil pastillər qranul qranullar suspenziya emulsiya aerozol aerosol flakon",
}
# Words for where a product is used.
ROUTES = {
    "eye": "goz", "ear": "qulaq", "nose": "burun nazal intranazal", "mouth": "bogaz agiz oral daxili dilalti sublingual", "vaginal": "vaginal vag",
    "rectal": "rektal", "skin": "deri xarici", "injection": "infuziya inyeksiya venadaxili ezeledaxili", "inhalation": "inhalyasiya",
}
# Units of mass, of doses and of activity.
MASS = "mkq|mkg|mcg|µg|mg|mq"
DOSE_UNITS = f"{MASS}|g|ml|qrm|qr|q|iu|ie|ed|me|tv|bv|u|units|tis|%"
ACTIVITY = "i̇u|iu|ui̇|ui|ie|me|tv|bv|ed|u|units?"
VOLUME = "ml|kg|kq|qrm|qr|gr|q|g"
PIECES = "tab|tabletka|kapsul|capsules|kaps|şt|шт|adet|amp|pieces|əd"
AFTER_COUNT = "mm|cm|sm|ml|m2|m|l|mg|mcg|mkg|mkq|µg|g|gr|q|qr|kg|kq|%|iu|bv|me|ie|мл|мг|г|кг"

NUMBER = r"\d+(?:\.\d+)?"
FORM_OF = {w: form for form, words in FORMS.items() for w in words.split()}
ROUTE_OF = {w: route for route, words in ROUTES.items() for w in words.split()}


def _replace(x: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda y, p: F.regexp_replace(y, p[0], p[1]), pairs, x)


def _plain_letters() -> tuple[str, str]:
    """Accented letters of Latin alphabets and the letters they are built on, by their decomposition."""
    bases = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            bases[c] = base
    return "".join(bases), "".join(bases.values())


ACCENTED, BASES = _plain_letters()


def strip_accents(x: Column) -> Column:
    """Letters without their marks; those of the region that have none to take off become the nearest Latin ones."""
    return F.regexp_replace(F.translate(F.translate(x, AZ, AZ_PLAIN), ACCENTED, BASES), r"\p{Mn}+", "")


def fold(name: Column) -> Column:
    """A spelling key: Cyrillic as Latin, sounds that are spelt two ways spelt one way, doubled letters single, all else but
    letters and digits one blank. A letter c alone (as in 'vitamin C') stays."""
    x = F.lower(F.replace(name, F.lit("İ"), F.lit("i")))
    x = _replace(x, (r"(?<![\p{L}\p{N}])с(?![\p{L}\p{N}])", "c"), (r"(?<![\p{L}\p{N}])в(?=\d)", "b"))
    x = F.translate(_replace(x, ("ю", "yu"), ("я", "ya")), FOLDED, FOLDED_TO)
    x = F.trim(F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]+", " "))
    for old, new in (("ph", "f"), ("th", "t"), ("sh", "s"), ("ch", "c"), ("ck", "k")):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = _replace(x, ("qu(?=[aeio])", "kv"), ("q", "g"), ("w", "v"), ("y", "i"), ("x", "ks"), ("(?<![a-z0-9])c(?![a-z0-9])", "\x01"), ("c(?=[ei])", "s"), ("c", "k"), ("\x01", "c"))
    return F.coalesce(F.regexp_replace(x, r"([a-z])\1+", "$1"), F.lit(""))


def spaced_thousands(x: Column) -> Column:
    """'1 000 000' in one piece; a number with a point before it is no head of thousands."""
    inside = r"(?<=\b\d{1,3}|\b\d{1,3}\s\d{3}|\b\d{1,3}\s\d{3}\s\d{3})(?<![.,]\d{1,3}|[.,]\d{1,3}\s\d{3})\s(?=\d{3}(?:\s\d{3})*\b)"
    return F.regexp_replace(x, inside, "")


def numbers(x: Column) -> Column:
    """Thousands without separators and decimal points for commas. A separator is of thousands if its groups are all zeros,
    or several, or a unit of activity follows; never after a leading zero."""
    head = r"(?<![\d.,])([1-9]\d{0,2})"
    end = r"(?![\d.,])"
    x = _replace(x, (rf"{head}[.,](000)[.,](000)[.,](000){end}", "$1$2$3$4"), (rf"{head}[.,](\d{{3}})[.,](\d{{3}})[.,](\d{{3}}){end}", "$1$2$3$4"), (rf"{head}[.,](\d{{3}})[.,](\d{{3}}){end}", "$1$2$3"), (rf"{head}[.,](000){end}", "$1$2"))
    x = F.regexp_replace(x, rf"(?iU){head}[.,](\d{{3}}){end}(?=\s*(?:{ACTIVITY})\b)", "$1$2")
    return F.regexp_replace(x, rf"(?<![\d.,])(\d+),(\d+){end}", "$1.$2")


def dose_lists(x: Column) -> Column:
    """'(40+10mq)' as '40 mq/10 mq': one unit after a list is each number's, up to four numbers. Commas part doses of pens only."""
    left = r"(?iU)(?<![\w.,\-])"
    for n in (4, 3, 2):
        several = r"\s*[+/]\s*".join([f"({NUMBER})"] * n)
        x = F.regexp_replace(x, rf"{left}\(?\s*{several}\s*\)?\s*({MASS})\b\s*\)?", " " + "/".join(f"${i} ${n + 1}" for i in range(1, n + 1)) + " ")
        commas = r"\s*,\s*".join([f"({NUMBER})"] * n)
        x = F.regexp_replace(x, rf"{left}{commas}\s*({MASS})(?=\s*/\s*doza)", " " + "/".join(f"${i} ${n + 1}" for i in range(1, n + 1)) + " ")
    x = F.regexp_replace(x, rf"(?iU)(\d\s*(?:{MASS}))\s*\+\s*(?={NUMBER}\s*(?:{MASS})\b)", "$1/")
    return F.regexp_replace(x, rf"(?iU)(\d\s*(?:{MASS}))\s*,\s*(?={NUMBER}\s*(?:{MASS})\s*/\s*doza)", "$1/")


def quantities(name: Column) -> Column:
    """The first step of everything that reads amounts from a name."""
    return dose_lists(numbers(spaced_thousands(name)))


def canonical_decimals(x: Column) -> Column:
    """No zeros at the end of a fraction."""
    return _replace(x, (r"(\d+)\.(\d*?)0+(?!\d)", "$1.$2"), (r"(\d+)\.(?!\d)", "$1"))


def units(x: Column) -> Column:
    """One spelling for each unit of an extracted amount."""
    return _replace(x, (r"(?<=\d)qr\b", "q"), (r"(?<=\d)kq\b", "kg"), (r"(?<=\d)gr\b", "g"))


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def form(name: Column) -> Column:
    """The form of a product by the first word that names one; null where only containers or nothing is named."""
    named = "|".join(sorted((w for w, f in FORM_OF.items() if f), key=len, reverse=True))
    word = F.lower(_found(name, rf"(?iU)\b({named})\b"))
    return F.element_at(F.create_map(*(F.lit(v) for w, f in FORM_OF.items() if f for v in (w, f))), word)


def routes(name: Column) -> Column:
    """Where a product is used, as a sorted set."""
    words = F.regexp_extract_all(F.lower(strip_accents(name)), F.lit(rf"\b({'|'.join(ROUTE_OF)})\b"), F.lit(1))
    table = F.create_map(*(F.lit(v) for pair in ROUTE_OF.items() for v in pair))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.element_at(table, w))))


def dosage(name: Column) -> Column:
    """The first dose, without blanks, in canonical decimals and units: '250mg/5ml'."""
    pattern = rf"(?iU)\b(\d+(?:[.,]\d+)?\s*(?:{DOSE_UNITS})(?:\s*/\s*(?:(?:\d+(?:[.,]\d+)?\s*)?(?:{DOSE_UNITS})|doza))*)(?:\b|(?<=%))"
    raw = F.replace(F.regexp_replace(F.lower(_found(quantities(name), pattern)), r"\s+", ""), F.lit(","), F.lit("."))
    return units(canonical_decimals(strip_accents(raw)))


def doses_mg(name: Column) -> Column:
    """Every dose in mg as a sorted set; grams and micrograms are converted, the amounts of liquids left out."""
    return doses_of(quantities(name))


def doses_of(plain: Column) -> Column:
    """The doses of a name of which the quantities are spelt out."""

    def those(unit: str, factor: float) -> Column:
        found = F.regexp_extract_all(plain, F.lit(rf"(?iU)(?<![\w.,])({NUMBER})\s*(?:{unit})\b"), F.lit(1))
        return F.transform(found, lambda x: F.round(x.cast("double") * factor, 6))

    return F.array_sort(F.array_distinct(F.concat(those("mg|mq", 1.0), those("g|q|qr|gr|qrm", 1000.0), those("mkq|mkg|mcg|µg", 0.001))))


def _volume(prepared: Column) -> Column:
    """The first amount of liquid or weight that is no denominator of a concentration."""
    concentration = rf"(?iU)\d+(?:[.,]\d+)?\s*(?:{DOSE_UNITS})\s*/\s*\d*(?:[.,]\d+)?\s*(?:ml|mg|g|q|qr)\b"
    found = _found(F.regexp_replace(prepared, concentration, " "), rf"(?i)(?<![\w.])(\d+(?:\.\d+)?\s*(?:{VOLUME}))(?=\b|[^a-zA-Z])")
    return units(canonical_decimals(F.regexp_replace(F.lower(found), r"\s+", "")))


def pack_size(name: Column) -> Column:
    """How many ('n20'), and only where that isn't said how much ('100ml')."""
    count = F.coalesce(*(_found(name, p) for p in (rf"(?iU)\bN(?:o\.?)?\s*(\d+)", r"№\s*(\d+)", rf"(?iU)(\d+)\s*(?:{PIECES})")))
    return F.coalesce(F.concat(F.lit("n"), count), _volume(dose_lists(numbers(name))))


def total_volume(name: Column) -> Column:
    """How much there is of a product, whatever the count."""
    return volume_of(quantities(name))


def volume_of(plain: Column) -> Column:
    """The amount in a name of which the quantities are spelt out."""
    return _volume(plain)


def pack_count(pack: Column, name: Column) -> Column:
    """count and sure: pieces of a pack as marked ('N10', '№10', '10 əd', '10x2') in the pack, else in the name; 1, not sure,
    without a mark. What a unit follows is no count."""
    other = rf"(?!\d)(?!\s*(?:{AFTER_COUNT})\b)"

    def of(text: Column) -> Column:
        x = _replace(F.lower(F.coalesce(text, F.lit(""))), ("№|nº", "n"), (r"no\.", "no"))
        pair = rf"(?U)\b(?:n|no)?\s*(\d{{1,4}})\s*[x×]\s*(\d{{1,4}})\b{other}"
        twice = _found(x, pair).cast("long") * _found(x, pair, 2).cast("long")
        return F.coalesce(twice, _found(x, rf"(?U)\b(?:n|no)\s*(\d{{1,4}})\b{other}").cast("long"), _found(x, r"(?U)\b(\d{1,4})\s*(?:ədəd|eded|əd\b|şt|adet|pcs?|pieces?|штук|шт)\b").cast("long"))

    found = F.coalesce(of(pack), of(name))
    return F.struct(F.coalesce(found, F.lit(1)).alias("count"), found.isNotNull().alias("sure"))


# Sections of a catalogue that names begin with, spellings of brands, and words that stand in brackets.
SECTIONS = "sudlu qarisiq|sudsuz siyiq|sudlu siyiq|usaq qidasi|usaq pecenyesi|usaq pecenye|usaq yemeyi|pecenye|pure|su|cay|sud|sampunu|sampun|balzami|balzam|sabunu|sabun|dezodoranti|dezodorant|losyonu|losyon|tonik|maskasi|maska|dermani|derman|vasitesi"
BRAND_SPELLINGS = {"frisolac": "frisolak", "similac": "similak", "malyutka": "malutka|malyuk|maluk", "nanny": "nenny|nenni", "bellakt": "bellak"}
COUNTRIES = "turkiye|turkey|rusiya|russia|almaniya|germany|fransa|france|italiya|italy|ispaniya|spain|polsa|poland|ukrayna|ukraine|azerbaycan|hindistan|india|yaponiya|japan|koreya|korea|isvecre|switzerland|gurcustan|georgia|iran|cin|china"
CONNECTORS = "ucun|ve|spris|qelem|mehlullu"


def normalized(name: Column) -> Column:
    """The name for matching and search: without forms, doses, packs, countries, remarks in brackets and sections of the
    catalogue. Tea tree and pine are plants, not tea and suppository."""
    x = _replace(quantities(F.trim(name)), (r"(?iU)\b(çay|şam)\s+(ağac)", "$1$2"))
    form_words = "|".join(sorted(FORM_OF, key=len, reverse=True))
    x = strip_accents(F.regexp_replace(x, rf"(?iU)\b(?:{form_words})\b", " "))
    x = F.lower(x)
    word = f"(?:{'|'.join(ROUTE_OF)}|{CONNECTORS}|{COUNTRIES})"
    x = _replace(
        x,
        (rf"\([^\w()]*(?:{word}[^\w()]*)*\)", " "),
        (r"\b(?:rektal|intranazale?|vaginal|sublingual)\b", " "),
        (rf"(?U)\b\d+(?:[.,]\d+)?\s*(?:{DOSE_UNITS})(?:\s*/\s*(?:(?:\d+(?:[.,]\d+)?\s*)?(?:{DOSE_UNITS})|doza))*(?:\b|(?<=%))", " "),
        (r"\bdoza?\b", " "),
        (r"\bn(?:o\.?)?\s*\d+|№\s*\d+|\d+\s*(?:tab|tabletka|kapsul|capsules|kaps|st|adet|amp|pieces|ed)\b", " "),
        (rf"\b(?:{COUNTRIES})\b", " "),
        (r"[^\p{L}\p{N}]+", " "),
    )
    x = F.regexp_replace(F.trim(x), rf"^(?:(?:{SECTIONS})\b\s*)+", "")
    x = _replace(x, *((rf"\b(?:{old})\b", new) for new, old in BRAND_SPELLINGS.items()))
    return F.coalesce(F.trim(F.regexp_replace(x, " +", " ")), F.lit(""))


def price_cents(text: Column) -> Column:
    """The first number of a text in cents: digits, points and commas up to anything else. A comma is a decimal point; of
    several points the last one is."""
    number = F.replace(_found(text, r"(\d[\d,.]*)"), F.lit(","), F.lit("."))
    parts = F.split(number, r"\.")
    last = F.element_at(parts, -1)
    joined = F.when(F.size(parts) > 2, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ""), F.lit("."), last)).otherwise(number)
    return F.round(joined.try_cast("decimal(20,6)") * 100).cast("long")


def catalogue_price_cents(text: Column) -> Column:
    """A price of a list page: a separator before exactly three digits at the end is of thousands, before one or two a decimal
    point; blanks part thousands. Null unless above zero."""
    number = F.regexp_replace(_found(text, r"(\d[\d\s .,]*)"), r"[\s ]+|[.,]+$", "")
    fraction = F.coalesce(_found(number, r"[.,](\d{1,2})$"), F.lit("0"))
    whole = F.regexp_replace(F.regexp_replace(number, r"[.,]\d{1,2}$", ""), "[.,]", "")
    cents = F.round(F.concat(whole, F.lit("."), fraction).try_cast("decimal(20,2)") * 100).cast("long")
    return F.when(cents > 0, cents)


def significant(key: Column, least: int = 4) -> Column:
    """Different words of a key that are long enough to mean something, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) >= least)))
