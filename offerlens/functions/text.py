"""Words of product names and how alike two sets of them are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .names import fold, price_cents

__all__ = ["fold", "fold_sql", "indel_similarity", "one_sided", "price_cents", "token_set_bound", "token_set_ratio", "tokens"]


def fold_sql(name: str) -> str:
    """The spelling key of names in Latin letters in SQL, for oracles."""
    x = f"lower(strip_accents(translate({name}, 'İı', 'ii')))"
    x = f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    for old, new in (("ph", "f"), ("th", "t"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("qua", "kva"), ("que", "kve"), ("qui", "kvi"), ("quo", "kvo"), ("q", "g"), ("w", "v"), ("y", "i"), ("x", "ks")):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN w = 'c' THEN w ELSE replace(replace(replace(w, 'ce', 'se'), 'ci', 'si'), 'c', 'k') END), ' ')"
    for letter in "abdefghijklmnoprstuvz":
        x = f"regexp_replace({x}, '{letter}{letter}+', '{letter}', 'g')"
    return x


def tokens(key: Column) -> Column:
    """The different words of a key, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda w: w != "")))


def one_sided(a: Column, b: Column) -> Column:
    """Whether each set has something that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    free = full = (1 << len(a)) - 1
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b)], dtype="Int32")


def indel_similarity(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence over both lengths; 100 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(_common(a, b) * 200.0 / both)


def _sides(a: Column, b: Column) -> tuple[Column, Column, Column, Column, Column]:
    join = lambda x: F.array_join(F.array_sort(x), " ")
    left, right = join(F.array_except(a, b)), join(F.array_except(b, a))
    shared = F.length(join(F.array_intersect(a, b)))
    blank = F.when(shared > 0, 1).otherwise(0)
    alone = lambda rest: (1 - (blank + F.length(rest)) / (2 * shared + blank + F.length(rest))) * 100
    sure = F.when((shared > 0) & ((left == "") | (right == "")), 100.0).when(shared > 0, F.greatest(alone(left), alone(right))).otherwise(0.0)
    return left, right, sure, 2 * (shared + blank) + F.length(left) + F.length(right), F.abs(F.length(left) - F.length(right))


def token_set_bound(a: Column, b: Column) -> Column:
    """What token_set_ratio can be at most, without comparing letters: sifts pairs before it."""
    _, _, sure, both, apart = _sides(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(sure, (1 - apart / both) * 100))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: likeness of two sets of words: of what each has alone, beside what they share, by insertions and
    deletions; or of what they share to either set if that is more. 0 if one is empty."""
    left, right, sure, both, _ = _sides(a, b)
    apart = F.length(left) + F.length(right) - 2 * _common(left, right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(sure == 100.0, 100.0).otherwise(F.greatest(sure, (1 - apart / both) * 100))
