"""Suggestions, addresses, pins and edits by hand, on rows made for their rules."""

from __future__ import annotations


from offerlens.operators import curation, review


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_suggestions_are_ordered_by_what_is_at_stake(spark):
    matches = spark.createDataFrame([(1, "a", 0.8, False, False), (2, "b", 0.7, False, False), (3, "c", 0.6, False, True), (4, "d", 0.9, False, True), (5, "e", 0.1, True, True), (6, "f", 0.5, False, False)], "match_id long, name string, confidence double, is_manual boolean, needs_review boolean")
    members = spark.createDataFrame([(1, 10, 100), (1, 11, 50), (2, 20, 100), (2, 21, None), (2, 22, 0), (3, 30, 5)], "match_id long, product_id long, price_cents long")
    found = [(r.match_id, r.spread_bp, r.products) for r in review.suggestions(matches, members).collect()]
    assert found == [(3, None, 1), (1, 5000, 2), (6, None, 0), (2, None, 3)]
    assert [r.match_id for r in review.suggestions(matches, members, flagged_only=True).collect()] == [3]


def test_addresses(spark):
    products = spark.createDataFrame([(1, "s", "12", "krem-a"), (2, "s", "13", "krem-a"), (3, "s", "krem-b", "Krem-B"), (4, "t", "12", None)], "product_id long, site string, external_id string, slug string")
    asked = spark.createDataFrame([("s", "https://x/p/12/?q#t"), ("s", "https://x/KREM-A"), ("s", "https://x/krem-b//"), ("t", "https://x/12"), ("s", ""), ("s", None), ("s", "https://x/99")], "site string, url string")
    assert rows(review.at_addresses(products, asked), "url", "product_id", "found") == sorted([("https://x/p/12/?q#t", 1, 1), ("https://x/KREM-A", 1, 2), ("https://x/KREM-A", 2, 2), ("https://x/krem-b//", 3, 1), ("https://x/12", 4, 1)], key=repr)


def test_pins_take_effect_where_policy_lets_them(spark):
    state = spark.createDataFrame([(1, "a", "u1", None, False, "de", True), (2, "b", "u2", 7, False, "de", True), (3, "b", "u3", None, False, "tr", True), (4, "b", "u4", None, False, None, False), (5, "a", "u5", None, False, None, True), (6, "a", "u5", None, False, None, True), (7, "a", "u7", None, True, None, True), (8, "c", "u8", 70, False, "de", True), (9, "a", "u9", None, False, None, True)], "product_id long, site string, url string, match_id long, dead boolean, country_code string, in_stock boolean")
    pins = spark.createDataFrame([(70, "a", "u1"), (70, "b", "u3"), (71, "b", "u2"), (71, "b", "u4"), (72, "a", "u5"), (72, "a", "u7"), (70, "c", "u8"), (73, "a", ""), (73, "a", "u9"), (74, "a", "u9"), (75, "c", "u8")], "match_id long, site string, url string")
    # 1 and 3 are of two countries, so neither joins 70; 8 stays where it is pinned first.
    assert rows(review.pinned_moves(pins, state), "product_id", "before", "after") == [(2, 7, 71), (9, None, 73)]
    assert rows(review.pinned_moves(pins.where("url <> 'u3'"), state), "product_id", "after") == [(1, 70), (2, 71), (9, 73)]
    after = curation.applied(state, review.pinned_moves(pins, state))
    assert review.pinned_moves(pins, after).count() == 0


def test_edits_keep_one_product_a_site(spark):
    state = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "a", None), (4, "c", None), (5, "c", None), (6, "a", 20), (7, "b", None)], "product_id long, site string, match_id long")
    edits = spark.createDataFrame([(1, "add", 3, 99), (2, "swap", 3, 10), (1, "add", 4, 10), (1, "add", 5, 10), (1, "remove", 6, 10), (1, "add", 7, 10), (1, "add", 77, 10)], "seq long, kind string, product_id long, match_id long")
    found = review.edit_moves(edits, state)
    assert rows(found.where("refused is null"), "product_id", "before", "after") == sorted([(1, 10, None), (3, None, 10), (4, None, 10)], key=repr)
    assert rows(found.where("refused is not null"), "product_id", "refused") == [(5, "two edits for one place"), (6, "not in that cluster"), (7, "the site has a product there"), (77, "no such product")]
    after = curation.applied(state, found.where("refused is null"))
    assert after.where("match_id is not null").groupBy("match_id", "site").count().where("count > 1").count() == 0
    freed = spark.createDataFrame([(1, "remove", 2, 10), (2, "add", 7, 10)], edits.schema)
    assert rows(review.edit_moves(freed, state).where("refused is null"), "product_id", "after") == sorted([(2, None), (7, 10)], key=repr)


def test_statistics_and_passes(spark):
    passes = spark.createDataFrame([(5, 5, 0, 5), (None, 5, 0, 5), (5, 5, 1, 5), (5, 6, 0, 5), (5, 5, 0, 4)], "expected long, raw long, failures long, different long")
    assert [r.complete for r in review.counted_passes(passes).collect()] == [True, False, False, False, False]
    products = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 9)], "product_id long, match_id long")
    matches = spark.createDataFrame([(1, False, True), (2, True, False)], "match_id long, is_manual boolean, needs_review boolean")
    assert rows(review.match_statistics(products, matches), "what", "n") == [("auto", 1), ("manual", 1), ("matched_products", 3), ("matches_to_review", 1), ("products", 4), ("products_to_review", 2)]
