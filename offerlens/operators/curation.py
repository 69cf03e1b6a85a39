"""Upkeep of matched clusters: split those that fell out, replace dead, lost and dear members, undo it from the log.

Each step reads the state (a row a product, with its match_id or none) and returns moves: product_id, before, after, reason.
Moves are applied by `applied`, logged by `logged`, and undone by `rolled_back`. A step that has been applied finds nothing
more to do. Clusters have a product a site, so pairs within one are few. Clusters made by hand are never touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: A row is lost after so many hours unseen, if its site showed at least this share of its rows since.
LOST_HOURS, SEEN_SHARE = 342, 0.5
#: Prices within the first share are one price, beyond the second they are apart.
SAME_PRICE, APART = 0.005, 0.01
MOVES = "product_id long, before long, after long, reason string"

Conflict = Callable[[str, str], Column]


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: rows of both sides are dealt by the key and sorted. Left to itself Spark takes a
    side for small by the bytes of its files, and the driver then collects its rows, which take many times as many there."""
    return df.hint("merge")


def by_hash(match_id: Column, index: Column) -> Column:
    """The id of a cluster that splits off as number index."""
    return F.xxhash64(match_id, index, F.lit("split"))


def splits(members: DataFrame, conflicts: DataFrame, new_id: Callable[[Column, Column], Column] = by_hash) -> DataFrame:
    """match_id, action, before, groups, ids, unmatched: what becomes of every cluster that does not hold together.

    members: match_id, product_id, site, is_manual, out_of_stock. conflicts: match_id, a, b (products, a before b) and kind,
    country or spec, of pairs of different sites. A cluster is judged if two members conflict or one is out of stock. Members
    in stock join, by id, the first group in which they conflict with none. Groups of two sites or more live on, the largest
    (of equals the first) under the old id; the rest are unmatched."""
    against = conflicts.select("match_id", F.col("a").alias("product_id"), F.col("b").alias("other")).union(conflicts.select("match_id", "b", "a")).groupBy("match_id", "product_id").agg(F.collect_set("other").alias("against"))
    kinds = conflicts.groupBy("match_id").agg(F.max(F.col("kind") == "country").alias("by_country"))
    listed = members.where("not is_manual").join(against, ["match_id", "product_id"], "left")
    one = F.struct("product_id", "site", "out_of_stock", F.coalesce("against", F.array().cast("array<bigint>")).alias("against"))
    clusters = listed.groupBy("match_id").agg(F.array_sort(F.collect_list(one)).alias("m"), F.max("out_of_stock").alias("by_offer")).join(kinds, "match_id", "left")
    clusters = clusters.where("by_offer or by_country is not null")

    def add(groups: Column, m: Column) -> Column:
        free = F.array_position(F.transform(groups, lambda g: ~F.arrays_overlap(g, m["against"])), True)
        alone = F.concat(groups, F.array(F.array(m["product_id"])))
        return F.when(free == 0, alone).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == free, F.concat(g, F.array(m["product_id"]))).otherwise(g)))

    ids = lambda x: F.transform(x, lambda m: m["product_id"])
    active = F.filter("m", lambda m: ~m["out_of_stock"])
    groups = F.aggregate(active, F.array().cast("array<array<bigint>>"), add)
    sites = lambda g: F.size(F.array_distinct(F.transform(F.filter("m", lambda m: F.array_contains(g, m["product_id"])), lambda m: m["site"])))
    df = clusters.withColumn("all_groups", groups)
    ranked = F.array_sort(F.transform(F.filter("all_groups", lambda g: sites(g) >= 2), lambda g, i: F.struct((-F.size(g)).alias("n"), i.alias("i"), g.alias("g"))))
    df = df.withColumn("groups", F.transform(ranked, lambda x: x["g"]))
    kept = F.flatten("groups")
    named = F.transform("groups", lambda g, i: F.when(i == 0, F.col("match_id")).otherwise(new_id(F.col("match_id"), i)))
    what = F.concat(F.when(F.col("by_offer"), "offer").when(F.col("by_country"), "country").otherwise("spec"), F.when(F.size("groups") > 0, "_repartition").otherwise("_dissolve"))
    return df.select("match_id", what.alias("action"), ids(F.col("m")).alias("before"), "groups", named.alias("ids"), F.array_except(ids(F.col("m")), kept).alias("unmatched"))


def split_moves(audits: DataFrame) -> DataFrame:
    """The moves that splits ask for."""
    placed = audits.select("match_id", "action", F.explode(F.arrays_zip("groups", "ids")).alias("x")).select("match_id", "action", F.explode("x.groups").alias("product_id"), F.col("x.ids").alias("after"))
    loose = audits.select("match_id", "action", F.explode("unmatched").alias("product_id"), F.lit(None).cast("long").alias("after"))
    return placed.where("after <> match_id").unionByName(loose).select("product_id", F.col("match_id").alias("before"), "after", F.col("action").alias("reason"))


def split_rejections(audits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """a, b, reason_type: pairs of judged clusters that must not meet again."""
    return conflicts.join(audits.select("match_id"), "match_id", "left_semi").select("a", "b", F.when(F.col("kind") == "country", "system_country").otherwise("system_spec").alias("reason_type")).distinct()


def applied(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The state after the moves."""
    m = moves.select("product_id", "after", F.lit(True).alias("_moved"))
    return state.join(large(m), "product_id", "left").withColumn("match_id", F.when(F.col("_moved"), F.col("after")).otherwise(F.col("match_id"))).select(*state.columns)


def logged(moves: DataFrame, seq: int) -> DataFrame:
    """The moves as entries of the log, under the number of their step."""
    return moves.select(F.lit(seq).cast("long").alias("seq"), "product_id", "before", "after", "reason")


def rollback_faults(state: DataFrame, log: DataFrame, since: int) -> DataFrame:
    """product_id, fault: why the log cannot be undone down to step `since`.

    An entry must begin where the one before it ended, the last must end where the product is now, and clusters that splits
    made must hold no product that came to them in another way."""
    late = log.where(F.col("seq") > since)
    w = Window.partitionBy("product_id").orderBy("seq")
    chain = late.withColumn("previous", F.lag("after").over(w)).withColumn("number", F.row_number().over(w))
    broken = chain.where((F.col("number") > 1) & ~F.col("previous").eqNullSafe(F.col("before"))).select("product_id", F.lit("gap in the log").alias("fault"))
    last = late.groupBy("product_id").agg(F.max_by("after", "seq").alias("expected"))
    now = last.join(large(state.select("product_id", "match_id", F.lit(True).alias("known"))), "product_id", "left")
    changed = now.where(F.col("known").isNull() | ~F.col("expected").eqNullSafe(F.col("match_id"))).select("product_id", F.when(F.col("known").isNull(), "product is gone").otherwise("moved since").alias("fault"))
    made = late.where("after is not null and reason like '%repartition'").select(F.col("after").alias("match_id")).distinct()
    joined = state.join(large(made), "match_id", "left_semi").join(large(last.select("product_id")), "product_id", "left_anti").select("product_id", F.lit("joined since").alias("fault"))
    return broken.union(changed).union(joined).distinct()


def rolled_back(state: DataFrame, log: DataFrame, since: int) -> DataFrame:
    """The state as it was after step `since`. Refused as a whole if rollback_faults finds anything."""
    faults = rollback_faults(state, log, since)
    if not faults.isEmpty():
        raise ValueError(f"the log does not lead to this state: {faults.first()}")
    first = log.where(F.col("seq") > since).groupBy("product_id").agg(F.min_by("before", "seq").alias("after"))
    return applied(state, first)


def with_freshness(state: DataFrame, now: str, hours: int = LOST_HOURS) -> DataFrame:
    """The state with lost: not seen for so many hours, at a site of which enough was seen since; and unknown: not seen, but
    neither was the site. state: site, last_seen_at, dead."""
    old = F.coalesce(F.col("last_seen_at") < F.expr(f"timestamp_ntz'{now}' - interval {hours} hour"), F.lit(True))
    df = state.withColumn("_old", old)
    seen = df.where("not dead").groupBy("site").agg((F.avg((~F.col("_old")).cast("int")) >= SEEN_SHARE).alias("_complete"))
    # A site is a row here, so the state stays where it is; dealt by site it would be as many tasks as there are sites.
    df = df.join(F.broadcast(seen), "site", "left")
    complete = F.coalesce("_complete", F.lit(False))
    return df.withColumn("lost", F.col("_old") & complete).withColumn("unknown", F.col("_old") & ~complete).select(*state.columns, "lost", "unknown")


def unmatchable_reason(in_stock_only: bool = True, with_country: bool = False) -> Column:
    """Why a product can enter no cluster now; null if it can. Reads conflicted, availability and country_code."""
    why = F.when(F.col("conflicted"), "identity_conflicted").when(F.col("availability") == "out_of_stock", "out_of_stock")
    if in_stock_only:
        why = why.when(F.col("availability") != "in_stock", "offer_not_eligible")
    return why.when(F.col("country_code").isNull(), "country_unknown") if with_country else why


def first_come(edges: DataFrame) -> DataFrame:
    """a, b: the first a (by turn, one for each a) takes the b it likes best (least wish), the next the best of what is left.

    edges: a, turn, b, wish (sortable). In a round every a whose best b no earlier a can still want takes it; the first of
    all always does, so there are at most as many rounds as there are a, and in practice few."""
    left, done = stored(edges.select("a", "turn", "b", F.struct("wish", "b").alias("wish"))), None
    while True:
        best = F.col("wish") == F.min("wish").over(Window.partitionBy("a"))
        first = F.struct("turn", "a") == F.min(F.struct("turn", "a")).over(Window.partitionBy("b"))
        taken = stored(left.withColumn("x", best & first).where("x").select("a", "b"))
        done = taken if done is None else done.unionByName(taken)
        if taken.isEmpty():
            return done
        left = stored(left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"))


#: Lists of candidates are looked at in tiles of so many rows: two at first, four times as many in each further round.
TILE = 16


def by_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b (or none): what each a takes, of rows in order of group, turn, a and place; those that can't be told yet are left out.

    A row is a place of the list of a's kind: b stands there, ok says whether a can take it, begin and stop which places came and
    size how long the list is. An a is sure of its b if all places before its window are known to be taken. After the first that is
    not, the rest of its group waits. Held are the rows of one a, what was taken in its group, and places that are still free."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    group, found = None, []
    for (grp, _, a), lot in groupby(rows, key=itemgetter(0, 1, 2)):
        if grp != group:
            group, taken, lists, waits = grp, set(), {}, False
        if waits:
            continue
        lot = list(lot)
        _, _, _, kind, _, _, _, begin, stop, size = lot[0]
        first, places = lists.get(kind, (0, {}))
        places.update({place: b for _, _, _, _, place, b, *_ in lot if place >= first})
        while places.get(first) in taken:
            del places[first]
            first += 1
        lists[kind] = first, places
        b = next((x[5] for x in lot if x[6] and x[5] not in taken), None)
        if first < begin or (b is None and stop < size):
            waits = True
            continue
        if b is not None:
            taken.add(b)
        found.append((a, b))
        if len(found) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def dead_moves(state: DataFrame, conflict: Conflict, score: Callable[[str, str], Column], least: float = 80.0, block: str = "block", alike: tuple[str, ...] | None = None) -> DataFrame:
    """Moves that put a living row of the same site in the place of a dead one.

    state: product_id, site, match_id, is_manual, dead, pack, strengths (an array), a block that a substitute shares, and what
    conflict and score (of the dead row and its substitute) read. A substitute is alive, unmatched, of equal pack and strengths,
    and does not conflict with the anchor, the first living member of another site. Clusters choose in order of id.

    alike: the columns that score reads, if not all. Dead rows of equal ones share a list of candidates, best first, of which each
    sees a window about the place that is its turn; those who need another one come again in the next round."""
    dead = state.where("dead and match_id is not null and not is_manual")
    # Of several dead rows of one site in a cluster the first is replaced.
    dead = dead.join(large(dead.groupBy("match_id", "site").agg(F.min("product_id").alias("product_id"))), ["match_id", "site", "product_id"], "left_semi")
    living = state.where("not dead and match_id is not null")
    met = side(dead, "d_").join(large(side(living, "m_")), (F.col("d_match_id") == F.col("m_match_id")) & (F.col("d_site") != F.col("m_site")))
    anchor = met.groupBy(F.col("d_product_id").alias("product_id")).agg(F.min("m_product_id").alias("m_product_id"))
    shared = ("site", "pack", "strengths", block)
    kinds = tuple(dict.fromkeys((*shared, *(alike or state.columns))))
    named = lambda df: df.withColumn("kind", F.min("product_id").over(Window.partitionBy(*kinds)))
    free = stored(named(state.where("not dead and match_id is null")))
    asking = stored(named(dead.join(large(anchor), "product_id")).withColumn("grp", F.min("kind").over(Window.partitionBy(*shared))))
    of_kind = lambda df, p: side(df.where("kind = product_id").select("kind", *kinds), p)
    both = F.expr(f"d_site = c_site and d_pack = c_pack and d_strengths <=> c_strengths and d_{block} = c_{block}")
    meet = of_kind(asking, "d_").join(large(of_kind(free, "c_")), both).withColumn("score", score("d_", "c_")).where(F.col("score") >= least)
    lists = stored(meet.select(F.col("d_kind").alias("kind"), "score", "c_kind").join(large(free.select(F.col("kind").alias("c_kind"), F.col("product_id").alias("b"))), "c_kind").select("kind", "score", "b"))
    left = asking.select("grp", "kind", F.col("match_id").alias("turn"), F.col("product_id").alias("a"), "m_product_id")
    done, tiles = None, 2
    while True:
        listed = stored(lists.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "b")).cast("long") - 1).withColumn("tile", F.expr(f"place div {TILE}")))
        sizes = listed.groupBy("kind").agg(F.count("*").alias("size"))
        turn = F.row_number().over(Window.partitionBy("kind").orderBy("turn", "a")) - 1 - TILE // 2
        # The window begins at the tile of a's turn, less half a tile, or ends with the list.
        left = stored(left.join(large(sizes), "kind").withColumn("first", F.greatest(F.lit(0), F.least(F.floor(turn / TILE), F.ceil(F.col("size") / TILE) - tiles))))
        asked = left.withColumn("tile", F.explode(F.sequence("first", F.col("first") + tiles - 1)))
        seen = asked.join(large(listed.select("kind", "tile", "place", "b")), ["kind", "tile"])
        pairs = seen.join(large(side(living, "m_")), "m_product_id").join(large(side(free, "c_")), F.col("b") == F.col("c_product_id"))
        ok = ~F.coalesce(conflict("m_", "c_"), F.lit(False))
        rows = pairs.select("grp", "turn", "a", "kind", "place", "b", ok.alias("ok"), (F.col("first") * TILE).alias("begin"), ((F.col("first") + tiles) * TILE).alias("stop"), "size")
        found = stored(rows.repartition("grp").sortWithinPartitions("grp", "turn", "a", "place").mapInArrow(by_turn, "a long, b long"))
        done = found if done is None else done.unionByName(found)
        left = stored(left.drop("size", "first").join(large(found.select("a")), "a", "left_anti"))
        if left.isEmpty():
            return exchanged(done.where("b is not null").join(large(dead.select(F.col("product_id").alias("a"), "match_id")), "a"), "dead")
        lists, tiles = listed.select("kind", "score", "b").join(large(found.select("b")), "b", "left_anti"), tiles * 4


def exchanged(taken: DataFrame, reason: str) -> DataFrame:
    """Moves of pairs (a: the row that leaves its cluster match_id, b: the one that comes in its place)."""
    none = F.lit(None).cast("long")
    move = lambda product, before, after, way: F.struct(product.alias("product_id"), before.alias("before"), after.alias("after"), F.lit(f"{reason}_{way}").alias("reason"))
    return taken.select(F.inline(F.array(move(F.col("a"), F.col("match_id"), none, "out"), move(F.col("b"), none, F.col("match_id"), "in"))))


IDENTITY = ("site", "norm", "dose", "pack")


def same(columns: tuple[str, ...]) -> Column:
    return F.expr(" and ".join(f"l_{c} <=> t_{c}" for c in columns))


def single(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Values that only one row has, and its product_id."""
    return rows.groupBy(*columns).agg(F.min("product_id").alias("product_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def alone(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows that are the only ones of their values."""
    return rows.join(large(single(rows, columns).select("product_id")), "product_id", "left_semi")


def lost_moves(state: DataFrame, conflict: Conflict) -> DataFrame:
    """Moves that give the place of a lost row to its twin: a living, unmatched row of equal site, norm, dose and pack.

    state: with_freshness and matchable, url, country_code, is_manual and what conflict reads. The twin is the only one, of
    several the only one of equal address, knows a known country no less, and conflicts with no other member."""
    lost = state.where("lost and match_id is not null and not is_manual")
    free = state.where("match_id is null and not lost and not unknown and not dead and matchable")
    # Identities with several twins are dropped as groups, so that no pair is made but with the one that can be meant. Pairs are
    # found by ids alone and are few; the rest of their rows is looked up for them.
    def only(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        met = side(lost.select("product_id", *columns), "l_").join(large(side(single(rows, columns), "t_")), same(columns))
        return stored(met.select("l_product_id", "t_product_id"))

    lonely, at_url = only(free, IDENTITY), only(free.where("url is not null"), (*IDENTITY, "url"))
    ids = lonely.unionByName(at_url.join(large(lonely), "l_product_id", "left_anti"))
    pairs = ids.join(large(side(lost, "l_")), "l_product_id").join(large(side(free, "t_")), "t_product_id")
    pairs = stored(pairs.where("l_country_code is null or l_country_code <=> t_country_code").where(~F.coalesce(conflict("l_", "t_"), F.lit(False))))
    others = side(state.where("match_id is not null"), "o_")
    met = pairs.join(large(others), F.expr("l_match_id = o_match_id and l_site <> o_site")).where(F.coalesce(conflict("o_", "t_"), F.lit(False)))
    sound = pairs.join(large(met.select("l_product_id").distinct()), "l_product_id", "left_anti")
    # A twin that several lost rows ask for goes to the first cluster.
    won = sound.groupBy("t_product_id").agg(F.min(F.struct("l_match_id", "l_product_id")).alias("r"))
    return exchanged(won.select(F.col("r.l_product_id").alias("a"), F.col("t_product_id").alias("b"), F.col("r.l_match_id").alias("match_id")), "lost")


def merge_moves(state: DataFrame, conflict: Conflict) -> DataFrame:
    """Moves that join two clusters of which one holds a lost row and the other its living twin.

    The lost row leaves; the smaller cluster (of equals the one of greater id) goes to the other. The twin must be the only one,
    matched or not; no site may be left on both sides, no members may conflict, all must be matchable. A cluster takes part in
    one join at a time; what else there is to join the next step finds."""
    lost = state.where("lost and match_id is not null and not is_manual")
    living = state.where("not lost and not unknown and not dead and matchable")
    pairs = side(lost, "l_").join(large(side(alone(living, IDENTITY), "t_")), same(IDENTITY)).where("t_match_id is not null and not t_is_manual and t_match_id <> l_match_id")
    pairs = pairs.where("l_country_code is null or l_country_code <=> t_country_code").where(~F.coalesce(conflict("l_", "t_"), F.lit(False)))
    joins = pairs.select(F.col("l_product_id").alias("gone"), F.col("l_match_id").alias("here"), F.col("t_match_id").alias("there"))
    members = state.where("match_id is not null")
    one = joins.join(large(side(members, "h_")), F.col("here") == F.col("h_match_id")).where("h_product_id <> gone")
    sizes = one.groupBy("gone", "here", "there").agg(F.count("*").alias("n_here"), F.min("h_matchable").alias("ok")).where("ok")
    other = members.groupBy(F.col("match_id").alias("there")).agg(F.count("*").alias("n_there"), F.min("matchable").alias("ok_there")).where("ok_there")
    met = one.join(large(side(members, "o_")), F.col("there") == F.col("o_match_id")).where(F.coalesce(conflict("h_", "o_"), F.lit(False)) | (F.col("h_site") == F.col("o_site")))
    sound = sizes.join(large(other), "there").join(large(met.select("gone").distinct()), "gone", "left_anti")
    keep_here = (F.col("n_here") > F.col("n_there")) | ((F.col("n_here") == F.col("n_there")) & (F.col("here") < F.col("there")))
    sound = sound.withColumn("keep", F.when(keep_here, F.col("here")).otherwise(F.col("there"))).withColumn("drop", F.when(keep_here, F.col("there")).otherwise(F.col("here")))
    ends = sound.select("gone", F.explode(F.array("here", "there")).alias("c"))
    first = ends.withColumn("x", F.col("gone") == F.min("gone").over(Window.partitionBy("c"))).groupBy("gone").agg(F.min("x").alias("x")).where("x")
    chosen = sound.join(large(first.select("gone")), "gone")
    leave = chosen.select(F.col("gone").alias("product_id"), F.col("here").alias("before"), F.lit(None).cast("long").alias("after"), F.lit("merge_out").alias("reason"))
    movers = chosen.join(large(members.select("product_id", "match_id")), F.col("drop") == F.col("match_id")).where("product_id <> gone")
    return leave.unionByName(movers.select("product_id", F.col("drop").alias("before"), F.col("keep").alias("after"), F.lit("merge_in").alias("reason")))


def same_price(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= SAME_PRICE * F.greatest(a, b)


def apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) > APART * F.greatest(a, b)


def stranger_moves(state: DataFrame, journal: DataFrame, conflict: Conflict, gap: Callable[[str, str], Column], block: str = "block", alike: tuple[str, ...] | None = None) -> DataFrame:
    """Moves that put, in the place of a member whose price fits none of the others, the one row of its site whose price fits all.

    state: with_freshness and price_cents, matchable, country_code, is_manual, block and what conflict and gap read; journal:
    product_id, price_cents, all prices there were. Only clusters of one row a site without rows of unknown state. The new row is
    alive, unmatched, of one block with a living member, no farther by name from any of the others than the old one, compatible with all, of
    a country no less known; and the old row has never had the price of any member.

    alike: the columns that gap reads, if not all. Rows of equal ones, of one site, block, price and country are one kind, and rows
    are looked at one by one, a few of the kinds at a time, only until a second fits."""
    live = F.expr("not lost and not unknown and not dead and matchable and price_cents > 0")
    members = state.where("match_id is not null and not is_manual").withColumn("live", F.coalesce(live, F.lit(False)))
    sound = members.groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"), F.max("unknown").alias("u"), F.count(F.when(F.col("live"), 1)).alias("alive")).where("n = sites and not u and alive >= 2")
    members = stored(members.join(large(sound.select("match_id")), "match_id", "left_semi"))
    pairs = side(members.where("live"), "d_").join(large(side(members, "o_")), F.expr("d_match_id = o_match_id and d_product_id <> o_product_id"))
    # Of a stranger no price meets that of a living member. The least and the greatest of these: a price that is one with both is one with all.
    of = lambda c: F.when(F.col("o_live"), c)
    rest = pairs.groupBy("d_product_id").agg(F.min(of(apart(F.col("d_price_cents"), F.col("o_price_cents")))).alias("far"), F.min(of(F.col("o_price_cents"))).alias("low"), F.max(of(F.col("o_price_cents"))).alias("high"), F.collect_set(of(F.col(f"o_{block}"))).alias("blocks")).where("far").drop("far")
    kinds = tuple(dict.fromkeys(("site", block, "price_cents", "country_code", *(alike or state.columns))))
    free = state.where("match_id is null").where(live).withColumn("kind", F.min("product_id").over(Window.partitionBy(*kinds)))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("product_id")).cast("long") - 1
    free = stored(side(free.withColumn("place", place).withColumn("tile", F.expr(f"place div {TILE}")), "c_"))
    # Prices that are one are of one step or of two next to each other; the steps are a little wider than need be.
    step = lambda c: F.floor(F.log(c) / math.log(1 + 1.1 * SAME_PRICE))
    each = free.where("c_place = 0").join(large(free.groupBy("c_kind").agg(F.count("*").alias("n"))), "c_kind").withColumn("s", step(F.col("c_price_cents")))
    asked = rest.select("d_product_id", "low", "high", F.explode("blocks").alias("b")).join(large(side(members, "d_")), "d_product_id").withColumn("s", F.explode(F.sequence(step(F.col("low")) - 1, step(F.col("low")) + 1)))
    # Blocks and steps of prices are few however many the rows, and kinds are few too, so here Spark may choose.
    cand = asked.join(each, (F.col("b") == F.col(f"c_{block}")) & (F.col("d_site") == F.col("c_site")) & (asked["s"] == each["s"])).drop("s")
    cand = cand.where(same_price(F.col("low"), F.col("c_price_cents")) & same_price(F.col("high"), F.col("c_price_cents"))).where("d_country_code is null or d_country_code <=> c_country_code")
    others = side(members, "o_")
    beside = F.expr("d_match_id = o_match_id and d_product_id <> o_product_id")
    far = cand.join(large(others), beside).where(gap("o_", "c_") > gap("o_", "d_")).select("d_product_id", "c_kind").distinct()
    near = cand.select("d_product_id", "d_match_id", "c_kind", "n").join(large(far), ["d_product_id", "c_kind"], "left_anti")
    before = F.sum("n").over(Window.partitionBy("d_product_id").orderBy("c_kind")) - F.col("n")
    left = stored(near.withColumn("before", before))
    fit, start, many = None, 0, TILE
    while True:
        part = left.where((F.col("before") < start + many) & (F.col("before") + F.col("n") > start))
        tiles = F.sequence(F.expr(f"greatest({start} - before, 0) div {TILE}"), F.expr(f"(least({start + many} - before, n) - 1) div {TILE}"))
        rows = part.withColumn("c_tile", F.explode(tiles)).join(large(free), ["c_kind", "c_tile"]).where((F.col("before") + F.col("c_place")).between(start, start + many - 1))
        bad = rows.join(large(others), beside).where(F.coalesce(conflict("o_", "c_"), F.lit(False))).select("d_product_id", "c_product_id").distinct()
        found = stored(rows.select("d_product_id", "d_match_id", "c_product_id").join(large(bad), ["d_product_id", "c_product_id"], "left_anti"))
        fit = found if fit is None else fit.unionByName(found)
        start, many = start + many, many * 8
        several = fit.groupBy("d_product_id").agg(F.count("*").alias("k")).where("k > 1").select("d_product_id")
        left = stored(left.where(F.col("before") + F.col("n") > start).join(large(several), "d_product_id", "left_anti"))
        if left.isEmpty():
            break
    fit = fit.join(large(several), "d_product_id", "left_anti")
    past = journal.where("price_cents > 0").select("product_id", "price_cents").distinct()
    mine = fit.select("d_product_id", "d_match_id").join(large(past.withColumnsRenamed({"product_id": "d_product_id", "price_cents": "p"})), "d_product_id")
    theirs = fit.select("d_product_id", "d_match_id").join(large(members.select(F.col("match_id").alias("d_match_id"), "product_id")), "d_match_id").where("product_id <> d_product_id").join(large(past), "product_id").select("d_product_id", F.col("price_cents").alias("q"))
    agreed = mine.join(large(theirs), "d_product_id").where(same_price(F.col("p"), F.col("q"))).select("d_product_id").distinct()
    fit = fit.join(large(agreed), "d_product_id", "left_anti")
    # One exchange in a cluster, and a row to one cluster, at a time: the first by id.
    fit = fit.withColumn("one", F.col("d_product_id") == F.min("d_product_id").over(Window.partitionBy("d_match_id"))).where("one")
    won = fit.groupBy("c_product_id").agg(F.min(F.struct("d_match_id", "d_product_id")).alias("r"))
    return exchanged(won.select(F.col("r.d_product_id").alias("a"), F.col("c_product_id").alias("b"), F.col("r.d_match_id").alias("match_id")), "price")
