"""SimHash near-duplicates, found through tables of distances to pivots.

Each text gets a 64-bit fingerprint; equal ones are one node from then on. Of two fingerprints that differ in
at most two bits, some two of four blocks of 16 bits are equal, so only fingerprints that share two blocks
meet. Where they meet, the distances of each to a set of reference fingerprints (the pivots) are tabled
first; a pair whose distances to any pivot differ by more than two cannot be within two bits of each other,
and what this leaves is verified. Fingerprints that share two blocks with very many others take a way without
pairs: every fingerprint is dealt to itself and its 64 neighbours at one bit, and two fingerprints are within
two bits exactly if they meet at some point. Components then grow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, stored

SEED, SHINGLE, PIVOTS = 42, 3, 48
#: Largest number of fingerprints with two blocks in common that are compared pair by pair.
PAIRWISE = 256
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's shingles; 0 without a word."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(words) - SHINGLE + 1)
    set_bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(PIVOTS)], np.uint64)


def links_within(fps: np.ndarray, most: int) -> np.ndarray:
    """Index pairs of fingerprints within so many bits: pivot table, largest coordinate difference, verification."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None]).astype(np.int8)
    left, right = np.triu_indices(len(fps), 1)
    for k in range(0, PIVOTS, 8):  # a few coordinates at a time discard most pairs
        near = np.abs(table[left, k : k + 8] - table[right, k : k + 8]).max(axis=1, initial=0) <= most
        left, right = left[near], right[near]
    near = np.bitwise_count(fps[left] ^ fps[right]) <= most
    return np.stack([left[near], right[near]], axis=1)


def block_links(members: DataFrame, most: int) -> DataFrame:
    """a, b: links among fingerprints of equal key, from rows (key, fp) sorted by key in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_key, carry = np.empty(0, np.int64), np.empty(0, np.int64)
        out: list[np.ndarray] = []

        def flush(keys: np.ndarray, fps: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for part in np.split(fps, cuts):
                if len(part) > 1:
                    pairs = links_within(part.view(np.uint64), most)
                    if len(pairs):
                        out.append(part[pairs])

        for batch in batches:
            keys = np.concatenate([carry_key, batch["key"].to_numpy()])
            fps = np.concatenate([carry, batch["fp"].to_numpy()])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            flush(keys[:whole], fps[:whole])
            carry_key, carry = keys[whole:], fps[whole:]
            if out:
                e = np.concatenate(out)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])
        flush(carry_key, carry)
        if out:
            e = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, most: int = 2) -> DataFrame:
    """a, b: enough links between the different fingerprints of nodes (column fp) to connect all that are near."""
    block = [F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(block[i], 16).bitwiseOR(block[j]).bitwiseOR(F.lit(n << 32)) for n, (i, j) in enumerate(combinations(range(4), 2))]
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Counting comes first: keys of one fingerprint, which are nearly all, meet nobody.
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(dealt.join(counts, "key"))
    few = met.where(F.col("n") <= PAIRWISE).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    many = met.where(F.col("n") > PAIRWISE).select("fp").distinct()
    points = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    at = many.select("fp", F.explode(points).alias("point"))
    first = at.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("point", "a")
    return block_links(few, most).union(at.join(first, "point").where("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge (a, b). Alternates large and
    small stars until nothing changes; each round is written, so that a lost executor costs one round."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        mark = now


def near_duplicates(docs: DataFrame, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row.

    Null, empty and blank texts have fingerprint zero, which links like any other. Rows of one id are nodes
    by their fingerprints. A null id gives a row with null doc_id; it never is a component's smallest, and a
    component of null ids only has a null id. An empty table gives no rows; other columns are not read.
    """
    if most > 2:
        raise ValueError("most must be at most 2: fingerprints farther apart need not meet")
    docs = stored(fingerprints(pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Rows that share an id connect their fingerprints.
    same_id = docs.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("doc_id is not null and a < z").select("doc_id", "a")
    same_id = docs.join(same_id, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    found = components(links(nodes, most).union(same_id))
    nodes = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = nodes.join(ids, "root").select("fp", "component_id")
    return docs.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
