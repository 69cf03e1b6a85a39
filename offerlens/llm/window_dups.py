"""Substring dedup by Rabin-Karp hashes of all word windows of a fixed length, counted in Spark.

A first pass finds the windows that can repeat (see anchors). For those, each chunk of texts hands Spark one
row for each different window: a 128-bit Rabin-Karp hash and the least id of a text that holds it. Spark finds the least id of
all chunks; where it is smaller, the hash goes back to the chunk. There, windows that start in a text of
smaller id merge into maximal intervals, and the words in them go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import BASE, anchor_places, candidates, chunked, parts, repeated_anchors, rolling, text_bytes, unpack
from .common import partitions_for, pick, stored

OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = np.iinfo(np.int64).max


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ids_of(table: pa.Table) -> np.ndarray:
    """Document ids; rows without one come after all others."""
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()


def windows_in(texts: list[str | None], ids: np.ndarray, repeated: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each window that can repeat: two hashes, its text's place in the list, its start in all texts laid end to end, and the texts' sizes."""
    units = [word_hashes(t) for t in texts]
    found, offset = [], 0
    for a, b in parts([len(u) for u in units]):
        sizes = np.array([len(u) for u in units[a:b]])
        joined = np.concatenate(units[a:b])
        starts, place, grams = anchor_places(joined, sizes, length)
        s = starts[candidates(place, grams, repeated)]
        if len(s):
            doc = np.repeat(np.arange(a, b), sizes)[s]
            found.append((rolling(joined, length, BASE)[s], rolling(joined, length, OTHER_BASE)[s], doc, s + offset))
        offset += len(joined)
    empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    h1, h2, doc, start = map(np.concatenate, zip(*found)) if found else empty
    return h1, h2, doc, start, np.array([len(u) for u in units], np.int64)


def least_ids(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal windows together, least id first, and where each group begins in it."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def among(h1: np.ndarray, h2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Which pairs of hashes are among the pairs s1, s2."""
    order = np.lexsort((s2, s1))
    s1, s2 = s1[order], s2[order]
    low, high = np.searchsorted(s1, h1, "left"), np.searchsorted(s1, h1, "right")
    hit = low < high
    hit[hit] = s2[low[hit]] == h2[hit]
    for i in np.flatnonzero(high - low > 1):  # first halves that two windows share
        hit[i] = h2[i] in s2[low[i] : high[i]]
    return hit


def remove_repeated_windows(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words, joined by blanks, if asked for) of every row.

    Null and blank texts have no words. Texts of one id do not remove each other's windows; rows without an
    id come after all others. Repeated rows give repeated results, an empty table gives no rows, and other
    columns are not read. A chunk of texts and the list of its repeated anchors are what one task holds.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = text_bytes(docs)
    docs, chunks = chunked(docs, total)
    repeated = stored(repeated_anchors(docs, total, length, word_hashes))
    n = partitions_for(docs.sparkSession, chunks // 4)
    dealt = docs.repartition(n, "chunk")

    def known(table: pa.Table) -> np.ndarray:
        found = [unpack(x.as_py(), 6) for x in table["hashes"] if x.is_valid]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = ids_of(left) if left.num_rows else np.empty(0, np.int64)
        h1, h2, doc, _, _ = windows_in(left["text"].to_pylist() if left.num_rows else [], ids, known(right), length)
        order, first = least_ids(h1, h2, ids[doc])
        one = order[first]
        chunk = left["chunk"][0].as_py() if left.num_rows else 0
        return pa.table({"h1": h1[one].view(np.int64), "h2": h2[one].view(np.int64), "least": ids[doc[one]], "chunk": pa.array(np.full(len(one), chunk, np.int32))})

    windows = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(count, "h1 long, h2 long, least long, chunk int")
    # A window has one row from each chunk at most, so no group is larger than the number of chunks.
    overall = F.min("least").over(Window.partitionBy("h1", "h2"))
    elsewhere = windows.withColumn("overall", overall).where("least > overall").select("chunk", F.lit(None).cast("binary").alias("hashes"), "h1", "h2")
    none = F.lit(None).cast("long")
    told = repeated.select("chunk", "hashes", none.alias("h1"), none.alias("h2")).unionByName(elsewhere)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left["text"].to_pylist() if left.num_rows else []
        ids = ids_of(left) if left.num_rows else np.empty(0, np.int64)
        h1, h2, doc, start, sizes = windows_in(texts, ids, known(right), length)
        order, first = least_ids(h1, h2, ids[doc])
        smallest = np.empty(len(order), np.int64)
        smallest[order] = np.repeat(ids[doc[order[first]]], np.diff(np.append(first, len(order))))
        sent = (right[c].combine_chunks().drop_null().to_numpy().view(np.uint64) if right.num_rows else np.empty(0, np.uint64) for c in ("h1", "h2"))
        one = order[first]
        earlier = np.empty(len(order), bool)
        earlier[order] = np.repeat(among(h1[one], h2[one], *sent), np.diff(np.append(first, len(order))))
        gone = start[(ids[doc] > smallest) | earlier]
        steps = np.zeros(int(sizes.sum()) + length + 1, np.int32)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + length, -1)
        covered = np.cumsum(steps) > 0
        removed, digests, kept_texts, at = [], [], [], 0
        for text, size in zip(texts, sizes.tolist()):
            words = (text or "").encode().split()
            mine = covered[at : at + size]
            at += size
            lost = int(mine.sum())
            kept = b" ".join(words if not lost else [w for w, m in zip(words, mine.tolist()) if not m])
            removed.append(lost)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode())
        out = {"doc_id": left["doc_id"] if left.num_rows else pa.array([], pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept_texts, pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, schema)
