"""Anchors: which passages of fixed length can occur twice at all.

A passage is `length` units long (words or bytes). In each passage the k-gram of least hash, with k half the
length, is its anchor; equal passages have equal anchors at equal places. So a passage whose anchor occurs
once in the corpus occurs once itself, and only about one k-gram in a quarter of the length has to be
counted. Texts are dealt to chunks; tasks send the hashes of anchors to ranges of the hash, packed into binary
columns, and the ranges send back to each chunk the hashes that occur more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text in a chunk, and bytes of text whose anchors make up one range.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def rolling(units: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of the k units from each place on."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(base, len(units)), out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * powers(inverse(base), n))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


#: In a packed place the upper bits are of the hash, the lower 30 the place.
PLACE = np.uint64((1 << 30) - 1)


def anchor_places(units: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the starts of passages that lie in one text, the place of each one's anchor
    (of equals the first; ascending), and the hash of the k-gram at every place."""
    k = length // 2
    n = len(units) - length + 1
    if n > PLACE:
        raise ValueError("a text of over 2**30 units has no place in an anchor")
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    grams = rolling(units, k)
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(packed, length - k + 1) & PLACE).astype(np.int64)
    starts = np.flatnonzero(text[:n] == text[length - 1 :])
    return starts, place[starts], grams


def parts(sizes: list[int], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many units together, to bound the arrays over them."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def short(hashes: np.ndarray) -> np.ndarray:
    """48 bits of a hash: all that tasks exchange of an anchor."""
    return hashes >> np.uint64(16)


def pack(x: np.ndarray, width: int) -> bytes:
    """The lower bytes of whole numbers, one plane for each byte, which compresses well if they are sorted."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def chunked(docs: DataFrame, text_bytes: int, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """docs with the column chunk, and the number of chunks; a chunk holds about CHUNK_BYTES of text at most, and
    every task of a shuffle has one. The text is part of what deals, so that rows of one id, or of none, spread."""
    n = partitions_for(docs.sparkSession, -(-text_bytes // CHUNK_BYTES))
    return docs.withColumn("chunk", F.pmod(F.xxhash64(id_col, "text"), F.lit(n)).cast("int")), n


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated_anchors(docs: DataFrame, total_bytes: int, length: int, units_of, often: int = 2000) -> DataFrame:
    """chunk, hashes: packed short hashes of the anchors that a chunk shares with others or holds twice; hot is
    true for rows of anchors that more than so many chunks hold. units_of gives the units of a text."""
    ranges = max(4, -(-total_bytes // RANGE_BYTES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            second = np.zeros(len(h), bool)
            second[1:] = ~new[1:] & new[:-1]
            h, c = h[new | second], c[new | second]  # that a chunk holds it twice is all that matters
            r = (h * np.uint64(ranges)) >> np.uint64(48)
            cuts = np.flatnonzero(np.diff(r)) + 1
            first = [0, *cuts.tolist()] if len(r) else []
            return pa.RecordBatch.from_pydict({
                "range": pa.array(r[first].astype(np.int32)),
                "hashes": pa.array([pack(x, 6) for x in np.split(h, cuts)][: len(first)], pa.binary()),
                "chunks": pa.array([pack(x, 4) for x in np.split(c, cuts)][: len(first)], pa.binary()),
            })

        for batch in batches:
            chunk = batch["chunk"].to_numpy()
            for i in range(0, batch.num_rows, 512):
                units = [units_of(t) for t in batch["text"].slice(i, 512).to_pylist()]
                for a, b in parts([len(u) for u in units]):
                    sizes = np.array([len(u) for u in units[a:b]])
                    _, place, grams = anchor_places(np.concatenate(units[a:b]), sizes, length)
                    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
                    held.append((short(grams[place]), np.repeat(chunk[i + a : i + b], sizes)[place]))
                    size += len(place)
            if size > 400_000:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        h = np.concatenate([unpack(x.as_py(), 6) for x in table["hashes"]])
        c = np.concatenate([unpack(x.as_py(), 4) for x in table["chunks"]])
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        n = np.repeat(np.diff(edge), np.diff(edge))
        rows = []
        for hot, chosen in ((False, (n > 1) & (n <= often)), (True, n > often)):
            mine, of = c[chosen], h[chosen]
            by = np.lexsort((of, mine))
            mine, of = mine[by], of[by]
            new = np.ones(len(mine), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (of[1:] != of[:-1])
            mine, of = mine[new], of[new]
            cuts = np.flatnonzero(np.diff(mine)) + 1
            for first, part in zip([0, *cuts.tolist()], np.split(of, cuts)):
                if len(part):
                    rows.append({"chunk": int(mine[first]), "hot": hot, "hashes": pack(part, 6)})
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int32()), ("hot", pa.bool_()), ("hashes", pa.binary())]))

    shares = docs.select("chunk", "text").mapInArrow(gather, "range int, hashes binary, chunks binary")
    return shares.groupBy("range").applyInArrow(meet, "chunk int, hot boolean, hashes binary")


def candidates(place: np.ndarray, grams: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which passages have an anchor among the repeated ones (sorted short hashes)."""
    if not len(repeated):
        return np.zeros(len(place), bool)
    h = short(grams[place])
    at = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
    return repeated[at] == h
