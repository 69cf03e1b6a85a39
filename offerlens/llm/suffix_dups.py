"""Suffix-array dedup: a distributed merge sort of suffixes that is aware of common prefixes.

Sorting a suffix for every byte would move many times the corpus, so the suffix array is sparse: it holds the
suffixes that start at anchors (see anchors), which equal passages share at equal places, and of these only
anchors that occur more than once. A chunk of texts sorts its suffixes into runs, keeps one of equal ones, and
sends each run front-coded: what a suffix shares with the one before it is a number, not bytes. Runs are
merged with a loser tree that knows, for each contender, how many bytes it shares with the last winner;
contenders that differ in that number are decided by it, others compared from there on, so no known prefix
is looked at again. The common prefixes of neighbours in the merged array, and those of the bytes to the left
of the anchors, tell which passages are equal; all but the earliest go back to their chunk as intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import anchor_places, candidates, chunked, mixed, parts, repeated_anchors, short, text_bytes, unpack
from .common import partitions_for, pick, stored
from .window_dups import NO_ID, ids_of

#: A random number for each value of a byte.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Anchors that more chunks than this hold are not grouped as such; each of their passages is a suffix of its own.
OFTEN = 2000


def byte_units(text: str | None) -> np.ndarray:
    return BYTE[np.frombuffer((text or "").encode(), np.uint8)]


def suffixes_in(texts: list[bytes], ids: np.ndarray, repeated: np.ndarray, hot: np.ndarray, length: int):
    """The different suffixes of a chunk, sorted, and what its own copies tell.

    Returns (suffixes, twins, gone): a suffix is (right, left, deal, text, place): the bytes from the anchor on,
    those before it, the hash it is dealt by, its text's place in the list, and the anchor's place in the text.
    twins has, by right and left, the other texts of the same id with the suffix at the same place, to which all
    that is found of it applies. gone has (text, from, to) for passages equal to an earlier one of the same chunk.
    """
    # Earlier texts first, so that the first of equal suffixes is the earliest.
    by_id = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    first: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
    twins: dict[tuple[bytes, bytes], dict[int, None]] = {}
    gone: list[tuple[int, int, int]] = []

    def meet(right: bytes, left: bytes, deal: int, doc: int, place: int) -> None:
        key = (right, left)
        _, other, at = first.setdefault(key, (deal, doc, place))
        if (other, at) == (doc, place):
            return
        mine, held = (ids[doc], place), (ids[other], at)
        if mine == held:
            twins.setdefault(key, {})[doc] = None
        elif mine > held:
            gone.append((doc, place - len(left), place + len(right)))
        else:
            gone.extend((d, at - len(left), at + len(right)) for d in (other, *twins.pop(key, ())))
            first[key] = (deal, doc, place)

    for a, b in parts([len(texts[i]) for i in by_id]):
        mine = by_id[a:b]
        sizes = np.array([len(texts[i]) for i in mine])
        begin = np.cumsum(sizes) - sizes
        joined = b"".join(texts[i] for i in mine)
        starts, place, grams = anchor_places(BYTE[np.frombuffer(joined, np.uint8)], sizes, length)
        for known, single in ((repeated, False), (hot, True)):
            chosen = candidates(place, grams, known)
            s, p = starts[chosen], place[chosen]
            if not len(s):
                continue
            if single:
                head, tail, at = s, s, s
            else:  # passages of one anchor in a row are one suffix with what stands before it
                new = np.flatnonzero(np.diff(p, prepend=-1))
                head, tail, at = s[new], s[np.append(new[1:], len(s)) - 1], p[new]
            doc = np.searchsorted(begin, at, side="right") - 1
            deal = short(grams[at])
            for h, t, x, d, g in zip(head.tolist(), tail.tolist(), at.tolist(), doc.tolist(), deal.tolist()):
                meet(joined[x : t + length], joined[h:x], g, mine[d], x - int(begin[d]))
    suffixes = [(*key, *value) for key, value in first.items()]
    suffixes.sort(key=lambda e: (e[0], e[1]))
    return suffixes, twins, gone


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that a and b share at their start; so many are known to be equal."""
    most = min(len(a), len(b))
    while known < most:
        step = min(8, most - known)
        if a[known : known + step] == b[known : known + step]:
            known += step
        else:
            while a[known] == b[known]:
                known += 1
            return known
    return known


def front_coded(rights: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """For sorted suffixes: bytes shared with the one before, length, and the bytes that follow the shared ones."""
    common, tails, last = bytearray(), [], b""
    for r in rights:
        k = shared(last, r)
        common.append(k)
        tails.append(r[k:])
        last = r
    return bytes(common), bytes(map(len, rights)), b"".join(tails)


def decoded(common: bytes, sizes: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a front-coded run, each with the number of bytes it shares with the one before."""
    at, last = 0, b""
    for k, n in zip(common, sizes):
        last = last[:k] + tails[at : at + n - k]
        at += n - k
        yield last, k


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(run, bytes shared with the last one) in sorted order, from sorted front-coded runs.

    A loser tree. Each contender carries the number of bytes it shares with the last winner: the one that
    shares more is smaller, and only of equals are bytes compared, from that number on.
    """
    n = len(runs)
    text: list[bytes | None] = [None] * n
    common = [0] * n
    for i, run in enumerate(runs):
        text[i], common[i] = next(run, (None, 0))

    def beats(i: int, j: int) -> bool:
        """Whether i comes before j; the loser's number then is about the winner."""
        a, b = text[i], text[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        if common[i] != common[j]:
            return common[i] > common[j]
        k = shared(a, b, common[i])
        before = (a[k : k + 1], i) < (b[k : k + 1], j)
        common[j if before else i] = k
        return before

    losers = [-1] * n

    def play(node: int) -> int:
        if node >= n:
            return node - n
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    winner = play(1) if n > 1 else 0
    while n and text[winner] is not None:
        yield winner, common[winner]
        text[winner], common[winner] = next(runs[winner], (None, 0))
        node = (winner + n) // 2
        while node:
            other = losers[node]
            if beats(other, winner):
                losers[node], winner = winner, other
            node //= 2


def classes(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """The class of each entry among those that share n bytes, given the sorted order and neighbours' shares."""
    numbers = np.cumsum(common < n)
    out = np.empty(len(order), np.int64)
    out[order] = numbers
    return out


def sorted_lefts(lefts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the bytes before the anchors, read backwards, and what neighbours in it share."""
    grid = np.frombuffer(b"".join(x[::-1].ljust(width, b"\0") for x in lefts), np.uint8).reshape(len(lefts), width)
    padded = np.zeros((len(lefts), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = grid
    keys = padded.view(">u8")
    order = np.lexsort(keys.T[::-1])
    differ = np.ones((len(lefts), width + 1), bool)
    differ[1:, :width] = grid[order][1:] != grid[order][:-1]
    common = differ.argmax(axis=1)
    common[:1] = 0
    return order, common


def equal_passages(common: np.ndarray, rights: np.ndarray, lefts: list[bytes], ids: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries in sorted order: the largest and the least distance before its anchor at which a passage
    starts that also starts earlier (-1 if there is none)."""
    far, near = np.full(len(rights), -1), np.full(len(rights), -1)
    k = length // 2
    group = np.cumsum(common < k)
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(many):
        return far, near
    # Dropping entries that meet nobody leaves whole groups, whose first entries share under k bytes with others.
    common, rights, ids, places = common[many], rights[many], ids[many], places[many]
    lefts = [lefts[i] for i in many]
    order, left_common = sorted_lefts(lefts, length - k)
    before = np.array([len(x) for x in lefts])
    everyone = np.arange(len(many))
    earliest = np.lexsort((places, ids))
    for o in range(length - k + 1):
        fit = (before >= o) & (rights >= length - o)
        if fit.sum() < 2:
            continue
        key = classes(everyone, common, length - o) * (len(many) + 1) + classes(order, left_common, o)
        chosen = earliest[fit[earliest]]
        _, first, back = np.unique(key[chosen], return_index=True, return_inverse=True)
        lead = chosen[first][back]
        late = chosen[(ids[lead] != ids[chosen]) | (places[lead] != places[chosen])]
        far[many[late]] = o
        near[many[late]] = np.where(near[many[late]] < 0, o, near[many[late]])
    return far, near


def remove_repeated_passages(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, then the carried columns.

    With with_text, also kept: the remaining text, where a character of which only some bytes would go stays
    whole. Null texts count as empty. Of passages that start at the same place of rows with one id none is
    earlier; rows without an id come after all others. Repeated rows give repeated results, an empty table
    gives no rows, and columns that are not named are not read. A task holds a chunk of texts, or the
    suffixes that share a range of anchor hashes.
    """
    if not 4 <= length <= 255:
        raise ValueError("length must be from 4 to 255: runs hold shared prefixes as bytes")
    extra = [f"x{i}" for i in range(len(carry))]
    docs = pick(docs, doc_id=id_col, text=text_col, **dict(zip(extra, carry))).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = text_bytes(docs)
    docs, chunks = chunked(docs, total)
    repeated = stored(repeated_anchors(docs, total, length, byte_units, OFTEN))
    buckets = chunks
    dealt = docs.repartition(partitions_for(docs.sparkSession, chunks // 4), "chunk")

    def known(table: pa.Table, hot: bool) -> np.ndarray:
        found = [unpack(x.as_py(), 6) for x, h in zip(table["hashes"], table["hot"]) if x.is_valid and h.as_py() == hot]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)

    def own(left: pa.Table, right: pa.Table):
        texts = [(t or "").encode() for t in left["text"].to_pylist()] if left.num_rows else []
        ids = ids_of(left) if left.num_rows else np.empty(0, np.int64)
        return texts, ids, *suffixes_in(texts, ids, known(right, False), known(right, True), length)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        _, ids, suffixes, _, _ = own(left, right)
        runs: dict[int, list[int]] = {}
        for i, e in enumerate(suffixes):
            runs.setdefault(e[2] % buckets, []).append(i)
        rows = []
        for bucket, numbers in runs.items():
            chosen = [suffixes[i] for i in numbers]
            common, sizes, tails = front_coded([e[0] for e in chosen])
            rows.append({
                "bucket": bucket, "chunk": left["chunk"][0].as_py(), "common": common, "sizes": sizes, "tails": tails,
                "left_sizes": bytes(len(e[1]) for e in chosen), "lefts": b"".join(e[1] for e in chosen),
                "ids": ids[[e[3] for e in chosen]].tobytes(), "places": np.array([e[4] for e in chosen], np.int32).tobytes(), "numbers": np.array(numbers, np.int32).tobytes(),
            })
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("common", "sizes", "tails", "left_sizes", "lefts", "ids", "places", "numbers"))]))

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        column = {c: table[c].to_pylist() for c in table.column_names}
        sequence = list(merged([decoded(*x) for x in zip(column["common"], column["sizes"], column["tails"])]))
        run = np.array([r for r, _ in sequence], np.int64)
        common = np.array([c for _, c in sequence], np.int64)
        # Entries of a run come in its own order, so a stable sort by run finds each one's place in the merged array.
        back = np.argsort(run, kind="stable")

        def gather(name: str, kind) -> np.ndarray:
            flat = np.concatenate([np.frombuffer(x, kind) for x in column[name]])
            out = np.empty(len(flat), flat.dtype)
            out[back] = flat
            return out

        all_lefts: list[bytes] = []
        for sizes, blob in zip(column["left_sizes"], column["lefts"]):
            at = 0
            for n in sizes:
                all_lefts.append(blob[at : at + n])
                at += n
        lefts: list[bytes] = [b""] * len(all_lefts)
        for i, x in zip(back.tolist(), all_lefts):
            lefts[i] = x
        far, near = equal_passages(common, gather("sizes", np.uint8).astype(np.int64), lefts, gather("ids", np.int64), gather("places", np.int32), length)
        numbers = gather("numbers", np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in column["sizes"]])])
        rows = []
        for i, chunk in enumerate(column["chunk"]):
            mine = back[ends[i] : ends[i + 1]]
            late = mine[far[mine] >= 0]
            if len(late):
                rows.append({"chunk": chunk, "verdict": np.stack([numbers[late], far[late], near[late]], axis=1).astype(np.int32).tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int32()), ("verdict", pa.binary())]))

    names = ("common", "sizes", "tails", "left_sizes", "lefts", "ids", "places", "numbers")
    runs = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, " + ", ".join(f"{c} binary" for c in names))
    verdicts = runs.groupBy("bucket").applyInArrow(merge, "chunk int, verdict binary")
    told = repeated.withColumn("verdict", F.lit(None).cast("binary")).unionByName(verdicts, allowMissingColumns=True)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, _, suffixes, twins, gone = own(left, right)
        for blob in right["verdict"].to_pylist() if right.num_rows else []:
            for number, far, near in np.frombuffer(blob or b"", np.int32).reshape(-1, 3).tolist():
                after, before, _, doc, place = suffixes[number]
                gone.extend((d, place - far, place - near + length) for d in (doc, *twins.get((after, before), ())))
        intervals: dict[int, list[tuple[int, int]]] = {}
        for doc, a, b in gone:
            intervals.setdefault(doc, []).append((a, b))
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, text in enumerate(texts):
            spans: list[list[int]] = []
            for a, b in sorted(intervals.get(i, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept = without(text, spans)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(without(text, [whole_characters(text, a, b) for a, b in spans]).decode() if with_text else None)
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if with_text else {})
        made = {"doc_id": left["doc_id"]} | {c: pa.array(out[c], k) for c, k in kinds.items()} | {c: left[c] for c in extra}
        return pa.table(made)

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else ""))
    for c in extra:
        schema.add(c, docs.schema[c].dataType)
    found = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, schema)
    return found.withColumnsRenamed(dict(zip(extra, carry)))


def without(text: bytes, spans: list) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = max(at, b)
    return b"".join([*kept, text[at:]]) if kept else text


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the bytes of characters that it only cuts."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
