"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each task.

Spark deals out the texts; each task cuts them at the pattern and hands the pieces it has not met lately, once
each, to DuckDB. There a piece is a set of rows, one for each token and its position. A recursive query joins
neighbouring rows with the merge table and contracts each piece's leftmost pair of least rank until no pair
is left. An ordered aggregation gives the ids. Another query takes ids and gives, again by an ordered
aggregation, the bytes that they decode to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import parts
from .common import pick, slices
from .token_counts import SPACE, Cutter, merges_done

#: Pieces met lately whose encoding a worker process keeps; it keeps as many again that it met before those.
CACHE_LIMIT = 200_000
#: Bytes of the longest piece that goes through DuckDB. There each merge rewrites the rows of the piece, which
#: takes the square of its length; longer pieces are merged, with the same result, on a heap.
LONGEST = 400
#: Bytes of the pieces that one query encodes, and tokens that one decodes, which bounds its rows.
ROUND = 400_000

#: A row has a token t at position p, the position q and token u that follow, and, in k, the token that the two
#: merge to, p and q. Only pairs that a step has changed are looked up again.
ENCODE = """
WITH RECURSIVE state(w, p, q, t, u, k, step) AS (
    SELECT w, p, p + 1::SMALLINT, s.t, s.u, (m.merged::BIGINT << 20) | (p::BIGINT << 10) | (p + 1), 0::SMALLINT
    FROM symbols AS s
    LEFT JOIN merges AS m ON m.pair = (s.t::BIGINT << 20) | s.u
    UNION ALL
    SELECT n.w, n.p, n.q, n.t, n.u, CASE WHEN n.changed THEN (m.merged::BIGINT << 20) | (n.p::BIGINT << 10) | n.q ELSE n.k END, n.step
    FROM (
        SELECT s.w, s.p, s.k, (s.step + 1)::SMALLINT AS step, s.p = best.p OR s.q = best.p AS changed,
               CASE WHEN s.p = best.p THEN gone.q ELSE s.q END AS q,
               CASE WHEN s.p = best.p THEN best.merged ELSE s.t END AS t,
               CASE WHEN s.p = best.p THEN gone.u WHEN s.q = best.p THEN best.merged ELSE s.u END AS u
        FROM state AS s
        JOIN (
            SELECT w, (k >> 20)::INTEGER AS merged, ((k >> 10) & 1023)::SMALLINT AS p, (k & 1023)::SMALLINT AS q
            FROM (SELECT w, min(k) AS k FROM state WHERE k IS NOT NULL GROUP BY w)
        ) AS best ON best.w = s.w
        JOIN state AS gone ON gone.w = best.w AND gone.p = best.q
        WHERE s.p <> best.q
    ) AS n
    LEFT JOIN merges AS m ON m.pair = CASE WHEN n.changed THEN (n.t::BIGINT << 20) | n.u END
)
SELECT string_agg(t, ',' ORDER BY p) AS ids
FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) AS final USING (w, step)
GROUP BY w ORDER BY w
"""

DECODE = "SELECT string_agg(v.bytes, '' ORDER BY p) AS bytes FROM coded JOIN vocabulary AS v USING (t) GROUP BY w ORDER BY w"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class Codec:
    """Encodes and decodes by the ranks of a file; encodings met before are kept, up to a limit."""

    def __init__(self, raw: bytes, pattern: str):
        import duckdb

        self.ranks = parse_ranks(raw)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "allocator_flush_threshold": "16MB", "temp_directory": ""})
        tokens = list(self.ranks)
        self.pairs = {(t[:i], t[i:]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        both = [self.ranks[a] << 20 | self.ranks[b] for a, b in self.pairs]
        merges = pa.table({"pair": pa.array(both, pa.int64()), "merged": pa.array(self.pairs.values(), pa.int32())})
        vocabulary = pa.table({"t": [self.ranks[t] for t in tokens], "bytes": [t.hex() for t in tokens]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        unicode_space = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        self.pieces = Cutter(unicode_space)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: By piece: its ids, joined by commas, and the bytes that they decode to. The same, of pieces met longer ago.
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = {}, {}

    def encode_pieces(self, pieces: list[str]) -> dict[str, str]:
        """The ids of each different piece, joined by commas."""
        out, todo = {}, {}
        for piece in pieces:
            b = piece.encode()
            if (whole := self.ranks.get(b)) is not None:
                out[piece] = str(whole)
            elif len(b) > LONGEST:
                symbols = [b[i : i + 1] for i in range(len(b))]
                merges_done(symbols, self.pairs)
                out[piece] = ",".join(str(self.ranks[s]) for s in symbols if s is not None)
            else:
                todo[piece] = b
        names, lists = list(todo), list(todo.values())
        for a, b in parts(list(map(len, lists)), ROUND):
            self.db.register("symbols", self.symbols(lists[a:b]))
            found = [ids for ids, in self.db.execute(ENCODE).fetchall()]
            self.db.unregister("symbols")
            out.update(zip(names[a:b], found, strict=True))
        return out

    def symbols(self, pieces: list[bytes]) -> pa.Table:
        """A row for each byte: its piece w, position p, token t, and the token u of the piece's next byte."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = lengths.cumsum()
        t = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.zeros(len(t), bool)
        last[ends - 1] = True
        p = np.arange(len(t)) - np.repeat(ends - lengths, lengths)
        return pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "p": p.astype(np.int16), "t": t, "u": pa.array(np.roll(t, -1), mask=last)})

    def learn(self, pieces: set[str]) -> None:
        """Sees to it that every one of the pieces is known."""
        if len(self.ids) >= CACHE_LIMIT:
            self.older, self.ids, self.bytes = (self.ids, self.bytes), {}, {}
        old_ids, old_bytes = self.older
        new = []
        for p in pieces - self.ids.keys():
            if p in old_ids:
                self.ids[p], self.bytes[p] = old_ids[p], old_bytes[p]
            else:
                new.append(p)
        coded = self.encode_pieces(new)
        self.ids |= coded
        self.bytes.update(zip(coded, self.decode(list(coded.values())), strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text its ids, joined by commas, their number, and the bytes that the ids decode to."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        for pieces in cut:
            joined = ",".join(map(self.ids.__getitem__, pieces))
            yield joined, joined.count(",") + 1 if pieces else 0, b"".join(map(self.bytes.__getitem__, pieces))

    def decode(self, ids: list[str]) -> list[bytes]:
        """The bytes of each list of ids (joined by commas; none of them empty)."""
        out: list[bytes] = []
        lists = [i.split(",") for i in ids]
        for a, b in parts(list(map(len, lists)), ROUND):
            t = np.array([x for one in lists[a:b] for x in one], np.int32)
            w = np.repeat(np.arange(b - a, dtype=np.int32), list(map(len, lists[a:b])))
            self.db.register("coded", pa.table({"w": w, "p": np.arange(len(t), dtype=np.int32), "t": t}))
            out += [bytes.fromhex(x) for x, in self.db.execute(DECODE).fetchall()]
            self.db.unregister("coded")
        return out


_codecs: dict[int, Codec] = {}


def codec_of(raw: bytes, pattern: str) -> Codec:
    """One codec a worker process, so that what it knows serves later tasks too."""
    key = hash((raw, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves, if asked for) of every row.

    A null text counts as empty: no tokens, and the digests of no bytes. Repeated rows give repeated results,
    null ids stay null, an empty table gives no rows, other columns are not read. One pass, no shuffle; the
    file of ranks (of fixed size) is read on the driver and goes along with the tasks.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(raw, pattern)
        for batch in slices(batches, 600):
            coded = list(codec.encode([t or "" for t in batch["text"].to_pylist()]))
            columns = {
                "doc_id": batch["doc_id"],
                "n_tokens": pa.array([n for _, n, _ in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for _, _, b in coded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([list(map(int, ids.split(","))) if ids else [] for ids, _, _ in coded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
