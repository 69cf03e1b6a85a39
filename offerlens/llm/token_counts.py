"""Token counts: byte-pair merging with a heap and a linked list.

The text is split as the tokenizer file says; in each piece the adjacent pair of lowest rank (leftmost of
equals) is merged again and again. Only the number of tokens is needed, which is the number of symbols
minus the number of merges, so no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick, slices

#: White space as Unicode defines it; Python's own \s has four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Ranges of characters that the regex module holds for letters or for numbers and the tokenizer libraries, whose
# tables end with Unicode 16, do not; and marks that the libraries' composition, whose tables are older, takes for characters alone.
NEWER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    "\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = (
    "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
)
NEWER_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac"
    "\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U00011938"
    "\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42"
    "\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
# Capital letters that the libraries know and str.lower() does not, as (first, last, distance to the small letter).
NEWER_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
#: What no character before U+0558 can be.
NEWER = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]")
FAR = re.compile("[\u0558-\U0010ffff]")
SPLIT_MARK = re.compile(f"([{NEWER_MARKS}])")
SMALL = {c: c + step for first, last, step in NEWER_CAPITALS for c in range(first, last + 1)}
CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")
#: Counts kept in a worker process: of stretches, and of pieces.
CACHE_LIMIT = 500_000


class Cutter:
    """Finds the pieces of a text by a pattern as the libraries do. Few texts hold characters that the module takes otherwise;
    these go by a pattern that leaves such characters out of its classes."""

    def __init__(self, pattern: str):
        self.usual = regex.compile(pattern).findall
        for name, newer in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)):
            pattern = pattern.replace(f"\\p{{{name}}}", f"[\\p{{{name}}}--[{newer}]]")
        self.exact = regex.compile(pattern, regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not FAR.search(text) or not NEWER.search(text):
            return self.usual(text)
        return self.exact(text)


def folded(text: str) -> str:
    """Composed and in small letters. A mark that the libraries do not know composes and moves with none."""
    parts = SPLIT_MARK.split(text) if FAR.search(text) else [text]
    text = "".join(unicodedata.normalize("NFC", x) for x in parts).replace("Σ", "σ").lower()
    return text.translate(SMALL) if CAPITAL.search(text) else text


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merges_done(symbols: list, ranks: dict[tuple, int]) -> int:
    """How many merges the symbols of one piece undergo; what is merged into the one before it becomes None."""
    n = len(symbols)
    if n < 2:
        return 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i] = a + b
        symbols[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        done += 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get((symbols[x], symbols[y]))) is not None:
                heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
    return done


def keep(known: dict[str, int], key: str, n: int) -> None:
    if len(known) >= CACHE_LIMIT:
        known.clear()
    if len(key) < 100:
        known[key] = n


class Counter:
    """Counts tokens by a tokenizer file with word ends; counts of pieces seen before are kept, up to a limit."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.ranks = {tuple(p): i for i, p in enumerate(map(lambda m: m.split(" ") if isinstance(m, str) else m, model["merges"]))}
        self.end = model["end_of_word_suffix"] or ""
        self.pieces = Cutter(steps[0]["pattern"]["Regex"].replace("\\s", SPACE))
        self.controls = regex.compile("[\x1c-\x1f]").search
        self.blank = regex.compile(f"[{SPACE}]+")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.alphabet = byte_alphabet()
        self.known: dict[str, int] = {}
        self.known_pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        if (n := self.known_pieces.get(piece)) is not None:
            return n
        symbols = [self.alphabet[b] for b in piece.encode()]
        symbols[-1] += self.end
        n = len(symbols)
        n -= merges_done(symbols, self.ranks)
        keep(self.known_pieces, piece, n)
        return n

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch without white space; each string of a special token inside it is one token."""
        parts = self.special.split(chunk) if "<|" in chunk else [chunk]
        n = len(parts) - 1
        for part in parts:
            n += sum(map(self.piece, self.pieces(part.lower() if part.isascii() else folded(part))))
        keep(self.known, chunk, n)
        return n

    def text(self, text: str) -> int:
        """Tokens of a text. No piece crosses white space, so stretches between are counted one by one."""
        total, known = 0, self.known
        for chunk in text.split() if text.isprintable() or not self.controls(text) else self.blank.split(text):
            n = known.get(chunk)
            total += self.chunk(chunk) if n is None else n
        return total


_counters: dict[int, Counter] = {}


def counter_of(raw: bytes) -> Counter:
    """One counter a worker process, so that what it knows serves later tasks too."""
    key = hash(raw)
    if key not in _counters:
        _counters[key] = Counter(raw)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; null ids stay
    null; an empty table gives no rows; other columns are not read. One pass, no shuffle; the tokenizer
    file (of fixed size) is read on the driver and goes along with the tasks.
    """
    with open(tokenizer_path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(raw)
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            counts = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
