"""Fill-in-the-middle transformation by displacement scatter.

The texts of a batch are one stretch of bytes. A scan finds the line ends and so the two cuts of each text;
with them it is known how far each of the three parts moves, and the differences between those moves stand
in an array at the places where parts begin. Its cumulative sum is the shift of every byte, and one numpy scatter
puts all bytes of all texts in place between the marks. Restoring is the inverse: marks are found in the
output, the same kind of array gives the place in the output of every byte of the text, and one gather reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Begin the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = range(3)
FORMS = np.array(["plain", "psm", "spm"])
#: Bytes of texts that are one stretch (a longer text is one alone), and bytes shifted at once.
STRETCH, BLOCK = 4 << 20, 1 << 20


def checked(marks: tuple[str, str, str]) -> list[np.ndarray]:
    """The bytes of the marks. None may be part of another or begin with another's end, so that text next to a mark never makes one."""
    raw = [m.encode() for m in marks]
    for i, a in enumerate(raw):
        for j, b in enumerate(raw):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b) if i == j else len(b) + 1)):
                raise ValueError(f"marks {marks[i]!r} and {marks[j]!r} can overlap")
    return [np.frombuffer(b, np.uint8) for b in raw]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and the place where each string begins, with the end; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def strings(data: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def stretches(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to so many bytes, or of one row."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def places(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where a mark begins."""
    found = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        found = found[data[found + k] == mark[k]]
    return found


def owner(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, at, "right") - 1


def shifted(begin: np.ndarray, shift: np.ndarray, total: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each block of bytes the place that every byte moves to; from each place in begin (ascending) on the shift is the one given."""
    difference, carry = np.diff(shift, prepend=0), 0
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        low, high = np.searchsorted(begin, (a, b))
        by_byte = np.zeros(b - a, np.int64)
        np.add.at(by_byte, begin[low:high] - a, difference[low:high])
        by_byte[0] += carry
        np.cumsum(by_byte, out=by_byte)
        carry = int(by_byte[-1])
        by_byte += np.arange(a, b)
        yield a, b, by_byte


def formed(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int, spm: int, marks: list[np.ndarray]) -> dict:
    """What becomes of the texts: n, form, prefix_chars, middle_chars, and the output's bytes and offsets."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    start, end = offsets[:-1], offsets[1:]
    line_ends = np.flatnonzero(data == ord("\n")) + 1
    first, last = np.searchsorted(line_ends, start, "right"), np.searchsorted(line_ends, end, "right")
    n = last - first
    full = np.flatnonzero(end > start)
    n[full] += data[end[full] - 1] != ord("\n")
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    padded = np.append(line_ends, len(data))
    cut = lambda u: np.where(u == 0, start, np.where(u >= n, end, padded[np.minimum(first + u - 1, len(line_ends))]))
    one, two = cut(units[:, 0]), cut(units[:, 1])
    form = np.where(h[:, 3] % 100 < spm, SPM, PSM)
    form[(end == start) | (h[:, 2] % 100 >= rate)] = PLAIN
    for mark in marks:
        at = places(data, mark)
        of = owner(start, at)
        form[of[at + len(mark) <= end[of]]] = PLAIN
    # Code points begin at bytes that continue none.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    plain = form == PLAIN
    sizes = [len(m) for m in marks]
    out_offsets = np.concatenate([[0], np.cumsum(end - start + np.where(plain, 0, sum(sizes)))])
    base = out_offsets[:-1]
    p, s, m = marks
    suffix, prefix = end - two, one - start
    # Where each part begins in the output; the parts stand in the text as prefix, middle, suffix.
    to_prefix = base + np.choose(form, (0 * n, 0 * n + len(p), len(s) + suffix + len(p)))
    to_suffix = base + np.choose(form, (two - start, len(p) + prefix + len(s), 0 * n + len(s)))
    to_middle = np.where(plain, base + prefix, base + sum(sizes) + prefix + suffix)
    out = np.empty(int(out_offsets[-1]), np.uint8)
    begin = np.stack([start, one, two], axis=1).ravel()
    shift = (np.stack([to_prefix, to_middle, to_suffix], axis=1) - np.stack([start, one, two], axis=1)).ravel()
    for a, b, place in shifted(begin, shift, len(data)):
        out[place] = data[a:b]
    for mark, part in zip(marks, (to_prefix, to_suffix, to_middle)):
        for k, byte in enumerate(mark):
            out[part[~plain] - len(mark) + k] = byte
    return {"n": n, "form": form, "prefix_chars": points[one] - points[start], "middle_chars": points[two] - points[one], "out": out, "offsets": out_offsets}


def unformed(out: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes and offsets, from the output and its form alone, and which rows lack a mark (their text is empty)."""
    out, offsets = out[offsets[0] : offsets[-1]], offsets - offsets[0]
    start, end = offsets[:-1], offsets[1:]
    at = np.full((3, len(form)), -1)
    for k, mark in enumerate(marks):
        found = places(out, mark)
        of = owner(start, found)
        whole = found + len(mark) <= end[of]
        at[k, of[whole][::-1]] = found[whole][::-1]  # the first of each row stands
    plain = form == PLAIN
    sizes = [len(m) for m in marks]
    p, s, m = at
    ordered = np.where(form == SPM, (start == s) & (s < p) & (p < m), (start == p) & (p < s) & (s < m))
    broken = ~plain & ~((at >= 0).all(axis=0) & ordered)
    middle = end - m - sizes[2]
    prefix = np.where(form == SPM, m, s) - p - sizes[0]
    length = np.where(plain, end - start, end - start - sum(sizes))
    length[broken] = 0
    texts = np.concatenate([[0], np.cumsum(length)])
    base = texts[:-1]
    prefix, middle = np.where(plain | broken, 0, prefix), np.where(plain | broken, 0, middle)
    begin = np.stack([base, base + prefix, base + prefix + middle], axis=1)
    source = np.stack([p + sizes[0], m + sizes[2], np.where(plain, start, s + sizes[1])], axis=1)
    text = np.empty(int(texts[-1]), np.uint8)
    for a, b, place in shifted(begin.ravel(), (source - begin).ravel(), len(text)):
        text[a:b] = out[place]
    return text, texts, broken


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output of every row.

    rate is the share of texts, in hundredths, that are transformed, spm the share of these that begin with the
    suffix. Cuts and form depend on seed and doc_id only (a null id counts as ''), so repeated rows give repeated
    results. Null and empty texts, and those that hold a mark, stay as they are (null becomes empty), with null for
    both lengths. A very long text is one stretch and takes about ten times its size. An empty table gives no
    rows; other columns are not read. One pass, no shuffle.
    """
    raw = checked(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch["text"])
            h = np.stack([batch[f"h{k}"].to_numpy() for k in range(1, 5)], axis=1)
            for a, b in stretches(offsets, STRETCH):
                f = formed(data, offsets[a : b + 1], h[a:b], rate, spm, raw)
                plain = f["form"] == PLAIN
                count = lambda x: pa.array(x, pa.int64(), mask=plain)  # noqa: E731,B023
                columns = [batch["doc_id"].slice(a, b - a), pa.array(f["n"], pa.int64()), pa.array(FORMS[f["form"]], pa.string()), count(f["prefix_chars"]), count(f["middle_chars"]), strings(f["out"], f["offsets"])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_middle(rows: DataFrame, marks: tuple[str, str, str] = MARKS, form_col: str = "form", output_col: str = "output", restored_col: str = "restored") -> DataFrame:
    """All columns of the rows and the text that each output and its form stand for.

    Null where an output lacks the marks that its form asks for, or is null itself; any form but psm and spm is plain.
    """
    raw = checked(marks)
    schema = pick(rows, **{c: c for c in rows.columns}).schema.add(restored_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch[output_col])
            kinds = np.array([PSM if f == "psm" else SPM if f == "spm" else PLAIN for f in batch[form_col].to_pylist()], np.int64)
            absent = batch[output_col].is_null().to_numpy(zero_copy_only=False)
            for a, b in stretches(offsets, STRETCH):
                text, texts, broken = unformed(data, offsets[a : b + 1], kinds[a:b], raw)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, strings(text, texts, broken | absent[a:b])], names=[*part.schema.names, restored_col])

    return rows.mapInArrow(run, schema)
