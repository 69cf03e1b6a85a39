"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

Every word of the corpus falls into one of a fixed number of hash buckets. A bucket has a sparse random index
vector; its context vector is the sum of the index vectors of the words around it, over all texts. Counting
runs in Spark: each task adds up its own share, and a grouped sum over buckets merges the shares. A document
is the weighted mean of its words' vectors. The network has two layers and learns from labelled documents; a
temperature fitted on rows that it did not learn from calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick, slices

#: Runs of letters, of digits and of other visible characters are the words here.
TOKENS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+").findall
CACHE_LIMIT = 500_000


@dataclass(frozen=True)
class Setting:
    """Sizes of the model; none depends on the data.

    train_rows bounds the labelled sample: of more labelled documents, those of the smallest hash are taken.
    """

    buckets: int = 8192
    width: int = 64
    ones: int = 4
    hidden: int = 32
    train_rows: int = 20_000
    epochs: int = 60
    seed: int = 7


def index_vectors(s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each bucket's index vector."""
    rng = np.random.default_rng(s.seed)
    places = np.argsort(rng.random((s.buckets, s.width)), axis=1)[:, : s.ones]
    return places, rng.choice(np.array([-1, 1]), (s.buckets, s.ones))


_buckets: dict[str, int] = {}


def bucket_ids(text: str, n: int) -> np.ndarray:
    """The bucket of each word of a text; case counts, as shouting says something about quality."""
    if len(_buckets) > CACHE_LIMIT:
        _buckets.clear()
    words = TOKENS(text)
    for w in {*words}.difference(_buckets):
        _buckets[w] = xxhash.xxh32_intdigest(w.encode())
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)) % n


def context_sums(docs: DataFrame, s: Setting) -> DataFrame:
    """bucket, n (its words in all texts), c0.. (sums of the index vectors of the words next to them)."""
    columns = [f"c{i}" for i in range(s.width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(s)
        sums, counts = np.zeros(s.buckets * s.width), np.zeros(s.buckets, np.int64)
        for batch in slices(batches):
            found = [x for t in batch["text"].to_pylist() if t and len(x := bucket_ids(t, s.buckets))]
            if not found:
                continue
            ids = np.concatenate(found)
            last = np.zeros(len(ids), bool)
            last[np.cumsum([len(x) for x in found]) - 1] = True
            counts += np.bincount(ids, minlength=s.buckets)
            inner = np.flatnonzero(~last)
            left, right = ids[inner], ids[inner + 1]
            for k in range(s.ones):
                for a, b in ((left, right), (right, left)):
                    sums += np.bincount(a * s.width + places[b, k], weights=signs[b, k], minlength=len(sums))
        seen = np.flatnonzero(counts)
        out = pd.DataFrame(sums.reshape(s.buckets, s.width)[seen].astype(np.int64), columns=columns)
        out.insert(0, "n", counts[seen])
        out.insert(0, "bucket", seen)
        yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    shares = docs.select("text").mapInArrow(run, "bucket long, n long, " + ", ".join(f"{c} long" for c in columns))
    return shares.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ["n", *columns]))


def word_vectors(docs: DataFrame, s: Setting) -> np.ndarray:
    """A vector for each bucket (rows of fixed number and width): its own index vector and its context, each of
    length one, weighted down for frequent words. Buckets without a word stay zero."""
    found = context_sums(docs, s).toPandas()
    places, signs = index_vectors(s)
    own = np.zeros((s.buckets, s.width))
    np.put_along_axis(own, places, signs, axis=1)
    context, n = np.zeros_like(own), np.zeros(s.buckets)
    rows = found["bucket"].to_numpy()
    context[rows] = found[[f"c{i}" for i in range(s.width)]].to_numpy()
    n[rows] = found["n"].to_numpy()
    length = np.linalg.norm(context, axis=1, keepdims=True)
    context /= np.where(length > 0, length, 1)
    weight = 1e-3 / (1e-3 + n / max(n.sum(), 1))
    return (np.hstack([own / np.sqrt(s.ones), context]) * np.where(n > 0, weight, 0)[:, None]).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, the mean likeness of a word's vector to the next one's
    (texts that stammer come out high), the logarithm of the summed squares of word shares, and that of the length."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    out = np.zeros((len(texts), vectors.shape[1] + 3), np.float32)
    for i, t in enumerate(texts):
        if t and len(ids := bucket_ids(t, len(vectors))):
            seen, n = np.unique(ids, return_counts=True)
            share = n / len(ids)
            out[i, :-3] = share @ vectors[seen]
            out[i, -3] = np.einsum("ij,ij->", unit[ids[1:]], unit[ids[:-1]]) / len(ids)
            out[i, -2:] = np.log(share @ share), np.log1p(len(ids))
    return out


class Network:
    """One hidden layer of tanh units, an output of one logit, trained with Adam on shuffled small batches."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Setting):
        rng = np.random.default_rng(s.seed)
        order = rng.permutation(len(y))
        cut = len(y) - len(y) // 5  # the last fifth is for the temperature
        self.mean, self.scale = x[order[:cut]].mean(0), x[order[:cut]].std(0) + 1e-6
        x = (x - self.mean) / self.scale
        p = self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, s.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(s.epochs):
            for rows in np.array_split(rng.permutation(order[:cut]), max(1, cut // 128)):
                h = np.tanh(x[rows] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
                back = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((x[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        rest = order[cut:] if len(y) >= 5 else order
        logit = np.tanh(x[rest] @ p[0] + p[1]) @ p[2] + p[3]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, logit / t) - y[rest] * logit / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return 1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]) / self.temperature))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, vectors: np.ndarray, s: Setting) -> pd.DataFrame:
    """Pooled vectors and labels of the training rows.

    Label rows are thinned to s.train_rows before they meet the texts, which bounds what is broadcast; as several
    texts may have one id, the pooled rows are thinned once more, which bounds what comes to the driver.
    """
    chosen = pick(labels, label_id="doc_id", label=label_col).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(s.train_rows)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["label_id"]).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pool(batch["text"].to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    pooled = rows.mapInArrow(run, "doc_id long, label int, x binary")
    return pooled.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "label", "x").limit(s.train_rows).toPandas().sort_values(["doc_id", "label", "x"])


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on) of every row.

    Null and empty texts get the score of a pooled vector of zeros. Rows with a null id are scored and count
    as held out or not by an empty id. Label rows with a null id or another value than 0 or 1 are ignored;
    repeated label rows count repeatedly. With labels of one kind only, or none, all scores are that kind's
    share (0.5 without any). An empty table gives no rows; other columns are not read.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    vectors = word_vectors(docs, setting)
    sample = labelled_sample(docs, labels.withColumn(label_col, F.col(label_col).cast("int")), label_col, vectors, setting)
    y = sample["label"].to_numpy(float)
    network = Network(np.array([np.frombuffer(b, np.float32) for b in sample["x"]]), y, setting) if len({*y}) == 2 else None
    share = float(y.mean()) if len(y) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            score = network.score(pool(texts, vectors)) if network else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
