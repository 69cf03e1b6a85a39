"""Each numbered query or its operator against a brute-force version, on the small tables and on awkward rows."""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from offerlens.llm import anchors
from offerlens.llm.byte_bpe import byte_bpe
from offerlens.llm.langid import Setting as LanguageSetting
from offerlens.llm.langid import identify_language, learn
from offerlens.llm.mixing import fit, knapsack, mix_sources
from offerlens.llm.near_dup import near_duplicates
from offerlens.llm.neighbours import Search, Setting, built, lifted, nearest
from offerlens.llm.quality import Network, bucket_ids, index_vectors, labelled_sample, pool, score_quality, word_vectors
from offerlens.llm.quality import Setting as QualitySetting
from offerlens.llm.quality_rules import quality_rules
from offerlens.llm.queries import queries
from offerlens.llm.suffix_dups import remove_repeated_passages
from offerlens.llm.token_counts import count_tokens
from offerlens.llm.window_dups import among, remove_repeated_windows

from . import brute

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts_of(docs) -> list[tuple]:
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def labels_for(spark, docs):
    rows = [(r[0], int(i % 2), 0) for i, r in enumerate(docs.select("doc_id").collect())]
    return spark.createDataFrame([*rows, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def test_quality_covers_every_row(spark, docs):
    found = score_quality(docs, labels_for(spark, docs)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in texts_of(docs))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == is_held_out(r.doc_id) for r in found)


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries()["op1_quality"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good = [r.score for r in found if labels[r.doc_id] == 1]
    bad = [r.score for r in found if labels[r.doc_id] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == labels[r.doc_id] for r in found) / len(found)
    assert auc > 0.9 and right > 0.8, (auc, right, len(found))


def test_quality_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(awkward, none).collect()} == {0.5}


def test_quality_sample_is_bounded(spark):
    """Also where very many texts have the id of one label."""
    s = QualitySetting(train_rows=10)
    docs = spark.createDataFrame([(1 if i < 250 else i, f"some words {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert 0 < len(labelled_sample(docs, labels, "quality", np.ones((s.buckets, 2 * s.width), np.float32), s)) <= 10


def test_quality_against_a_plain_version(spark):
    """Word vectors, pooling and the network's pass in plain loops over a tiny table."""
    s = QualitySetting(buckets=16, width=4, ones=2, hidden=3, epochs=2)
    texts = ["good words here", "Bad!! bad 12", "", None, "good", "words words bad here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    places, signs = index_vectors(s)
    own, context, n = np.zeros((16, 4)), np.zeros((16, 4)), np.zeros(16)
    for b in range(16):
        for p, v in zip(places[b], signs[b]):
            own[b, p] = v
    lists = [bucket_ids(t or "", 16).tolist() for t in texts]
    for ids in lists:
        for k, b in enumerate(ids):
            n[b] += 1
            for other in ids[max(0, k - 1) : k] + ids[k + 1 : k + 2]:
                context[b] += own[other]
    vectors = np.zeros((16, 8))
    for b in range(16):
        if n[b]:
            length = np.sqrt((context[b] ** 2).sum()) or 1
            vectors[b] = np.concatenate([own[b] / np.sqrt(2), context[b] / length]) * 1e-3 / (1e-3 + n[b] / n.sum())
    assert np.allclose(word_vectors(docs, s), vectors, atol=1e-6)
    pooled = np.zeros((6, 11))
    for row, ids in zip(pooled, lists):
        if ids:
            share = np.bincount(ids, minlength=16) / len(ids)
            unit = [v / (np.linalg.norm(v) or 1) for v in vectors]
            row[:8] = sum(vectors[b] for b in ids) / len(ids)
            row[8] = sum(unit[a] @ unit[b] for a, b in zip(ids, ids[1:])) / len(ids)
            row[9:] = np.log((share**2).sum()), np.log(1 + len(ids))
    assert np.allclose(pool(texts, vectors.astype(np.float32)), pooled, atol=1e-4)
    learnt = [i for i in range(6) if not is_held_out(i)]
    net = Network(pool([texts[i] for i in learnt], vectors.astype(np.float32)), np.array([i % 2 for i in learnt], float), s)
    want = {}
    for i, row in enumerate(pooled):
        h = [np.tanh(sum((row[a] - net.mean[a]) / net.scale[a] * net.p[0][a, j] for a in range(11)) + net.p[1][j]) for j in range(3)]
        want[i] = 1 / (1 + np.exp(-(sum(h[j] * net.p[2][j] for j in range(3)) + net.p[3][0]) / net.temperature))
    got = {r.doc_id: r.score for r in score_quality(docs, labels, setting=s).collect()}
    assert got == pytest.approx(want, abs=1e-2)


def test_language_covers_every_row(docs):
    found = identify_language(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in texts_of(docs))
    langs = {r.lang for r in docs.select("lang").collect()}
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.lang_pred in langs | {"und"} for r in found)


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, "hello there", "en"), (2, None, "en"), (3, "12 34 !?", "de"), (4, "", None), (6, "guten tag", "de"), (7, "привет", "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in identify_language(docs).collect()}
    assert [found[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and found[1].lang_pred != "und" and found[7].lang_pred != "und"


def test_language_learns(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries()["op2_langid"](spark, sf).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id] for r in found) / len(found)
    assert right > 0.95, (right, len(found))


def test_language_counts_items_below_the_cut(spark):
    """What is among the first of one language only keeps its count in the others; the floor is for what they lack."""
    docs = spark.createDataFrame([("a b a b a b", "de"), ("b b c c c d d d d", "en"), ("e", "fr")], "text string, lang string")
    langs, rows, table = learn(docs, LanguageSetting(entries=2, longest=1))
    assert langs == ["de", "en", "fr"] and set(rows[0]) == {"a", "b", "c", "d", "e"}
    assert table[rows[0]["b"]] == pytest.approx(np.log([3 / 6, 2 / 9, 0.5 / 1]))
    assert table[rows[1]["b"]] == pytest.approx(np.log([3 / 6, 2 / 9, 0.5 / 1]))
    assert table[rows[0]["d"]] == pytest.approx(np.log([0.5 / 6, 4 / 9, 0.5 / 1]))


def test_language_against_a_plain_version(spark):
    """Word-first backoff in plain loops over a tiny table."""
    texts = [("the cat sat on the mat", "en"), ("die katze sass da", "de"), ("le chat est la", "fr"), ("the dog", "en"), ("der hund", "de"), ("mat katz lala", None), ("Hundert cats, 12!", None), ("xyzzy", None), ("ü", None), ("...", "en")]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counts: dict[tuple[str, int], Counter] = {}
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    for i, (text, lang) in enumerate(texts):
        if lang and not is_held_out(i):
            for w in words(text):
                for n in range(5):
                    counts.setdefault((lang, n), Counter()).update([w] if n == 0 else grams(w, n))
    langs = sorted({x for x, _ in counts})
    share = lambda lang, n, item: np.log((counts[lang, n][item] or 0.5) / sum(counts[lang, n].values()))
    want = {}
    for i, (text, _) in enumerate(texts):
        total, found = dict.fromkeys(langs, 0.0), words(text)
        for w in found:
            for n in (0, 4, 3, 2, 1):
                known = [g for g in ([w] if n == 0 else grams(w, n)) if any(counts[x, n][g] for x in langs)]
                if known:
                    for x in langs:
                        total[x] += sum(share(x, n, g) for g in known) / len(known)
                    break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        want[i] = (best, 1 / sum(np.exp(total[x] - total[best]) for x in langs)) if found else ("und", 0.0)
    for r in identify_language(docs).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1]), r


def test_fit_against_all_subsets():
    """On few documents the chosen total is as near the budget as any subset's."""
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 50, 70_000, 100_000, 130_000]) for _ in range(7)]
        lengths, counts = np.unique(sizes, return_counts=True)
        budget = rng.randrange(1, sum(sizes))
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        taken = fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        best, off = min(abs(x - budget) for x in sums), abs(int(lengths @ taken) - budget)
        assert off <= best + 8192, (sizes, budget, best, off)
    assert np.array([100_000]) @ fit(np.array([100_000]), np.array([1]), 60_000) == 100_000


def test_mixing_spreads_rows_without_an_id(spark):
    """They are told apart by their texts, so what is taken comes near the target as with ids."""
    docs = spark.createDataFrame([(None, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, source string")
    docs = docs.withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string")))
    found = mix_sources(docs, carry=("text",)).collect()
    for source in "ab":
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert {r.text for r in found} == {r.text for r in docs.collect()}


def test_mixing(docs):
    want = Counter((r[0], r[1], len(brute.words(r[2]))) for r in docs.select("doc_id", "source", "text").collect())
    found = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == want
    sizes: Counter = Counter()
    for (_, source, size), n in want.items():
        sizes[source] += size * n
    targets = brute.targets(sizes) if sum(sizes.values()) else {}
    taken: Counter = Counter()
    longest: Counter = Counter()
    members = Counter(r.source for r in found)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    # A few documents cannot hit every target; with many, half a per cent is far off.
    assert all(abs(taken[s] - t) <= (longest[s] / 2 + 1 if members[s] < 20 else t / 200) for s, t in targets.items()), (taken, targets)
    again = mix_sources(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in again) == Counter((r.doc_id, r.source, r.taken) for r in found)


@pytest.mark.parametrize(("lengths", "budget", "total"), [([10**6], 900_000, 10**6), ([10**6], 400_000, 0), ([500_000, 800_000], 800_000, 800_000), ([70_000, 200_000, 900_000], 950_000, 970_000)])
def test_fit_of_few_very_long_documents(lengths, budget, total):
    lengths = np.array(lengths)
    assert lengths @ fit(lengths, np.ones(len(lengths), np.int64), budget) == total


def test_knapsack_against_all_sums():
    """With repeated lengths and common divisors: the nearest sum, the smaller of two."""
    rng = random.Random(2)
    for _ in range(200):
        unit = rng.choice([1, 2, 6])
        lengths = np.array(sorted(rng.sample(range(1, 20), 5))) * unit
        counts, budget = np.array([rng.randrange(4) for _ in lengths]), rng.randrange(1, 150)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {x + k * n for x in sums for k in range(c + 1)}
        taken = knapsack(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert int(lengths @ taken) == min((x for x in sums if x <= 2 * budget), key=lambda x: (abs(x - budget), x))


@pytest.mark.parametrize("n, odd", [(20_000, 0), (6_000, 1)])
def test_fit_of_very_many_lengths(n, odd):
    """What the fit holds goes with the words it fits, not with the number of lengths, also where the budget can't be hit."""
    import tracemalloc

    lengths = np.arange(1, n + 1) * 2
    if odd:  # but for one document too long to use, all are even
        lengths[-1] = 10**9 + 1
    counts = np.ones(n, np.int64)
    budget = int(lengths[:-1].sum()) // 2 | 1
    tracemalloc.start()
    taken = fit(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(int(lengths @ taken) - budget) == 1 and peak < 100 << 20, peak


def test_near_duplicates(docs):
    assert rows_of(near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(brute.near_duplicates(texts_of(docs)), key=repr)


def test_near_duplicates_farther_than_found():
    with pytest.raises(ValueError):
        near_duplicates(None, most=3)


def test_near_duplicates_of_crowded_blocks(spark, monkeypatch):
    """Blocks with more members than are compared in pairs take the other way, with the same links."""
    from offerlens.llm import near_dup

    monkeypatch.setattr(near_dup, "PAIRWISE", 2)
    base = [0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 1, 0xFFFF << 16, (0xFFFF << 16) | 1 << 40, 0xF0F0 << 32]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in base], "fp long")
    roots = {r.node: r.root for r in near_dup.components(near_dup.links(nodes, 2)).collect()}
    groups: dict[int, int] = {i: i for i in range(len(base))}
    for _ in base:
        for i in groups:
            for j in groups:
                if (base[i] ^ base[j]).bit_count() <= 2:
                    groups[i] = groups[j] = min(groups[i], groups[j])
    for i, x in enumerate(base):
        for j, y in enumerate(base):
            same = roots.get(signed(x), signed(x)) == roots.get(signed(y), signed(y))
            assert same == (groups[i] == groups[j])


def vectors(spark):
    rows = [(i, [float((i * j) % 7 - 3), float(i % 5), 0.5]) for i in range(120) for j in (1,)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (320, [1.0, 2.0])]
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, embedding array<float>, id string, score double")


def test_neighbours_are_exact_with_factor_one(spark):
    data = vectors(spark)
    got = nearest(data, setting=Setting(factor=1.0, shard=40, block=3, leaf=8))
    rows = [tuple(r) for r in data.select("vec_id", "embedding").collect()]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(brute.nearest(rows), key=repr)
    assert nearest(data.limit(0)).count() == 0


def test_neighbours_of_ids_with_several_vectors(spark):
    """An id is one item, scored by its best pair of vectors, also where it has more rows than are asked for."""
    rng = random.Random(2)
    rows = [(i % 25 if i < 60 else 7, [float(rng.randrange(-9, 9)) for _ in range(3)]) for i in range(200)] + [(20, [1.0, 2.0, 3.0])] * 2
    best: dict[tuple[int, int], float] = {}
    for i, v in rows:
        for j, w in rows:
            if i % 20 == 0 and i != j and any(v) and any(w):
                best[i, j] = max(best.get((i, j), -np.inf), sum(a * b for a, b in zip(v, w)))
    want = []
    for i in {a for a, _ in best}:
        ranked = sorted((-s, j) for (a, j), s in best.items() if a == i)[:20]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(ranked, 1)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(data, setting=Setting(shard=50, block=2, leaf=8))
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_neighbours_recall(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute.nearest([tuple(r) for r in data.select("vec_id", "embedding").collect()])
    got = {(r.query_id, r.vec_id): r for r in queries()["op5_neighbours"](spark, SF).collect()}
    hits = [(q, i, s) for q, _, i, s in want if (q, i) in got]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(got[q, i].score == s for q, i, s in hits)


@pytest.mark.parametrize("kind", ["unclustered", "clustered", "lengths", "flat"])
def test_neighbours_of_shards_with_many_leaves(kind):
    """With the query's own setting, on shards that split into leaves, as the test tables are too small to do."""
    rng = np.random.default_rng(3)
    n, k = 20_000, 20
    x = rng.normal(size=(n, 3 if kind == "flat" else 64))
    if kind == "clustered":
        x = rng.normal(size=(40, 64))[rng.integers(40, size=n)] + 0.3 * x
    if kind in ("lengths", "flat"):
        x *= rng.lognormal(0, 0.5, size=(n, 1))
    ids, q = np.arange(n), np.arange(0, n, 100)
    top = float(np.linalg.norm(x, axis=1).max())
    order, nodes = built(lifted(x, top), Setting().leaf, Setting().seed)
    run = Search(x[q], ids[q], x[order], ids[order], nodes, top, k, Setting())
    run.run()
    assert n > 4 * Setting().leaf
    want = x[q] @ x.T
    want[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-want, axis=1)[:, :k]
    hits = sum(len(set(a) & set(b)) for a, b in zip(best.tolist(), run.found.tolist()))
    assert hits == best.size, hits / best.size


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in texts_of(docs)]
    assert rows_of(count_tokens(docs, WORD_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_repeated_windows(docs):
    assert rows_of(remove_repeated_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_windows(texts_of(docs)), key=repr)


def test_windows_are_told_by_both_hashes():
    u = lambda *x: np.array(x, np.uint64)
    assert among(u(1, 1, 2, 3, 5, 5), u(1, 2, 1, 1, 8, 9), u(5, 1, 2, 5), u(9, 1, 7, 7)).tolist() == [True, False, False, False, False, True]
    assert among(u(1), u(1), u(), u()).tolist() == [False]


@pytest.mark.parametrize("half", [None, 3])
def test_rows_of_one_id_spread_over_chunks(spark, half):
    docs = spark.createDataFrame([(half if i % 2 else i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    dealt, n = anchors.chunked(docs, 16 * anchors.CHUNK_BYTES)
    sizes = [r["count"] for r in dealt.groupBy("chunk").count().collect()]
    assert n == 16 and max(sizes) < 2 * 4000 / 16


def test_a_single_machine_only_may_have_its_own_folder(spark, monkeypatch):
    from offerlens.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(ValueError):
        common.shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_folder(Session)


def test_quality_rules(docs):
    got = rows_of(quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == sorted(brute.quality_rules(texts_of(docs)), key=repr)


def test_byte_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in texts_of(docs):
        ids = t.encode_ordinary(x or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((x or "").encode())))
    assert rows_of(byte_bpe(docs, BPE, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_repeated_passages(docs):
    got = rows_of(remove_repeated_passages(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeated_passages(texts_of(docs)), key=repr)


def test_repeated_passages_of_hot_anchors(spark, monkeypatch):
    """Anchors that very many chunks hold go another way, with the same result."""
    from offerlens.llm import anchors, suffix_dups

    monkeypatch.setattr(suffix_dups, "OFTEN", 1)
    monkeypatch.setattr(anchors, "CHUNK_BYTES", 4000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    got = rows_of(remove_repeated_passages(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeated_passages(texts_of(docs)), key=repr)


def test_repeated_passages_of_repeated_rows(spark, monkeypatch):
    """Rows of one id, or of none, with a passage at one place lose it alike when an earlier id in another chunk has it."""
    from offerlens.llm import anchors

    monkeypatch.setattr(anchors, "CHUNK_BYTES", 4000)
    rng = random.Random(7)
    prose = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    rows = []
    for i in range(40):
        passage, head = prose(30), prose(3)
        rows += [(i, prose(40) + " " + passage)]
        rows += [(100 + i, f"{head} {passage} {x}") for x in ("tail", "tail", prose(5))] + [(100 + i, passage)]
        rows += [(None, passage + prose(4))] * 2 + [(None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = rows_of(remove_repeated_passages(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeated_passages(rows), key=repr)


def blocks_of_code_points(size: int = 2048):
    """Code points between letters, before a digit and after a mark, in texts of so many: all but most of the ideographs, Hangul
    syllables, private ones and planes without any characters, of which there is one in 97."""
    alike = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xF8FF), (0x20000, 0x2A6D0), (0x2A700, 0x2B730), (0x2B740, 0x2B810), (0x2B820, 0x2CEA0), (0x2CEB0, 0x32000), (0x34000, 0x3CFFF), (0x40000, 0x10FFFF))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c % 97 == 0 or not any(a <= c <= b for a, b in alike))]
    for i in range(0, len(every), size):
        yield " ".join(f"a{c}b {c}1 ẹ{c}́" for c in every[i : i + size])


def test_token_counts_of_every_code_point():
    from tokenizers import Tokenizer

    from offerlens.llm.token_counts import Counter as Tokens

    t, mine = Tokenizer.from_file(WORD_BPE), Tokens(open(WORD_BPE, "rb").read())
    for text in blocks_of_code_points():
        assert mine.text(text) == len(t.encode(text, add_special_tokens=False).ids), text[:4]


def test_byte_bpe_of_every_code_point():
    import tiktoken

    from offerlens.llm.byte_bpe import Codec, parse_ranks

    raw = open(BPE, "rb").read()
    t = tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(raw), special_tokens={})
    codec = Codec(raw, public_tokenizers.PATTERN)
    for text in blocks_of_code_points(16384):
        ((ids, n, _),) = codec.encode([text])
        assert ids == ",".join(map(str, t.encode_ordinary(text))) and n == ids.count(",") + 1, text[:4]


def test_tokenizers_agree_on_random_strings():
    """Rare letters, marks and numbers next to each other, in all orders."""
    import tiktoken
    from tokenizers import Tokenizer

    from offerlens.llm import token_counts
    from offerlens.llm.byte_bpe import Codec, parse_ranks

    rng = random.Random(11)
    rare = [c for c in map(chr, range(0x300, 0x20000)) if re.match(f"[{token_counts.NEWER_LETTERS}{token_counts.NEWER_NUMBERS}{token_counts.NEWER_MARKS}]", c)] + list("ΣσỊ̇́ͅaB1 '") + list(map(chr, token_counts.SMALL))
    texts = ["".join(rng.choice(rare) if rng.random() < 0.7 else chr(rng.choice((rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(rng.randrange(1, 30))) for _ in range(6000)]
    t, mine = Tokenizer.from_file(WORD_BPE), token_counts.Counter(open(WORD_BPE, "rb").read())
    assert [x for x in texts if mine.text(x) != len(t.encode(x, add_special_tokens=False).ids)] == []
    raw = open(BPE, "rb").read()
    other = tiktoken.Encoding("rare", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(raw), special_tokens={})
    assert [x for x, (ids, _, _) in zip(texts, Codec(raw, public_tokenizers.PATTERN).encode(texts)) if ids != ",".join(map(str, other.encode_ordinary(x)))] == []
