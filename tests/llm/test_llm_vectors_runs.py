"""Periodic runs, top-k search and clustering against brute force, and on nulls, ties, repeats, odd values and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lectern.llm import centroid_clustering, periodic_runs, topk_search
from lectern.llm import queries as llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(words, doc_id):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        seqs = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
            seqs.append(planted([rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)], rng.randrange(500)))
        least, times = rng.choice([(6, 4), (6, 3), (1, 4), (9, 5)])
        symbols = np.array([x for s in seqs for x in s], np.int64)
        found = [tuple(map(int, r)) for r in periodic_runs.runs(symbols, np.array(list(map(len, seqs)), np.int64), least, times)] if len(symbols) else []
        assert found == [(i, *r) for i, s in enumerate(seqs) for r in brute_runs(s, least, times)]


def test_suffix_array_common_prefixes_and_minima():
    rng = np.random.default_rng(1)
    sizes = np.array([300, 1, 40, 500])
    text = np.concatenate([rng.integers(0, 2, n) + 10 * i for i, n in enumerate(sizes)])
    starts = np.cumsum(sizes) - sizes
    order, rank = periodic_runs.suffix_array(text, np.repeat(starts + sizes, sizes))
    ends = np.repeat(starts + sizes, sizes)
    suffixes = [text[i : ends[i]].tolist() for i in range(len(text))]
    assert [suffixes[i] for i in order] == sorted(suffixes) and (order[rank] == np.arange(len(text))).all()
    shared = periodic_runs.common_prefixes(text, starts, order)
    for k in range(1, len(text)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        n = next((t for t, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n
    least = periodic_runs.RangeMinimum(shared)
    lo = rng.integers(0, len(text), 3000)
    hi = np.minimum(lo + rng.integers(0, 400, 3000), len(text) - 1)
    assert least(lo, hi).tolist() == [shared[a : b + 1].min() for a, b in zip(lo, hi)]


def test_long_repeats_stay_linear():
    n = 200_000
    assert periodic_runs.runs(np.zeros(n, np.int64), np.array([n])).tolist() == [[0, 0, n, 1]]
    assert periodic_runs.runs(np.arange(n) % 700, np.array([n])).tolist() == [[0, 0, n, 700]]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_of_runs_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = ["a", "b", "Über", "c d", "the", "x" * 40, *(f"w{i}" for i in range(80))]
    rows = []
    for i in range(120):
        n = rng.choice([0, 1, 4, 12, 50, 200])
        rows.append((i * 7, "".join(rng.choice(words[: rng.choice([1, 2, 80])]) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))))
    rows += [(None, "a b " * 9), (None, None), (9000, None), (9001, ""), (9002, " \n "), (9003, "a " * 30_000), (9004, "x y z " * 20_000 + "q")]
    rows += [rows[3], rows[3], (11, "A a " * 6), (12, "one two " * 5 + "one one one one one one")]
    # further columns have names that the work uses itself
    table = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, text string, id int, runs string, __w int")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = llm.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for i, t in rows:
        w = planted(WORD.findall(t or ""), i)
        found = brute_runs(w) if len(set(w)) > 3 or len(w) < 1000 else None
        if found is None:  # one long run of the whole text
            q = len(set(w))
            found = [(0, len(w), q)] if all(a == b for a, b in zip(w, w[q:])) else brute_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected.append((i, len(found), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(collapsed(w, found))))
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert sum(r.n_runs > 0 for r in out) > 10
    assert llm.op11_periodic_runs(spark, str(tmp_path)).schema.simpleString().count("bigint") == 6


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="times"):
        periodic_runs.runs(np.zeros(3, np.int64), np.array([3]), times=2)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_search(rows, k=5):
    most = topk_search.MOST
    kept = [(j, i, [math.floor(256 * x) for x in v]) for j, (i, v) in enumerate(rows) if finite(v)]
    out = []
    for j, i, v in kept:
        if i is None or i % 50:
            continue
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), m is None, m or 0) for jj, m, w in kept if jj != j and len(w) == len(v))
        out += [(i, r + 1, None if null else m, -s) for r, (s, null, m) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(50, rows[3][1]), (100, rows[100][1]), (None, rows[5][1]), (None, None), (600, None), (650, [0.1, None] * 4), (700, [float("nan")] + [0.0] * 7)]
    rows += [(750, [float("inf")] * 8), (800, []), (801, []), (850, [1.0]), (-50, [0.5] * 8), (-100, [1e30] * 8), (900, [1e6] * 8), (901, [-1e6] * 8), (7, [3e7] * 8)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # ties for the k-th place in every task
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_search_equals_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors], "vec_id long, embedding array<double>, row int, score int").repartition(5)
    found = topk_search.search(df)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_search(vectors)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_search_with_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk_search.search(make([])).count() == 0
    assert topk_search.search(make([(50, [1.0])])).count() == 0
    assert topk_search.search(make([(50, None), (51, [1.0])])).count() == 0
    rows = [(50, [1.0]), (51, [0.5]), (52, [-1.0])]
    assert [tuple(r) for r in topk_search.search(make(rows)).orderBy("rank").collect()] == [(50, 1, 51, 32768), (50, 2, 52, -65536)]


def brute_lloyd(rows, k=8, rounds=10):
    most = centroid_clustering.MOST
    kept = [(i, tuple(max(-most, min(most, math.floor(1024 * x))) for x in v)) for i, v in rows if finite(v) and len(v) == 64]
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(f"3:{r[0]}") if r[0] is not None else "", r[1]))[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [near(v)[0] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), x in zip(kept, at) if x == j]:
                c[j] = tuple(sum(z) // len(mine) for z in zip(*mine))
    at, per = [near(v) for _, v in kept], {}
    for j, d in at:
        per[j] = per.get(j, 0) + d
    top = 2**63 - 1
    return sorted(((i, j, d, min(top, per[j]), min(top, sum(per.values())), digest(",".join(map(str, c[j])))) for (i, _), (j, d) in zip(kept, at)), key=repr)


def test_clustering_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5 / 3, 0.2) for _ in range(64)]) for i in range(150)]
    rows += [(None, rows[3][1]), (None, [0.1] * 64), (5, None), (6, [None] * 64), (7, [0.1] * 63), (8, [float("nan")] * 64), (9, [])]
    rows += [(10, rows[4][1]), (10, rows[4][1]), (10, [1e30] * 64)]
    few = [(77, rows[0][1]), (77, rows[1][1]), (77, [-1.0] * 64)] * 5
    for some in (rows, rows[:3], rows[:1] * 9, [r for r in rows if r[0] is None], few):
        df = spark.createDataFrame([(*r, 1, "x") for r in some], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
        found = centroid_clustering.inertia(*centroid_clustering.cluster(df))
        assert sorted(map(tuple, found.collect()), key=repr) == brute_lloyd(some)
    assert centroid_clustering.inertia(*centroid_clustering.cluster(df.limit(0))).count() == 0


def test_the_language_sample_is_bounded_whatever_the_ids_are(spark):
    from pyspark.sql import functions as F

    from lectern.llm import language_id

    # one id, or none, for all rows; one text in a third of them
    rows = [(7 if i % 2 else None, "the same words again" if i % 3 == 0 else f"some text number {i}", "en") for i in range(1200)]
    rows += [(7, f"ein anderer Text mit der Nummer {i}", "de") for i in range(5)] + [(7, None, "en"), (7, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language_id.training_sample(docs, "doc_id", "text", "lang", F.lit(True), docs_per_lang=40).toPandas()
    assert sample["lang"].value_counts().to_dict() == {"en": 40, "de": 5}
    assert sample["text"].nunique() >= 44
    model = language_id.train(docs, docs_per_lang=40)
    assert {r.lang_pred for r in language_id.identify(docs.where("lang = 'de'"), model).collect()} == {"de"}
