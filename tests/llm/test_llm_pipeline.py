"""The pipeline's stages on a small table, each against a brute-force version of its own input."""

import collections
import random

import pytest

import corpus_pipeline
from lectern.llm import near_copies, simhash
from lectern.llm.common import materialize


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, 0), (90002, "12 34", "en", "src1", 5), (90003, "", "en", None, 0), (None, docs.first().text + " more", "en", "src2", 9)], docs.schema)
    out = [docs.union(odd)]
    for _, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], "/root/testdata/sf0.001")))
    return [x.collect() for x in out], out


def test_stages(steps):
    (docs, known, exact, near, mixed, packed), frames = steps
    assert [f.columns for f in frames[1:5]] == [frames[0].columns] * 4
    assert {r.doc_id for r in docs} - {r.doc_id for r in known} == {90001, 90002, 90003}
    best = {}
    for r in known:
        k = r.text.encode().lower()
        best[k] = max(best.get(k, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(best.values()) == sorted(-1 if r.doc_id is None else r.doc_id for r in exact)
    assert sorted((r.doc_id for r in near), key=lambda x: (x is None, x or 0)) == near_kept([(r.doc_id, r.text) for r in exact])
    assert set(collections.Counter(r.doc_id for r in mixed).values()) <= {1, 2}
    tokens = collections.Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert set(tokens) == {r.doc_id for r in mixed}


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0 and (i == 4 or out.columns == docs.columns)


def test_stages_keep_extra_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    wide = docs.selectExpr("*", "doc_id as id", "text as fp", "1 as kept", "2 as size", "'x' as recipe", "'y' as h")
    for _, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, wide, "/root/testdata/sf0.001")
        assert out.columns == wide.columns and out.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, wide, "").count() >= 30


def shingle_set(text, words=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_kept(rows):
    """Brute force: of each component of rows (id, text) whose sets are similar, the smallest id, null last."""
    sets, kept, seen = [shingle_set(t) for _, t in rows], [], set()
    for i in range(len(rows)):
        todo, part = [] if i in seen else [i], []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                part.append(rows[x][0])
                todo += [j for j in range(len(rows)) if similar(sets[x], sets[j])]
        if part:
            kept.append(min(part, key=lambda x: (x is None, x or 0)))
    return sorted(kept, key=lambda x: (x is None, x or 0))


def chained_texts(rng):
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + ["", "  ", "one two", "One  two", "one two three", "boiler plate of all the pages here"]
    for b in base[:8]:
        for n in range(1, 9):  # from one changed word to beyond the limit, in chains as well
            c = list(b)
            for _ in range(n):
                c[rng.randrange(len(c))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(c))
            b = c if n % 3 == 0 else b
    passage = [f"p{i}" for i in range(100)]
    for i in range(30):  # a passage that many share is no link, nor is it where it is most of a text
        texts.append(" ".join(passage[: 30 + 2 * i] + [f"own{i}x{k}" for k in range(25)]))
    return texts


@pytest.mark.parametrize("hot", [500, 10**9])
def test_near_copies_equal_brute_force_jaccard(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)  # at the larger number every repeated shingle is dealt over many tasks
    rng = random.Random(3)
    rows = list(enumerate(chained_texts(rng)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == near_kept(rows)
    sets = [(shingle_set(t), simhash.fingerprint(t.encode())) for _, t in rows]
    far = [1 for i, (a, f) in enumerate(sets) for b, g in sets[:i] if similar(a, b) and (f ^ g).bit_count() > 4]
    assert far  # pairs that four bits of a four-word fingerprint miss


def test_sets_of_near_copies_move_in_passes(spark, monkeypatch):
    rows = list(enumerate(chained_texts(random.Random(8))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    moved, write = [], near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df: moved.append(df.columns) or write(df))
    kept = lambda: (moved.clear(), sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, words=5, similarity=(4, 5)).collect()))[1]
    monkeypatch.setattr(near_copies, "AT_ONCE", 10**6)
    once, few = kept(), moved.count(["u", "v"])
    monkeypatch.setattr(near_copies, "AT_ONCE", 2)  # two bytes a shingle of the texts; a set has eight for each of its own
    assert kept() == once == near_kept(rows) and moved.count(["u", "v"]) > few


def test_near_dedup_keeps_unrelated_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, b), (5, a + " tail"), (9, c), (None, c + " end"), (None, None), (7, " "), (9, c)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, id int")
    kept = simhash.drop_near_duplicates(docs, words=5, similarity=(4, 5))
    assert kept.columns == docs.columns
    # rows that repeat id and text of the one that stays, stay as well
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, a), (5, b), (7, " "), (9, c), (9, c)])


def test_shingle_hashes_equal_where_words_do():
    import pyarrow as pa

    texts = ["a b c d e f", "  A b\tC d e f ", "a b", "", " ", "b", "a b c d e", "x a b c d e f", "ä b c d e f"]
    found = [near_copies.as_set(x).tolist() for x in near_copies.shingles(pa.array(texts), 5)]
    assert [len(x) for x in found] == [2, 2, 1, 0, 0, 1, 1, 3, 2]
    assert found[0] == found[1] and set(found[6]) < set(found[0]) < set(found[7]) and not set(found[2]) & set(found[5])
    assert len(set(found[0]) & set(found[8])) == 1
