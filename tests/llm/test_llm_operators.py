"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from layouts import LABELLED
from tokenizers import Tokenizer

from lectern.llm import components, exact_dedup, html_extract, language_id, mixing, packing, quality_rules, simhash, substring_dedup, token_count, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, h string, stratum string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.encode().lower().decode()


@pytest.fixture(scope="module")
def rows():
    """Random texts with copies, near copies, shared passages, nulls, repeated rows and a very long text."""
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(300)] + ["Über", "naïve,", "the", "of", "$$$", "e\u0301a", "\u00a0x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for _ in range(n))
    texts = [text(rng.choice([0, 1, 3, 4, 5, 20, 60, 120, 300])) for _ in range(60)]
    texts += [texts[50], texts[50].upper(), texts[51] + " tail", "x " + texts[52], texts[53].replace("w1 ", "w2 ")]
    texts += [None, "", " \n ", "a" * 50_000, "b c " * 8_000, text(30_000)]
    passage = text(40)
    texts += [text(20) + passage + text(15), text(5) + passage, passage]
    out = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[5]), (None, None), (out[7][0], texts[8])]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "\u00e9", None]), 1, "x", 1, "y", None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [64, 7])
def test_exact_groups(docs, rows, none, bits):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1] or "")].append(r[0])
    exp = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = set()
        for i in ids:
            exp.append((i, keep, len(ids), i == keep and i not in seen, hashlib.sha256(t.encode()).hexdigest()))
            seen.add(i)
    cols = ("id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_groups(docs, hash_bits=bits), *cols) == sorted(exp, key=repr)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(97, 123, 60_000).astype(np.uint8)
    b = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), a])
    cuts = lambda x: exact_dedup.cut_points(x, np.array([0, len(x)]), 10, 256, 8192)[0]
    pieces = lambda x: {x[s:e].tobytes() for s, e in zip([0, *cuts(x)], cuts(x))}
    assert len(pieces(a) & pieces(b)) > 0.9 * len(pieces(a))
    assert all(e - s <= 8192 for s, e in zip([0, *cuts(a)], cuts(a)))


def brute_fingerprint(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i in range(len(fps)):
        least[root(i)].append(ids[i])
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("blocks", [None, 8])
def test_near_groups(docs, rows, none, blocks):
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    exp = [(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps, 4))]
    assert got(simhash.near_groups(docs, blocks=blocks), "id", "fingerprint", "component_id") == sorted(exp, key=repr)
    assert simhash.near_groups(none).count() == 0


def test_links_connect_dense_and_sparse_points(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    fps |= {0, 1, 3, 7, 15, 31, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    parts = {r.node: r.component for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    exp = brute_components(signed, fps, 4)
    mine = [parts.get(f, f) for f in signed]
    assert [mine.index(m) for m in mine] == [exp.index(e) for e in exp]
    e = simhash.embed(np.array(fps, np.uint64))
    for i, j in ((rng.randrange(len(fps)), rng.randrange(len(fps))) for _ in range(500)):
        assert int(np.bitwise_count(e[i] ^ e[j])) <= bin(fps[i] ^ fps[j]).count("1")


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_of_paths_and_stars(spark, one_task):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (-5, -3)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(4), one_task=one_task).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {-5: -5, -3: -5}
    assert components.components(spark.createDataFrame([], "u long, v long"), one_task=one_task).count() == 0


def brute_removal(rows, width=13):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()


@pytest.mark.parametrize("bits,flush", [(64, 1_500_000), (64, 500), (12, 3_000)])
def test_remove_repeats(docs, rows, none, bits, flush):
    found = substring_dedup.remove_repeats(docs, bits=bits, flush=flush)
    assert got(found, "id", "n_words", "n_removed", "kept_sha256") == sorted(brute_removal(rows), key=repr)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_paths_are_glued(spark):
    parts = spark.createDataFrame([(9, 0, 5, 1, 10), (9, 5, 3, 1, 15), (9, 8, 2, 2, 18), (9, 12, 1, 1, 20)], substring_dedup.SPAN)
    assert got(substring_dedup.glued(parts), "id", "start", "len", "src", "src_start") == [(9, 0, 8, 1, 10), (9, 12, 1, 1, 20), (9, 8, 2, 2, 18)]


def test_mix(docs, rows, none):
    r = mixing.mix(docs, cap=2).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert collections.Counter((x["doc_id"], x["__size"]) for x in r) == collections.Counter((x[0], size(x[1])) for x in rows)
    sources = sorted({x[3] for x in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(x[1]) for x in rows if x[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = dict.fromkeys(sources, 0.0), 1.5 * sum(total.values()), set(sources)
    while left > 1e-6 and open_:  # share, cut at twice the size, share the excess again
        part = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        left = 0.0
        for s, p in part.items():
            target[s] += p
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    longest = max(x["__size"] for x in r)
    for s in sources:
        mine = [x for x in r if x["source"] == s]
        assert all(x["__target"] == pytest.approx(target[s]) and x["__source_size"] == total[s] for x in mine)
        assert abs(sum(x["__copies"] * x["__size"] for x in mine) - target[s]) <= longest + 1
    assert all(0 <= x["__copies"] <= 2 for x in r)
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert collections.Counter((x.doc_id, x.text) for x in emitted.collect()) == collections.Counter(dict_of(r))
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


def test_mix_is_the_same_however_it_is_dealt_out(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 3 as int)) as text", "case when id % 3 = 0 then null else concat('s', id % 2) end as source")
    whole = mixing.mix(docs).collect()
    for fine, rows in ((1, 10), (4096, 10), (64, 1)):
        assert sorted(mixing.mix(docs.repartition(5), fine=fine, rows=rows).collect()) == sorted(whole)


def dict_of(r):
    out = []
    for x in r:
        out += [(x["doc_id"], x["text"])] * x["__copies"]
    return out


def test_pieces_rebuild_every_document(docs, rows, none):
    t = Tokenizer.from_file(VOCABULARY)
    found = packing.pieces(docs, VOCABULARY, group_docs=16).collect()
    ids = {}
    for r in rows:
        e = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        ids.setdefault((r[0], len(e)), []).append(e)
    spans, bins = collections.defaultdict(list), collections.defaultdict(list)
    for x in found:
        want = {zlib.crc32(np.array(e[x.start : x.start + x.length], "<u4").tobytes()) for e in ids[x.id, x.doc_tokens]}
        assert x.ids_crc32 in want and x.length > 0
        spans[x.id, x.doc_tokens].append((x.start, x.length))
        bins[x.sequence_id].append((x.offset, x.length))
    for k, es in ids.items():  # each id once for each row
        cover = collections.Counter(p for s, n in spans[k] for p in range(s, s + n))
        assert cover == collections.Counter({p: len(es) for p in range(k[1])})
    padding = 0
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 8 * len(bins)
    assert packing.pieces(none, VOCABULARY).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 60))]
        room, bins = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                b = len(room)
                room.append(100)
                bins.append([])
            room[b] -= sizes[i]
            bins[b].append(i)
        assert packing.first_fit_decreasing(sizes, 100) == bins


def test_groups_are_cut_no_more_than_it_takes():
    rng = random.Random(7)
    for n, low, high in [(0, 1, 2), (1, 1, 100), (40, 1, 100), (300, 50, 99), (300, 1, 30), (64, 50, 51), (3, 100, 101)]:
        sizes = [rng.randrange(low, high) for _ in range(n)]
        found = packing.pack_group(sizes, 100, 2)
        cover = collections.Counter((i, p) for s in found for i, at, k in s for p in range(at, at + k))
        assert cover == collections.Counter((i, p) for i, k in enumerate(sizes) for p in range(k))
        fill = [sum(k for _, _, k in s) for s in found]
        odd = [f for f in fill if f < 98]
        assert max(fill, default=0) <= 100 and all(f & (f - 1) == 0 for f in odd) and sum(odd) < 100 and len(set(odd)) == len(odd)
        bins = packing.first_fit_decreasing(sizes, 100)
        held = [b for b in bins if any(s[: len(b)] == [(i, 0, sizes[i]) for i in b] for s in found)]
        # as many bins stay as the tokens allow, up to the one that the gaps end in
        assert len(held) >= sum(sizes) // 100 - 1


def test_token_counts_equal_the_library(docs, rows, none):
    t = Tokenizer.from_file(VOCABULARY)
    exp = [(r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows]
    assert got(token_count.token_counts(docs, VOCABULARY), "id", "n_bytes", "n_tokens", "over_limit") == sorted(exp, key=repr)
    assert token_count.token_counts(none, VOCABULARY).count() == 0


def test_token_counts_and_ids_of_odd_characters():
    rng = random.Random(1)
    pool = ["'s", "don't", "<|endoftext|>", "<|startoftext|>x", "\u0130", "\u03a3", "e\u0301", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "漢字", "123", "²", "...", "ABC", "\U0001f600", "\ufb01", "\x00", "\u0149", "हिन्दी", "\t", "\n", " ", ",", "ª"]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.7 else chr(rng.randrange(32, 0x2FFF)) for _ in range(rng.randrange(0, 12))) for _ in range(1500)]
    t, ids = Tokenizer.from_file(VOCABULARY), packing.WordIds(VOCABULARY, held=200)
    exp = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in ids.of(pa.array(texts), block=100)] == exp
    counter = token_count.Merger(VOCABULARY, held=200)
    for lo in range(0, len(texts), 100):
        assert counter.of(pa.array(texts[lo : lo + 100])).tolist() == [len(e) for e in exp[lo : lo + 100]]


def test_quality_measures(docs, rows, none):
    exp = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        exp.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    labels = docs.sparkSession.createDataFrame([(3, True), (3, False), (None, True), (6, None)], "id long, good boolean")
    found = quality_rules.judge(docs, labels)
    assert got(found, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(exp, key=repr)
    assert all(r.kept == (not r.base_failed) for r in found.collect())  # nothing is proved by so few labels
    assert quality_rules.judge(none, labels).count() == 0


def test_proved_cutoffs_decide(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(5000)]
    rows, labels = [], []
    for i in range(4800):
        words, bad = rng.sample(pool, 60), i % 8 == 0
        if bad:
            words[:15] = ["#$#$#"] + ["%%%" + x for x in words[1:15]]
        elif i % 997 == 0:
            words[0] = "#####"  # a few good ones over the lowest cutoffs
        rows.append((i, " ".join(words), (None, "en", "xx")[0 if i % 2 else 1 if i > 100 else 2]))
        labels.append((i, not bad))
    found = {r.id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "id long, good boolean")).collect()}
    # by hand: shares, exact tails and the split of the error over 3 strata and all cutoffs
    def shares(t):
        w = t.split()
        chars = sum(map(len, w))
        return {"symbol_share": sum(c in "#*$%&|<>" for c in t) / chars, "dup_line_share": 0.0, "repeat_share": 0.0, "word_length": chars / len(w)}

    of, risk = {i: shares(t) for i, t, _ in rows}, quality_rules.RISK / 4
    level = quality_rules.ERROR / (3 * sum(map(len, quality_rules.GRIDS.values())))
    cutoff = {}
    for stratum in (None, "en", "xx"):
        good = [i for i, _, s in rows if s == stratum and labels[i][1]]
        for m, grid in quality_rules.GRIDS.items():
            k = {c: sum(of[i][m] > c for i in good) for c in grid}
            tail = {c: sum(math.comb(len(good), x) * risk**x * (1 - risk) ** (len(good) - x) for x in range(k[c] + 1)) if k[c] < len(good) * risk else 1 for c in grid}
            cutoff[stratum, m] = min((c for c in grid if tail[c] <= level), default=math.inf)
    for i, _, stratum in rows:
        assert found[i].reasons == [m for m in quality_rules.GRIDS if of[i][m] > cutoff[stratum, m]], i
        assert found[i].kept == (not found[i].reasons)
    gone = [i for i in found if not found[i].kept]
    assert len(gone) > 500 and {rows[i][2] for i in gone} == {None, "en"}  # "xx" has too few labels to prove anything


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.02), (0, 5000, 0.02), (60, 5000, 0.02)]
    for k, n, p in cases:
        df = spark.createDataFrame([(k, n)], "k long, n long")
        mine = df.select(quality_rules.binomial_tail(df.k, df.n, p)).first()[0]
        from fractions import Fraction

        q = Fraction(p)
        exact = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert mine == pytest.approx(exact, rel=1e-8)


def test_thresholds_hold_the_risk(spark):
    rng = random.Random(5)
    rows = [("s", True, rng.random() * 0.5, 0.0) for _ in range(4000)] + [("s", False, 0.9, 0.0)] * 500 + [("t", True, 0.1, 0.0)] * 20
    labelled = spark.createDataFrame(rows, "stratum string, good boolean, a double, b double")
    grids = {"a": (0.1, 0.3, 0.49, 0.499, 0.6), "b": (0.5,)}
    chosen = quality_rules.thresholds(labelled, labelled.select("stratum").distinct(), grids, risk=0.02, error=0.05)
    assert got(chosen, "stratum", "measure", "cutoff") == [("s", "a", 0.499), ("s", "b", 0.5)]


def test_language_model_codes_add_up():
    model = language_id.fit({"x": [b"abracadabra abra", b"cadabra abra"], "y": [b"zyzzyva zyx", b"xyzzy"]})
    a = model.classes
    unseen = 256 - (a - 1)
    for tree in model.trees:
        p = np.exp2(-tree.bits.reshape(-1, a).astype(float))
        assert np.allclose(p[:, 1:].sum(1) + unseen * p[:, 0], 1, atol=1e-4)


def dictionary_ppm(sample, least, most):
    """Code length of a text by a PPM of plain dictionaries: up to three bytes, method C with exclusions."""
    counts = collections.defaultdict(collections.Counter)
    for t in sample:
        for i in range(len(t)):
            for order in range(min(3, i) + 1):
                counts[t[i - order : i]][t[i]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}
    most_of = lambda order, m: set(sorted((c for c in total if len(c) == order and total[c] >= least), key=lambda c: (-total[c], c))[:m])
    two = most_of(2, most // 4)
    known = two | {c for c in most_of(3, most) if c[:2] in two} | {c for c in total if len(c) < 2} | {b""}

    @functools.cache
    def cost(context, byte):
        out, gone = 0.0, set()
        while True:
            if context in known:
                here = {s: n for s, n in counts[context].items() if s not in gone}
                if byte in here:
                    return out - math.log2(here[byte] / (sum(here.values()) + len(here)))
                if here:
                    out -= math.log2(len(here) / (sum(here.values()) + len(here)))
                gone |= here.keys()
            if not context:
                return out + math.log2(256 - len(gone))
            context = context[1:]

    return lambda text: sum(cost(text[max(0, i - 3) : i], text[i]) for i in range(len(text)))


@pytest.mark.parametrize("least,most", [(2, 8192), (1, 60)])
def test_language_codes_equal_a_ppm_of_dictionaries(least, most):
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"]]
    sample = {x: [r["text"].encode() for r in rows if r["lang"] == x][:20] for x in sorted({r["lang"] for r in rows})}
    model = language_id.fit(sample, least, most)
    plain = [dictionary_ppm(sample[x], least, most) for x in model.langs]
    texts = [r["text"].encode()[:3000] for r in rows[-200:]] + [b"", b"a", "\xff\u6f22 \u0130x".encode(), b"\xff\xfe ab\x00"]
    if most > 60:  # beyond one piece
        texts.append(b" ".join(r["text"].encode() for r in rows)[: 4 << 20] * 2)
        texts[-1] = (texts[-1] * (1 + (5 << 20) // len(texts[-1])))[: 5 << 20]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = language_id.whole_lengths(model, np.frombuffer(b"".join(texts), np.uint8), off)
    for t, each in zip(texts, found):
        assert each == pytest.approx([code(t) for code in plain], rel=1e-5, abs=1e-6)


def test_a_language_keeps_its_contexts_beside_larger_ones():
    small, large = [b"kot i pies "] * 3, [bytes(random.Random(k).choices(range(97, 123), k=5000)) for k in range(40)]
    alone, beside = (language_id.fit(x, most_nodes=400) for x in ({"s": small}, {"l": large, "s": small}))
    text = np.frombuffer(b"kot i pies", np.uint8)
    codes = [language_id.code_lengths(m, text, np.array([0, len(text)]))[0, m.langs.index("s")] for m in (alone, beside)]
    assert codes[0] == pytest.approx(codes[1], rel=1e-6)


def test_languages_are_told_apart(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = language_id.train(docs, allowed=fold != 2)
    found = language_id.identify(docs.where(fold == 2).withColumnRenamed("lang", "truth"), model).join(docs, F.col("id") == F.col("doc_id")).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (None, "the of and")], "doc_id long, text string")
    r = {x.id: x for x in language_id.identify(odd, model).collect()}
    assert [r[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and r[None].lang_pred == "en" and 0 <= r[None].score <= 1
    assert language_id.identify(none, model).count() == 0
    empty = language_id.train(none)
    assert {x.lang_pred for x in language_id.identify(odd, empty).collect()} == {"und"}


def test_language_by_code_length_of_the_whole_text(spark):
    from pyspark.sql import functions as F

    en, de = "the cat sat on the mat and the dog was in the house with the others ", "der hund und die katze sitzen auf der matte und nicht in dem haus von uns "
    # the one language has long texts only: they're learned by slices
    docs = spark.createDataFrame([(i, en * 20, "en") for i in range(8)] + [(10 + i, de * 600, "de") for i in range(8)], "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, "doc_id", "text", "lang", F.lit(True)).collect()
    assert {len(r.text) for r in sample if r.lang == "de"} == {language_id.SAMPLE_BYTES} and len({bytes(r.text) for r in sample if r.lang == "de"}) > 1
    model = language_id.train(docs)
    text = f"{en}\n{de * 140}\n{en}"
    r = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.lang_pred == "de"
    raw, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    total = language_id.code_lengths(model, raw, off)
    assert model.langs[total[0].argmin()] == "de" and r.bits_per_byte == pytest.approx(total.min() / off[1])
    assert language_id.whole_lengths(model, raw, off, piece=1000) == pytest.approx(total, rel=1e-6)


def test_html_pages():
    w = html_extract.learn()
    text = lambda p: html_extract.main_text(p, w)
    equal, right, wrong, missed = 0, 0, 0, 0
    for page in LABELLED:
        inside = re.sub(r"<[^>]*>", " ", " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))).split()
        found = text(page.replace("[[", "").replace("]]", "")).split()
        equal += "".join(found) == "".join(inside)
        both = sum((collections.Counter(inside) & collections.Counter(found)).values())
        right, wrong, missed = right + both, wrong + len(found) - both, missed + len(inside) - both
    assert equal >= len(LABELLED) - 1 and right / (right + wrong) >= 0.99 and right / (right + missed) >= 0.97, (right, wrong, missed)
    page = """<body><div class="sidebar">side words go here</div><div id=content><p>Real   text\n one &amp; two.</p><div class="cookie-notice">We use cookies</div>
    <p>Second&nbsp;&lt;x&gt;<p>third<form>Name <input></form></div><section class="comments"><p>Nice post! loved it so much</p></section><footer>(c) us</footer></body>"""
    assert text(page) == "Real text one & two.\nSecond <x>\nthird"
    page = """<div class="layout has-sidebar"><div class="sidebar"><p>side words</p></div><article class="post"><p>The text itself.</p></article>
    <section class="comments"><article class="comment"><p>A reader says a lot of things here.</p></article></section></div>"""
    assert text(page) == "The text itself."
    assert text(None) == text("") == text("<nav>menu</nav><script>var a='<p>x</p>'</script>") == ""
    assert text("just words") == "just words" and text("<p>cut off <b") == "cut off" and text("<p>a <i>b</i>c <a href=\"q>d</a> e</p>").startswith("a bc")
    assert html_extract.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)


def test_html_scan_decides_where_names_say_nothing(monkeypatch):
    w = html_extract.learn()
    right = wrong = missed = 0
    texts = []
    for page in html_extract.labelled_pages():
        inside = re.sub(r"<[^>]*>", " ", " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))).split()
        plain = page.replace("[[", "").replace("]]", "")
        texts.append((plain, html_extract.main_text(plain, w)))
        found = texts[-1][1].split()
        both = sum((collections.Counter(inside) & collections.Counter(found)).values())
        right, wrong, missed = right + both, wrong + len(found) - both, missed + len(inside) - both
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95, (right, wrong, missed)
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (0, len(scores)))
    assert sum(html_extract.main_text(plain, w) != found for plain, found in texts) >= 10  # what no name rules out, the scan does


def test_html_time_is_linear():
    import time

    w, took = html_extract.learn(), {}
    for n in (10_000, 40_000):
        for kind, page in {"deep": "<div>" * n + "x y" + "</span></p>" * n, "articles": "<article>" * n + "</main>" * n, "p": "<p><b>" * n + "<div>" * n}.items():
            began = time.perf_counter()
            html_extract.main_text(page, w)
            took[kind, n] = time.perf_counter() - began
    assert all(took[k, 40_000] < 10 * took[k, 10_000] + 0.2 for k in ("deep", "articles", "p"))  # four times the page


def test_html_rows_of_odd_kinds(spark):
    rows = [(1, "u", "<p>a b c</p>", "x"), (1, "u", "<p>a b c</p>", "x"), (None, None, None, None), (2, None, "", "y"), (3, "v", "<p>" + "word " * 300_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extract.extract(pages)
    assert found.columns == ["id", "url", "text", "n_chars"]
    assert sorted((r.id or 0, r.url or "", r.text[:6], r.n_chars) for r in found.collect()) == [(0, "", "", 0), (1, "u", "a b c", 5), (1, "u", "a b c", 5), (2, "", "", 0), (3, "v", "word w", 1_499_999)]
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_keeps_tables_and_lists_of_an_article(tag):
    table = "<table>" + "".join("<tr>" + "".join(f"<td>n{r}{c}</td>" for c in range(4)) + "</tr>" for r in range(20)) + "</table>"
    links = "<ul>" + "".join(f"<li><a href=/r{i}>ref{i}</a></li>" for i in range(30)) + "</ul>"
    terms = "<dl>" + "".join(f"<dt>t{i}</dt><dd>d{i}</dd>" for i in range(20)) + "</dl>"
    nav = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
    text = lambda p: html_extract.main_text(p, html_extract.learn())
    words = lambda p: re.sub("<[^>]*>", " ", p).split()
    for body in (f"{links}<p>A first line of words.</p>{table}<p>Then a few more words follow.</p>{terms}{links}", f"{table}<p>Short end.</p>", links):
        page = f"<body>{nav}<{tag}>{body}<nav>in page</nav></{tag}><div>{nav}</div></body>"
        assert text(page).split() == words(body)
    body = f"<p>Some words stand before the table here.</p>{table}<p>And a few more come after.</p>"
    assert text(f"<body>{nav}<div>{body}</div><div>{nav}</div></body>").split() == words(body)  # without the element, by the weights


def test_html_of_the_tables(spark):
    import html as h

    found = html_extract.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in found:
        a = pages[r.id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", a)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_urls(spark, none):
    urls = ["https://WWW.Example.com/en/7?x=/de/", "http://example.com/en/8", "http://a.example.net/de/81#q", "ftp://x.net/de/", "http://org/es/", "http://forg/es/", None, "no scheme", "http://", "http://casino-win.example.org/fr/", "http://good.example.org?q", "x://a.com"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    model = url_filter.train(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    r = {x.id: x for x in url_filter.verdicts(pages, model).collect()}
    assert [(r[i].host, r[i].path, r[i].rule, r[i].verdict) for i in range(6)] == [
        ("www.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("a.example.net", "/de/81", "example.net/de/8", "allow"),
        ("x.net", "/de/", "net/de/", "block"), ("org", "/es/", "org/es/", "block"), ("forg", "/es/", None, r[5].verdict),
    ]
    assert all((r[i].host, r[i].path, r[i].verdict) == ("", "", "allow") for i in (6, 7, 8))
    assert r[9].verdict == "block" and r[10].verdict == "allow" and r[10].path == "" and r[None].rule == r[0].rule
    assert url_filter.verdicts(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_urls_of_one_host_differ_by_path_and_query(spark):
    rng = random.Random(5)
    good, bad = ["garden", "plants", "history", "museum", "river", "bridge"], ["casino", "slots", "poker", "jackpot"]
    of = lambda words, key: f"https://clean.example.info/{rng.choice(words)}/{rng.choice(words)}-{rng.randrange(99)}?{key}={rng.choice(words)}"
    urls = [of(good, "page") for _ in range(600)] + [of(bad, "bet") for _ in range(600)]
    schema = "page_id long, url string"
    model = url_filter.train(spark.createDataFrame(list(enumerate(urls)), schema))
    tried = ["https://Clean.example.info/Casino/free-slots?bet=1", "https://clean.example.info/garden/river-7?page=museum", "https://clean.example.info/garden/?bet=jackpot-poker-slots#garden"]
    r = {x.id: x for x in url_filter.verdicts(spark.createDataFrame(list(enumerate(tried)), schema), model).collect()}
    assert [r[i].verdict for i in range(3)] == ["block", "allow", "block"] and {x.host for x in r.values()} == {"clean.example.info"} and r[0].path == "/Casino/free-slots"


def test_character_model_sums_to_one():
    m = url_filter.Markov(3).fit(["abc.example", "abd.example"])
    for context in ("", "ab", "zzz", "^ab"):
        assert sum(m.probability(context, c) for c in [*m.alphabet, "\x00"]) == pytest.approx(1)


def test_url_models_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    one = spark.createDataFrame([(1, "http://casino.example/")], none.schema)
    model = url_filter.train(none, accepted=[], rejected=[])
    assert [r.verdict for r in url_filter.verdicts(one, model).collect()] == ["allow"]
    model = url_filter.train(none)  # the labelled URLs alone
    assert [r.verdict for r in url_filter.verdicts(one, model).collect()] == ["block"]


def test_held_out_urls_are_told_apart(spark):
    model = url_filter.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert model.recall >= 0.8 and model.false_rejects <= 0.02
    good, bad = url_filter.fold(url_filter.ACCEPTED)[1], url_filter.fold(url_filter.REJECTED)[1]
    assert not {*good, *bad} & {*url_filter.fold(url_filter.ACCEPTED)[0], *url_filter.fold(url_filter.REJECTED)[0]}
    # none of these was trained on, nor are most of their words in any URL that was
    assert sum(model.score(u) > model.threshold for u in bad) >= 12 and sum(model.score(u) > model.threshold for u in good) <= 2


def test_character_model_equals_a_recursive_one():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc/.") for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    m = url_filter.Markov(3).fit(texts, alphabet="xyz")
    alphabet = {*"^$xyz", *"".join(texts)}

    def p(context, char):
        shorter = 1 / (len(alphabet) + 1) if context == "" else p(context[1:], char)
        follows = collections.Counter(t[i + len(context)] for t in (f"^{x}$" for x in texts) for i in range(len(t) - len(context)) if t[i : i + len(context)] == context and i + len(context) > 0)
        n, kinds = sum(follows.values()), len(follows)
        return (follows[char] + kinds * shorter) / (n + kinds) if n else shorter

    for t in [*texts[:5], "zx/ab", "", "q"]:
        whole = f"^{t}$"
        expected = sum(np.log(p(whole[max(0, i - 3) : i], whole[i])) for i in range(1, len(whole))) / (len(whole) - 1)
        assert m.rate(t) == pytest.approx(expected)


def test_url_models_count_every_url_of_the_table(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    urls = [f"h{rng.randrange(40)}.example.info/{rng.choice('abcdef')}{i}" for i in range(2800)] + [f"h{rng.randrange(40)}.example.info/casino/{i}" for i in range(2500)]
    pages = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(urls)], "page_id long, url string").repartition(5)
    accepted, rejected = ["plain.example.org/garden/a", "www.river.net/b", "c.org/d", "e.org/f"], ["casino.example.biz/slots", "casino.org/bet", "my-casino.net/x", "casino.com/held"]
    model = url_filter.train(pages, accepted=accepted, rejected=rejected)
    held = {r.url for r in spark.createDataFrame([(u,) for u in urls], "url string").where(F.pmod(F.xxhash64("url"), F.lit(4)) == 3).collect()}
    good, bad = ([*given[:3], *(u for u in urls if u not in held and ("casino" in u) == label)] for given, label in ((accepted, False), (rejected, True)))
    most, chars = max(len(good), len(bad)), set("".join(good + bad))
    a, r = (url_filter.Markov().fit(x, max(1.0, most / len(x)), chars) for x in (good, bad))  # all of them, by plain dictionaries
    tried = [urls[0], urls[-1], "new.host/ä-never-seen?x=casino", "z", ""]
    found = {x.url: x.score for x in model.scores(spark.createDataFrame([(u,) for u in tried], "url string")).collect()}
    assert found == {u: pytest.approx(r.rate(u) - a.rate(u), abs=1e-8) for u in tried}
    scores = sorted(r.rate(u) - a.rate(u) for u in [accepted[3], *(u for u in held if "casino" not in u)])
    assert model.threshold == pytest.approx(max(0.0, scores[min(len(scores) - 1, int(np.ceil(len(scores) * 0.995)))]), abs=1e-8)


def test_url_rows_of_odd_kinds(spark):
    long = "https://plain.example.info/" + "garden/" * 30_000
    rows = [(1, long, "x", "y"), (1, long, "x", "y"), (None, None, None, None), (2, "https://casino-slots.example.info/?" + "bonus&" * 30_000, "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    found = url_filter.verdicts(pages, url_filter.train(pages)).collect()
    assert sorted((r.id or 0, r.verdict, len(r.path)) for r in found) == [(0, "allow", 0), (1, "allow", 210_001), (1, "allow", 210_001), (2, "block", 1)]


def test_exact_dedup_picks_one_of_repeated_rows_by_all_columns(spark):
    rows = [(5, "Same", "b"), (5, "same", "a"), (5, "other", "z"), (4, "SAME", "a"), (None, None, "q"), (None, "", "p"), (6, "é", "x"), (6, "É", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n string").repartition(3)
    found = exact_dedup.drop_exact_duplicates(docs)
    assert found.columns == docs.columns
    # all columns in their order decide: "Same" comes before "same", null before anything
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(5, "Same", "b"), (5, "other", "z"), (None, None, "q"), (6, "é", "x"), (6, "É", "x")]))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lectern.llm import common

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(unset)
