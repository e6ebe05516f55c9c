"""Phrases, near copies by MinHash and whitening against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOC, frame
from vigipanel.llm import collocations, minhash_pairs, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, top):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[k:k + size]) for k in range(len(words) - size + 1))
    found = []
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((1000000 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p)))
        longer = [n for (other, *q), n in f.items() if other == lang and len(q) == 3 and n >= least and len(p) == 2 and p in (q[:2], q[1:])]
        if not any(100 * n >= 50 * a for n in longer):
            found.append((lang, score, a, " ".join(p), f[(lang, *p[:k])], f[(lang, *p[k:])]))
    out = []
    for lang in {x[0] for x in found}:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, rank, phrase, a, l, r, total[lang], score) for rank, (_, score, a, phrase, l, r) in enumerate(own, 1)]
    return sorted(out)


def phrase_rows(spark):
    draw = random.Random(3)
    words = "Nova stella Ärger le Le do\x00 é pax  x 😀 a,b c;d e:f g!h i?j k.l tab\tx new\nline".split(" ")
    rows = [(draw.choice(["en", "de", None, "und"]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for _ in range(80)]
    rows += [("en", None), (None, ""), ("fr", "  \n\t"), ("en", "le do " * 3000), ("en", "x" * 20000)] + [rows[0]] * 12
    table = spark.createDataFrame([(k, t, lang, "s", 0, "clash", 7, "clash") for k, (lang, t) in enumerate(rows)], DOC)
    return rows, table.withColumnRenamed("line", "phrase").withColumnRenamed("key", "f").withColumnRenamed("item", "print")


@pytest.mark.parametrize("bits", [64, 9])
def test_phrases(spark, bits):
    """Also with nine bits of a fingerprint, where most phrases collide, and with small blocks."""
    rows, table = phrase_rows(spark)
    for least, top in ((10, 2000), (3, 15)):
        assert sorted(map(tuple, collocations.ranked(collocations.phrase_counts(table, least, bits, 3000), least, top).collect())) == plain_phrases(rows, least, top)


def test_phrase_scores_beyond_64_bits(spark):
    """Counts of 10**10 have products of more than 64 bits."""
    a, l, r = 7_000_000_001, 9_000_000_007, 8_000_000_033
    counts = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    assert [x["score"] for x in collocations.scored(counts).collect()] == [1000000 * a * a // (l * r)]


def test_no_phrases(spark):
    table = spark.createDataFrame([], DOC)
    assert collocations.collocations(table).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "s", 0, "", 7, "")], DOC)).collect() == []


def plain_sets(texts):
    out = []
    for text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        out.append({tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    return out


def plain_components(texts, ids):
    sets = plain_sets(texts)
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k in range(len(texts)):
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return [(ids[k], len(sets[k]), least.get(find(k)), ids[k] == least.get(find(k))) for k in range(len(texts))]


def replaced(text, draw, n):
    words = text.split(" ")
    for k in draw.sample(range(len(words)), n):
        words[k] = f"w{draw.random()}"
    return " ".join(words)


def near_texts(prose):
    draw = random.Random(8)
    base = [prose(n) for n in (150, 80, 60, 30, 12)]
    texts = [replaced(t, draw, k) for t in base for k in range(8) for _ in range(3) if k < len(t.split()) // 3]
    texts += [replaced(base[0], draw, draw.randint(1, 9)) for _ in range(60)]          # a crowd in which few pairs link
    return texts + [base[0].upper(), base[3] + "\n", "one two", "One  TWO", "one", None, "", " \n", prose(6000), prose(6000)] + [base[1]] * 5


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_copies(spark, prose, monkeypatch, rounds):
    monkeypatch.setattr(minhash_pairs, "ROUNDS", rounds)
    texts = near_texts(prose)
    got = [tuple(r) for r in minhash_pairs.near_copies(frame(spark, texts, 100).repartition(5)).collect()]
    assert sorted(got) == plain_components(texts, range(100, 100 + len(texts)))


def test_crowds_leave_half_keys_only(spark, prose):
    """A crowd has a row for each half-key of an item, not one for each pair of them."""
    draw = random.Random(5)
    base = prose(150)
    texts = [replaced(base, draw, draw.randint(1, 4)) for _ in range(60)]
    rows = [(k, minhash_pairs.tk.signed(minhash_pairs.half_keys(minhash_pairs.tk.shingles(t, 4))).tolist()) for k, t in enumerate(texts + [prose(40)])]
    halves = minhash_pairs.shared_halves(spark.createDataFrame(rows, "item long, halves array<long>"))
    held = {r["item"]: (r["n"], r["w"]) for r in halves.groupBy("item").agg(F.count("*").alias("n"), F.max("w").alias("w")).collect()}
    assert set(held) <= set(range(60)) and len(held) > 50 and all(n == w <= 2 * minhash_pairs.HALVES for n, w in held.values())


def test_near_copies_without_ids(spark, prose):
    """Null and repeated doc_ids, repeated rows."""
    one, two = prose(50), prose(50)
    texts = [one, one, two, two + " x", None, prose(20)] + [one]
    ids = [None, 5, None, None, None, 5, 5]
    table = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string")
    got = [tuple(r) for r in minhash_pairs.near_copies(table).collect()]
    assert sorted(got, key=repr) == sorted(plain_components(texts, ids), key=repr)


def test_no_near_copies(spark, prose):
    assert minhash_pairs.near_copies(frame(spark, [])).collect() == []
    got = minhash_pairs.near_copies(frame(spark, [prose(40), prose(30)])).collect()
    assert sorted(map(tuple, got)) == [(0, 37, 0, True), (1, 27, 1, True)]


def test_tables_find_rare_pairs():
    """Of pairs at a similarity of 0.8 nearly all share a table; the counted share agrees with ``chance``."""
    draw = np.random.default_rng(4)
    hit = {0.8: 0, 0.4: 0}
    for s in hit:
        both = round(200 * s)
        for _ in range(400):
            x = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
            rest = (200 - both) // 2
            a, b = (minhash_pairs.half_keys(np.concatenate((x[:both], x[k:k + rest]))) for k in (both, both + rest))
            same = a == b
            hit[s] += same[:minhash_pairs.HALVES].any() and same[minhash_pairs.HALVES:].any()
    assert minhash_pairs.chance(0.8) > 0.999 and hit[0.8] >= 398
    assert abs(hit[0.4] / 400 - minhash_pairs.chance(0.4)) < 0.08


def plain_whitening(vectors):
    x = np.array(sorted({tuple(np.floor(256 * np.array(v, float)).astype(int)) for v in vectors}))
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    e, q = np.linalg.eigh(v)
    return x, e[::-1], q[:, ::-1], np.trace(v)


@pytest.mark.parametrize("d,n", [(3, 40), (20, 300)])
def test_whitening(spark, d, n):
    draw = np.random.default_rng(d)
    data = (draw.standard_normal((n, d)) * np.linspace(1, 3, d)).astype(np.float32)
    rows = [(k, [float(c) for c in v], "clash") for k, v in enumerate(data)]
    rows += [(None, rows[0][1], ""), (7, rows[7][1], "again"), (901, None, ""), (902, [None] * d, ""), (903, [float("nan")] * d, ""), (904, [float("-inf")] * d, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")
    got = whitening.whitened(table).toPandas()
    x, e, q, trace = plain_whitening(data)
    count = min(4, d)
    assert len(got) == (n + 2) * count and got["n"].eq(len(x)).all()
    sums = [int(s) for s in x.sum(axis=0)]
    for component in range(1, count + 1):
        own = got[(got["component"] == component) & got["vec_id"].notna()].drop_duplicates("vec_id").sort_values("vec_id")
        whole = np.floor(256 * data.astype(float))
        want = (whole - x.mean(axis=0)) @ q[:, component - 1] / np.sqrt(e[component - 1])
        sign = np.sign(want @ own["whitened"].to_numpy())
        assert np.allclose(own["whitened"], sign * want, atol=1e-9)
        assert np.allclose(own["explained"], e[component - 1] / trace, rtol=1e-12)
        assert own["deviation"].tolist() == [sum((len(x) * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in whole]
    assert got["identity_error"].max() < 1e-10


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [float("nan")])], kind)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, []), (2, [])], kind)).collect() == []
    # one direction only: one component; a shorter vector is padded with zeros
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [3.0])], kind)).collect()
    assert [(r["vec_id"], r["component"], r["deviation"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in got] == [(1, 1, 512 ** 2, 1.0, 1.0), (2, 1, 512 ** 2, 1.0, 1.0)]
    # 1e30 is beyond whole numbers of 64 bits: floor stops at the largest, and the deviation doesn't fit
    got = whitening.whitened(spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in got] == [None, None]


def test_eigenpairs_of_hard_spectra():
    """Clustered, equal and vanishing eigenvalues; sizes around the width of the subspace."""
    draw = np.random.default_rng(2)
    for d in (1, 2, 7, 16, 17, 64, 200):
        for spectrum in (draw.random(d), np.ones(d), np.linspace(1, 1 + 1e-6, d), np.r_[np.full(min(3, d), 5.0), np.full(d - min(3, d), 1e-9)], np.zeros(d)):
            basis = np.linalg.qr(draw.standard_normal((d, d)))[0]
            v = (basis * spectrum) @ basis.T
            values, axes = whitening.eigenpairs(lambda p: v @ p, d, 4)
            want = np.sort(spectrum)[::-1][:4]
            assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * max(want[0], 1e-300))
            assert np.allclose(axes.T @ axes, np.eye(len(want)), atol=1e-13)
            assert np.linalg.norm(v @ axes - axes * values, axis=0).max() <= 1e-12 * max(want[0], 1e-300)


def test_bit_table_without_rows_on_the_driver(spark, monkeypatch):
    """The table is set in tasks and comes to the driver as bytes, in pieces of a fixed size."""
    for n in (0, 1, 20_000):
        found = spark.range(n).select(F.xxhash64("id").alias("print"), F.lit(10).cast("long").alias("n"))
        prints = np.array([r["print"] for r in found.collect()], np.int64).view(np.uint64)
        with monkeypatch.context() as patched:
            patched.setattr(type(found), "toPandas", lambda self: pytest.fail("all words of the table as rows"))
            bits = collocations.bit_table(found).value
        assert len(bits) * 64 == (1 << 19 if n > 1 else 1 << 16) and collocations.has(bits, prints).all()
        assert sum(int(x).bit_count() for x in bits) == len({int(p) % (len(bits) * 64) for p in prints})


def test_phrases_as_they_stand():
    """Phrases with single spaces are cut out in one piece, the others joined from their words."""
    text = "Aa b  c\td \ud800x é\xff , w\x0bq ü z " * 3
    (_, block), = collocations.blocks(collocations.pd.DataFrame({"text": [text], "lang": ["xx"]}), 64, 1 << 20)
    words = [block.data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(block.starts, block.ends)]
    for size in (1, 2, 3):
        at = block.prints(size)[0]
        assert len(at) and block.phrases(at, size) == [" ".join(words[p:p + size]) for p in at.tolist()]
