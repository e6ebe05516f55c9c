"""Decontamination, mixing, toxicity and the pipeline against plain versions."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.conftest import frame
from vigipanel.llm import decontamination, mixing, queries, toxicity

ITEMS = [
    (1, "Anna bought 12 apples and 30 pears for 5 dollars on monday morning before the market closed."),
    (2, "a train leaves the station at noon and arrives in the evening after many stops"),
    (3, "too few"), (4, None), (5, "exactly five words stand here"),
]


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_WINDOWS, 0])
def test_leaks(spark, prose, limit):
    benchmark = spark.createDataFrame([(k, t, "clash") for k, t in ITEMS], "item_id long, text string, doc_id string")
    texts = [
        None, "", prose(30), prose(10) + " " + ITEMS[0][1] + " " + prose(10), ITEMS[1][1].upper(),
        "so Peter bought 7 apples and 45 pears for 9 dollars on monday morning before the market closed.",
        "a train leaves the station at noon", "we say exactly five words stand here today", "too few", "1 2 3 4 5 6 7 8 9 10 11 12",
    ]
    docs = frame(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, benchmark, broadcast_windows=limit).collect()}
    assert set(got) == {(3, 1), (4, 2), (5, 1), (7, 5)}
    assert got[3, 1]["exact"] and not got[5, 1]["exact"] and got[5, 1]["n_changed"] >= 3
    assert decontamination.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.where("false")).count() == 0


def test_slots_must_agree(spark):
    benchmark = spark.createDataFrame([(1, "take 5 of them and then give 5 more to her and keep 5 for later on")], "item_id long, text string")
    docs = frame(spark, ["take 8 of them and then give 8 more to her and keep 8 for later on", "take 8 of them and then give 9 more to her and keep 7 for later on"])
    assert [r["doc_id"] for r in decontamination.contaminated(docs, benchmark).collect()] == [0]


def test_leaks_with_a_word_more_or_less(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [words[:20] + ["more"] + words[20:], words[:20] + words[21:], words[:8] + ["far"] * 40 + words[30:], words]
    got = {r["doc_id"]: r for r in decontamination.contaminated(frame(spark, [" ".join(t) for t in texts]), benchmark).collect()}
    assert {k: (r["n_matched"], r["exact"]) for k, r in got.items()} == {0: (26, False), 1: (25, False), 3: (33, True)}


def _plain_exponent(tokens, budget, entropy, repeats):
    share = np.array(tokens) / sum(tokens)

    def at(e):
        w = share ** e
        w = w / w.sum()
        return -(w * np.log(w)).sum(), (w * budget / share).max()

    grid = np.linspace(0, 1, 20001)
    flat = max((e for e in grid if at(e)[0] >= entropy * math.log(len(tokens)) - 1e-12), default=0)
    return max(flat, min((e for e in grid if at(e)[1] <= repeats), default=1.0))


def test_exponent(spark):
    for tokens in ([900, 50, 50], [10, 10], [5000, 40, 30, 1]):
        sources = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(tokens)], "source string, tokens long")
        got = mixing.exponent(sources, 1.0, 0.9, 3.0)
        assert abs(got - _plain_exponent(tokens, 1.0, 0.9, 3.0)) < 2e-4


def test_mixture(spark, prose):
    rows = [(k, prose(20 + k % 17), s) for k, s in enumerate(["a"] * 200 + ["b"] * 30 + [None] * 10)] + [(999, None, "a"), (998, " ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS block", "1 AS tokens")
    out = mixing.mixed(docs).collect()
    size, used = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    for r in out:
        used[r["source"]] += r["n_tokens"] * r["copies"]
    total = sum(size.values())
    e = _plain_exponent([size[s] for s in size], 1.0, mixing.LEAST_ENTROPY, mixing.MOST_REPEATS)
    z = sum((n / total) ** e for n in size.values())
    for s, n in size.items():
        quota = (n / total) ** e / z * total
        assert quota - 40 < used[s] <= quota + 0.002 * total
    for s in size:
        copies = {r["copies"] for r in out if r["source"] == s}
        assert max(copies) - min(copies) <= 1
    again = sorted((r["doc_id"], r["copies"]) for r in mixing.mixed(docs.repartition(5)).collect())
    assert again == sorted((r["doc_id"], r["copies"]) for r in out) and not {998, 999} & {r["doc_id"] for r in out}
    assert mixing.mixed(docs.where("false")).count() == 0


def test_transducers():
    lexicon = {"fool$": 2.0, "scumb": 3.0}
    heads = toxicity._heads(lexicon)

    def kinds(text):
        found = toxicity.matches(text, lexicon, heads)
        return {k for k, v in zip(toxicity.KINDS, found) if v > 0}

    assert kinds("what a fool") == {"plain"} and kinds("you are a fool") == {"directed"} and kinds("he is not a fool, ok") == {"negated"}
    assert kinds('it was "fool" there') == {"reported"} and kinds("scumbags all") == {"plain"} and kinds("foolish") == set()
    assert kinds("i will kill you") == {"threat_directed"} and kinds("she is here. a fool") == {"plain"} and kinds(None) == set()


def test_toxicity(spark, prose):
    bad = ["idiot", "moron", "trash"]
    texts = [prose(40) + (f" {bad[k % 3]} {bad[(k + 1) % 3]} " if k % 4 == 0 else " ") + prose(40) for k in range(240)] + [None, "", "x" * 40000]
    docs = frame(spark, texts).withColumn("toxic", toxicity.F.lit("clash"))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    assert len(rows) == 243
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["doc_id"] < 240 and r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1
    empty = toxicity.fitted(docs, labels.where("false"))
    assert {round(r["score"], 6) for r in toxicity.scored(docs, empty).collect()} == {0.5}
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fitted(docs, flipped) == toxicity.fitted(docs, labels)


def test_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline(spark):
    import corpus_pipeline as p
    from vigipanel.llm import jaccard_join

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    stages = dict(p.STAGES)
    assert 4 <= len(p.STAGES) <= 5
    larger = SMALL.replace("0.001", "0.01")      # enough labels to learn from
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    clean = stages["toxicity"](spark, spark.read.parquet(f"{larger}/documents.parquet"), larger)
    left = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert sum(d not in left for d, y in labels.items() if y) >= 0.4 * sum(labels.values())
    assert sum(d not in left for d, y in labels.items() if not y) <= 0.02 * len(labels) and clean.columns == docs.columns
    lined = p.cut_lineage(stages["line dedup"](spark, docs, SMALL))
    lines = [x.strip() for r in lined.collect() for x in r["text"].split("\n") if x.strip()]
    assert len(lines) == len(set(lines)) and lined.columns == docs.columns
    single = p.cut_lineage(stages["n-gram Jaccard join"](spark, docs, SMALL))
    ids = {r["doc_id"] for r in single.collect()}
    assert ids == {r["component_id"] for r in jaccard_join.joined(docs).collect()}
    pure = stages["benchmark decontamination"](spark, docs, SMALL)
    items = [r["text"].lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in docs.collect() if any(t in r["text"].lower() for t in items)}
    assert gone and {r["doc_id"] for r in pure.collect()} == {r["doc_id"] for r in docs.collect()} - gone
    out = p.run(spark, SMALL)
    assert out.count() > 50 and out.where("copies < 1").isEmpty()
    docs.unpersist()


def test_stages_keep_what_is_not_their_own(spark, prose, tmp_path):
    """Shared and missing doc_ids, repeated rows, empty texts, clashing columns: nothing unrelated goes."""
    import corpus_pipeline as pipe

    spark.createDataFrame([(1, prose(40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    one, two, three = prose(60), prose(60), prose(60)
    texts = [(1, one), (2, one + " more"), (2, two), (None, three), (None, three + " again"), (None, two + " x"), (5, None), (6, ""), (7, " \n"), (8, prose(30)), (8, prose(30))]
    texts.append(texts[-1])
    rows = [(i, t, "en", "s", None if t is None else len(t), "a", 1, None, 2) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, removed string, gone_row long, row string, item long")
    kept = pipe.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    left = [(1, one), (2, two), (5, None), (6, ""), (7, " \n"), texts[-3], texts[-2], texts[-1]]
    assert [x for x in got if x[1] not in (three, three + " again")] == sorted(left, key=repr) and len(got) == len(left) + 1
    item = spark.read.parquet(str(tmp_path / "benchmark.parquet")).first()["text"]
    leaky = docs.union(spark.createDataFrame([(2, item, "en", "s", 1, "a", 1, None, 2)], docs.schema))
    assert sorted(map(repr, pipe.drop_leaks(spark, leaky, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))
    lines = pipe.drop_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and {r["doc_id"] for r in lines.where("doc_id >= 5").collect()} == {5, 6, 7, 8}
    for stage in (pipe.drop_lines, pipe.drop_near_copies, pipe.drop_leaks):
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_lines_of_repeated_rows_count_once(spark):
    from vigipanel.llm import line_dedup

    table = spark.createDataFrame([(1, "first line\nsecond line")] * 2 + [(2, "second line\nthird")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in line_dedup.counted(table).collect()}
    assert got == {1: (2, 0, []), 2: (2, 1, [0])}
