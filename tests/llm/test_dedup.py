"""Line, passage, document and byte-level deduplication against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import frame
from vigipanel.llm import hubs, jaccard_join, line_dedup, passages, repeats

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def edited(text, draw, n):
    out = list(text)
    for _ in range(n):
        k = draw.randrange(len(out))
        out[k:k + 1] = draw.choice([[], ["z"], [out[k], "q"]])
    return "".join(out)


def test_banded_distance():
    draw = random.Random(1)
    for edits in (1, 2):
        one = ["".join(draw.choice("ab") for _ in range(draw.randint(6, 12))) for _ in range(400)]
        two = [edited(x, draw, draw.randint(0, 4)) or "ab" for x in one]
        keep = [k for k in range(400) if len(two[k]) > edits]
        one, two = [one[k] for k in keep], [two[k] for k in keep]
        assert line_dedup.within(one, two, edits).tolist() == [distance(a, b) <= edits for a, b in zip(one, two)]


def test_fine_keys():
    from itertools import combinations

    for edits in (1, 2):
        assert all(any(set(t) <= set(c) for t in line_dedup._triples(edits)) for c in combinations(range(6), 6 - edits))
    draw = random.Random(9)
    for _ in range(300):
        one = "".join(draw.choice("abc") for _ in range(draw.randint(79, 90)))
        two = edited(one, draw, draw.randint(1, 2))
        limit = 2 if min(len(one), len(two)) >= 80 else 1
        if one != two and distance(one, two) <= limit:
            a, b = ({(k, r) for k, r in zip(*map(list, line_dedup.fine_keys(x)))} for x in (one, two))
            assert any((k, 0) in b for k, _ in a) or any((k, 0) in a for k, _ in b)


def test_lines(spark, prose, monkeypatch):
    draw = random.Random(5)
    base = [prose(18) for _ in range(6)] + [prose(9) for _ in range(4)]
    lines = base + [edited(x, draw, k) for x in base for k in (1, 2, 3)] + ["short", "short", " padded  ", "padded", "é" * 90, "é" * 89 + "e"]
    draw.shuffle(lines)
    texts = ["\n".join(lines[k:k + 4]) for k in range(0, len(lines), 4)] + [None, "", "\n\n", "x" * 50000]
    docs = frame(spark, texts)
    places = [(d, n, x.strip(" \t\n\x0b\f\r")) for d, t in enumerate(texts) if t for n, x in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]

    def near(a, b):
        limit = next((e for least, e in line_dedup.EDITS if min(len(a), len(b)) >= least), 0)
        return a == b or (abs(len(a) - len(b)) <= limit and max(len(a), len(b)) < 1000 and limit and distance(a, b) <= limit)

    pairs = [(i, j) for i in range(len(places)) for j in range(i) if near(places[i][2], places[j][2])]
    root = groups(len(places), pairs)
    want = {(d, n): root[k] == k for k, (d, n, _) in enumerate(places)}
    for many in (32, 2):
        monkeypatch.setattr(line_dedup, "MANY", many)
        got = {(r["doc_id"], r["line_no"]): r["stays"] for r in line_dedup.classed(docs).collect()}
        assert got == want and not all(got.values())
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    for d, t in enumerate(texts):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((d, n), True))
        if t is None or left == t or left.strip():
            assert kept[d] == left
        else:
            assert d not in kept
    assert line_dedup.deduplicated(docs).columns == docs.columns
    assert line_dedup.counted(docs.where("false")).count() == 0


def test_crowded_lines_meet_on_rare_grams(spark, monkeypatch):
    """Lines that share most of their characters and are no near copies of a hub: the near pairs, not all of them."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    frame_words = [word(7) for _ in range(20)]
    lines = []
    for _ in range(60):
        words = list(frame_words)
        words[draw.randrange(20)] = word(12)
        lines.append(" ".join(words))
    lines += [edited(x, draw, 1 + k % 2) for k, x in enumerate(lines[:12])] + [" ".join(frame_words)]
    lines = list(dict.fromkeys(lines))
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2}
    rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "item long, root long, text string")
    for often in (2, 16):
        monkeypatch.setattr(line_dedup, "OFTEN", often)
        got = {(r["a"], r["b"]) for r in line_dedup.rare_pairs(rows).collect()}
        assert near <= got and 12 <= len(near) and len(got) < 200 < len(lines) * (len(lines) - 1) // 10
    # the whole operator compares no more than that
    tried, near_of = spark.sparkContext.accumulator(0), line_dedup._near

    def counted_near(batches):
        def told():
            for batch in batches:
                tried.add(len(batch))
                yield batch
        yield from near_of(told())

    monkeypatch.setattr(line_dedup, "_near", counted_near)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in line_dedup.classed(docs).where("stays").collect())
    assert got == sorted(set(groups(len(lines), near)))
    assert tried.value < 700


def test_frequent_grams_meet_on_counts(spark):
    """Lines of a few words in many orders, whose short grams are all frequent: near pairs are found, and few others tried."""
    draw = random.Random(3)
    words = "an the retion ouen tistha sting ndea thing other".split()
    base = [draw.choice(words) for _ in range(24)]
    lines = []
    for _ in range(90):
        copy = list(base)
        for at in draw.sample(range(24), 4):
            copy[at] = draw.choice(words)
        lines.append(" ".join(copy))
    lines = list(dict.fromkeys(lines + [edited(x, draw, 1 + k % 2) for k, x in enumerate(lines[:20])]))
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2}
    rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "item long, root long, text string")
    got = {(r["a"], r["b"]) for r in line_dedup.rare_pairs(rows).collect()}
    assert near <= got and 18 <= len(near) and len(got) < 300


@pytest.mark.parametrize("slots", [4, 1 << 18])
def test_lines_hand_on_their_first_grams_only(spark, monkeypatch, slots):
    """Near copies of one long line: no step holds all grams of a line, and no order of the grams loses a near pair."""
    draw = random.Random(15)
    base = "".join(draw.choice("abcdefgh ") for _ in range(90))
    lines = list(dict.fromkeys([base] + [edited(base, draw, 1 + k % 4) for k in range(40)]))
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2}
    rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "item long, root long, text string")
    monkeypatch.setattr(line_dedup, "SLOTS", slots, raising=False)
    sizes, cut = [], line_dedup.cut_lineage

    def told(frame):
        out = cut(frame)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", told)
    got = {(r["a"], r["b"]) for r in line_dedup.rare_pairs(rows).collect()}
    assert near <= got and len(near) > 20
    assert max(sizes) <= (4 * 2 + 1) * len(lines)


def test_pairs_that_counts_of_characters_rule_out():
    draw = random.Random(12)
    one = ["".join(draw.choice("ab é") for _ in range(50)) for _ in range(200)]
    two = [edited(x, draw, draw.randint(0, 3)) for x in one]
    allowed = np.array([k % 3 for k in range(200)])
    good = line_dedup.possible(one, two, allowed)
    assert all(good[k] for k in range(200) if distance(one[k], two[k]) <= allowed[k])
    assert not line_dedup.possible(["aaab"], ["bbba"], np.array([1]))[0]


@pytest.mark.parametrize("buffer", [1, 7, 100_000])
def test_keys_of_probes_only(spark, monkeypatch, buffer):
    monkeypatch.setattr(hubs, "BUFFER", buffer)
    rows = [(1, 3), (1, 5), (1, 7), (2, 3), (2, 5), (3, 8), (3, 3), (4, 9), (4, 4), (4, 5), (5, 2), (6, 6), (6, 6)] + [(7, 2 * k + 1) for k in range(30)]
    batches = [hubs.pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "item": [i for _, i in part]}) for part in [
        x[at:at + 4] for x in [sorted(rows, key=lambda r: (r[0], r[1] & 1, r[1]))] for at in range(0, len(rows), 4)]]

    class Frame:
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            return sorted((r["a"], r["b"], r["many"]) for b in run(iter(batches)) for r in b.to_pylist())

    assert hubs.sharing(Frame(), probes=True) == [(3, 8, False), (4, 4, True), (4, 5, True), (4, 9, True)]


def test_lines_of_rows_that_share_an_id(spark, prose):
    a, b, c, d, e, f = (prose(18) for _ in range(6))
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{c}\n{a}"), (2, f"{d}\n{e}"), (None, f"{f}\n{b}"), (None, f"{d}\nx"), (3, f"{e}z")], "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in line_dedup.deduplicated(docs).collect()}
    assert left == {(1, a), (2, c), (2, e), (None, f"{f}\n{b}"), (None, f"{d}\nx")}
    counts = sorted((r["doc_id"] or 0, r["n_lines"], r["removed"]) for r in line_dedup.counted(docs).collect())
    assert counts == [(0, 2, []), (0, 2, []), (1, 2, [1]), (2, 2, [0]), (2, 2, [1]), (3, 1, [0])]


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_keys_without_order():
    for n in (1, 2, 40, 700):
        elements = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        for band, segments, _ in jaccard_join.schemes(n):
            keys, _, starts, *_ = jaccard_join.segment_keys(elements, band, segments)
            own, held = jaccard_join.own_keys(elements, band, segments)
            assert own.tolist() == keys.tolist() and len(held) == len(starts)


@pytest.mark.parametrize("many", [32, 2])
def test_jaccard(spark, prose, monkeypatch, many):
    monkeypatch.setattr(jaccard_join, "MANY", many)
    draw = random.Random(2)
    common = prose(40)
    texts = [None, "", " ", "one two", "One Two", "a b c d e f g h i", "a b c d e f g h", common]
    for n in (12, 30, 80, 300):
        words = prose(n).split()
        for k in range(4):
            copy = list(words)
            for _ in range(k * n // 60):
                copy[draw.randrange(n)] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(words).upper())
        texts.append(common + " " + " ".join(words))
        texts.append(common + " " + prose(n // 3))
    docs = frame(spark, texts, 100)
    own = sets(texts)
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    root = groups(len(texts), linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(docs).collect()}
    assert got == {100 + k: (len(own[k]), 100 + root[k]) for k in range(len(texts))}
    twice = jaccard_join.joined(docs.union(docs.where("doc_id = 105")))
    assert twice.count() == len(texts) + 1
    assert jaccard_join.joined(docs.where("false")).count() == 0


def _crowd(words, draw, replaced):
    """One copy of a text per entry of ``replaced``, with so many words of its own."""
    out = []
    for k, n in enumerate(replaced):
        copy = list(words)
        for j, at in enumerate(draw.sample(range(len(words)), n)):
            copy[at] = f"own{k}x{j}"
        out.append(" ".join(copy))
    return out


def test_crowds(spark):
    """A few copies with many words of their own stop at another level than the crowd that they link to."""
    draw = random.Random(8)
    texts = _crowd([f"w150x{k}" for k in range(150)], draw, [1] * 100 + [3] * 24)
    own = sets(texts)
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    names = [jaccard_join.class_of(jaccard_join.tk.shingles(t)) for t in texts]
    held = defaultdict(set)
    for f in jaccard_join._first_keys([{"text": texts}]):
        for key, item in zip(f["key"], f["item"]):
            held[key].add(item)
    further = defaultdict(set)
    for f in jaccard_join._further_keys([{"item": names, "text": texts}]):
        for key, item in zip(f["key"], f["item"]):
            further[key].add(item)
    keys = list(held.values()) + list(further.values())
    assert any(a >= 100 for a, _ in linked) and not [(a, b) for a, b in linked if not any(names[a] in x and names[b] in x for x in keys)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.joined(frame(spark, texts)).collect()}
    assert got == dict(enumerate(groups(len(texts), linked)))


def test_hubs_join_weights_once(spark):
    """Rows of crowded keys carry their weights from round to round."""
    many = spark.createDataFrame([(key, item) for key in range(3) for item in range(9)], "key long, item long")
    pairs = spark.createDataFrame([], "a long, b long")
    links, left = hubs.linked(pairs, many, lambda found: found.where("a = 0 AND b < 3"))
    assert left.columns.count("w") == 1 and {r["w"] for r in left.collect()} == {3}
    assert {(r["a"], r["b"]) for r in links.collect()} <= {(0, 1), (0, 2)}


def test_sets_of_several_texts(prose):
    texts = [None, "", " \t", "One", "a b c d", "a b c d e", "É a\x0bb", prose(3000), prose(30), "the " * 50, "x\ny"]
    for size in (4, 5):
        for chunk in (1, 100, 1 << 16):
            got = list(jaccard_join.tk.shingle_sets(texts, size, chunk))
            assert [x.tolist() for x in got] == [jaccard_join.tk.shingles(t, size).tolist() for t in texts]
    assert list(jaccard_join.tk.shingle_sets([])) == []


def test_needed_segments():
    for size in list(range(1, 60)) + [137, 1000, 5000]:
        for partner in range(-(-size * 80 // 100), size * 100 // 80 + 1):
            mine, theirs = ({s[0]: s for s in jaccard_join.schemes(n)} for n in (size, partner))
            shared = set(mine) & set(theirs)
            assert any(min(mine[b][2], theirs[b][2]) >= jaccard_join.allowed(size, partner) and mine[b][1] == theirs[b][1] for b in shared)


@pytest.mark.parametrize("many", [2048, 1])
def test_repeats(spark, prose, many):
    passage, other = prose(90), prose(120)
    texts = [
        None, "", "short", "a" * 1500, "abcde" * 200, prose(60) + passage + prose(80), prose(10) + passage, passage, other + prose(30) + other,
        prose(400), "é" * 450, "x" + "é" * 450, "short",
    ]
    texts.append(texts[9])
    docs = frame(spark, texts)
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + 400] for b in raw for k in range(len(b) - 399))
    got = {r["doc_id"]: r for r in repeats.removed(docs, many=many).collect()}
    for k, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - 399):
            if seen[b[at:at + 400]] > 1:
                gone[at:at + 400] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), gone.sum(), (edges == 1).sum(), kept)
    assert repeats.removed(docs.where("false")).count() == 0


def test_stretches_without_a_loop_over_anchors(prose, monkeypatch):
    """Runs of starting places with one anchor against their definition; no frame per text."""
    for text in [prose(300), "a" * 900, "abcde" * 250, prose(70) + "the " * 300 + prose(80), "é" * 300 + prose(50)]:
        data = text.encode()
        at = np.arange(len(data) - 63)
        grams = repeats.tk.span_hashes(repeats.tk.running(np.frombuffer(data, np.uint8)), at, at + 64)
        want = [max((p for p in range(k, k + 337) if grams[p] == grams[k:k + 337].min())) for k in range(len(data) - 399)]
        first, count, name, _ = repeats.stretches(text)
        got = np.repeat(name, count)
        assert first.tolist() == [k for k in range(len(want)) if not k or want[k] != want[k - 1]] and got.tolist() == repeats.tk.mix(grams[want]).tolist()
    made, frame_of = [], repeats.pd.DataFrame
    monkeypatch.setattr(repeats.pd, "DataFrame", lambda *a, **k: made.append(1) or frame_of(*a, **k))
    texts = [prose(120) for _ in range(40)]
    list(repeats._anchor_rows(400)([{"row": list(range(40)), "text": texts}]))
    wanted = [[{"anchor": 1, "stretch": k, "n": 1, "at": 0, "size": 400, "many": False}] for k in range(40)]
    rows = [r for f in repeats._pick([{"text": texts, "wanted": wanted}]) for r in f.itertuples(index=False)]
    assert len(made) == 2 and [r.data for r in rows] == [t.encode()[:400] for t in texts]


def test_passages(spark, prose):
    passage = prose(70)
    words = passage.split()
    words[35] = "edited"
    texts = [
        None, "", "too short", prose(100) + " " + passage + " " + prose(50), passage + " " + prose(90), prose(120) + " " + " ".join(words), prose(200),
        prose(40) + " " + prose(45), prose(80),
    ]
    texts += [texts[8], prose(30), texts[4]]
    docs = frame(spark, texts)
    found = defaultdict(list)
    for r in passages.passages(docs).collect():
        found[r["doc_id"]].append(r)
    assert set(found) == {3, 4, 5, 8, 9, 11}
    assert {r["class_id"] for d in (3, 5) for r in found[d]} == {3} and {r["class_id"] for d in (8, 9) for r in found[d]} == {8}
    assert any(r["first_word"] <= 100 and r["first_word"] + r["n_words"] >= 170 for r in found[3])
    assert passages.passages(docs.where("false")).count() == 0


@pytest.mark.parametrize("copies", [10, 100])
def test_passages_of_groups(spark, copies):
    """Copies that differ in one word of 70 each link to the common passage only, which is not the first of them."""
    draw = random.Random(6)
    words = [f"w{k}" for k in range(70)]
    texts = [" ".join(words[:at] + [f"own{k}"] + words[at + 1:]) for k, at in enumerate(draw.randrange(22, 48) for _ in range(copies))]
    texts.insert(copies // 2, " ".join(words))
    places = [tuple(r) for r in passages.passages(frame(spark, texts)).select("doc_id", "class_id").collect()]
    words = [passages.tk.sequence_hashes(passages.tk.words(t), 5) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if passages.passages_of(words[a], words[b])]
    own = sets(texts)
    assert all(100 * len(own[k] & own[copies // 2]) >= 80 * len(own[k] | own[copies // 2]) for k in range(len(texts)))
    root = groups(len(texts), linked)
    met = [a for a in range(len(texts)) if a not in {d for d, _ in places}]
    # two of four min-hashes agree with a probability of 0.99 at a similarity of 0.87
    assert set(root) == {0} and len(met) <= 0.04 * copies and {c for _, c in places} == {0}


@pytest.mark.parametrize("inserted", [(25, 2), (20, 1), (40, 2)])
def test_passages_with_insertion(inserted):
    at, n = inserted
    one = [f"w{k}" for k in range(55)]
    two = one[:at] + ["new", "words"][:n] + one[at:]
    x, y = (passages.tk.signed(passages.tk.sequence_hashes(passages.tk.words(" ".join(w)), 5)) for w in (one, two))
    assert 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    assert passages.passages_of(x, y) and passages.aligned(x, y) and passages.aligned(y, x)


def test_compact_windows():
    draw = random.Random(4)
    for n in (5, 40, 200):
        values = np.array([draw.randrange(60) for _ in range(n)], np.uint64)
        got = {tuple(x) for x in passages.compact_windows(values, 6).tolist()}
        want = set()
        for c in range(n):
            left = next((j for j in range(c - 1, -1, -1) if values[j] < values[c]), -1) + 1
            right = next((j for j in range(c + 1, n) if values[j] <= values[c]), n) - 1
            if right - left + 1 >= 6:
                want.add((c, left, right))
        assert got == want


def _windows_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["item", "text"])
    rows = np.concatenate([np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1) for b in passages._windows([batch])])
    return rows[:, [1, 0, 2, 3, 4]]          # item, key, c, l, r


def test_windows_of_several_texts(prose):
    """Texts worked on together have the windows of each alone."""
    texts = [prose(300), None, "short", "the " * 400, prose(50), "", prose(49), prose(700)]
    rows = _windows_of(texts)
    for k, text in enumerate(texts):
        tokens = passages.tk.sequence_hashes(passages.tk.words(text), 5)
        want = set()
        for f in range(passages.HASHES if len(tokens) >= passages.LEAST else 0):
            want |= {(f, *x) for x in passages.compact_windows(passages.tk.mix(tokens ^ passages._SEEDS[f:f + 1])).tolist()}
        assert {(x[1] & 3, *x[2:]) for x in rows[rows[:, 0] == k].tolist()} == want


def test_places_of_repeating_texts(prose, monkeypatch):
    """The stretches of a key that overlap in a text make one place, so a text that repeats itself makes no product of them."""
    passage = prose(60)
    texts = ["the " * 400, prose(100) + " the" * 300, prose(200), " ".join([passage] * 9), passage]
    rows = _windows_of(texts)
    want = defaultdict(list)
    for item in range(len(texts)):
        own = rows[rows[:, 0] == item].tolist()
        for _, kx, cx, lx, rx in own:
            for _, ky, cy, ly, ry in own:
                low, high = max(lx, ly), min(rx, ry)
                if kx & 3 < ky & 3 and low <= min(cx, cy) and max(cx, cy) <= high and high - low + 1 >= passages.LEAST:
                    want[item, kx, ky].append((low, high, min(cx, cy), max(cx, cy)))
    for chunk in (1 << 20, 100):
        monkeypatch.setattr(passages, "_PAIRS", chunk)
        places = passages._places(rows)
        assert places[:, 6].sum() == sum(map(len, want.values())) and len({tuple(x) for x in places[:, :2].tolist()}) == len(want)
    assert [x[2:4] + x[6:] for x in places[places[:, 1] == 0].tolist()] == [[0, 395, 351]] * 6
    hits = passages._meet(places[np.lexsort((places[:, 1], places[:, 0]))])
    assert len({tuple(x[:2]) for x in passages._regions(hits[hits[:, 6] == 0][:, :6]).tolist()}) == 1 and (hits[:, 6] > passages.MANY).sum() >= 12


def test_regions_in_any_order():
    """Merging hits before gives the same regions, and none of a pair overlap in both texts."""
    draw = np.random.default_rng(5)
    low = draw.integers(0, 400, (300, 2))
    hits = np.column_stack((draw.integers(0, 3, 300), np.full(300, 9), low[:, 0], low[:, 0] + 46, low[:, 1], low[:, 1] + 46))
    whole = {tuple(x) for x in passages._regions(hits).tolist()}
    parts = np.concatenate([passages._regions(hits[draw.permutation(300)[:200]]), hits])
    assert {tuple(x) for x in passages._regions(parts).tolist()} == whole
    boxes = np.array(sorted(whole))
    for k, box in enumerate(boxes):
        met = passages._overlapping(boxes, box) & (boxes[:, 0] == box[0])
        assert met.sum() == 1 and met[k]


def test_pairs_left_over(spark, prose):
    """Leftover pairs without enough common shingles are not verified; no pair with a passage is dropped."""
    common, passage = prose(20), prose(70)
    texts = [prose(60) + " " + common + " " + prose(60) for _ in range(6)]
    texts += [prose(30) + " " + passage + " " + prose(40), passage, "the " * 80, "the " * 60 + common, " ".join(passage.split()[:30] + ["new"] + passage.split()[30:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "item long, text string")
    words = [passages.tk.sequence_hashes(passages.tk.words(t), 5) for t in texts]
    many = spark.createDataFrame([(0, k, 0, len(w) - 1) for k, w in enumerate(words)], "key long, item long, low int, high int")
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    want = {(a, b) for a, b in pairs if passages.passages_of(words[a], words[b])}
    got = {tuple(r) for r in passages._likely(docs, many, spark.createDataFrame(pairs, "a long, b long"), docs.select("item")).collect()}
    assert want and want <= got and not [(a, b) for a, b in got if a < 6 and b < 6]


def test_jaccard_without_ids(spark, prose):
    a, b = prose(60), prose(60)
    docs = spark.createDataFrame([(None, a), (7, a + " more"), (None, b), (None, b + " x"), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.joined(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 7), (7, 7), (9, 9)]
