"""The operators beyond SQL against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import minhash, suffix_dedup
from weft.llm.components import components
from weft.llm.decontaminate import LEAST, WINDOW, contamination, decontaminate, masks_of, needed
from weft.llm.lm_score import lm_scores
from weft.llm.packing import _Trial, best_fit, cost_of, pack
from weft.llm.quality import keep_quality, quality_scores, train_quality
from weft.llm.toxicity import BlockMaxIndex, toxicity_scores, train_toxicity
from weft.llm.words import hashed_words, shingles

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge shore tundra urban vale woods yonder zephyr".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def test_hashed_words_and_shingles():
    texts = ["One two, three", "", "four", "two one " * 5, "ÀÉ z"]
    h, at = hashed_words(pa.array(texts))
    plain = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    seen = {}
    for w, x in zip([w for p in plain for w in p], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    _, s_at = shingles(h, at)
    assert np.diff(s_at).tolist() == [1, 0, 1, 6, 1]


# Suffix dedup


def removed_by_hand(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup(table, most):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (40, 60, 200)]
    rows = [(i, prose(rng, rng.randint(0, 60)) + passages[i % 3][rng.randint(0, 80) :] + prose(rng, rng.randint(0, 60))) for i in range(24)]
    rows += [(30, "a" * 500), (31, "a" * 150), (32, "ab" * 300), (33, None), (34, ""), (35, rows[0][1]), (None, passages[2]), (36, "é" * 130), (36, passages[0]), (37, passages[2] * 3)]
    got = suffix_dedup.suffix_dedup(table(rows), most=most).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed_by_hand(rows, 200)


def test_suffix_dedup_long_text(table, monkeypatch):
    """A text longer than a segment is cut without losing windows; strings repeat across segments."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    find = suffix_dedup._find_anchors(200)
    rng = random.Random(5)
    text = "".join(rng.choice("abcd") for _ in range(7000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text], pa.binary())], ["key", "key2", "bytes"])
    places = {(p, g, c) for b in find([batch]) for p, g, c in zip(b["place"].to_pylist(), b["gram"].to_pylist(), b["context"].to_pylist(), strict=True)}
    _, place, _, _, gram, context = suffix_dedup._anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200)
    assert places == set(zip(place.tolist(), gram.view(np.int64).tolist(), context.view(np.int64).tolist(), strict=True))
    assert suffix_dedup.suffix_dedup(table([])).count() == 0


def test_suffix_dedup_at_cuts(table, monkeypatch):
    """Each anchor of a text longer than a segment comes once, and nothing is removed for being near a cut."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (9000, 7050, 3000, 500)]
    data = texts[0].encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data], pa.binary())], ["key", "key2", "bytes"])
    places = [p for b in suffix_dedup._find_anchors(200)([batch]) for p in b["place"].to_pylist()]
    assert sorted(places) == sorted(suffix_dedup._anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 200)[1].tolist())
    # Repeats that lie across cuts, in one text and in two.
    rows = list(enumerate([*texts, texts[1][:4000] + texts[0][1850:2150] + texts[2][900:1200] + texts[1][4000:4100]]))
    rows[3] = (3, texts[3] + texts[2][1990:2210])
    got = suffix_dedup.suffix_dedup(table(rows)).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed_by_hand(rows, 200)


# Near duplicates


def jaccard_classes(rows, weighted=True):
    """Classes by the Jaccard similarity of multisets (or sets) of runs of five words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        runs = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        sets.append(runs if weighted else Counter(set(runs)))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        union = (sets[a] | sets[b]).total()
        if not union or (sets[a] & sets[b]).total() / union >= 0.8:
            root[find(b)] = find(a)
    return [find(k) for k in range(len(rows))], sets


def near_rows():
    rng = random.Random(11)
    rows = []
    for base in range(6):
        words = prose(rng, 150).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One  two!"), (104, "three"), (None, rows[0][1]), (105, rows[3][1]), (105, rows[3][1])]
    # The same runs, but not as often; and two texts that differ in what a repeated part outweighs.
    part, other = prose(rng, 30), prose(rng, 25)
    rows += [(110, f"{part} " * 2), (111, f"{part} " * 5), (112, f"{part} " * 50 + other), (113, f"{part} " * 50 + prose(rng, 25))]
    # Rows that share an id, and are near copies.
    rows += [(114, rows[2][1] + " end"), (114, rows[2][1] + " stop")]
    return rows


def test_near_duplicates(table):
    rows = near_rows()
    for rounds, weighted in ((0, False), (0, True), (2, True)):
        classes, _ = jaccard_classes(rows, weighted)
        want = {}
        for (i, _), c in zip(rows, classes, strict=True):
            want.setdefault(c, []).append(i)
        expected = sorted((i, min((x for x in want[c] if x is not None), default=None), len(want[c])) for (i, _), c in zip(rows, classes, strict=True) if i is not None)
        got = minhash.near_duplicates(table(rows), rounds=rounds, weighted=weighted).collect()
        assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in got if r["doc_id"] is not None) == expected
    kept = minhash.drop_near_copies(table(rows).withColumn("class_id", F.lit(0)))
    assert kept.columns == [*table(rows).columns, "class_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in expected})
    assert minhash.near_duplicates(table([])).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_jaccard(weighted):
    rng = np.random.default_rng(2)
    e = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = np.ones(200), np.ones(200)
    if weighted:
        wa, wb = rng.uniform(0.2, 4, 200), rng.uniform(0.2, 4, 200)
    k = 2000
    sig = minhash.signatures(np.concatenate([e[:200], e[100:]]), np.concatenate([wa, wb]), np.array([0, 200, 400]), k)
    shared = np.minimum(wa[100:], wb[:100]).sum()
    truth = shared / (wa.sum() + wb.sum() - shared)
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / k)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for p in edges for x in p}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in ends}


# Packing


def least_cost(lengths, caps):
    """The cost of the best packing, by trying all."""
    best = [math.inf]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(cost_of(c) for c in caps if c >= b) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= max(caps):
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_best_fit_against_all_packings():
    """Near the optimum, never over the optimum of one size by much, and cheaper than one size with the same rules."""
    rng = random.Random(40)
    caps = (512, 1024, 2048, 4096)
    chosen, best, alone = 0.0, 0.0, 0.0
    for _ in range(60):
        lengths = sorted((rng.choice([rng.randint(1, 512), rng.randint(200, 1500), rng.randint(1000, 4096)]) for _ in range(rng.randint(1, 7))), reverse=True)
        bins, places, sizes = best_fit(lengths, caps)
        used = Counter()
        for b, at, n in zip(bins, places, lengths, strict=True):
            assert at == used[b]
            used[b] += n
        assert all(used[b] <= sizes[b] for b in used)
        got, want = sum(map(cost_of, sizes)), least_cost(lengths, caps)
        assert want - 1e-6 <= got <= 1.5 * want
        chosen, best, alone = chosen + got, best + want, alone + sum(map(cost_of, best_fit(lengths, caps[-1:])[2]))
    assert chosen <= 1.06 * best and chosen < 0.8 * alone


def test_best_fit_uses_every_size():
    rng = random.Random(41)
    lengths = sorted((min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)), reverse=True)
    sizes = Counter(best_fit(lengths)[2])
    assert set(sizes) == {512, 1024, 2048, 4096}
    opened = Counter(best_fit(lengths, (4096,))[2])
    assert sum(cost_of(c) * n for c, n in sizes.items()) < sum(cost_of(c) * n for c, n in opened.items())
    # The trial takes runs of equal lengths at once, and gives what piece by piece gives.
    trial = _Trial(lengths)
    for k in range(0, 3000, 97):
        for cap in (512, 1024, 2048, 4096):
            if cap >= lengths[k]:
                room = cap - lengths[k]
                for n in lengths[k + 1 :]:
                    room -= n if n <= room else 0
                assert trial.fill(k, cap) == cap - room


def test_pack_deals_rows_that_share_an_id(table):
    rows = [(None, "one two three four five")] * 4000
    shards = {r["shard"]: r["n"] for r in pack(table(rows), shard_tokens=1000).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert len(shards) == 20 and max(shards.values()) < 300


def test_best_fit_and_pack(table):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 30, 200, 700]))) for i in range(150)] + [(None, "one two"), (200, None), (201, "  \n "), (7, "again"), (202, prose(rng, 3000))]
    got = pack(table(rows), capacities=(128, 256, 512), shard_tokens=8000).collect()
    want = Counter()
    for i, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        want[i] += n
    seen = Counter()
    spans = {}
    for r in got:
        seen[r["doc_id"]] += r["n_tokens"]
        spans.setdefault((r["shard"], r["bin"], r["capacity"]), []).append((r["place"], r["n_tokens"]))
    assert seen == Counter({k: v for k, v in want.items() if v})
    assert len({k[:2] for k in spans}) == len(spans) and len({k[0] for k in spans}) > 1
    for (_, _, cap), parts in spans.items():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= cap and not any(at <= c < cap for c in (128, 256, 512))
    assert pack(table([])).count() == 0


# Decontamination


def test_masks_lose_no_window():
    """Whatever permitted words of a window differ, some mask lies on words that agree."""
    for window in range(1, WINDOW + 1):
        for gone in itertools.combinations(range(window), window - needed(window)):
            assert any(all(o + k not in gone for k, bit in enumerate(m) if bit == "1") for m in masks_of(window) for o in range(window - len(m) + 1))


def windows_by_hand(docs, items):
    """{(document, item): best share of words that agree}."""
    out = {}
    for (i, t), (j, u) in itertools.product(docs, items):
        w, v = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (t, u))
        size = min(WINDOW, len(v))
        agree = [sum(a == b for a, b in zip(w[p : p + size], v[q : q + size], strict=True)) for p in range(len(w) - size + 1) for q in range(len(v) - size + 1) if size]
        if agree and max(agree) >= LEAST * size - 1e-9:
            out[i, j] = max(agree)
    return out


@pytest.mark.parametrize("length", range(1, 15))
def test_contamination_at_each_length(spark, table, length):
    """Every permitted pattern of substitutions in an item of each length, and every pattern with one more."""
    names = [f"w{k}" for k in range(400)]
    rng = random.Random(length)
    item = [names[k] for k in rng.sample(range(300), length)]
    window = min(WINDOW, length)
    docs = []
    for size in (window - needed(window), window - needed(window) + 1):
        for gone in itertools.islice(itertools.combinations(range(window), size), 0, None, 1 if size < 3 else 7):
            docs.append((len(docs), " ".join([names[300 + len(docs) % 90], *("other" if k in gone else x for k, x in enumerate(item[:window])), "tail"])))
    items = [(1, " ".join(item))]
    got = {(r["doc_id"], r["item_id"]): r["agree"] for r in contamination(table(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == windows_by_hand(docs, items)


def test_contamination_of_repeated_words(spark, table):
    """Long texts of one word, or of a short period, are no product of places."""
    docs = [(1, "same " * 200_000), (2, "one two three " * 60_000), (3, "same " * 12), (4, "one three two " * 40)]
    items = [(1, "same " * 2000), (2, "one two three " * 700), (3, "same same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["agree"], r["word"], r["item_word"]) for r in contamination(table(docs), bench).collect()}
    assert got == {(1, 1): (13, 0, 0), (1, 3): (2, 0, 0), (2, 2): (13, 0, 0), (3, 3): (2, 0, 0)}


def test_contamination(spark, table):
    rng = random.Random(9)
    names = [f"w{k}" for k in range(500)]
    items = [(k, prose(rng, n, names)) for k, n in enumerate((13, 20, 40, 60, 14, 9, 3))]
    docs = []
    for k in range(40):
        words = prose(rng, 60, names).split()
        item = items[k % 7][1].split()
        cut = item[rng.randint(0, max(0, len(item) - 20)) :][: rng.randint(8, 20)]
        for _ in range(k % 4):
            cut[rng.randrange(len(cut))] = "zz"
        docs.append((k, " ".join(words[:30] + (cut if k % 3 else []) + words[30:])))
    docs += [(90, None), (91, ""), (None, items[2][1]), (92, items[3][1].upper().replace(" ", ", "))]
    bench = spark.createDataFrame([*items, (8, "not there"), (9, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["agree"] for r in contamination(table(docs), bench).collect()}
    assert found == windows_by_hand(docs, items)
    clean = decontaminate(table(docs), bench)
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if i not in {d for d, _ in found}), key=repr)
    assert contamination(table([]), bench).count() == contamination(table(docs), bench.limit(0)).count() == 0
    assert decontaminate(table(docs), bench.limit(0)).count() == len(docs)


# Language models


def lm_by_hand(rows, is_target, vocab_size=None):
    """(id, tokens, losses, difference) of each row by plain counting."""
    texts = [(i, re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows]
    count = Counter(w for _, t in texts for w in t)
    if vocab_size:
        hashes = {w: int(hashed_words(pa.array([w]))[0].view(np.int64)[0]) for w in count}
        vocab = set(sorted(count, key=lambda w: (-count[w], hashes[w]))[: vocab_size - 1])
        texts = [(i, [w if w in vocab else 0 for w in t]) for i, t in texts]
    size = vocab_size or len(count) + 1
    models = []
    for m in (True, False):
        mine = [t for i, t in texts if is_target(i) == m]
        models.append((Counter(p for t in mine for p in zip([None, *t][:-1], t, strict=True)), Counter(w for t in mine for w in t), Counter(w for t in mine for w in [None, *t][:-1] if t)))
    tokens = [sum(m[1].values()) for m in models]
    scale = [min((x for x in tokens if x), default=1) / max(n, 1) for n in tokens]
    out = []
    for i, t in texts:
        ce = []
        for k, (pairs, words, contexts) in enumerate(models):
            mine = is_target(i) == (k == 0)
            own, own_context = Counter(zip([None, *t][:-1], t, strict=True)), Counter([None, *t][:-1])
            loss = 0.0
            for a, b in zip([None, *t][:-1], t, strict=True):
                uni = (scale[k] * words[b] + 1) / (scale[k] * tokens[k] + size)
                loss -= math.log((scale[k] * (pairs[a, b] - mine * own[a, b]) + 8 * uni) / (scale[k] * (contexts[a] - mine * own_context[a]) + 8))
            ce.append(loss / max(1, len(t)))
        out.append((i, len(t), *ce, ce[1] - ce[0]))
    return sorted(out, key=repr)


def same_scores(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-4)


def is_odd(i):
    return i is not None and i % 2 == 1


def test_lm_scores(table):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40, WORDS[:12] if i % 2 else WORDS[8:])) for i in range(40)] + [(50, None), (51, ""), (None, "amber birch")]
    same_scores(lm_scores(table(rows), F.col("doc_id") % 2 == 1, vocab_size=16).collect(), lm_by_hand(rows, is_odd, 16))
    same_scores(lm_scores(table(rows), F.lit(False)).collect(), lm_by_hand(rows, lambda i: False))
    assert lm_scores(table([]), F.lit(True), vocab_size=16).count() == 0


@pytest.mark.parametrize("bucket_tokens", [10, 60, 1 << 19])
def test_lm_scores_count_every_word(table, bucket_tokens):
    """More distinct words than any fixed table: each has counts of its own, heavy or not."""
    rng = random.Random(18)
    names = [f"w{k}" for k in range(6000)]
    rows = [(i, " ".join([*names[i * 100 : i * 100 + 100], prose(rng, 30), prose(rng, 15, names[:40])])) for i in range(60)] + [(60, None), (61, "w1"), (None, "amber w7"), (7, "amber amber amber"), (63, "amber birch " * 400)]
    same_scores(lm_scores(table(rows), F.col("doc_id") % 3 == 1, bucket_tokens=bucket_tokens).collect(), lm_by_hand(rows, lambda i: i is not None and i % 3 == 1))


def test_lm_scores_tell_copies_from_single_texts(table):
    """A text is not known to a model by itself, but by another that is like it."""
    rng = random.Random(28)
    names = [f"v{k}" for k in range(900)]
    rows = [(i, prose(rng, 40, names)) for i in range(40)]
    rows += [(100 + k, rows[k][1]) for k in (3, 8)]
    got = {r["doc_id"]: r["ce_background"] for r in lm_scores(table(rows), F.col("doc_id") == 1).collect()}
    assert max(got[i] for i in (3, 8, 103, 108)) < min(v for i, v in got.items() if i not in (3, 8, 103, 108))


# Classifiers


def test_block_max_is_exact():
    rng = np.random.default_rng(6)
    vocab = np.sort(rng.integers(1, 1 << 62, 80).astype(np.uint64))
    rows = [(np.sort(rng.choice(vocab, rng.integers(1, 12), replace=False)), None) for _ in range(400)]
    rows = [(h, rng.integers(1, 4, len(h))) for h, _ in rows]
    index = BlockMaxIndex(vocab, rng.uniform(1, 5, 80), rows)
    dense = np.zeros((400, 80))
    for k, (h, c) in enumerate(rows):
        at, w = index.vector(h, c)
        dense[k, at] = w
    for k in range(0, 400, 7):
        at, w = index.vector(*rows[k])
        near, cosine = index.nearest(at, w, 10)
        truth = dense @ dense[k]
        assert np.allclose(np.sort(truth[truth > 0])[::-1][: len(near)], cosine)
        assert np.allclose(truth[near], cosine)


def test_toxicity(spark, table):
    rng = random.Random(12)
    bad = ["slurry", "gripe", "venom", "spite"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        words = prose(rng, 60).split()
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "venom and spite"), (902, "Spite! " * 3000)]
    labels += [(None, 1), (0, 0), (5, None)]
    model = train_toxicity(table(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), max_clean=100)
    got = {r["doc_id"]: r for r in toxicity_scores(table(rows), model).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["predicted"] == (i % 6 == 0) for i in range(200, 300)) >= 98
    assert got[902]["predicted"] == 1 and got[None]["predicted"] == 1 and got[900]["score"] == got[901]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[902]["evidence"] and all(e["id"] < 200 for e in got[902]["evidence"])
    none = train_toxicity(table(rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity_scores(table(rows), none).count() == len(rows)
    assert toxicity_scores(table([]), model).count() == 0


def test_toxicity_small_and_rare(spark, table):
    """Few examples, and fewer in a rare language: no word is certain to depend on the label, and every text has neighbours."""
    rng = random.Random(21)
    other = ["anker", "birke", "zeder", "delta2", "glut", "furt", "hain", "heide"]
    rows, labels = [], []
    for i in range(40):
        toxic, rare = i % 4 == 0, i % 10 in (4, 8, 9)
        words = prose(rng, 20, other if rare else WORDS).split() + [f"x{i}"]
        words += ["gift", "hass"] if toxic and rare else ["venom", "spite"] if toxic else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(100, prose(rng, 20, other) + " gift hass"), (101, prose(rng, 20, other)), (102, prose(rng, 20, WORDS))]
    model = train_toxicity(table(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), k=4)
    got = {r["doc_id"]: r for r in toxicity_scores(table(rows), model).collect()}
    assert all(r["evidence"] for r in got.values())
    assert got[100]["score"] > got[101]["score"]
    vectors = [model.index.vector(*np.unique(hashed_words(pa.array([t]))[0], return_counts=True)) for _, t in rows]
    for (near, cosine), v in zip(model.index.nearest_many(vectors, 4), vectors, strict=True):
        assert near.tolist() == model.index.nearest(*v, 4)[0].tolist() and np.allclose(cosine, model.index.nearest(*v, 4)[1])


def test_quality(spark, table):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        text = prose(rng, 60).upper().replace(" ", "!! ") if junk else prose(rng, 60)
        rows.append((i, text, "en", f"s{i % 3}"))
        if i < 150:
            labels.append((i, int(not junk)))
    rows += [(900, None, None, None), (901, "", "en", "s1"), (None, prose(rng, 50), "en", "s2")]
    labels += [(None, 1), (3, None), (1, 0)]
    docs = table(rows).withColumn("_score", F.lit("clash")).withColumn("_y", F.lit(1))
    model = train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["predicted"] for r in quality_scores(docs.drop("_score", "_y"), model).collect()}
    assert len(got) == len(rows) and sum(got[i] == int(i % 5 != 0) for i in range(150, 300)) >= 147
    kept = keep_quality(docs.drop("_score"), model)
    assert kept.columns == docs.drop("_score").columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in got.items() if p}
    assert quality_scores(table([]), model).count() == 0
