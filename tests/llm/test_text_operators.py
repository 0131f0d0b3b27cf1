"""Text operators against brute force on the awkward cases and on empty tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from riskloom.llm import minhash, mixing, packing, passages, ppm, quality, suffix
from riskloom.llm.catalog import tokenizer_path
from riskloom.llm.text import mix64

from .cases import documents, frame

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- suffix dedup

def removed_by_hand(rows, length=100):
    texts = [(i if i is not None else 2**63, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, t in texts:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (i, s):
                gone[s : s + length] = True
        runs = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((None if i == 2**63 else i, len(t), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_equals_brute_force(spark):
    got = sorted((tuple(r) for r in suffix.remove_repeats(frame(spark)).collect()), key=str)
    assert got == removed_by_hand(documents())
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_sorter_classes(seed):
    rng = random.Random(seed)
    unit = bytes(rng.choice(b"ab" if seed % 2 else b"abcdef ") for _ in range(250))
    data = b"".join(unit[(a := rng.randrange(0, 140)) : a + rng.randrange(100, 111)] for _ in range(20)) + b"a" * 400
    starts = np.arange(len(data) - 99)
    classes = suffix.SuffixSorter().classes(np.frombuffer(data, np.uint8), starts)
    by_text, by_class = {}, {}
    for s in starts:
        text = data[s : s + 100]
        assert by_text.setdefault(text, classes[s]) == classes[s]
        assert by_class.setdefault(classes[s], text) == text


def test_difference_cover_holds_every_difference():
    for v in (7, 16, 32):
        cover = suffix.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


# --- MinHash near-dedup

def test_near_duplicates(spark):
    rows = minhash.near_duplicates(frame(spark)).collect()
    assert len(rows) == len(documents())
    group = collections.defaultdict(set)
    for r in rows:
        group[r.doc_id].add(r.class_id)
    for i in (1, 2, 3, 10):  # copies and a near copy
        assert group[i] == {1}
    for i in (4, 5, 6, 7, 8, 11):  # empty texts and texts that only share a passage stay alone
        assert group[i] == {i}
    kept = collections.Counter((r.class_id) for r in rows if r.kept)
    assert kept[1] == 1 and sum(r.kept for r in rows if r.doc_id in (1, 2, 3, 10)) == 1
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_bucket_rounds_link_near_copies_of_one_text(spark):
    """Forty edits of a text, few alike to the smallest id: all are one group, whatever the leaders."""
    rng = random.Random(1)
    base = documents()[0][1].split()
    rows = [(100, " ".join(base), "en", "a")]
    for i in range(40):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "a"))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_near_duplicates_make_components_twice_at_most(spark, monkeypatch):
    """Leaders, small buckets and blocks: the passes over all edges do not grow with the leaders."""
    calls, made = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges: calls.append(1) or made(edges))
    rng = random.Random(1)
    base = documents()[0][1].split()
    rows = [(100, " ".join(base), "en", "a")]
    for i in range(40):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "a"))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert 1 <= len(calls) <= 2


def test_similar_classes_of_a_large_bucket_are_one_group(spark):
    """Hundreds of unlike texts of one template with planted near copies: the groups are those of brute force over the buckets."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    template, rows = [word() for _ in range(150)], []
    for i in range(260):
        own = [word() for _ in range(36)]
        rows.append((i, " ".join(template + own), "en", "a"))
        if i % 6 == 0:
            rows.append((1000 + i, " ".join(template + own[:18] + ["edited"] + own[19:]), "en", "a"))
    docs = frame(spark, rows)
    idf = spark.sparkContext.broadcast(minhash.inverse_frequencies(docs))
    bands = {r.doc_id: set(r.bands) for r in minhash.signatures(docs, idf, 2, 3).collect()}
    cls = {(r.a, r.b): r.doc_id for r in minhash.signatures(docs, idf, 2, 3).collect()}
    vector = {cls[r.a, r.b]: minhash._unpack(r.n, bytes(r.v)) for r in minhash.vectors(docs).collect()}
    want = {i: i for i in bands}

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    sizes = collections.Counter(b for own in bands.values() for b in own)
    assert max(sizes.values()) > 3 * minhash.SMALL
    for i in bands:
        for j in bands:
            if i < j and bands[i] & bands[j] and minhash.weighted_jaccard(vector[i], vector[j], idf.value) >= minhash.SIMILAR:
                want[max(root(i), root(j))] = min(root(i), root(j))
    assert len({root(i) for i in want}) < len(want) - 20
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, bands=2).collect()}
    assert got == {i: root(i) for i in want}


def test_similar_pairs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = np.random.default_rng(1)
    idf = (1 + rng.random(1 << minhash.CELL_BITS)).astype(np.float32)
    pool = np.sort(rng.integers(0, 2**32, 60, dtype=np.uint32))
    n, v = [], []
    for _ in range(40):
        own = pool[rng.random(60) < 0.9]
        count = rng.integers(1, 4, len(own), dtype=np.uint32) if rng.random() < 0.5 else np.ones(len(own), np.uint32)
        n.append(len(own))
        v.append(own.tobytes() + (b"" if count.max() == 1 else count.tobytes()))
    left, right = np.arange(0, 25), np.arange(20, 40)
    sim = {(i, j): minhash.weighted_jaccard(minhash._unpack(n[i], v[i]), minhash._unpack(n[j], v[j]), idf) for i in left.tolist() for j in right.tolist()}
    got = {p for p in minhash.similar_pairs(n, v, left, right, idf, 0.8) if sim[p] >= 0.8}
    assert got == {p for p, s in sim.items() if s >= 0.8} and len(got) > 20


def test_weighted_jaccard_and_sampling_agree():
    """Two weighted sets agree on a sample about as often as their weighted Jaccard similarity."""
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**32, 300, dtype=np.uint32))
    b = np.unique(np.concatenate([a[:240], rng.integers(0, 2**32, 60, dtype=np.uint32)]))
    idf = np.ones(1 << minhash.CELL_BITS, np.float32)
    one = lambda x: np.ones(len(x), np.uint32)
    sim = minhash.weighted_jaccard((a, one(a)), (b, one(b)), idf)
    both = len(np.intersect1d(a, b))
    assert math.isclose(sim, both / (len(a) + len(b) - both))
    sampler = minhash.Sampler(400)
    codes = [sampler.samples(x, np.ones(len(x), np.float32), np.array([0]))[0] for x in (a, b)]
    assert abs((codes[0] == codes[1]).mean() - sim) < 0.08


# --- quality

def test_quality_scores(spark):
    labels = spark.createDataFrame([(i, int(i != 16), 0) for i in (1, 2, 3, 7, 8, 11, 13, 16)] + [(16, 0, 0), (None, 1, 0), (9, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.classify(frame(spark), labels).collect()
    assert len(rows) == len(documents())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    empty = {r.score for r in rows if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1  # the share of label 1
    none = quality.classify(frame(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95


def test_near_copies_are_recalled_over_all_pairs(spark):
    """Copies with one to five changed words: of all pairs of similarity 0.8 or more, at least 0.95 share a class."""
    rng = random.Random(12)
    rows, originals = [], [[f"{rng.randrange(10**6):x}" for _ in range(200)] for _ in range(250)]
    for k, words_ in enumerate(originals):
        near = list(words_)
        for place in rng.sample(range(200), 1 + k % 5):
            near[place] = f"new{rng.randrange(10**6):x}"
        rows += [(2 * k, " ".join(words_), "en", "a"), (2 * k + 1, " ".join(near), "en", "a")]
    docs = frame(spark, rows)
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    idf = minhash.inverse_frequencies(docs)
    sets = {}
    for r in minhash.vectors(docs.select("doc_id", "text")).join(
            minhash.signatures(docs, spark.sparkContext.broadcast(idf), minhash.BANDS, minhash.ROWS).select("doc_id", "a", "b"), ["a", "b"]).collect():
        sets[r["doc_id"]] = minhash._unpack(r["n"], r["v"])
    alike = [k for k in range(250) if minhash.weighted_jaccard(sets[2 * k], sets[2 * k + 1], idf) >= minhash.SIMILAR]
    found = sum(classes[2 * k] == classes[2 * k + 1] for k in alike)
    assert len(alike) > 150 and found >= 0.95 * len(alike)
    # different originals share no words: no other pair is alike, and none may be joined
    assert all(classes[2 * k] in (2 * k, 2 * k + 1) and classes[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(250))


def test_components_of_new_links_join_what_was_linked(spark):
    rng = random.Random(5)
    linked, every, parent = spark.createDataFrame([], "node long, component long"), [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for _ in range(3):
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(18)]
        every += links
        for a, b in links:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        linked = minhash.joined_components(linked, spark.createDataFrame(links, "x long, y long"))
        want = {x: find(x) for a, b in every if a != b for x in (a, b)}
        assert {r.node: r.component for r in linked.collect()} == want


# --- language model

def test_ppm_counts_and_base_score(spark):
    rows = documents()
    tokens = [(i, TOKEN.findall(lower(t)) + ["\n"]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, x in tokens if not held(i) for w in x)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(x), sum(count[w] > 0 for w in x), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), 6))
                  for i, x in tokens)
    for frequent in (5, 1 << 20):  # with and without the join of rare tokens
        got = ppm.score(frame(spark), frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert ppm.score(frame(spark, [])).count() == 0


def ppm_by_hand(train, texts, order):
    """log10 probabilities by dictionaries, one byte at a time, with exclusion by sets."""
    counts = collections.defaultdict(collections.Counter)
    for text in train:
        padded = b"\n" * order + text
        for k in range(order, len(padded)):
            for j in range(order + 1):
                counts[padded[k - j : k]][padded[k]] += 1

    def chance(context, symbol):
        if context and context not in counts:
            return chance(context[1:], symbol)
        own, excluded, p = counts.get(context, {}), set(), 1.0
        while True:
            left = {b: n for b, n in own.items() if b not in excluded}
            total = sum(left.values())
            if total:
                if symbol in left:
                    return p * (left[symbol] - (0.5 if excluded or len(left) < 256 else 0)) / total
                p *= len(left) / 2 / total
                excluded |= set(left)
            if not context:
                return p / max(1, 256 - len(excluded))
            context = context[1:]
            own = counts.get(context, {})

    out = []
    for text in texts:
        padded = b"\n" * order + text
        out.append(sum(math.log10(chance(padded[k - order : k], padded[k])) for k in range(order, len(padded))))
    return out


def normal(text):
    return (" ".join(TOKEN.findall(lower(text))) + "\n").encode()


@pytest.mark.parametrize("order", [1, 3, 5])
@pytest.mark.parametrize("common,chunk", [(1 << 20, 1 << 20), (50, 100), (0, 1)])
def test_ppm_scores_equal_a_plain_model(spark, monkeypatch, order, common, chunk):
    """With all grams broadcast, some, or none."""
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    rows = [r for r in documents() if len(r[1] or "") < 1500] + [(20 + k, f"abc abd {'ab' * k} é", "en", "a") for k in range(8)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    want = ppm_by_hand([normal(t) for (_, t, *_), h in zip(rows, held) if not h], [normal(t) for _, t, *_ in rows], order)
    got = ppm.score(frame(spark, rows), order=order, common=common).collect()
    assert any(held) and not all(held)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(x, 6)) for (i, *_), x in zip(rows, want))


def test_ppm_without_training_documents(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    got = ppm.score(frame(spark, [(i, "some words", "en", "a") for i in ids])).collect()
    assert all(math.isclose(r.score, -len(b"some words\n") * math.log10(256), rel_tol=1e-9) and r.train_tokens == 0 for r in got)


def test_ppm_is_a_probability_with_escape_and_exclusion():
    """Every state's chances sum to one, and scoring in stretches equals scoring byte by byte."""
    text = np.frombuffer(b"abracadabra abracadabra alakazam\n" * 9, np.uint8)
    at = np.array([0, 33, len(text)])
    code = ppm.context_codes(text, at, 3)
    key, n = np.unique(code, return_counts=True)
    trie = []
    for k in range(4):
        low, inverse = np.unique(key & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        trie.append(((low >> np.uint64(8)).astype(np.int64), (low & np.uint64(255)).astype(np.int64), np.bincount(inverse, weights=n).astype(np.int64)))
    model = ppm.Model(trie)
    assert np.allclose((10.0 ** model.logp.astype(np.float64)).sum(axis=1), 1, atol=1e-3)
    whole = model.score(text, at, stretch=10**6)
    assert np.allclose(whole, model.score(text, at, stretch=7), rtol=1e-6)
    assert whole[0] > 33 * -math.log10(256)


# --- mixing

def test_mix_reaches_its_targets(spark):
    rows = documents()
    got = mixing.mix(frame(spark), block_words=16).collect()
    sizes = collections.Counter()
    for i, t, _, s in rows:
        sizes[s] += len(TOKEN.findall(t or ""))
    targets = {s: (n, t) for s, n, t in mixing.source_targets(dict(sizes))}
    assert abs(sum(t for _, t in targets.values()) - sum(sizes.values())) < 1e-6
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size and (r.source_size, r.target) == targets[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, (_, t) in targets.items())
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(frame(spark).repartition(5), block_words=16).collect())
    assert mixing.mix(frame(spark, [])).count() == 0


def test_targets_share_the_excess_again():
    # weights 1, 2, 3: source b stops at three times its size, its excess goes to a and c by weight
    got = mixing.source_targets({"a": 100, "b": 2, "c": 50, None: 8})
    assert [s for s, *_ in got] == ["a", "b", "c", None]
    left = 160 - 6
    assert got[1][2] == 6 and math.isclose(got[3][2], min(24, left / 5)) and math.isclose(sum(t for *_, t in got), 160)


def targets_by_hand(sizes):
    """The contract's rule: weights 1, 2, 3 by code point, null last; shares above three times a source are shared again."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, unit = total - sum(full.values()), sum(w for s, w in weight.items() if s not in full)
        share = {s: full.get(s, rest * weight[s] / unit if unit else 0) for s in names}
        over = {s: 3 * sizes[s] for s in names if s not in full and share[s] > 3 * sizes[s]}
        if not over:
            return share
        full |= over


def test_targets_equal_the_rule():
    rng = random.Random(6)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 10, rng.randrange(10000)]) for s in rng.sample(["a", "b", "é", "Z", "", None, "zz"], rng.randrange(1, 8))}
        if not sum(sizes.values()):
            continue
        want = targets_by_hand(sizes)
        assert all(math.isclose(t, want[s], abs_tol=1e-6) for s, _, t in mixing.source_targets(sizes))


@pytest.mark.parametrize("sizes", [{"a": 90_000, "b": 50_000, "c": 20_000, None: 700}, {"a": 100_000, "b": 10, "c": 100_000}])
def test_every_prefix_of_the_schedule_has_the_target_shares(spark, sizes):
    targets = mixing.source_targets(sizes)
    total, block = sum(t for *_, t in targets), 64
    rows = mixing.schedule(spark, targets, block).orderBy("slot", "turn").collect()
    words = collections.Counter()
    for k, r in enumerate(rows):
        words[r.source] += r.words
        assert all(abs(words[s] - t / total * sum(words.values())) <= 6 * block for s, _, t in targets), k
    assert {s: words[s] for s, *_ in targets} == {s: round(t) for s, _, t in targets}
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r.turn)
    assert all(sorted(t) == list(range(len(t))) for t in by_source.values())


def test_taken_is_the_sum_over_the_slots(spark, monkeypatch):
    """Another schedule gives another mix: a schedule without one source's slots takes nothing of it."""
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: whole(*a).where("source = 'b'"))
    assert {r.source for r in mixing.mix(frame(spark), block_words=16).where("taken > 0").collect()} == {"b"}
    assert {r.source for r in mixing.mixed_documents(frame(spark), block_words=16).collect()} == {"b"}


def test_mixed_documents_hold_the_words_taken_in_slot_order(spark):
    taken = sum(r.taken for r in mixing.mix(frame(spark), block_words=16).collect())
    out = mixing.mixed_documents(frame(spark), block_words=16).collect()
    assert sum(len(TOKEN.findall(r.text)) for r in out) == taken
    rows = [(k, " ".join(["w"] * 40), "en", "abc"[k % 3]) for k in range(900)]
    mixed = mixing.mixed_documents(frame(spark, rows), block_words=64).collect()
    seen, share = collections.Counter(), {"a": 1 / 6, "b": 2 / 6, "c": 3 / 6}
    for k, r in enumerate(mixed, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - share[s] * k) <= 8 for s in share), (k, seen)


# --- passages

def test_compact_windows_are_cartesian_tree_spans():
    rng = np.random.default_rng(0)
    for trial in range(10):
        sizes = rng.integers(0, 90, 6)
        at = np.concatenate([[0], np.cumsum(sizes)])
        shingle = rng.integers(0, 2**62 if trial % 2 else 30, at[-1]).astype(np.uint64)
        value = mix64(shingle ^ mix64(np.full(1, 978, np.uint64))) | np.uint64(1)
        for width in (1, 5, 46):
            want = []
            for d in range(6):
                for c in range(at[d], at[d + 1]):
                    lo = hi = c
                    while lo > at[d] and value[lo - 1] > value[c]:
                        lo -= 1
                    while hi + 1 < at[d + 1] and value[hi + 1] >= value[c]:
                        hi += 1
                    if hi - lo + 1 >= width:
                        want.append((lo, c, hi))
            assert sorted(zip(*(x.tolist() for x in passages.compact_windows(shingle, at, 1, width))), key=lambda x: x[1]) == want


def test_segments_with_an_edit_at_every_place_equal_brute_force():
    """Passages of 50 to 100 words with one word changed: the words that brute force over all pairs of stretches covers."""
    rng, width = np.random.default_rng(2), passages.MIN_WORDS - passages.SHINGLE + 1
    lost = 0
    for words in (50, 55, 60, 69, 84, 100):
        for edit in range(words):
            n = words - passages.SHINGLE + 1
            passage = rng.integers(0, 2**62, n).astype(np.uint64)
            around = [rng.integers(0, 2**62, 12).astype(np.uint64) for _ in range(4)]
            changed = passage.copy()
            part = slice(max(0, edit - passages.SHINGLE + 1), edit + 1)
            changed[part] = rng.integers(0, 2**62, len(changed[part])).astype(np.uint64)
            own, other = np.concatenate([around[0], changed, around[1]]), np.concatenate([around[2], passage, around[3]])
            hit, met = np.isin(own, other), np.isin(other, own)
            at = np.flatnonzero(met)
            want = np.zeros(len(own), bool)
            for a in np.flatnonzero(hit):
                for b in np.flatnonzero(hit) + 1:
                    if b - a >= width and not want[a:b].all():
                        inside = np.isin(other, own[a:b])
                        total = np.concatenate([[0], np.cumsum(inside)])
                        both = total[at + 1][None, :] - total[at][:, None]
                        size = (at + 1)[None, :] - at[:, None]
                        if (both / (b - a + np.maximum(size, 1) - both))[size > 0].max() >= passages.SIMILAR:
                            want[a:b] = True
            got = np.zeros(len(own), bool)
            for a, b in passages.near_segments(own, other, width, passages.SIMILAR):
                got[a:b] = True
            assert (got == want).all(), (words, edit)
            lost += not want.any()
    # what stays is shorter than the least passage once it starts and ends with a match
    assert lost < 20


def test_shared_passages_go_from_later_documents(spark):
    rows = passages.remove_passages(frame(spark), with_text=True).collect()
    assert len(rows) == len(documents())
    gone = collections.defaultdict(list)
    for r in rows:
        gone[r.doc_id].append((r.n_words, r.n_removed))
    assert gone[1] == [(200, 0)] and gone[2] == [(200, 200)] and gone[7] == [(170, 0)]
    # the passage of 70 words, in other case and beside other text; a near copy with one word changed
    assert gone[8][0][1] == 70 and gone[15][0][1] == 70 and gone[None][0][1] == 70
    assert gone[3][0][1] >= 190 and gone[10] == [(200, 200)] * 2
    for i in (4, 5, 6, 11, 12, 13, 14):
        assert gone[i][0][1] == 0
    assert passages.remove_passages(frame(spark, [])).count() == 0


def test_passages_of_lines_that_stand_alone_in_many_documents(spark):
    """The partner of a passage is neither the earliest of its windows' keys nor the earliest with its surroundings."""
    rng = random.Random(31)
    word = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]
    rows, late, alone = [], [], 3 * passages.FEW // 2
    for group in range(12):
        lines = [word(18) for _ in range(4)]
        # every second group has its lines in more documents than are linked one by one
        for i in range(alone if group % 2 else 4):
            rows += [(len(rows) + k, " ".join(word(40) + line + word(40)), "en", "a") for k, line in enumerate(lines)]
        whole = sum(lines, [])
        near = list(whole)
        near[rng.randrange(20, 50)] = "changed"
        late += [(100_000 + group, " ".join(word(40) + whole + word(40)), "en", "a"), (200_000 + group, " ".join(word(40) + near + word(40)), "en", "a")]
    cut = {r.doc_id: r.n_removed for r in passages.remove_passages(frame(spark, rows + late)).collect()}
    assert [i for i in range(12) if cut[200_000 + i] < 50] == []
    assert not any(n for i, n in cut.items() if i < 200_000)


def test_prefix_shingles_of_similar_stretches_meet():
    """Random passages of 46 shingles with up to a fifth changed, in any common order of the shingles."""
    rng, width = np.random.default_rng(4), passages.MIN_WORDS - passages.SHINGLE + 1
    for trial in range(300):
        own = rng.integers(0, 2**62, 91).astype(np.uint64)
        other, lo = rng.integers(0, 2**62, 91).astype(np.uint64), int(rng.integers(0, 46))
        stretch = own[lo : lo + width].copy()
        lost = rng.choice(width, int(rng.integers(0, 6)), replace=False)
        stretch[lost] = rng.integers(0, 2**62, len(lost))
        at = int(rng.integers(0, 46))
        other[at : at + width] = stretch
        c = 45 if 45 - lo not in lost.tolist() and lo <= 45 < lo + width else None
        if c is None:
            continue
        common = np.concatenate([own[: int(rng.integers(0, 91))], stretch[: int(rng.integers(0, width))]])
        order = lambda x: x | np.isin(x, common).astype(np.uint64) << np.uint64(63)
        mine = own[passages.prefix_shingles(order(own), c, width, passages.SIMILAR)]
        theirs = other[passages.prefix_shingles(order(other), at + 45 - lo, width, passages.SIMILAR)]
        assert np.isin(mine, theirs).any(), trial


# --- rows without an id of their own

def test_windows_of_a_repeated_shingle_are_one_chain():
    """A run of one word gives a window per place; as a chain they cover what their links cover one by one."""
    rng, width = np.random.default_rng(6), 46
    shingle = rng.integers(1, 2**63, 400).astype(np.uint64)
    shingle[100:160], shingle[250:330:5] = 77, 78
    at = np.array([0, 200, 400])
    many = 0
    for j in range(passages.HASHES):
        l, c, r = passages.compact_windows(shingle, at, j, width)
        _, group = np.unique(passages._keys(shingle, c, j), return_inverse=True)
        order = np.lexsort((c, group))
        l, c, r, group = l[order], c[order], r[order], group[order]
        start = passages._chains(group, np.zeros(len(c), np.int32), l, c, r, width)
        many = max(many, len(c) - len(start))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(c)]):
            for back, on in ((0, 45), (45, 0), (3, 60), (20, 25)):
                covered = set()
                for k in range(a, b):
                    covered |= set(range(max(l[k], c[k] - back), min(r[k], c[k] + on) + 1))
                assert min(covered) == max(l[a], c[a] - back) and max(covered) == min(r[a], c[b - 1] + on)
                assert len(covered) == max(covered) - min(covered) + 1
    assert many > 10


def test_candidates_that_hold_a_segment_pass_the_sift():
    rng, width, similar, passed = np.random.default_rng(7), 12, 0.8, 0
    rows, other = [], np.arange(1, 60, dtype=np.uint64)
    for _ in range(300):
        own = np.where(rng.random(rng.integers(5, 40)) < 0.2, 10**6, 0).astype(np.uint64) + np.arange(rng.integers(1, 20), 60, dtype=np.uint64)[0]
        own = own + np.arange(len(own), dtype=np.uint64)
        rows.append(own)
    hit = [np.isin(x, other) for x in rows]
    good = passages.hopeful(np.concatenate(hit), np.cumsum([len(x) for x in rows]), width, similar)
    for x, h, g in zip(rows, hit, good):
        value = np.where(h, 1.0, -similar / (1 - similar))
        want = any(h[a] and h[b - 1] and value[a:b].sum() > -1e-6 for a in range(len(x)) for b in range(a + width, len(x) + 1))
        assert g == want and (g or not passages.near_segments(x, other, width, similar))
        passed += g
    assert 20 < passed < 280


def test_keys_of_a_block_are_found_once(spark, monkeypatch, tmp_path):
    """What a block settles goes through the buckets with the rest: texts are not cut into shingles again for it."""
    from riskloom.llm.repeats import repeated_codes
    seen = tmp_path / "seen"

    def keys_of(prints, data, offsets):
        with open(seen, "a") as f:
            f.write(f"{len(offsets) - 1}\n")
        return np.arange(len(offsets) - 1), np.full(len(offsets) - 1, 5, np.uint64)
    rows = spark.createDataFrame([(k, k, "abc") for k in range(40)], "id long, key long, text string").repartition(2)
    assert len({r.id for r in repeated_codes(rows, 64, keys_of).collect()}) == 40
    assert sum(map(int, seen.read_text().split())) == 40


def test_rows_that_share_a_doc_id_are_not_gathered(spark, monkeypatch):
    """A third of the rows has no doc_id: each gets the codes of its own text only, and the results of brute force."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(60):
        shared, own = ([word() for _ in range(60)] for _ in range(2))
        rows += [(None, " ".join(own[:20] + shared), "en", "a"), (i, " ".join(shared + own[20:40]), "en", "a"), (100 + i, " ".join(own[40:]), "en", "a")]
    most = {}

    def watched(module, name):
        whole = getattr(module, name)

        def call(known, *rest):
            most[name] = known.selectExpr("max(aggregate(codes, 0, (n, c) -> n + length(c))) AS n").first().n // 8
            return whole(known, *rest)
        monkeypatch.setattr(module, name, call)

    watched(suffix, "bucket_runs")
    watched(passages, "repeated_windows")
    found = suffix.remove_repeats(frame(spark, rows)).collect()
    cut = passages.remove_passages(frame(spark, rows)).collect()
    assert most["bucket_runs"] < 100 and most["repeated_windows"] < 100
    # the passage stays in the rows with an id: rows without one come last
    assert sum(r.n_removed > 300 for r in found if r.doc_id is None) == 60 and not any(r.n_removed for r in found if r.doc_id is not None)
    assert sum(r.n_removed >= 60 for r in cut if r.doc_id is None) == 60 and not any(r.n_removed for r in cut if r.doc_id is not None)


def test_labelled_sample_takes_one_row_of_a_repeated_doc_id(spark):
    rows = [(i % 4, f"text {i} of some words", "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    ids = labels.where(~quality.held_out("doc_id")).where("doc_id < 4").count()
    assert 0 < ids and len(quality.labelled_sample(frame(spark, rows), labels, 100)) == ids


# --- packing

def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    size = 512
    got = packing.pack_documents(frame(spark), tokenizer_path(), size).collect()
    want = []
    for i, t, *_ in documents():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, lo in enumerate(range(0, len(ids), size)):
            part = ids[lo : lo + size]
            want.append((str(i), k, lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= -(-sum(w[3] for w in want) // size) + 1
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_special_token_strings_get_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["abc <|endoftext|> def", "abc<|endoftext|>def", "<|startoftext|>", "<|STARTOFTEXT|> x <|endoftext", "a  <|endoftext|><|endoftext|>\n b", "\x01 <|endoftext|>"]
    got = packing.pieces(frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), tokenizer_path()).collect()
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_rows_without_ids_and_copies_spread_over_demes(spark):
    for a, b in ((2500, 1500), (2222, 1777)):
        rows = spark.range(8200).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", f"IF(id < 4100, {a}, {b}) AS length", "CAST(5 AS BIGINT) AS ids_crc32")
        got = packing.pack(rows.repartition(4)).groupBy("sequence_id").sum("length").collect()
        assert len(got) <= 4100 * 1.01 and max(r[1] for r in got) <= 4096 and sum(r[1] for r in got) == 4100 * (a + b)


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 80).tolist()
    a = packing.Bins(sizes, 100, []).put(list(range(80)))
    b = packing.mutate(rng, sizes, 100, a)
    for x in (a, b, packing.crossover(rng, sizes, 100, a, b), packing.evolve(sizes, 100, 1, [])):
        assert sorted(i for k in x for i in k) == list(range(80))
        assert all(sum(sizes[i] for i in k) <= 100 for k in x)


def test_demes_of_the_fewest_bins_evolve_on(monkeypatch):
    """Best-fit decreasing reaches the lower bound; all offspring are made all the same, and bins get fuller."""
    calls, better = [], 0
    crossover = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: (calls.append(1), crossover(*a))[1])
    for seed in (1, 2, 4, 16, 24, 39):
        sizes = np.random.default_rng(seed).integers(5, 60, 80).tolist()
        first = packing.Bins(sizes, 100, []).put(list(range(80)))
        assert len(first) == -(-sum(sizes) // 100)
        elite = packing.evolve(sizes, 100, [seed, 0], [])
        last = packing.evolve(sizes, 100, [seed, 1], [elite, first])
        grown = [packing.fitness(sizes, 100, x) for x in (first, elite, last)]
        assert grown == sorted(grown)
        better += grown[2] > grown[0]
    assert len(calls) >= 12 * packing.OFFSPRING and better >= 3
    for sizes in ([7], [7, 7]):
        assert sorted(i for k in packing.evolve(sizes, 100, 1, []) for i in k) == list(range(len(sizes)))


def test_names_of_rows_by_several_words_follow_their_order():
    """Pairs of numbers are sorted packed with their row; plain tuples say what has to come out."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 700):
        keys = [rng.integers(0, 4, n).astype(np.uint64) << np.uint64(61) for _ in range(4)]
        rows = list(zip(*(k.tolist() for k in keys)))
        for many in (1, 2, 3, 4):
            short = [row[:many] for row in rows]
            rank = {row: i for i, row in enumerate(sorted(set(short)))}
            assert suffix._names(*keys[:many]).tolist() == [rank[row] for row in short]
        small = [k.astype(np.int64) for k in (rng.integers(0, n, n), rng.integers(0, n + 1, n))]
        pairs = list(zip(*(k.tolist() for k in small)))
        rank = {row: i for i, row in enumerate(sorted(set(pairs)))}
        assert suffix._pair_ranks(*small).tolist() == [rank[row] for row in pairs]
