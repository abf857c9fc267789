"""Pivot index, BagMinHash, components, mixing, language model, pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tendermatch.llm import embedding_dedup, graph, lm_score, minhash_dedup, mixing
from tendermatch.llm.queries import QUERIES, op6_lm_score, op7_pivot_index, op8_bag_minhash, rank_file

from .conftest import rows

SF = "/root/testdata/sf0.01"


def roots(nodes, links):
    """Smallest node of every node's component."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(1)
    links = {"chain": [(int(a), int(b)) for a, b in zip(*(lambda p: (p[:-1], p[1:]))(rng.permutation(200)))],
             "star": [(150, k) for k in range(300) if k != 150], "none": [],
             "random": [tuple(map(int, p)) for p in rng.integers(0, 400, (250, 2))]}[kind]
    table = spark.createDataFrame([*links, *links[:5], (7, 7), (None, 3)] if links else [], "a long, b long")
    links = [p for p in links if p[0] != p[1]]
    truth = roots({n for p in links for n in p}, links)
    assert dict(rows(graph.components(table))) == truth


def _vector_truth(data, threshold=0.95):
    good = [(i, np.array(v, dtype=float)) for i, v in data
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = Counter()
    pairs = []
    for k, (a, x) in enumerate(good):
        for b, y in good[k + 1:]:
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    up = roots({i for i, _ in data if i is not None}, pairs)
    return sorted([(i, links.get(i, 0), up.get(i), i is None or up[i] == i) for i, _ in data], key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    data = []
    for k in range(120):
        base = rng.normal(size=8)
        data += [(10 * k + j, (base + rng.normal(size=8) * 0.03 * j * (k % 3)).astype(np.float32).tolist()) for j in range(1 + k % 4)]
    data += [(5001, None), (5002, []), (5003, [0.0] * 8), (5004, [float("nan")] + [1.0] * 7), (5005, [None] + [1.0] * 7),
             (5006, [float("inf")] + [1.0] * 7), (None, data[0][1]), (5007, data[0][1]), (5008, [x * 1e30 for x in data[3][1]])]
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, near string").repartition(5)
    assert rows(embedding_dedup.near_duplicates(table)) == _vector_truth(data)
    assert rows(embedding_dedup.near_duplicates(table.limit(0))) == []


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    data = [(k, (base + rng.normal(size=8) * 0.12).tolist()) for k in range(150)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(embedding_dedup.near_duplicates(table)) == _vector_truth(data)


def test_recall_on_the_table(spark):
    got = {r.vec_id: r for r in op7_pivot_index(spark, SF).collect()}
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    truth = _vector_truth(data)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(t[1] for t in truth)
    assert all(got[t[0]].n_links <= t[1] for t in truth)


def multiset(text):
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum(min(n, b[k]) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _class_truth(data, threshold=0.8):
    sets = [(i, multiset(t)) for i, t in data]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:]
             if None not in (a, b) and x and y and similarity(x, y) >= threshold and a != b]
    up = roots({i for i, _ in data if i is not None}, links)
    sizes = Counter(up[i] for i, m in sets if i is not None and m)
    out, seen = [], set()
    for i, m in sets:
        if i is None or not m:
            out.append((i, i, 1, True))
        else:
            key = (i, frozenset(m.items()))
            out.append((i, up[i], sizes[up[i]], up[i] == i and key not in seen))
            seen.add(key)
    return sorted(out, key=repr)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    for top in (2, 6, 50):
        base = {k: int(rng.integers(1, top)) for k in range(200)}
        other = {k: (n if rng.random() < 0.7 else int(rng.integers(1, top + 5))) for k, n in base.items()}
        found = []
        for turn in range(80):
            sides = []
            for bag in (base, other):
                value = minhash_dedup.mix(np.array([k + 1000 * turn for k in bag], dtype=np.uint64))
                order = np.argsort(value)
                sides.append((value[order], np.array(list(bag.values()))[order]))
            (v, w), (x, y) = sides
            s = minhash_dedup.signatures(np.concatenate([v, x]), np.concatenate([w, y]), np.array([0, 200, 400]))
            found.append((s[0] == s[1]).mean())
        truth = sum(min(base[k], other[k]) for k in base) / sum(max(base[k], other[k]) for k in base)
        assert abs(np.mean(found) - truth) < 4 * np.std(found) / len(found) ** 0.5 + 0.003
        assert minhash_dedup.jaccard(v, w, x, y) == pytest.approx(truth)


def test_multisets_of_short_and_repeated_words():
    texts = ["a b c", "A  b\tC", "", None, "x " * 30, "a b c d e f", " \n", "é É é É é"]
    value, weight, starts = minhash_dedup.multisets(texts)
    assert np.diff(starts).tolist() == [1, 1, 0, 0, 1, 2, 0, 1] and value[0] == value[1] and weight[2] == 26
    assert np.isinf(minhash_dedup.signatures(value, weight, starts)).all(axis=1).tolist() == [False, False, True, True, False, False, True, False]


def test_classes(docs, empty_docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(minhash_dedup.classes(docs.withColumn("size", F.lit("clash")))) == _class_truth(data)
    assert rows(minhash_dedup.classes(empty_docs)) == []
    kept = minhash_dedup.drop_near_duplicates(docs)
    truth = [t for t in _class_truth(data) if t[3]]
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((t[0] for t in truth), key=repr)


def test_shared_shingles_of_many_sets(monkeypatch):
    """Counted through postings, in parts: what each pair of multisets shares."""
    rng = np.random.default_rng(9)
    sets = []
    for n in (0, 1, 40, 60, 200):
        value = np.unique(rng.integers(0, 250, n)).astype(np.uint64)
        sets.append((value, rng.integers(1, 4, len(value))))
    for most in (1 << 20, 7):
        monkeypatch.setattr(minhash_dedup, "POSTINGS", most)
        for own in (sets, sets[:1], []):
            postings = minhash_dedup._Postings(own)
            for value, weight in sets:
                want = [sum(min(w, dict(zip(*b)).get(v, 0)) for v, w in zip(value, weight)) for b in own]
                assert postings.shared(value, weight).tolist() == want


def test_blocks_compare_without_a_search_for_each_pair(spark, monkeypatch):
    """Unlinked rows of one open bucket: no pair is searched on its own."""
    def never(*sets):
        raise AssertionError("a pair was compared on its own")

    monkeypatch.setattr(minhash_dedup, "jaccard", never)
    rng = np.random.default_rng(10)
    value = [sorted(rng.choice(1 << 40, 30, replace=False).tolist()) for _ in range(40)]
    value[7] = value[3][:29] + [1 << 41]
    sets = spark.createDataFrame([(k, v, [1] * 30) for k, v in enumerate(value)], "did long, value array<long>, weight array<int>")
    members = spark.createDataFrame([(5, k, k) for k in range(40)], "key long, did long, comp long")
    assert [sorted(r) for r in minhash_dedup._blockwise(members, sets, 0.8).collect()] == [[3, 7]]


def test_classes_need_links_that_miss_the_hub(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(100)]
    data = []
    for k in range(60):                                  # near the threshold: many pairs fail, many links skip the hub
        words = list(base)
        for at in rng.permutation(100)[:int(rng.integers(1, 5))]:
            words[at] = f"x{rng.integers(0, 12)}"
        data.append((k, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(minhash_dedup.classes(docs)) == _class_truth(data)


def test_classes_of_the_table(spark):
    got = {r.doc_id: r for r in op8_bag_minhash(spark, SF).collect()}
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = [(i, multiset(t)) for i, t in data]
    holders = defaultdict(list)
    for k, (_, m) in enumerate(sets):
        for shingle in m:
            holders[shingle].append(k)
    links = set()
    for k, (a, m) in enumerate(sets):
        for j in {j for s in m for j in holders[s] if j > k}:
            if similarity(m, sets[j][1]) >= 0.8:
                links.add((a, sets[j][0]))
    up = roots([i for i, _ in data], links)
    assert {i: r.class_id for i, r in got.items()} == up and all(r.kept == (up[i] == i) for i, r in got.items())


def _fill(nodes, given):
    """Budgets of (name, weight, cap) siblings: proportional, capped, in rounds."""
    budget = {n: 0.0 for n, _, _ in nodes}
    open_ = list(nodes)
    while open_ and given > 1e-9:
        share = given / sum(w for _, w, _ in open_)
        full = [(n, w, c) for n, w, c in open_ if budget[n] + share * w >= c]
        if not full:
            for n, w, _ in open_:
                budget[n] += share * w
            break
        for n, _, c in full:
            given -= c - budget[n]
            budget[n] = c
        open_ = [x for x in open_ if x not in full]
        given += sum(budget[n] for n, _, _ in open_)
        for n, _, _ in open_:
            budget[n] = 0.0
    return budget


def test_budgets_move_shortages_to_siblings_first(spark):
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2, "*": 1}, "source": {"*": 1}}
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 900), ("a", "de", "s1", 50), ("b", "en", "s1", 5000), ("b", "fr", "s9", 10), ("a", "en", "s3", 0)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {tuple(r[:3]): r.budget for r in mixing.budgets(table, 2000, 1, weights).collect()}
    tree = defaultdict(int)
    for d, g, s, n in leaves:
        tree[d] += n
        tree[d, g] += n
    top = _fill([(d, weights["domain"][d], tree[d]) for d in "ab"], 2000)
    for d in "ab":
        langs = sorted({x[1] for x in leaves if x[0] == d})
        mid = _fill([(g, weights["lang"].get(g, 1), tree[d, g]) for g in langs], top[d])
        for g in langs:
            low = _fill([(x[2], 1, x[3]) for x in leaves if x[:2] == (d, g)], mid[g])
            for s, value in low.items():
                assert abs(got[d, g, s] - value) <= 3
    assert sum(got.values()) == 2000


def test_mix_rows(docs, empty_docs):
    out = mixing.mix(docs.withColumn("epoch", F.lit("clash")))
    got = out.select("own.doc_id", "epoch", "n_tokens", "domain").collect()
    total = sum(len((r.text or "").encode().split()) for r in docs.collect())
    assert set(out.columns) == {"own", "domain", "lang", "source", "n_tokens", "epoch"} and len(got) > 5
    longest = max(len((r.text or "").encode().split()) for r in docs.collect())
    assert total * 3 // 4 <= sum(r.n_tokens for r in got) <= total * 3 // 4 + 12 * longest
    assert mixing.mix(empty_docs).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).count() == 0


def test_mix_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = rows(mixing.mix(docs).select("own.doc_id", "epoch"))
    assert first == rows(mixing.mix(docs.repartition(9)).select("own.doc_id", "epoch"))


def test_attention_gradients():
    rng = np.random.default_rng(1)
    net = lm_score.Attention(rng, np.full(lm_score.CLASSES + 1, 1 / (lm_score.CLASSES + 1)))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    size = lm_score.CONTEXT + lm_score.FRESH
    vec, starts = rng.normal(size=(2, size, lm_score.SHAPE)), np.zeros((2, size), dtype=bool)
    starts[:, :9] = True
    target, used = rng.integers(0, lm_score.CLASSES + 1, (2, lm_score.FRESH)), rng.random((2, lm_score.FRESH)) < 0.7
    _, grads = net.gradients(vec, starts, target, used)
    for name, weight in net.weights.items():
        at = tuple(rng.integers(0, s) for s in weight.shape)
        kept, step = weight[at], 1e-4
        weight[at] = kept + step
        up = net.gradients(vec, starts, target, used)[0]
        weight[at] = kept - step
        assert abs((up - net.gradients(vec, starts, target, used)[0]) / (2 * step) - grads[name][at]) < 1e-5, name
        weight[at] = kept


def test_fast_scores_are_those_of_the_forward_pass():
    rng = np.random.default_rng(3)
    net = lm_score.Attention(rng, np.full(lm_score.CLASSES + 1, 1 / (lm_score.CLASSES + 1)))
    net.weights["start"] = rng.normal(size=lm_score.WIDTH).astype(np.float32)
    counts = np.array([1, 60, 130, 48])
    vec, cls = rng.normal(size=(counts.sum(), lm_score.SHAPE)).astype(np.float32), rng.integers(0, lm_score.CLASSES + 1, counts.sum())
    before, fresh, used, of = lm_score.windows(counts)
    logp = net.forward(vec[before], before < 0)["logp"]
    value = np.where(used, np.take_along_axis(logp, cls[fresh][:, :, None], axis=2)[:, :, 0], 0).sum(axis=1)
    assert np.allclose(net.classes(net.enter(vec), cls, counts), np.bincount(of, value, 4), rtol=1e-4)


def test_fast_scores_with_long_vectors_in_the_batch():
    """A window's scores are those of the forward pass, however long the vectors of it and of its neighbours are."""
    rng = np.random.default_rng(6)
    net = lm_score.Attention(rng, np.full(lm_score.CLASSES + 1, 1 / (lm_score.CLASSES + 1)))
    counts = np.array([40, 40, 90])
    vec, cls = rng.normal(size=(counts.sum(), lm_score.SHAPE)).astype(np.float32), rng.integers(0, lm_score.CLASSES + 1, counts.sum())
    vec[60:] *= 30
    before, fresh, used, of = lm_score.windows(counts)
    logp = net.forward(vec[before], before < 0)["logp"]
    value = np.where(used, np.take_along_axis(logp, cls[fresh][:, :, None], axis=2)[:, :, 0], 0).sum(axis=1)
    got = net.classes(net.enter(vec), cls, counts)
    assert np.allclose(got, np.bincount(of, value, 3), rtol=1e-4)
    assert np.allclose(got[:1], net.classes(net.enter(vec[:40]), cls[:40], counts[:1]), rtol=1e-5)


def test_windows_score_each_token_once_and_look_back_only():
    counts = np.array([1, 48, 49, 200, 3])
    before, fresh, used, of = lm_score.windows(counts)
    assert sorted(fresh[used].tolist()) == list(range(counts.sum()))
    begin = np.cumsum(counts) - counts
    for b, f, u, text in zip(before, fresh, used, of):
        for k in np.flatnonzero(u):
            assert b[k + lm_score.CONTEXT] == (f[k] - 1 if f[k] > begin[text] else -1)
            assert f[k] - begin[text] < lm_score.CONTEXT or (b[k + 1:k + lm_score.CONTEXT + 1] >= 0).all()
    assert (lm_score.MASK[0, lm_score.CONTEXT + 1:] < 0).all() and (lm_score.MASK[:, 0] == 0).all()


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(2)
    size = 7
    pairs = np.unique(rng.integers(0, size * size, 12))
    spelling = lm_score.Spelling(rng.integers(0, 5, (3, lm_score.LENGTHS)), rng.integers(0, 5, (3, size)), rng.integers(0, 5, (3, size)),
                                 pairs, rng.integers(1, 9, len(pairs)))
    for cls in range(3):
        for first in range(size):
            words = [[first, k] for k in range(size)]
            got = spelling.score(np.array(sum(words, [])), np.full(size, 2), np.full(size, cls))
            alone = spelling.score(np.array([first]), np.array([1]), np.array([cls]))
            expected = np.exp(alone[0]) / spelling.lengths[cls, 0] * spelling.lengths[cls, 1]
            assert np.exp(got).sum() == pytest.approx(expected, rel=1e-5)


def _base_truth(data, learn):
    counts, ends = Counter(), 0
    for i, t in data:
        if learn(i):
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    log = lambda c: np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    out = []
    for i, t in data:
        words = (t or "").encode().lower().split()
        out.append((i, len(words) + 1, sum(w in counts for w in words) + (ends > 0), total, sum(log(counts[w]) for w in words) + log(ends)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("top", [3, 500_000])
def test_lm_rows(docs, empty_docs, top, monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(lm_score, "MAX_WORDS", 20)         # shipped with the code: the dictionary is thinned all the time
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    run = lambda d: lm_score.score(d, learn, rank_file(), public_tokenizers.PATTERN, top_words=top)
    got = rows(run(docs.withColumn("score", F.lit("clash"))))
    truth = _base_truth([(r.doc_id, r.text) for r in docs.collect()], lambda i: (i or 0) % 2 == 0)
    assert [g[:4] for g in got] == [t[:4] for t in truth]
    assert np.allclose([g[4] for g in got], [t[4] for t in truth]) and all(np.isfinite(g[5]) and g[5] < 0 for g in got)
    if top == 3:
        assert rows(run(empty_docs)) == []
        nothing = lm_score.score(docs, F.lit(False), rank_file(), public_tokenizers.PATTERN).collect()
        assert all(np.isfinite(r.score) and r.train_tokens == 0 for r in nothing)


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """A distinct word counts once in the spelling, in however many partitions and dictionaries it stands."""
    import public_tokenizers
    monkeypatch.setattr(lm_score, "MAX_WORDS", 20)
    rng = np.random.default_rng(4)
    data = [(k, " ".join(f"w{n}ords" for n in rng.zipf(1.4, 60) % 5000)) for k in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    one, many = (sorted((r.doc_id, r.score) for r in lm_score.score(
        frame.repartition(n, "doc_id"), F.col("doc_id") % 2 == 0, rank_file(), public_tokenizers.PATTERN).collect()) for n in (1, 9))
    assert np.allclose([s for _, s in one], [s for _, s in many], rtol=1e-5)


def test_lm_pairs_beyond_the_broadcast(spark, monkeypatch):
    """Scores do not depend on how many counts of pairs are broadcast: the others are joined."""
    import public_tokenizers
    rng = np.random.default_rng(5)
    data = [(k, " ".join(f"w{n}ords{n % 7}ly" for n in rng.zipf(1.4, 60) % 5000)) for k in range(30)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = []
    for most in (500_000, 20, 0):
        monkeypatch.setattr(lm_score, "TOP_PAIRS", most)
        got.append([s for _, s in sorted((r.doc_id, r.score) for r in lm_score.score(
            frame, F.col("doc_id") % 2 == 0, rank_file(), public_tokenizers.PATTERN).collect())])
    assert np.allclose(got[0], got[1], rtol=1e-5) and np.allclose(got[0], got[2], rtol=1e-5)


def test_lm_learns_from_all_rows(spark, monkeypatch):
    """Vectors and classes come from all training rows, the windows from whole and distinct texts."""
    import public_tokenizers
    seen = {}
    fit = lm_score.fit

    def spy(*args, **kw):
        seen["args"] = args
        return fit(*args, **kw)

    monkeypatch.setattr(lm_score, "fit", spy)
    vocabulary = lm_score.Vocabulary(rank_file(), public_tokenizers.PATTERN)
    greek = ["αβγδ", "κλμν", "πρστ"]
    copies = [(k, "the same words again") for k in range(1200)]
    long = " ".join(["start here"] * 1500 + ["and the other end"] * 1500 + greek)
    frame = spark.createDataFrame([*copies, (5000, long), (5001, " ".join(greek * 9))], "doc_id long, text string")
    lm_score.score(frame, F.lit(True), rank_file(), public_tokenizers.PATTERN).count()
    shapes, ids = seen["args"][0], seen["args"][2]
    for word in greek:
        own, _ = vocabulary.encode([word.encode()])
        assert np.abs(shapes.vectors[own]).sum(axis=1).all() and np.isin(own, ids).all()
    counts = seen["args"][4]
    assert len(counts) == 1 + -(-(3000 + 6000 + 4) // lm_score.FRESH) + 1


def test_lm_trains_on_every_window_of_many(spark, monkeypatch):
    """More windows than are taken at once: all of them are dealt to shards, none is left out, and copies count once."""
    import public_tokenizers
    for name, value in (("TRAIN_WINDOWS", 20), ("SHARD_WINDOWS", 4), ("ROUNDS", 3), ("PIECE", 2), ("STEPS", 30), ("MIXED", 8)):
        monkeypatch.setattr(lm_score, name, value)
    rng = np.random.default_rng(6)
    data = [(k, " ".join(f"w{n}ords" for n in rng.zipf(1.4, 10 + 25 * k) % 500)) for k in range(16)]
    frame = spark.createDataFrame([*data, *[(100 + k, data[5][1]) for k in range(30)], (200, ""), (201, None)], "doc_id long, text string")
    seen, fit = [], lm_score.fit_shards

    def spy(shapes, prior, around, shards, n_windows):
        seen.append((shards, [r.asDict() for r in around.dropDuplicates(["tid", "nth"]).collect()]))
        return fit(shapes, prior, around, shards, n_windows)

    monkeypatch.setattr(lm_score, "fit_shards", spy)
    one, many = ([(r.doc_id, r.score) for r in sorted(lm_score.score(
        frame.repartition(n, "doc_id"), F.lit(True), rank_file(), public_tokenizers.PATTERN).collect())] for n in (1, 7))
    assert [i for i, _ in one] == [i for i, _ in many] and np.allclose([s for _, s in one], [s for _, s in many], rtol=1e-5)
    assert np.ptp([s for i, s in one if i in (5, *range(100, 130))]) < 1e-6
    for shards, pieces in seen:
        vectors = np.zeros((lm_score.Vocabulary(rank_file(), public_tokenizers.PATTERN).size, lm_score.SHAPE), np.float32)
        found = lm_score._pieces(lm_score.Single(lm_score.Shapes(vectors, np.zeros((1, lm_score.SHAPE), np.float32))), pieces)
        assert shards > 1 and len({(r["round"], r["shard"]) for r in pieces}) > 4
        texts = {t or "" for _, t in data} | {""}
        # an empty text and a null one are two texts of a single token
        assert found[4].sum() == sum(len(t.split()) + 1 for t in texts) + 1


def test_pieces_are_windows(monkeypatch):
    """Windows made from pieces are those of whole texts."""
    rng = np.random.default_rng(8)
    size = 300
    shapes = lm_score.Shapes(rng.normal(size=(size, lm_score.SHAPE)).astype(np.float32), rng.normal(size=(5, lm_score.SHAPE)).astype(np.float32))
    counts, rows, fresh = [0, 95, 96, 97, 400, 3], [], 2 * lm_score.FRESH
    words = [[rng.integers(0, size, rng.integers(1, 4)).astype(np.int32) for _ in range(n)] for n in counts]
    for text in words:
        for nth in range(-(-(len(text) + 1) // fresh)):
            from_, to = nth * fresh - lm_score.CONTEXT - 1, min(len(text), (nth + 1) * fresh)
            own = text[max(0, from_):to]
            rows.append({"ids": b"".join(w.tobytes() for w in own), "sizes": np.array([len(w) for w in own], np.int32).tobytes(),
                         "lead": max(0, -from_), "ends": len(text) < (nth + 1) * fresh})
    vec, cls, before, at, used = lm_score._pieces(lm_score.Single(shapes), rows)
    flat = [w for t in words for w in t]
    all_vec, all_cls = shapes.words(np.concatenate(flat), np.array([len(w) for w in flat]))
    all_vec, all_cls = lm_score.with_ends(all_vec, all_cls, np.array(counts))
    want_before, want_at, want_used, _ = lm_score.windows(np.array(counts) + 1)
    assert (used == want_used).all() and (cls[at][used] == all_cls[want_at][used]).all()
    assert ((before < 0) == (want_before < 0))[:, lm_score.CONTEXT:][used].all()
    near = (want_before >= 0) & (before >= 0)
    assert np.allclose(vec[before][near], all_vec[want_before][near], atol=1e-6)
    assert (near == (want_before >= 0))[:, :lm_score.CONTEXT + 1].all()


def test_words_of_a_batch_are_those_of_its_texts():
    texts = [" a  B c ", None, "", " \t ", "x\x0by\x1cz\x85q\x00 w\u00a0K\u0130", "end\n", "\r\x0c"] * 3
    want = [(t or "").encode().lower().split() for t in texts]
    for most in (1, 20, 1 << 20):
        for skip in (0, 1, 3):
            got = []
            for begin, words, counts in lm_score._parts(pa.array(texts).slice(skip), most):
                assert begin == len(got)
                own, ends = words.cast(pa.binary()).to_pylist(), np.cumsum(counts).tolist()
                got += [own[y - n:y] for y, n in zip(ends, counts.tolist())]
            assert got == want[skip:]
    assert list(lm_score._parts(pa.array([], pa.string()))) == []


def test_frequent_words_are_encoded_once(monkeypatch):
    """A worker's full dictionary makes room without the words it meets most: they are not encoded again."""
    import public_tokenizers
    monkeypatch.setattr(lm_score, "MAX_WORDS", 40)
    vocabulary = lm_score.Vocabulary(rank_file(), public_tokenizers.PATTERN)
    seen, encode = Counter(), vocabulary.encode
    monkeypatch.setattr(vocabulary, "encode", lambda words: (seen.update(words), encode(words))[1])
    worker = lm_score.Encoded(vocabulary)
    for k in range(30):
        words = [b"the", b"usual", b"words", *[f"rare{k}of{n}".encode() for n in range(25)]] * 2
        ids, sizes = worker.encode(pa.array(words, pa.binary()))
        want = encode(words)
        assert ids.tolist() == want[0].tolist() and sizes.tolist() == want[1].tolist()
    assert [seen[w] for w in (b"the", b"usual", b"words")] == [1, 1, 1] and len(seen) == 3 + 30 * 25


def test_neighbours_are_those_of_each_place(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(lm_score, "COMMON", 6)
    size, counts = 30, np.array([0, 70, 1, 5, 300])
    ids = (rng.random(counts.sum()) ** 2 * 25).astype(np.int32)
    freq = np.bincount(ids, minlength=size)
    known, common = np.flatnonzero(freq), np.argsort(-freq, kind="stable")[:6]
    row, column = np.full(size + 1, -1), np.full(size + 1, -1)
    row[known], column[common] = np.arange(len(known)), np.arange(6)
    want, begin = np.zeros((len(known), 6), np.int64), 0
    for n in counts.tolist():
        text = ids[begin:begin + n]
        for x in range(n):
            for y in range(max(0, x - lm_score.NEAR), min(n, x + lm_score.NEAR + 1)):
                if x != y and column[text[y]] >= 0:
                    want[row[text[x]], column[text[y]]] += 1
        begin += n
    rank = lm_score.ranks(row, column)
    out, own = np.zeros((6, rank[-1] + 1), np.int64), np.full(rank[-1] + 1, -1)
    lm_score.neighbours(ids, counts, rank, out)
    own[rank], got = row, np.zeros_like(want)
    for c, r in zip(*np.nonzero(both := lm_score.both_ways(out))):
        got[own[r], c] = both[c, r]
    assert (got == want).all()


def test_vectors_of_words_are_means_in_order():
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(50, lm_score.SHAPE)).astype(np.float32)
    counts = rng.integers(1, 30, 300)
    ids = rng.integers(0, 50, counts.sum())
    vec, _ = lm_score.Shapes(vectors, np.zeros((1, lm_score.SHAPE), np.float32)).words(ids, counts)
    want = np.add.reduceat(vectors[ids], np.cumsum(counts) - counts) / counts[:, None]
    assert (vec == want.astype(np.float32)).all()


def test_window_draw_grows_with_the_rows():
    got = [sum(len(lm_score.drawn(t * 7919 - 50_000, 40, 0.05)) for t in range(n)) for n in (500, 5000)]
    assert 800 < got[0] < 1200 and 9000 < got[1] < 11_000


def test_lm_on_held_out_rows(spark):
    got = op6_lm_score(spark, SF).collect()
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    truth = _base_truth(data, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    got = sorted(got, key=lambda r: r.doc_id)
    truth = sorted(truth)
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [t[:4] for t in truth]
    assert np.allclose([r.base_score for r in got], [t[4] for t in truth])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
