import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyread.llm import jaccard_join as J
from tallyread.llm import topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, cell string"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t), 5, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- near duplicates -------------------------------------------------------------------


def grams(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(texts):
    sets = [grams(t) for t in texts]
    links = [[] for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].append(j)
                links[j].append(i)
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([root[i], *(root[j] for j in near)])
            if least < root[i]:
                root[i], changed = least, True
    return root, [len(x) for x in links]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    line = "a line that very many of these documents share with each other"
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(20, 120))]
        if rng.random() < 0.4:
            base = line.split() + base
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 0, 1, 4])):
            edited = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                edited[rng.randrange(len(edited))] = word()
            texts.append("  ".join(edited) if rng.random() < 0.2 else " ".join(edited))
    rng.shuffle(texts)
    return texts


def test_join_equals_brute_force(spark):
    texts = corpus(1, 150) + ["", None, "  ", "short one", "short one", "other one", "word " * 500, "word " * 700]
    got = {r["doc_id"]: r for r in J.jaccard_join(documents(spark, texts)).collect()}
    root, count = brute_force(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == count
    kept = J.one_of_each_class(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r for r in root})


def test_large_group_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 16)
    monkeypatch.setattr(J, "CELL", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(70):
        edited = base[:]
        edited[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(edited))
    texts += corpus(3, 20)
    got = {r["doc_id"]: r for r in J.jaccard_join(documents(spark, texts)).collect()}
    root, count = brute_force(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == count


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for count, links in ((2, 1), (60, 40), (200, 190), (90, 400)):
        pairs = [(rng.randrange(count), rng.randrange(count)) for _ in range(links)] + [(i, i + 1) for i in range(300, 340)]
        label = {v: v for pair in pairs for v in pair if pair[0] != pair[1]}
        for _ in label:
            for a, b in pairs:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = J.components(spark.createDataFrame(pairs, "id long, root long")).collect()
        assert {r["id"]: r["root"] for r in got} == label and len(got) == len(label)


def test_copies_and_splits_lose_no_link(spark, monkeypatch):
    """Texts with many copies are classed apart, and buckets are split again."""
    monkeypatch.setattr(J, "HOT_COPIES", 3)
    monkeypatch.setattr(J, "BUCKET", 4)
    texts = corpus(6, 60)
    texts += texts[:1] * 9 + texts[5:7] * 5
    docs = documents(spark, texts).withColumnRenamed("extra", "gone_id")
    got = {r["doc_id"]: r for r in J.jaccard_join(docs).collect()}
    root, count = brute_force(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == count
    assert sorted(r["doc_id"] for r in J.one_of_each_class(docs).collect()) == sorted(set(root))


def common_lines(seed, groups, copies):
    """Texts of which a half is one line common to all, in groups of near copies."""
    rng = random.Random(seed)
    line, texts = [f"line{i}" for i in range(60)], []
    for group in range(groups):
        base = line + [f"own{group}x{i}" for i in range(60)]
        for _ in range(copies):
            edited = base[:]
            edited[rng.randrange(120)] = f"edit{rng.randrange(10**9)}"
            texts.append(" ".join(edited))
    return texts


def test_cells_by_a_common_line_are_taken_apart(spark, monkeypatch):
    """Sets are copied for each block of their cell, so a cell must not hold all texts with one line."""
    monkeypatch.setattr(J, "BUCKET", 8)
    monkeypatch.setattr(J, "CELL", 8)
    seen = []
    linked = J.linked

    def watched(members, texts, threshold):
        seen.append(max(r["size"] for r in members.select("size").collect()))
        return linked(members, texts, threshold)

    monkeypatch.setattr(J, "linked", watched)
    texts = common_lines(4, 30, 4) + corpus(5, 20)
    got = {r["doc_id"]: r for r in J.jaccard_join(documents(spark, texts)).collect()}
    root, count = brute_force(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == count
    assert seen and seen[0] <= 20


def test_no_text_moves_for_more_rows_than_one_broadcast(spark, monkeypatch):
    """Cells' members and ids that go are broadcast in parts, and nothing changes by it."""
    texts = corpus(7, 60)
    root, count = brute_force(texts)
    docs = documents(spark, texts)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 20)
    got = {r["doc_id"]: r for r in J.jaccard_join(docs).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == count
    assert 20 < len(texts) - len(set(root)) <= 20 * J.BROADCAST_PARTS
    kept = J.one_of_each_class(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    monkeypatch.setattr(J, "BROADCAST_PARTS", 1)
    kept = J.one_of_each_class(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_empty_and_repeated_rows(spark):
    assert J.jaccard_join(documents(spark, [])).count() == 0
    alone = documents(spark, ["one text of five words", "nothing like it at all here"])
    twice = alone.unionByName(alone)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(twice).collect())
    assert got == [(0, 0, 0), (1, 1, 0)]


def test_repeated_rows_inside_a_group(spark):
    """Repeated rows count once, and of different texts under one id the smallest alone."""
    words = [f"w{i}" for i in range(100)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(["x", *words[50:], "y"])
    rows = [(0, text), (0, text), (1, near), (2, near), (2, "a text apart from all of the others"), (3, other), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(docs).collect())
    assert got == [(0, 0, 1), (1, 0, 1), (2, 2, 0), (3, 3, 0)]


def test_runs_reach_the_recall():
    assert J.runs_for(0.9999, 0.8, J.CHOSEN, 0) >= 3
    values = np.random.default_rng(0).integers(0, 2**32, (2000, J.EMBEDDING)).astype(np.uint32)
    near = values.copy()
    near[:, : round(0.2 * J.EMBEDDING)] ^= 1
    met = np.zeros(2000, bool)
    for run in range(J.runs_for(0.9999, 0.8, J.CHOSEN, 0)):
        node = np.full(2000, 977 + run, np.uint64)
        one, other = J.paths_of(values, node), J.paths_of(near, node)
        both = set(zip(*map(np.ndarray.tolist, one))) & set(zip(*map(np.ndarray.tolist, other)))
        met[[i for i, _ in both]] = True
    assert met.mean() > 0.999


# --- top-k -----------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.2, 12).astype(np.float32).tolist() for _ in range(700)]
    vectors[5], vectors[6], vectors[50] = vectors[4], vectors[4], [0.0] * 12
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(900, None, "x"), (950, [float("nan")] * 12, "x"), (1000, [None] * 12, "x"), (1050, [float("inf")] * 12, "x"), (1100, [], "x"), (1150, [0.5] * 5, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(map(tuple, topk.top_k(table, table.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()))
    usable = {i: np.floor(256 * np.pad(np.array(v, np.float64), (0, 12 - len(v)))).astype(np.int64) for i, v in [*enumerate(vectors), (1150, [np.float32(0.5)] * 5)]}
    expected = []
    for q in [i for i in usable if i % 50 == 0]:
        best = sorted((-int(usable[q] @ usable[c]), c) for c in usable if c != q)[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(expected)


def test_top_k_refuses_scores_beyond_64_bits(spark):
    rows = [(0, [3e9, 3e9]), (1, [1e300, 0.0]), (50, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(table, table, 2)


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 1, (900, 8)) * rng.gamma(1, 1, (900, 1))
    vectors[100:400] = vectors[100]
    table = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    ints = np.floor(256 * vectors.astype(np.float32).astype(np.float64)).astype(np.int64)
    got = sorted(map(tuple, topk.top_k(table, table.where("vec_id % 50 = 0"), 3).select("query_id", "rank", "vec_id", "score").collect()))
    expected = []
    for q in range(0, 900, 50):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in range(900) if c != q)[:3]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(expected)
    few = table.where("vec_id in (0, 7)")
    assert topk.top_k(few, few.where("vec_id = 0"), 5).count() == 1
    assert topk.top_k(table.where("1 = 0"), table.where("1 = 0"), 5).count() == 0


# --- toxicity --------------------------------------------------------------------------


def toy(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "he", "nd", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "zax" + word(), "villain"])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def network():
    texts, labels = toy(1, 240)
    return toxicity.fit(texts, labels, rounds=2, epochs=3)


def test_classifier_on_held_out_texts(network):
    texts, labels = toy(2, 150)
    predicted = network.scores(texts) >= 0.5
    truth = np.array(labels) == 1
    assert (predicted & truth).sum() >= 0.85 * truth.sum() and (predicted & ~truth).sum() <= 0.1 * (~truth).sum()


def test_windows_cover_all_words():
    for n in (0, 1, 16, 32, 33, 48, 49, 500):
        spans = toxicity.windows_of(n)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b - a <= toxicity.WINDOW for a, b in spans)
        assert all(later[0] - earlier[0] == toxicity.STRIDE for earlier, later in zip(spans, spans[1:]))
        assert set(range(n)) == {i for a, b in spans for i in range(a, b)}
    assert "".join(toxicity.words_of("x" * 100)) == "x" * 100


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._unit_parameters(rng, "u", 3, 2).items()}
    x, mask = rng.normal(0, 1, (4, 3, 3)), np.ones((4, 3))
    mask[2:, 1] = 0
    target = rng.normal(0, 1, (3, 4))

    def loss():
        pooled, kept = toxicity._read(p, "u", *toxicity._project(p, "u", x), mask, True)
        return (pooled * target).sum(), kept

    _, kept = loss()
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d_f, d_b = toxicity._read_back(p, "u", grads, kept, target)
    toxicity._project_back(p, "u", grads, x, d_f, d_b)
    for name in p:
        flat, step = p[name].reshape(-1), 1e-3
        for i in range(0, flat.size, 5):
            old = flat[i]
            flat[i] = old + step
            up = loss()[0]
            flat[i] = old - step
            down = loss()[0]
            flat[i] = old
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[i]) < 5e-3


def test_scores_over_documents(spark, network):
    texts = ["", None, " ", "scoundrel", "an er th " * 4_000, "y" * 30_000, "an er", "an er"]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, network).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert rows[0]["score"] == rows[1]["score"] and rows[6]["score"] == rows[7]["score"]
    assert rows[3]["predicted"] == 1
    assert all(rows[i]["held_out"] == (toxicity.remainder(i) == 0) for i in rows)
    kept = toxicity.without_toxic(docs, network)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if not r["predicted"]}
    none = toxicity.fit([], [])
    assert [r["score"] for r in toxicity.score_documents(docs, none).collect()] == [0.0] * len(texts)


def test_sample_leaves_out_held_out_rows(spark):
    texts, labels = toy(4, 60)
    docs = documents(spark, texts)
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (3, 0, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs, table)
    expected = {(t, y) for i, (t, y) in enumerate(zip(texts, labels)) if toxicity.remainder(i)}
    assert set(got) == expected and F is not None
