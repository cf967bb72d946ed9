import hashlib
import random
import re

import numpy as np
import pytest

from veldspar.llm import _common as C
from veldspar.llm import _pairs as P
from veldspar.llm import cross_polytope as X
from veldspar.llm import minhash_join as M
from veldspar.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, n):
    docs = sorted((i, k, WORD.findall(t or "")) for k, (i, t) in enumerate(rows) if i is not None)
    first = {}
    for i, _, w in docs:
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, _, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (i, p):
                gone[p : p + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(docs):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows[5] = (5, rows[4][1])
    rows[6] = (6, "w " * 200)
    rows[7] = (7, None)
    rows[8] = (8, "")
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_WORDS", 300)
    monkeypatch.setattr(S, "RANGE_WINDOWS", 100)
    monkeypatch.setattr(S, "MOST_TASKS", 3)
    rows = corpus(seed)
    monkeypatch.setattr(S, "REGROUP", 50)
    df = spark.createDataFrame([(i, t, "x", "y", 7, "z") for i, t in rows], "doc_id long, text string, N_words string, part string, __bundle int, __items string").repartition(5)
    got = S.substring_dedup(df, window=20)
    assert "N_words" not in got.columns and "part" in got.columns
    assert {tuple(r) for r in got.select("part", "__bundle", "__items").collect()} == {("y", 7, "z")}
    got = got.collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_substrings(rows, 20)
    assert all(sum(s["end"] - s["start"] for s in r["removed_spans"]) == r["n_removed"] for r in got)


def test_substrings_keep_white_space_nulls_and_repeats(spark):
    a = " ".join(f"w{k}" for k in range(25))
    rows = [(1, a + "\n\nown  end"), (2, "start\n" + a + "\nend"), (None, a), (3, "x"), (3, "x")]
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_white_space=True).collect()
    by = sorted((r["doc_id"] or 0, r["kept_text"]) for r in got)
    assert by == [(0, a), (1, rows[0][1]), (2, "start\nend"), (3, "x"), (3, "x")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.substring_dedup(empty).collect() == []


def test_very_long_text(spark):
    long = " ".join(str(k % 977) for k in range(120_000))
    row = S.substring_dedup(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row["n_words"] == 120_000 and row["n_removed"] == 120_000 - 977
    assert hashlib.sha256(row["kept_text"].encode()).hexdigest()


def grams(text, n=5):
    w = WORD.findall((text or "").lower())
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute_links(rows):
    sets = {i: grams(t) for i, t in rows if i is not None}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            low = min([comp[i], *(comp[j] for j in links[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    return {i: (len(links[i]), comp[i]) for i in sets}


def near_corpus():
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"t{rng.randint(0, 500)}" for _ in range(rng.randint(60, 120))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words[rng.randrange(len(words))] = "new"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), "A b c"), (len(rows) + 1, "a  B\nc"), (len(rows) + 2, ""), (len(rows) + 3, None), (None, "a b c")]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", block)
    monkeypatch.setattr(P, "BUCKET_ROWS", 4 * block)
    monkeypatch.setattr(P, "PAIRS", 7 * block)
    rows = near_corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, band int").repartition(4)
    got = M.jaccard_join(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_links(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    lost = next(r for r in got if r["doc_id"] is None)
    assert lost["kept"] and lost["class_id"] is None


def test_jaccard_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.jaccard_join(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["n_links"], r["kept"]) for r in M.jaccard_join(twice).collect()) == [(1, False), (1, True)]


def test_rows_without_near_duplicates(spark):
    """Repeated rows leave one; a row goes by its own text, not by that of another row of its id."""
    a, b = "a b c d e f", "other words stand in this one"
    rows = [(1, a, "x"), (1, a, "x"), (2, b, "y"), (3, a, "z"), (3, b + " again and so on", "z"), (None, a, "n"), (None, a, "n"), (4, "", "e"), (4, "", "e"), (5, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").repartition(3)
    got = M.without_near_duplicates(df)
    assert got.columns == df.columns
    stay = [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7], rows[8], rows[9]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, stay))


def test_ids_of_other_types(spark):
    texts = [("b", "a b c d e f g"), ("a", "A b c d e f g"), ("c", "x y z"), (None, "x y z")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["component_id"], r["kept"]) for r in M.jaccard_join(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert got == {"b": ("a", 1, "a", False), "a": ("a", 1, "a", True), "c": ("c", 0, "c", True), None: (None, 0, None, True)}
    vectors = [("b", [1.0, 2.0]), ("a", [2.0, 4.0]), ("c", [-1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in X.embedding_links(spark.createDataFrame(vectors, "vec_id string, embedding array<double>")).collect()}
    assert got == {"b": (1, "a", False), "a": (1, "a", True), "c": (0, "c", True)}


def test_chains_cost_in_proportion_to_their_links(spark, monkeypatch):
    """Each document is like its neighbours only: what meets grows with the links, not with the chain's square."""
    met = []
    whole = P.verified

    def counted(meetings, linked, partitions):
        met.append(meetings.count())
        return whole(meetings, linked, partitions)

    monkeypatch.setattr(P, "verified", counted)
    n, words = 3000, [f"w{k}" for k in range(3200)]
    got = M.jaccard_join(spark.createDataFrame([(k, " ".join(words[k : k + 64])) for k in range(n)], "doc_id long, text string")).collect()
    # 60 five-grams each: distance d shares 60 - d of 60 + d, 0.8 or more up to d = 6
    assert {r["doc_id"]: r["n_links"] for r in got} == {k: min(k, 6) + min(n - 1 - k, 6) for k in range(n)}
    assert {r["component_id"] for r in got} == {0} and met[-1] < 12 * n
    angles = [(k, [float(np.cos(k * 0.1)), float(np.sin(k * 0.1))] + [0.0] * 30) for k in range(60)]
    spark_rows = X.embedding_links(spark.createDataFrame(angles, "vec_id long, embedding array<double>")).collect()
    u = np.array([v for _, v in angles])
    assert [r["n_links"] for r in sorted(spark_rows)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


@pytest.mark.parametrize("classes", [10**4, 10**6, 10**8])
def test_buckets_hold_pairs_at_the_threshold(classes):
    """Pairs at a cosine of 0.9501 share a bucket, however many hashes make one."""
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9501 * x + (1 - 0.9501**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    hashes, shared = X.hashes_for(classes, 64), np.zeros(1000, bool)
    for t in range(X.TABLES):
        a, b = (X.probe(np.stack([X.rotated(v, np.random.default_rng((X._SEED, 2, t, h))) for h in range(hashes)]), hashes, X.PROBES)[0] for v in (x, y))
        shared |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert shared.mean() >= 0.999


def test_jaccard_with_more_blocks_than_documents(spark, monkeypatch):
    rows = near_corpus()
    monkeypatch.setattr(M, "BLOCK_CHARS", 60)
    got = M.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_links(rows)


def test_embeddings_with_empty_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    m = np.repeat(rng.normal(size=(6, 32)), 3, axis=0) + rng.normal(size=(18, 32)) * 0.02
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(X, "LINK_BLOCK", 1)
    assert [r["n_links"] for r in X.embedding_links(df).collect()] == [2] * 18


@pytest.mark.parametrize("shared", [1, 2, 4095, 4096, 4097, 8193])
def test_shared_counts_keep_the_last_column(shared):
    common = np.arange(shared, dtype=np.uint64)
    got = M.shared_counts([common, np.append(common, np.uint64(1 << 40)), np.array([1 << 50], np.uint64)])
    assert got[0, 1] == got[1, 0] == shared and got[2, 0] == got[2, 1] == 0


def test_jaccard_of_one_repeated_word(spark):
    rows = [(1, "a " * 5), (2, "a " * 80), (3, "b " * 80)]
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in M.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_bands_reach_the_recall():
    bands, rows = M.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        M.bands_for(0.1, 0.999999, 4)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 48))
    near = base[:120] + rng.normal(size=(120, 48)) * 0.28
    m = np.vstack([base, near, base[:3]])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 48), (n + 3, [float("nan")] + [1.0] * 47), (n + 4, [None] + [1.0] * 47), (n + 5, [float("inf")] * 48), (None, [1.0] * 48), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    got = X.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    found = np.array([by[i]["n_links"] for i in range(n)])
    assert (found <= true.sum(1)).all() and found.sum() >= 0.999 * true.sum() > 0
    assert [by[n + k]["n_links"] for k in range(8)] == [0, 0, 0, 0, 0, 0, 1, 1] and by[n + 7]["component_id"] == n + 6
    assert by[300 + 120]["component_id"] == by[0]["component_id"] and by[None]["kept"]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert X.embedding_links(empty).collect() == []


def test_embedding_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.repeat(rng.normal(size=(4, 32)), 10, axis=0) + rng.normal(size=(40, 32)) * 0.02
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, X.embedding_links(df).collect()))
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    monkeypatch.setattr(X, "LINK_BLOCK", 4)
    assert sorted(map(tuple, X.embedding_links(df).collect())) == whole and whole[0][1] == 9
