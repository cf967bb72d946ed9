import itertools
import random
import re
import string

import numpy as np
import pytest

import corpus_pipeline
from veldspar.llm import packing as K
from veldspar.llm import quality_rules


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


@pytest.mark.parametrize("buckets", [1, 2, 3, 4])
def test_boundaries_by_brute_force(buckets):
    rng = random.Random(buckets)
    for _ in range(20):
        lengths = [rng.randint(0, 15) for _ in range(rng.randint(1, 40))]
        distinct = sorted(set(lengths))
        counts = np.array([lengths.count(x) for x in distinct])
        ends = K.optimal_boundaries(np.array(distinct), counts, counts * distinct, buckets)
        best = min(padding(lengths, c) for r in range(1, buckets + 1) for c in itertools.combinations(distinct, r) if c[-1] == distinct[-1])
        assert padding(lengths, ends) == best and len(ends) <= buckets and ends[-1] == distinct[-1]


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(5)
    top = np.sort(rng.choice(5000, 700, replace=False))
    docs = rng.integers(1, 50, 700)
    n, s = (np.concatenate(([0], np.cumsum(x))) for x in (docs, top * docs))
    cost = top * n[1:] - s[1:]
    for _ in range(1, 8):
        cost = np.array([min([cost[j], *(cost[:j] + top[j] * (n[j + 1] - n[1 : j + 1]) - (s[j + 1] - s[1 : j + 1]))]) for j in range(700)])
    ends = np.array(K.optimal_boundaries(top, docs, top * docs, 8))
    assert (docs * (ends[np.searchsorted(ends, top)] - top)).sum() == cost[-1]


def test_one_long_text_leaves_the_others_buckets(spark):
    rows = [(k, n) for k, n in enumerate([3, 3, 10, 11, 50, 51, 400, 401])]
    df = spark.createDataFrame([*rows, (99, 4_000_000)], "doc_id int, n_tokens int")
    assert K.length_boundaries(df, "n_tokens", 8) == [3, 10, 11, 50, 51, 400, 401, 4_000_000]
    assert {r["padding"] for r in K.pack(df).collect()} == {0}


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 10, 50, 400]), "x") for i in range(300)] + [(300, None, "x"), (301, 5000, "x"), (None, 3, "x"), (7, 3, "x"), (7, 3, "x")]
    df = spark.createDataFrame(rows, "doc_id int, n_tokens int, bucket string").repartition(5)
    got = K.pack(df, buckets=3, token_budget=1000).collect()
    assert len(got) == len(rows)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(rows)
    by = {}
    for r in got:
        assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        by.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), rows_of in by.items():
        room = max(1, 1000 // rows_of[0]["bucket_length"])
        last = max(b for k, b in by if k == bucket)
        assert len(rows_of) == room or batch == last and len(rows_of) <= room
    assert K.pack(df.where("doc_id > 9999")).collect() == []


def test_word_counts(spark):
    df = spark.createDataFrame([(1, "a  b\nc"), (2, ""), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in K.pack_documents(df).collect()} == {1: 3, 2: 0, 3: 0}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas())
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] and counts[1] == counts[2] == counts[3] == counts[4] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def test_pipeline_removes_frequent_lines(spark):
    rng = random.Random(3)  # letters only: all digits are alike to a line's key
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(n))
    rows = [(k, f"{own(40)}\n All rights   reserved {k % 10}\n\n{own(40)}", "h", 9) for k in range(30)]
    rows += [(7, own(80), "h", 9), (None, own(80), None, 9), (40, own(60) + "\nAll rights reserved 1", "g", 9), (41, "short", "h", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.quality(spark, docs, "").collect()
    want = [(i, "\n".join(x for x in t.split("\n") if s != "h" or "rights" not in x)) for i, t, s, _ in rows if i != 41]
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(key((r["doc_id"], r["text"])) for r in got) == sorted(map(key, want))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    cut = quality_rules.without_frequent_lines(docs).where("doc_id = 12").first()
    assert cut["removed_lines"] == [" All rights   reserved 2"] and "reserved" in cut["text"]


def test_pipeline_takes_odd_rows(spark):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good + " a@b.co", "en", "s", 9), (2, good + " a@b.co", "en", "s", 9), (3, None, None, None, None), (None, good[::-1], "en", "s", 9), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {1, None} and got[1]["text"].endswith("[EMAIL]") and got[1]["n_chars"] == len(got[1]["text"])


def test_pack_spreads_repeats_and_takes_odd_lengths(spark):
    rows = [(1, 20, "x")] * 400 + [(2, -5, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id int, n_tokens int, row string").repartition(3)
    got = K.pack(df, buckets=2, token_budget=200).collect()
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(rows)
    assert sorted(r["n_tokens"] for r in got)[:3] == [0, 0, 20]
    long = spark.createDataFrame([("a", "w " * 300_000), ("b", None)], "doc_id string, text string")
    assert {r["doc_id"]: (r["n_tokens"], r["slot"]) for r in K.pack_documents(long).collect()} == {"a": (300_000, 0), "b": (0, 0)}


def test_pipeline_by_brute_force(spark):
    """All stages but packing against plain Python, over odd rows: repeats, an id that is kept and rejected, copies."""
    from test_dedup import brute_links
    from test_text import BASE, brute_rules, passes

    rng = random.Random(12)
    own = lambda n: [f"{rng.choice(string.ascii_lowercase)}{rng.randint(0, 9999)}x" for _ in range(n)]
    passage = own(60)
    rows = []
    for k in range(40):
        words = own(90)
        if k % 5 == 0:
            words[10:10] = passage
        if k % 7 == 0:
            words[3:3] = [f"mail me{k}@host{k}.org"]
        rows.append((k, " ".join(words)))
    rows += [(50, rows[3][1]), (51, rows[4][1] + " end"), (52, "too short"), (6, "also too short"), (60, rows[8][1]), (8, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (53, None), (54, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __row int").repartition(3)
    got, columns = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = spark.createDataFrame(stage(spark, got, "").collect(), docs.schema)
        assert got.columns == columns

    stay = [(i, t) for i, t in rows if not brute_rules(t)[-1]]
    ids = dict(enumerate(t for i, t in stay))
    named = {k: i for k, (i, _) in enumerate(stay)}
    comp = brute_links([(k, t) for k, t in ids.items() if named[k] is not None])
    first = {}
    for k, (_, c) in comp.items():
        first[c] = min(first.get(c, (named[k], k)), (named[k], k))
    stay = [(i, t) for k, (i, t) in enumerate(stay) if i is None or first[comp[k][1]] == (i, k)]
    seen, cut = set(), []
    for i, t in sorted((x for x in stay if x[0] is not None), key=lambda x: x[0]):
        w = t.split(" ")
        wins = [tuple(w[p : p + 20]) for p in range(len(w) - 19)]
        gone = {q for p, x in enumerate(wins) if x in seen for q in range(p, p + 20)}
        seen |= set(wins)
        cut.append((i, " ".join(x for q, x in enumerate(w) if q not in gone)))
    cut += [x for x in stay if x[0] is None]

    def clean(t):
        spans = sorted((m.start(), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, t) if passes(k, m[0]))
        out, at = "", 0
        for s, e, k in spans:
            if s >= at:
                out += t[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        return out + t[at:]

    want = sorted((-1 if i is None else i, clean(t), len(clean(t))) for i, t in cut)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == want
    assert len(want) == 42 and sum("[EMAIL]" in t for _, t, _ in want) == 6
