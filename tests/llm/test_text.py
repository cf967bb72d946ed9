import hashlib
import random
import re
import string

import numpy as np

from veldspar.llm import bpe as B
from veldspar.llm import html_extract as H
from veldspar.llm import licenses as L
from veldspar.llm import line_crf as Q
from veldspar.llm import pii as P
from veldspar.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(x) if k % 2 == 0 else (2 * int(x) - 9 * (int(x) > 4)) for k, x in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def brute_pii(text):
    found = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def texts():
    rng = random.Random(11)
    out = ["", None, "a@b.co_c@d.com x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111 and +1 (499) 555-6503.", "é😀 mail: ü@x.de a.b@x-y.co.uk", "+1234567890123456 +12345678-", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", "ssn 123-45-6789 but 987-65-4321"]
    for _ in range(150):
        out.append("".join(rng.choice(["@", ".", "-", "+", " ", "a", "B", "é", "(", ")", "1", "4111111111111111", "10.0.0.1", "x.y@z.com", "2", "555", "\n"]) for _ in range(rng.randint(1, 40))))
    return out


def test_pii_by_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, __email int")
    assert P.find_pii(df).columns == [*df.columns, "pii_spans"]
    for r in P.find_pii(df).collect():
        assert r["__email"] == 1
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii_spans"] if s["rank"] < 4]
        assert got == brute_pii(r["text"]), r["text"]
    kinds = {r["doc_id"]: [s["kind"] for s in r["pii_spans"] if s["rank"] >= 4] for r in P.find_pii(df).collect()}
    assert kinds[7] == ["iban", "iban"] and kinds[8] == ["ssn"]


def test_pii_context_is_whole_words_on_both_sides(spark):
    texts = ["ssn 123-45-6789", "123-45-6789 (SSN)", "lessness 123-45-6789", "123-45-6789", "call +1 (499) 555-6503", "+1 (499) 555-6503 is my phone", "recalled +1 (499) 555-6503"]
    df = spark.createDataFrame(list(enumerate(texts)), "__text int, text string")
    got = {r["__text"]: [(s["kind"], round(s["score"], 2)) for s in r["pii_spans"]] for r in P.find_pii(df).collect()}
    assert [got[k] for k in range(7)] == [[("ssn", 0.8)], [("ssn", 0.8)], [], [], [("phone", 0.9)], [("phone", 0.9)], [("phone", 0.6)]]


def test_redaction_by_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, __opened int")
    spans = {r["doc_id"]: r["pii_spans"] for r in P.find_pii(df).collect()}
    for r in P.redact(df).collect():
        text, out, at = dict(rows)[r["doc_id"]], "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert r["text"] == (text if text is None else out + text[at:])


def test_pii_long_texts_and_redaction(spark):
    long = "x" * 50_000 + " " + "1" * 60_000 + " " + " ".join(f"u{k}@h{k}.org" for k in range(2000))
    df = spark.createDataFrame([(1, long), (2, "call +1 (499) 555-6503 or a@b.co"), (3, None), (4, "none"), (5, "4111 1111 1111 1111")], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in P.redact(df).collect()}
    assert got[1].count("[EMAIL]") == 2000 and "@" not in got[1] and got[1].startswith("x" * 50_000)
    assert (got[2], got[3], got[4], got[5]) == ("call [PHONE] or [EMAIL]", None, "none", "[CARD]")
    assert P.redact(df.where("doc_id > 9")).collect() == []
    assert P.redact(df).columns == df.columns


def vocabulary():
    return B.Vocabulary.load(B.vocabulary_path())


def test_bpe_equals_tiktoken():
    import tiktoken

    v = vocabulary()
    own = B.Encoder(v, B.default_pattern())
    other = tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(2)
    cases = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 2000, " x \n\n y", "it's we'll 12345 ...!!", "😀 中文 é"]
    cases += ["".join(rng.choice(["the", "ing", " ", "er", "é", "1", ".", "\n", "zq", "😀", "  ", "'s"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    cases += ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text in cases:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == other.encode_ordinary(text), text
        assert own.decode(packed).decode() == text


def test_bpe_appends_and_edits():
    v = vocabulary()
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))).encode() for _ in range(2))
        p = B.Prefixes(v, a)
        p.append(b)
        assert p.tokens() == B.Prefixes(v, a + b).tokens()
        at = rng.randrange(len(a))
        p.edit(at, at + 1, b"xyz")
        assert p.tokens() == B.Prefixes(v, a[:at] + b"xyz" + a[at + 1 :] + b).tokens()


def test_bpe_edits_stop_where_old_tokens_return():
    v = vocabulary()
    rng = random.Random(7)
    for new in (b"", b"q", b"zzthe and"):
        data = "".join(rng.choice("abcdeinorst") for _ in range(20_000)).encode()
        p, read = B.Prefixes(v, data), []
        p.append = lambda more, p=p, read=read: (read.append(len(more)), B.Prefixes.append(p, more))
        p.edit(500, 503, new)
        assert sum(read) < 5000 and p.data == data[:500] + new + data[503:]
        assert p.last == B.Prefixes(v, p.data).last
        p.edit(len(p.data) - 1, len(p.data), b"x")
        assert p.last == B.Prefixes(v, p.data).last


def test_bpe_frames(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 5), (3, None, 5)], "doc_id int, text string, n_tokens int")
    out = B.encode(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_tokens"] == len(got[1]["ids"]) == 2 and got[2]["n_tokens"] == got[3]["n_tokens"] == 0
    assert got[3]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["decoded"] for r in B.decode(out).orderBy("doc_id").collect()] == ["hello world", "", ""]
    assert B.encode(df.where("doc_id > 9")).collect() == []


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(i, i + 3)}
    n = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_rules_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b#", "c", "dé", "x|", "longer"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 12))), None if i % 7 == 0 else f"s{i % 2}", 0) for i in range(60)]
    rows += [(100, None, "s1", 0), (101, "", "s1", 0), (102, "u " * 80, "s1", 0), (None, "v w", "s1", 0), (5, "twice", "s1", 0), (5, "twice", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, row int")
    got = R.quality_rules(df).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key(r[:7]) for r in got)) == sorted(key((i, *brute_rules(t))) for i, t, _, _ in rows)
    assert R.quality_rules(df.where("doc_id > 999")).collect() == []


def test_frequent_lines_deplete(spark):
    rng = random.Random(8)
    own = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    boiler = "\n".join(own(30) for _ in range(4))
    rows = [(i, f"{boiler}\n{own(20)}", "h") for i in range(30)] + [(100 + i, own(80), "h") for i in range(60)]
    same = own(80)
    rows += [(200 + i, same, "h") for i in range(50)]
    got = {r["doc_id"]: r for r in R.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(30)) and got[0]["n_frequent_words"] == 120
    assert all(got[100 + i]["kept"] for i in range(60)) and all(got[200 + i]["kept"] for i in range(50))


BSD = next(text for label, text in L.TEMPLATES if label == "bsd")


def test_licenses_of_another_corpus(spark, monkeypatch):
    corpus = [("own", "one two three four five six"), ("own", "one two"), ("other", "one two three four nine nine nine")]
    df = spark.createDataFrame([("a", "x one two three four five six y"), ("a", "one two three four nine nine nine"), (None, "one two three")], "doc_id string, text string")
    want = sorted([("a", "own"), ("a", "other"), ("", "")])
    for limit in (L.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(L, "BROADCAST_GRAMS", limit)
        assert sorted((r["doc_id"] or "", r["labels"]) for r in L.scan_licenses(df, corpus=corpus).collect()) == want


def license_rows():
    apache = L.TEMPLATES[1][1]
    changed = apache.replace("may not use", "must never use")
    return [(1, "code\n" + apache), (2, "x " + changed + " y"), (3, "MIT  License, CC-BY and the apache\nlicense"), (4, None), (5, ""), (6, "licensed under the gnu General public License"), (7, "nothing of the kind"), (8, "é" * 100_000), (9, BSD + " z"), (9, BSD + " z"), (None, "mit license")]


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in license_rows()], "doc_id int, text string, key string")
    got = L.scan_licenses(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11
    assert by[1]["labels"] == "apache" and by[1]["score"] == 1.0 and by[2]["labels"] == "apache" and 0.6 <= next(s["cover"] for s in by[2]["spans"] if s["template"] == 1) < 1
    assert (by[3]["n_base"], by[3]["first_word"], by[3]["last_word"], by[3]["base_labels"]) == (3, 0, 6, "apache,cc-by,mit")
    assert by[4]["n_words"] == 0 and by[5]["first_word"] is None and by[4]["labels"] == ""
    assert by[6]["base_labels"] == "gpl" and by[7]["score"] == 0.0 and by[8]["n_words"] == 1
    assert by[9]["labels"] == "bsd" and by[9]["spans"][0]["start"] == 0 and by[None]["base_labels"] == "mit"
    assert L.scan_licenses(df.where("doc_id > 99")).collect() == []


def brute_chain(unary, moves):
    import itertools

    n = len(unary)
    weight = {s: np.exp(sum(u for u, y in zip(unary, s, strict=True) if y) + sum(moves[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=n)}
    total = sum(weight.values())
    return np.array([sum(w for s, w in weight.items() if s[k]) / total for k in range(n)])


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 5])
    unary = rng.normal(size=9)
    chain = Q.Chain(np.ones(1), rng.normal(size=(2, 2)), np.zeros(1), np.ones(1))
    got = chain.marginals(unary, sizes)
    assert np.allclose(got, np.concatenate([brute_chain(unary[a:b], chain.moves) for a, b in ((0, 3), (3, 4), (4, 9))]))


def test_crf_learns_from_mixed_chains(spark):
    x = np.array([[1.0], [1.0], [-1.0], [-1.0], [-1.0], [1.0]])
    first = Q.Chain(np.array([9.0]), np.zeros((2, 2)), np.zeros(1), np.ones(1))
    got = Q.line_labels(first, x, np.array([0, 0, 0, 1, 1, 2]), np.array([1, 1, 1, 0, 0, 0]))
    assert got.tolist() == [1, 1, 0, 0, 0, 0]  # a doubted line turns; a document's only line doesn't
    assert [len(c) for c in Q.training_chains(np.zeros((64 * 20 + 1, Q.N_LINE)))] == [64] * 7 + [1]
    good, bad = "Words of a text, as they should be, stand here.", "### $$$ BUY BUY BUY !!!"
    rows = [(k, "\n".join([good if k % 2 else bad] * 3), k % 2, 0) for k in range(60)] + [(0, bad, 0, 0), (1, None, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, label int")
    labels = df.select("doc_id", "quality").unionByName(spark.createDataFrame([(2, 1), (3, 7), (None, 1)], "doc_id long, quality int"))
    chain = Q.train(df, labels)
    got = {(r["doc_id"], r["score"] > 0.5) for r in Q.score_quality(df.where("text is not null"), chain).collect()}
    assert got == {(k, bool(k % 2)) for k in range(60)}
    assert Q.score_quality(df.where("doc_id > 99"), chain).collect() == [] and Q.train(df.where("doc_id > 99"), labels) is None


def test_crf_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    chain = Q.train(docs, labels)
    scored = Q.score_quality(docs, chain).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    odd = spark.createDataFrame([(1, None, 9.0), (2, " \n\t", 9.0), (None, "Good words in a line of text, as they should be.", 9.0), (3, "x " * 200_000, 9.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in Q.score_quality(odd, chain).collect()}
    assert got[1]["score"] == got[2]["score"] == 0.0 and got[None]["held_out"] is False and 0 <= got[3]["score"] <= 1
    assert Q.train(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in Q.score_quality(odd.where("doc_id = 3"), None).collect()} == {0.5}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div class="top-menu"><a href=x>Home</a></div><header>Head</header>
<div class="layout"><div class="sidebar">Side text that is long enough to matter somewhat, it really is</div><div class="post-%d"><h1>Title &amp; more</h1><p>First <b>para</b>
graph &eacute; of the article, with words.<p>Second one<br>continues<script>if (a < b) {}</script>.</p><div class="ad-slot">Buy</div><form><p>mail</p></form>
<ul><li>one<li>two</ul><div id="comments"><p>A reader wrote a very long comment, longer than the whole article, to see whether it is taken for the text. A reader wrote a very long comment.</p></div></div></div><footer>F</footer></body>"""


def test_html(spark):
    want = "Title & more\n\nFirst para graph é of the article, with words.\n\nSecond one continues.\n\none\n\ntwo"
    rows = [(k, f"http://Host.example/{k}", PAGE % k) for k in range(5)] + [(10, None, None), (11, "x", ""), (12, "http://host.example/p", "<p>alone"), (13, "http://b.c/", "plain < text & no tags"), (14, "http://b.c/", "<!-- never ends <p>x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id int, url string, html string, host int")
    got = {r["page_id"]: r for r in H.extract_pages(df).collect()}
    assert {got[k]["text"] for k in range(5)} == {want} and got[0]["n_chars"] == len(want) and got[0]["host"] == 1
    assert [got[k]["text"] for k in (10, 11, 12, 13, 14)] == ["", "", "alone", "plain < text & no tags", ""]
    paths = {r["host"]: r["paths"] for r in H.host_paths(df).collect()}
    assert "html>body>div.layout>div.post-N" in paths["host.example"][0]
    assert H.extract_pages(df.where("page_id > 99")).collect() == []


def test_html_article_in_two_parts(spark):
    part = lambda word, n: f"<div class={word}><p>{f'{word} ' * n}</div>"
    page = lambda inner: f"<body><div class=content>{inner}</div><footer>F</footer></body>"
    pages = [page(part("text", 200))] * 6 + [page(part("text", 80) + part("more", 120))]
    df = spark.createDataFrame([(k, "http://h.x/", p) for k, p in enumerate(pages)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    assert got[0] == " ".join(["text"] * 200) and got[6] == " ".join(["text"] * 80) + "\n\n" + " ".join(["more"] * 120)


def test_html_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"http://h{k % 3}.x/{k}", PAGE % k) for k in range(9)], "page_id int, url string, html string")
    whole = sorted(map(tuple, H.extract_pages(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, H.extract_pages(df).collect())) == whole


def test_html_hostile():
    for source in ("<" * 20_000, "<a b='" * 5_000, "<p>" * 20_000 + "x", "<div>" * 3_000 + "deep", "</p>" * 9_000, "<table><tr><td>a<td>b<tr><td>c</table>"):
        H.extract(source)
    assert H.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert H.extract("<div><div class=lead><p>%s</div><div class=rest><p>%s</div></div><div><p>tiny</div>" % ("w " * 60, "v " * 200)).startswith("w w")
    assert H.extract("<div><p>%s<ul><li>%s</ul></div>" % ("w " * 60, "v " * 200)).startswith("w w")


def test_html_short_parts_stay(spark):
    part = lambda word, n: f"<div class={word}><p>{f'{word} ' * n}</div>"
    page = lambda *parts: f"<body><div class=menu>m</div><div class=content>{''.join(parts)}</div>"
    text = lambda *parts: "\n\n".join(" ".join([w] * n) for w, n in parts)
    pages = [page(part("text", 200), part("more", 15))] * 80 + [page(part("text", 100), part("more", 100))]
    df = spark.createDataFrame([(k, "http://h.x/", p, "c", "d") for k, p in enumerate(pages)], "page_id int, url string, html string, __paths string, __salt string")
    got = {r["page_id"]: r for r in H.extract_pages(df).collect()}
    assert got[0]["text"] == text(("text", 200), ("more", 15)) and got[80]["text"] == text(("text", 100), ("more", 100))
    assert (got[80]["__paths"], got[80]["__salt"]) == ("c", "d")
    assert H.extract(pages[0]) == got[0]["text"] and H.extract(pages[80]) == got[80]["text"]


def test_html_of_generated_pages(spark):
    """Pages put together from known blocks and junk, in several templates: the text is exactly the blocks."""
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["river", "stone", "under", "évening", "light", "a", "of"]) for _ in range(n))
    junk = [lambda: f"<nav><a href=/>{say(3)}</a></nav>", lambda: f"<div class='cookie-notice'>{say(30)}</div>", lambda: f"<aside><p>{say(40)}</p></aside>", lambda: f"<script>var x = '<p>{say(9)}</p>';</script>", lambda: f"<div class=related-posts><ul><li>{say(9)}</ul></div>", lambda: f"<form><p>{say(8)}<input></form>", lambda: f"<section id=comments><p>{say(60)}</section>", lambda: f"<!-- {say(5)} -->"]
    def block(kind, text):
        shown = text.replace("é", "&eacute;") if rng.random() < 0.5 else text
        at = shown.find(" ")
        return f"<{kind}>{shown[: at + 1]} \n<b>{shown[at + 1 :]}</b></{kind}>" if at > 0 else f"<{kind}>{shown}</{kind}>"
    shells = ["<body>%s<article>%s</article>%s<footer>f</footer>", "<body><div id=wrap>%s<div class=post-3>%s</div></div>%s", "<body>%s<main><div><div>%s</div></div></main>%s", "<body><div class=top>x</div>%s<table><tr><td>%s</td></tr></table>%s"]
    rows, want = [], {}
    for k in range(200):
        blocks = [(rng.choice(["p", "h2", "li", "blockquote"]), say(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        inner = "".join(block(*b) + (rng.choice(junk)() if rng.random() < 0.4 else "") for b in blocks)
        shell = shells[k % 3]
        rows.append((k, f"https://u:p@H{k % 3}.example:80/{k}", shell % ("".join(rng.choice(junk)() for _ in range(2)), inner, rng.choice(junk)())))
        want[k] = "\n\n".join(t for _, t in blocks)
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()}
    assert got == want


def test_html_keeps_what_belongs_to_the_article():
    long = "w " * 60
    assert H.extract(f"<body><header>site</header><article><header><h1>Head</h1></header><p>{long}</article>").startswith("Head\n\nw w")
    assert H.extract(f"<body><h1>Head</h1><article><p>{long}</article><h1>after</h1>").startswith("Head\n\nw w")
    assert H.extract("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</article>") == "so x=2 holds"
    assert H.extract(f"<article><p>{long}<section class=related-work><p>Others did it.</section><div class='related'>r</div></article>").endswith("Others did it.")
    for name in ("page-footer", "mainMenu", "article-sidebar", "post_share", "related-content", "text-ad", "story-notice", "comments", "comment-list"):
        assert H.extract(f"<body><div><p>{long}</p><div class='{name}'><p>{'junk ' * 90}</div></div>") == long.strip(), name
    for name in ("has-sidebar", "layout no-sidebar", "page-with-left-sidebar", "menu-open", "post comments-open", "has-comments", "article-header", "content widget", "navy"):
        assert H.extract(f"<body><div class='{name}'><p>{long}</div>") == long.strip(), name
    deep = H.extract("<div>" * 20_000 + "deep")
    assert deep == "deep" and H.extract("<div class=a>" * 300 + "x" + "</div>" * 300 + "y", ["html>div.a"]) == "x\n\ny"
