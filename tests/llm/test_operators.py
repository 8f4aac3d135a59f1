"""The corpus operators on small inputs: nulls, empty and repeated rows, and results of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import op1_neighbours, op2_token_counts, op3_url_filters, op4_decontamination, op5_toxicity, op6_mixing, op7_language_id, op8_html_extraction, op9_license_scan, op10_ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 1.0) for i, t, lang, s in rows], DOCS)


EDGE = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "one two", "en", "a"), (4, "!!! 123", None, "b"), (5, "word " * 5_000, "en", "b")]


@pytest.mark.parametrize("rows", [[], EDGE])
def test_defined_results_on_edges(spark, rows):
    d = docs(spark, rows)
    n = len(rows)
    assert op2_token_counts.length_histogram(d).agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0] == n
    bench = spark.createDataFrame([(1, "word " * 9), (2, None)], "item_id long, text string")
    assert sorted((r["n_words"], r["n_hit"]) for r in op4_decontamination.scan(d, bench).collect()) == sorted({0: []}.get(n, [(0, 0), (0, 0), (0, 0), (2, 0), (1, 0), (5_000, 5_000)]))
    labels = spark.createDataFrame([(1, None), (2, 0), (5, 1)], "doc_id long, toxic int")
    assert op5_toxicity.score(d, op5_toxicity.learn(d, labels)).count() == n
    queue, limit = op6_mixing.plan_mix(d)
    assert op6_mixing.taken(queue, limit).count() == n
    said = op7_language_id.identify(d, op7_language_id.learn(d)).select("text", "lang_pred").collect()
    assert len(said) == n and all(r["lang_pred"] == "und" for r in said if not r["text"] or r["text"] == "!!! 123")
    found = op10_ngram_join.join_documents(d).collect()
    assert len(found) == n and all(r["component_id"] == r["doc_id"] for r in found)
    assert op9_license_scan.scan(d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"), "text")).count() == n


def test_neighbours_equal_brute_force_with_ties(spark):
    x = np.random.default_rng(1).standard_normal((400, 8)) * np.arange(1, 401)[:, None] ** 0.1
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    got = op1_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = 0
    for q in range(0, 400, 20):
        s = (x[q] * x).sum(1)
        want = [k for k in np.lexsort((np.arange(400), -s)) if k != q][:20]
        hits += len(set(want) & set(by[q].values()))
        assert sorted(by[q]) == list(range(1, 21))
    assert hits >= 0.9 * 400 and [by[60][k] for k in range(1, 21)] == [k for k in range(50, 71) if k != 60]
    assert op1_neighbours.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_token_sums(spark):
    d = docs(spark, [(i, "the cat sat " * i, "en", "a") for i in range(6)])
    h = op2_token_counts.length_histogram(d)
    lengths = [r["n_tokens"] for r in h.collect() for _ in range(r["n_docs"])]
    assert all(r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in lengths) for r in op2_token_counts.suffix_sums(h).collect())
    assert [r["truncated_total"] for r in op2_token_counts.truncated_totals(h, [0, 5]).collect()] == [0, sum(min(x, 5) for x in lengths)]


def test_rules_both_ways(spark):
    urls = ["https://A.example.com/en/1", "http://www.example.com/en/x", "http://x.net/fr/", "http://net/es/", "nourl", None, "http://b.com", "http://b.org/en/?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    a, b = (sorted(op3_url_filters.judge(pages, op3_url_filters.PAGE_RULES, max_broadcast=m).collect()) for m in (0, 100))
    assert a == b and [r["rule"] for r in a] == ["example.com/en/", "www.example.com/en/", "net/fr/", "net/es/", None, None, None, None]


def test_decontamination_cuts_and_drops(spark):
    items = [(1, "a1 b1 c1 d1 e1 f1 g1 h1 i1"), (2, "x2 y2 z2")]
    rows = [(1, "Start A1 b1, c1 d1 e1 f1 g1 h1 end of this rather long text here now", "en", "s"), (2, "clean text", "en", "s"), (3, "a1 b1 c1 d1 e1 f1 g1 h1 x2 y2 z2", "en", "s")]
    out = {r["doc_id"]: r["text"] for r in op4_decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == {1: "Start  end of this rather long text here now", 2: "clean text"}


def test_mix_is_near_targets(spark):
    d = docs(spark, [(i, "w " * (1 + i % 7), "en", "abc"[i % 3]) for i in range(900)])
    queue, limit = op6_mixing.plan_mix(d)
    for r in op6_mixing.taken(queue, limit).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") / F.col("size")).alias("m")).collect():
        assert abs(r["t"] - r["g"]) <= 8 and r["m"] <= 2


def test_mix_keeps_repeated_rows_apart(spark):
    rows = [(k // 2, "w " * (1 + k // 2 % 5), "en", "ab"[k // 2 % 2]) for k in range(80)] + [(None, "x y", None, "a"), (None, "y x", None, "a"), (None, "y x", None, "a"), (3, None, None, None)]
    d = docs(spark, rows)
    queue, limit = op6_mixing.plan_mix(d)
    want = sorted((str(r["doc_id"]), r["size"]) for r in op6_mixing.taken(queue, limit).collect() for _ in range(r["taken"] // max(r["size"], 1)))
    out = op6_mixing.mixed(d).collect()
    assert sorted((str(r["doc_id"]), len(r["text"].split())) for r in out) == want
    most = {}
    for r in out:
        most[r["doc_id"], r["text"]] = most.get((r["doc_id"], r["text"]), 0) + 1
    assert all(n <= 2 * sum((i, t) == key for i, t, *_ in rows) for key, n in most.items())


def test_extraction_and_model_join(spark):
    page = "<html><body><nav><a>Menu</a></nav><div class=box>{n}</div><article><h1>T &amp; U</h1><p>Text {k}<p>a\n b</article><footer>F</footer>"
    pages = spark.createDataFrame([(k, "http://h.org/x", page.format(n="Always the same", k=k)) for k in range(20)] + [(99, None, None)], "page_id long, url string, html string")
    a, b = ({r["page_id"]: r["text"] for r in op8_html_extraction.extract(pages, max_model=m).collect()} for m in (1_000, 0))
    assert a == b and a[3] == "T & U Text 3 a b" and a[99] == ""


def extracted(spark, pages, **kw):
    rows = spark.createDataFrame([(k, url, html) for k, (url, html) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in op8_html_extraction.extract(rows, **kw).collect()}


def test_measured_importance_overrules_names(spark):
    form = "<body><form id=aspnetForm><nav>Menu</nav><div class=c><h1>Title {k}</h1><p>All the text of page {k} stands in a form.</div><div class=d>Same on all</div></form>"
    article = "<body><nav>Menu {k}</nav><article><p>Read this too</p><p>Main text of page {k}, which is much longer than the menu</article>"
    pages = [("http://form.org/", form.format(k=k)) for k in range(6)] + [("http://art.org/", article.format(k=k)) for k in range(40)]
    for most in (1_000, 0):
        got = extracted(spark, pages, max_model=most)
        assert got[3] == "Title 3 All the text of page 3 stands in a form."
        assert got[9] == "Main text of page 3, which is much longer than the menu"


def test_copies_of_a_page_do_not_make_its_text_boilerplate(spark):
    page = "<body><div class=t>Text {k}</div><div class=s>Same on all</div></body>"
    pages = [("http://two.org/", page.format(k=0))] * 2 + [("http://many.org/", page.format(k=k)) for k in [0] * 30 + list(range(1, 9))]
    got = extracted(spark, pages)
    assert got[0] == got[1] == "Text 0 Same on all"
    assert [got[k] for k in range(2, 40)] == [f"Text {k}" for k in [0] * 30 + list(range(1, 9))]


def test_head_and_drawings_end_as_in_browsers(spark):
    pages = [
        "<html><head><meta charset=utf-8><title>No</title><body><article><p>Whole text</article>",
        "<head><link href=x><script>no()</script><p>Whole text",
        "<head><title>No</title></head><body><article><p>Whole <svg viewBox='0 0 1 1'/>text</article>",
        "<article><svg width=1><path d=z /><text>no</text></svg><p>Whole text</article>",
        "<article><svg width=1><style>p > b {}</style><path d=z><p>Whole text</article>",
    ]
    got = extracted(spark, [(None, p) for p in pages])
    assert [got[k] for k in range(5)] == ["Whole text"] * 5


def test_licenses_are_inherited(spark):
    files = spark.createDataFrame([(1, "p/LICENSE", "Released under the MIT License.\nmore"), (2, "p/q/r.txt", "text"), (3, "z.txt", "All rights reserved? no"), (4, "p/q/s.txt", "x\nLicensed under the Apache License, Version 2.0.")], "file_id long, path string, text string")
    got = {r["file_id"]: (r["license"], r["licensed_by"]) for r in op9_license_scan.scan(files).collect()}
    assert got[1] == ("MIT", "file") and got[2] == ("MIT", "p") and got[4] == ("Apache-2.0", "file")


def test_wrapped_notices_and_leading_blocks(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\ncode"
    go = "// Copyright 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage x"
    late = "Some words of prose\nReleased under the MIT License."
    files = spark.createDataFrame([(1, "m/a.c", mpl), (2, "g/a.go", go), (3, "g/h/b.txt", "text"), (4, "l/a.txt", late), (5, "l/b.txt", "text"), (6, "r/a.txt", "All rights reserved.\nx")], "file_id long, path string, text string")
    got = {r["file_id"]: (r["license"], r["licensed_by"]) for r in op9_license_scan.scan(files).collect()}
    assert got == {1: ("MPL-2.0", "file"), 2: ("BSD-3-Clause", "file"), 3: ("BSD-3-Clause", "g"), 4: ("MIT", "file"), 5: (None, None), 6: ("Proprietary", "file")}


def test_short_queries_find_long_neighbours(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    long = np.repeat(centres, 64, 0) + rng.normal(scale=0.002, size=(24 * 64, 8))
    short = 0.02 * (centres[np.arange(512) % 24] + rng.normal(scale=0.1, size=(512, 8)))
    x = np.concatenate([short, long])
    ids = np.concatenate([20 * np.arange(512), 20 * np.arange(24 * 64) + 1])
    got = op1_neighbours.neighbours(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    scores = short @ x.T
    scores[np.arange(512), np.arange(512)] = -np.inf
    best = {(int(ids[q]), int(ids[k])) for q in range(512) for k in np.argsort(-scores[q])[:20]}
    assert len(best & found) >= 0.98 * len(best)


def test_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in rng.integers(0, 500, 80 + 20 * group)]
        for copy in range(12):
            words = list(base)
            for at in rng.integers(0, len(words), copy // 3):
                words[at] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s"))
    rows += [(len(rows), rows[0][1].upper(), "en", "s"), (len(rows) + 1, "two words", "en", "s"), (len(rows) + 2, "Two words", "en", "s"), (len(rows) + 3, "words two", "en", "s")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, *_ in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_ngram_join.join_documents(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
