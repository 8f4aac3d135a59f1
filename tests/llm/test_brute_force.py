"""The operators against brute force, and their defined cases: names of columns, very long texts, repeats, ties."""

import collections
import math
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import op1_neighbours, op2_token_counts, op3_url_filters, op4_decontamination, op5_toxicity, op6_mixing, op7_language_id, op8_html_extraction, op9_license_scan, op10_ngram_join

#: Columns that clash with results, with each other but for case, or that need quotes.
ODD = ["doc_id", "text", "lang", "source", "Score", "a.b", "mix_epoch", "lang_pred", "finish", "k"]


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "S", "dot", 4, "L", "f", 9) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, Score string, `a.b` string, mix_epoch int, lang_pred string, finish string, k int")


def nearest(x, ids, q, k=20):
    s = (x[q] * x).sum(1)
    order = np.lexsort((ids, -s))
    return [int(ids[j]) for j in order if ids[j] != ids[q]][:k]


# 1


def test_neighbours_over_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 128), ("GROUP", 3), ("PACK", 32), ("FAN", 2)):
        monkeypatch.setattr(op1_neighbours, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6_000)] + 0.3 * rng.normal(size=(6_000, 24))
    x[100:400] = 3 * x[100]  # a common vector
    ids = np.arange(6_000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = op1_neighbours.neighbours(spark.createDataFrame([*rows, *rows[:50]], "vec_id long, embedding array<double>").withColumn("a.b", F.lit(1)), every=60).collect()
    by = collections.defaultdict(dict)
    for r in got:
        by[r["query_id"]][r["rank"]] = r
    hits = sum(len(set(nearest(x, ids, q)) & {r["vec_id"] for r in by[q].values()}) for q in range(0, 6_000, 60))
    assert hits >= 0.98 * 20 * 100 and all(sorted(ranks) == list(range(1, 21)) for ranks in by.values())
    assert [by[120][k]["vec_id"] for k in range(1, 21)] == [k for k in range(100, 121) if k != 120]  # ties go to the smaller ids
    assert all(abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-9 for r in got)


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_neighbours_whose_squares_leave_the_range(spark, size):
    x = np.random.default_rng(4).normal(size=(120, 6))
    rows = [(i, (v * size).tolist()) for i, v in enumerate(x)]
    got = op1_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=40).collect()
    for q in (0, 40, 80):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == nearest(x, np.arange(120), q)


# 2


def test_token_counts_equal_brute_force(spark):
    count = op2_token_counts.make_counter("x.tiktoken", open(op2_token_counts.DEFAULT_VOCABULARY, "rb").read())
    texts = ["", None, "a", "a", "the cat sat", "Ünïcode  text\n\n here", "x" * 2_000, "  lead", "<|endoftext|>", *("w " * k for k in range(0, 3_000, 170))]
    lengths = [count([t])[0] if t else 0 for t in texts]
    h = op2_token_counts.length_histogram(odd_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    assert {r["n_tokens"]: r["n_docs"] for r in h.collect()} == collections.Counter(lengths)
    rows = {r["n_tokens"]: r for r in op2_token_counts.suffix_sums(h).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        above = [x for x in lengths if x >= n]
        assert (r["docs_ge"], r["tokens_ge"], r["total_docs"], r["total_tokens"]) == (len(above), sum(above), len(lengths), sum(lengths))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and math.isclose(r["quantile"], sum(x <= n for x in lengths) / len(lengths))
    for r in op2_token_counts.length_quantiles(h, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == next(x for x in sorted(lengths) if sum(y <= x for y in lengths) >= r["p"] * len(lengths))
    for r in op2_token_counts.truncated_totals(h, [0, 3, 10**6]).collect():
        assert (r["truncated_total"], r["n_truncated"]) == (sum(min(x, r["context_limit"]) for x in lengths), sum(x > r["context_limit"] for x in lengths))


def test_long_runs_of_blanks(monkeypatch):
    import tiktoken

    content = open(op2_token_counts.DEFAULT_VOCABULARY, "rb").read()
    count = op2_token_counts.make_counter("x.tiktoken", content)
    assert count([" " * 1_000_000 + "a"])[0] > 10 and count(["\n" * 1_500_000 + "a" + "\t" * 1_000_000])[0] > 10
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    whole = tiktoken.Encoding("own", pat_str=op2_token_counts.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = np.random.default_rng(5)
    for _ in range(60):  # runs that the engine can take whole: cut or not, the count is the same
        runs = ["".join(rng.choice(list(" \n\t  "), rng.integers(10_000, 12_000), p=[0.6, 0.2, 0.1, 0.05, 0.05])) for _ in range(2)]
        text = "".join(x for k in range(2) for x in (str(rng.choice(["a", "b1", "", "!?", "é"])), runs[k])) + str(rng.choice(["", "z", "9", "'s"]))
        assert "".join(op2_token_counts.cut_at_long_runs(text)) == text and count([text])[0] == len(whole(text))


# 3


def test_urls_edges(spark):
    long = "http://www.example.com/en/" + "x/" * 60_000
    pages = spark.createDataFrame([(1, long, 1), (2, long, 1), (3, "", 1), (4, None, 1), (4, None, 1), (5, "HTTP://EXAMPLE.com/en/a?b", 1)], "page_id long, url string, `rule.x` int")
    a, b = (sorted(tuple(r) for r in op3_url_filters.judge(pages, op3_url_filters.PAGE_RULES, max_broadcast=m).collect()) for m in (0, 100))
    assert a == b and [(r[0], r[3], r[4]) for r in a] == [(1, "www.example.com/en/", "allow"), (2, "www.example.com/en/", "allow"), (3, None, "allow"), (4, None, "allow"), (4, None, "allow"), (5, "example.com/en/", "block")]
    for most in (0, 100):
        assert op3_url_filters.judge(pages.limit(0), op3_url_filters.PAGE_RULES, max_broadcast=most).isEmpty()
        assert {r["verdict"] for r in op3_url_filters.judge(pages, [], max_broadcast=most - 1).collect()} == {"allow"}


# 4


@pytest.mark.parametrize(("most", "held"), [(500_000, 4), (25, 2)])
def test_decontamination_equals_sql(spark, most, held):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words, rng.integers(1, 60)))) for k in range(12)] + [(20, None), (21, "..."), (22, ",".join(rng.choice(words, 70))), (3, "w1 w2"), (None, "w3 w4 w5")]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 200)))) for k in range(60)]
    for k in range(40):
        own = items[int(rng.integers(0, 12))][1].upper().split()
        at = int(rng.integers(0, max(1, len(own) - 7)))
        rows.append((100 + k, " ".join([*rng.choice(words, 5), *own[at : at + 12], "zz", *rng.choice(words, 5)])))
    rows += [(500, None), (501, ""), (502, "été-" * 40_000 + items[0][1])]
    found = op4_decontamination.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_words=most, max_held=held)
    got = sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256), F.col("n_items") >= 2).collect())
    con = duckdb.connect()
    for name, table, key in (("documents", rows, "doc_id"), ("benchmark", [("null" if i is None else str(i), t) for i, t in items], "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} {'BIGINT' if key == 'doc_id' else 'VARCHAR'}, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", table)
    assert got == sorted(con.execute(op4_decontamination.ORACLE_SQL["op4_decontamination"]).fetchall())
    if most < 100:
        assert len(op4_decontamination.build(spark.createDataFrame(items, "item_id long, text string"), max_words=most)) > 8


def test_no_window_is_left_across_a_cut(spark):
    item = " ".join(f"a{k}" for k in range(10))
    first, last = " ".join(f"a{k}" for k in range(5)), " ".join(f"a{k}" for k in range(5, 10))
    docs = odd_docs(spark, [(1, f"{'x ' * 40}{first} {item} {last} {'y ' * 40}", "en", "s"), (2, None, None, None)])
    out = op4_decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == ODD and {r["doc_id"]: r["text"] and r["text"].split() for r in out.collect()} == {1: ["x"] * 40 + ["y"] * 40, 2: None}


# 5


def toxic_corpus(spark, n=1_600):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijk"), rng.integers(3, 9))) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, 50))
        bad = k % 4 == 0
        if bad:
            for at in rng.integers(0, 50, 5):
                text[at] = ("you m0ron", "worthless", "you scum!!")[at % 3]
        rows.append((k, " ".join(text), "en", "s"))
        labels.append((k, int(bad)))
    return odd_docs(spark, rows), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    truth = dict(labels)
    model = op5_toxicity.learn(docs, table(labels))
    scored = op5_toxicity.score(docs, model)
    assert scored.columns == [c for c in ODD if c != "Score"] + ["score"]
    got = {r["doc_id"]: (r["held"], r["score"]) for r in scored.select("doc_id", op5_toxicity.held_out(F.col("doc_id")).alias("held"), "score").collect()}
    held = [i for i, (h, _) in got.items() if h]
    assert len(held) > 200 and all(0 <= s <= 1 for _, s in got.values())
    assert sum((got[i][1] >= 0.3) == truth[i] for i in held) >= 0.97 * len(held)
    # Labels of the held-out fold don't matter.
    other = op5_toxicity.learn(docs, table([(i, 1 - y if got[i][0] else y) for i, y in labels]))
    assert {r["doc_id"]: r["score"] for r in op5_toxicity.score(docs, other).collect()} == {i: s for i, (_, s) in got.items()}
    kept = op5_toxicity.civil(docs, model)
    assert kept.columns == ODD and kept.select("Score", "`a.b`").distinct().collect() == [("S", "dot")]


def test_repeated_labelled_ids_are_learned_from_once(spark):
    docs, labels = toxic_corpus(spark, 400)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    again = docs.union(docs).union(docs)
    x = np.random.default_rng(1).random((50, len(op5_toxicity.FEATURES)))
    assert (op5_toxicity.learn(docs, table).scores(x) == op5_toxicity.learn(again, table).scores(x)).all()


def test_trees_and_calibration():
    rng = np.random.default_rng(8)
    x = rng.random((2_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    trees = op5_toxicity.Trees().fit(x[:1_000], y[:1_000])
    assert ((trees.raw(x[1_000:]) > 0) == y[1_000:]).mean() > 0.97
    score = rng.normal(size=600)
    truth = (rng.random(600) < 1 / (1 + np.exp(-2 * score))).astype(float)
    fitted = op5_toxicity.Isotonic().fit(score, truth)
    out = fitted(np.sort(score))
    assert (np.diff(out) >= 0).all() and out.min() >= 0 and out.max() <= 1
    assert abs(fitted(score).mean() - truth.mean()) < 0.03
    long = "x" * 5_000
    assert op5_toxicity.term(long) in op5_toxicity.terms_of(f"a {long}") and len(op5_toxicity.term(long)) < 100


# 6


def test_equal_rows_cost_no_more_than_different_ones(spark):
    took = []
    for n, same in ((20_000, False), (20_000, True)):
        docs = spark.range(n).select((F.lit(1) if same else F.col("id")).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("a.b"), F.lit(2).alias("mix_epoch"))
        began = time.time()
        out = op6_mixing.mixed(docs)
        assert out.columns == [*docs.columns, "mix_finish", "mix_epoch_"]
        assert out.agg(F.count("*"), F.countDistinct("mix_finish")).first() == (30_000, 30_000)
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 5


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(9)
    size = {f"h{k:04d}": int(rng.integers(1, 400)) for k in range(900)} | {None: 50}
    docs = spark.createDataFrame([(k, "w " * n, "en", s) for k, (s, n) in enumerate(size.items())], "doc_id long, text string, lang string, source string")
    queue, limit = op6_mixing.plan_mix(docs)
    got = {r["source"]: r["target"] for r in op6_mixing.taken(queue, limit).collect()}
    ranked = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}
    low, high, budget = 0.0, 1e6, 1.5 * sum(size.values())
    for _ in range(200):  # the water level, by halving
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * size[s]) for s in size) < budget else (low, level)
    assert all(math.isclose(got[s], min(level * weight[s], 2 * size[s]), rel_tol=1e-9) for s in size)


# 7


def test_cosines_equal_plain_bundles(spark):
    def vector(code):
        return np.random.default_rng([op7_language_id.SEED, code]).integers(0, 2, op7_language_id.DIMENSIONS, np.int8).astype(int) * 2 - 1

    def bundle(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        line = " " + " ".join(words) + " " if words else ""
        out = np.zeros(op7_language_id.DIMENSIONS)
        for at in range(len(line) - 2):
            out += math.prod(np.roll(vector(ord(c)), place) for place, c in enumerate(line[at : at + 3]))
        return out

    unit = lambda v: v / np.linalg.norm(v)
    rows = [(1, "the quick brown fox", "en"), (2, "der schnelle braune Fuchs über", "de"), (3, "el rápido zorro marrón", "es"), (5, "the lazy dog", "en"), (9, "der faule Hund", "de")]
    docs = spark.createDataFrame([*rows, *[(None, t, x) for _, t, x in rows]], "doc_id long, text string, lang string")
    fold = {r["doc_id"]: r["h"] for r in docs.where("doc_id is not null").select("doc_id", op7_language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    want = {}
    for i, text, lang in rows:
        if not fold[i]:
            want[lang] = want.get(lang, 0) + unit(bundle(text))
    learned = op7_language_id.learn(docs)
    assert set(learned) == set(want) and all(np.allclose(learned[x], unit(v), atol=1e-4) for x, v in want.items())
    for r in op7_language_id.identify(docs, learned).collect():
        cosines = {x: float(unit(bundle(r["text"])) @ unit(v)) for x, v in want.items()}
        assert r["lang_pred"] == min(cosines, key=lambda x: (-round(cosines[x], 6), x)) and abs(r["score"] - max(0, max(cosines.values()))) < 1e-3


def test_languages_on_held_out_rows(spark):
    rng = np.random.default_rng(10)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    words = {x: ["".join(rng.choice(list(s), rng.integers(2, 8))) for _ in range(300)] for x, s in letters.items()}
    rows = [(k, " ".join(rng.choice(words[x], 30)), x, "s") for k in range(1_500) for x in ("cc" if k % 500 == 0 else ("aa", "bb")[k % 2],)]
    rows += [(9_000, None, "aa", "s"), (9_001, "", "aa", "s"), (9_002, "½ ² ① 12 --- ٣", "aa", "s"), (9_003, "́̂", "aa", "s"), (9_004, "abc " * 300_000, "aa", "s")]
    docs = odd_docs(spark, rows)
    learned = op7_language_id.learn(docs, max_training=600)
    said = op7_language_id.identify(docs, learned)
    assert said.columns == [c for c in ODD if c not in ("Score", "lang_pred")] + ["lang_pred", "score"]
    got = {r["doc_id"]: r for r in said.withColumn("held", op7_language_id.held_out(F.col("doc_id"))).collect()}
    held = [r for i, r in got.items() if r["held"] and i < 9_000]
    assert set(learned) == set(letters)  # the rare one, too
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in range(9_000, 9_004)) and got[9_004]["lang_pred"] == "aa"
    kept = op7_language_id.speakable(docs, learned, op7_language_id.floors(docs, learned))
    assert kept.columns == ODD and kept.select("Score", "lang_pred").distinct().collect() == [("S", "L")]
    assert {i for i in range(9_000, 9_004)} & {r["doc_id"] for r in kept.collect()} == set() and kept.count() >= 0.99 * 1_500


def test_languages_are_learned_from_every_training_text(spark):
    rng = np.random.default_rng(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    rows = [(k, "".join(rng.choice(list(letters[x]), rng.integers(4, 30))), x) for k in range(32_000) for x in ("cc" if k % 4_000 == 0 else ("aa", "bb")[k % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8, "doc_id")
    known = docs.where(~op7_language_id.held_out(F.col("doc_id"))).select("text", "lang").collect()
    assert op7_language_id.training(docs).count() == len(known) > 22_000
    profiles, want = op7_language_id.Profiles(), {}
    for x in letters:
        want[x] = op7_language_id._unit(op7_language_id._unit(profiles.bundles([r["text"] for r in known if r["lang"] == x])).sum(0, dtype=np.float64))
    learned = op7_language_id.learn(docs)
    assert set(learned) == set(want) and all(np.allclose(learned[x], v, atol=1e-6) for x, v in want.items())
    names, floors = sorted(learned), {}
    for k, x in enumerate(names):
        cosine = np.round(op7_language_id._unit(profiles.bundles([r["text"] for r in known if r["lang"] == x])) @ np.stack([learned[y] for y in names]).T, 6)
        own = cosine[cosine.argmax(1) == k, k].astype(float)
        floors[x] = max(op7_language_id.MIN_SCORE, op7_language_id.FLOOR_SHARE * float(np.quantile(own, op7_language_id.FLOOR_QUANTILE)))
    found = op7_language_id.floors(docs, learned)
    assert found == pytest.approx(floors, abs=1e-6) and max(found.values()) > op7_language_id.MIN_SCORE


# 8


def plain_tree(pages, gamma=op8_html_extraction.GAMMA):
    """What stays of pages without telling names, by dictionaries: (url, html) in, texts out."""
    hosts = collections.defaultdict(dict)
    for url, page in pages:
        hosts[op8_html_extraction.host_of(url)][page] = op8_html_extraction.blocks_of(page)
    gone = set()
    for host, held in hosts.items():
        texts, styles = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
        for blocks, shapes in held.values():
            for path, text in {(b[0], b[3]) for b in blocks}:
                texts[path][text] += 1
            for path, style in set(shapes):
                styles[path][style] += 1
        m = {path: sum(any(b[0] == path for b in blocks) for blocks, _ in held.values()) for path in texts}
        measure = {}
        for path, counts in texts.items():
            for text, c in counts.items():
                content = 1 - math.log(c) / math.log(m[path]) if m[path] > 1 else 1.0
                n = sum(styles[path].values())
                shape = content if not n else 1.0 if n == 1 else -sum(k / n * math.log(k / n, n) for k in styles[path].values())
                measure[path, text] = gamma * content + (1 - gamma) * shape
        mass = {key: len(key[1].split()) * texts[key[0]][key[1]] for key in measure}
        level = sum(measure[k] * mass[k] for k in mass) / sum(mass.values())
        for path in texts:
            own = [k for k in measure if k[0] == path]
            mean = sum(measure[k] * mass[k] for k in own) / sum(mass[k] for k in own)
            trust = 0.0 if m[path] < 4 else 5 * min(1.5, math.log(m[path]) / math.log(30))
            for key in own:
                if 1 + trust * (mean - max(0.5, level)) < 0 or 1 + trust * (measure[key] - 0.5) < 0:
                    gone.add((host, *key))
    return [" ".join(b[3] for b in op8_html_extraction.blocks_of(page)[0] if (op8_html_extraction.host_of(url), b[0], b[3]) not in gone) for url, page in pages]


def nameless(n=60):
    """Pages of plain divs: a fixed head, rotating boxes, unique text, and a foot with the host's name."""
    rng = np.random.default_rng(12)
    pages = []
    for k in range(n):
        host = ("big.org", "big.org", "big.org", "small.org")[k % 4]
        body = "".join(f"<p>Page {k} says {' '.join(rng.choice(list('abcdefgh'), 12))} here" for _ in range(int(rng.integers(2, 6))))
        pages.append((f"http://{host}/{k}", f"<body><div class=a><ul><li>Home<li>About us<li>Contact</ul></div><div class=b>Buy thing {k % 3} now</div><div class=c><h2>Title {k}</h2>{body}</div><div class=z>Copyright {host}</div></body>"))
    return pages


def texts_of(spark, pages, **kw):
    rows = spark.createDataFrame([(k, url, page, 1) for k, (url, page) in enumerate(pages)], "page_id long, url string, html string, `a.b` int")
    return [r["text"] for r in op8_html_extraction.extract(rows, **kw).orderBy("page_id").collect()]


@pytest.mark.parametrize("most", [1_000, 0])
def test_tree_without_names_equals_dictionaries(spark, most):
    pages = nameless()
    got = texts_of(spark, pages, max_model=most)
    assert got == plain_tree(pages)
    assert all(t.startswith(f"Title {k} Page {k} says") and "Buy" not in t and "Home" not in t and "Copyright" not in t for k, t in enumerate(got) if k % 4 != 3)


def test_an_empty_model_removes_nothing(spark):
    pages = [(f"http://h.org/{k}", f"<body><nav>Menu {k}</nav><article><p>Text {k} is longer than that</article><footer>Foot</footer>") for k in range(8)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    model = op8_html_extraction.tree(rows)
    assert texts_of(spark, pages, model=model) == [f"Text {k} is longer than that" for k in range(8)] and model.count() > 0
    assert texts_of(spark, pages, model=model.limit(0)) == [f"Menu {k} Text {k} is longer than that Foot" for k in range(8)]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</section>" * 50_000, "<a b=\"" * 50_000 + "x", "<p title='" * 50_000 + "> x", "<a x=\">\" " * 50_000 + "x", "<" * 100_000 + "x", "<p>x" * 50_000, "<ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, "<svg>" * 50_000 + "x", "<!--" * 50_000 + "x"])
def test_pages_are_read_in_linear_time(page):
    began = time.time()
    op8_html_extraction.blocks_of(page)
    assert time.time() - began < 5


def test_markup(spark):
    pages = ["<html><head><meta x><title>No</title><p>Hi <b>you</b>", "<p>1 < 2 and <3</p>", '<article><h1 class="article-header">T</h1><div class="related-work">R</div><div class="search-results">S</div><div class="comments">C</div><svg/>x</article>', '<a "foo>bar</a>', "<svg><path>no</svg>a<svg><title>t</title><p>b", "</p>x&amp;y&#x41;", "<script>no", "", None]
    assert texts_of(spark, [(f"http://h{k}.org/", p) for k, p in enumerate(pages)]) == ["Hi you", "1 < 2 and <3", "T R S x", "bar", "a b", "x&yA", "", "", ""]
    assert texts_of(spark, []) == []
    assert texts_of(spark, [(None, "<p>a")] * 3) == ["a"] * 3


# 9


def test_licences_that_were_taken_for_others():
    judge = op9_license_scan.Templates({}, 1_000).of_text
    gpl = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    for text, name in (
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("This program is free software: " + gpl.format("Affero"), "AGPL-3.0"),
        ("made available under the terms of the Eclipse Public License v2.0", "EPL-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("// SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"), ("SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: Unlicense", "Unlicense"),
        (op9_license_scan.TEMPLATES["BSD-2-Clause"][-1], "BSD-2-Clause"), (op9_license_scan.TEMPLATES["BSD-3-Clause"][-1], "BSD-3-Clause"), ("Some rights reserved.", None),
        ("GNU GENERAL PUBLIC LICENSE Version 2", "GPL-2.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"), ("Copyright (c) 1999 Someone\n\n" + op9_license_scan.TEMPLATES["MIT"][-1], "MIT"),
        (op9_license_scan.TEMPLATES["ISC"][-1], "ISC"), (op9_license_scan.TEMPLATES["0BSD"][-1], "0BSD"), ("Licensed under the Foo License, Version 2.0.", None), ("All rights reserved.", "Proprietary"), ("word " * 200_000 + "Released under the MIT License.", "MIT"),
    ):
        assert judge(text)[0] == name, text[:60]


def test_cosines_of_lines_equal_plain_vectors(spark):
    docs = spark.createDataFrame([(k, None, t) for k, t in enumerate(["Licensed under the Apache License", "license of the work", "Released under MIT license now", "nothing"])], "file_id long, path string, text string")
    df, n = op9_license_scan.document_frequencies(docs)
    assert n == 4 and (df["license"], df["released"], df.get("mozilla", 0)) == (3, 1, 0)
    templates = op9_license_scan.Templates(df, n)
    weight = lambda words: {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w, c in collections.Counter(words).items()}
    line = op9_license_scan.words_of("Released under MIT license now")
    for s, k in templates.of_line("Released under MIT license now"):
        best = max(sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) for notice in op9_license_scan.TEMPLATES[templates.names[k]] if len(op9_license_scan.words_of(notice)) <= op9_license_scan.NOTICE_WORDS for a, b in [(weight(line), weight(op9_license_scan.words_of(notice)))])
        assert s <= best + 1e-8
    assert any(templates.names[k] == "MIT" for _, k in templates.of_line("Released under MIT license now"))


def test_only_licence_files_speak_for_directories(spark):
    rows = [(1, "p/util.py", "# SPDX-License-Identifier: MIT\ncode"), (2, "p/other/x.py", "code"), (3, "q/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nsee also the GNU Lesser General Public License version 3"), (4, "q/a/b/c.c", "code"), (5, "q/a/LICENSE.txt", "Licensed under the MIT License."), (6, "whole/readme", op9_license_scan.TEMPLATES["ISC"][-1]), (7, "whole/x", "code"), (8, None, "code"), (9, "top.c", "code"), (9, "top.c", "code")]
    files = spark.createDataFrame([(*r, 1) for r in rows], "file_id long, path string, text string, `a.b` int")
    got = {r["file_id"]: (r["license"], r["licensed_by"]) for r in op9_license_scan.scan(files).collect()}
    assert got == {1: ("MIT", "file"), 2: (None, None), 3: ("GPL-3.0", "file"), 4: ("MIT", "q/a"), 5: ("MIT", "file"), 6: ("ISC", "file"), 7: ("ISC", "whole"), 8: (None, None), 9: (None, None)}
    tie = spark.createDataFrame([(1, "d/LICENSE", "Licensed under the MIT License."), (2, "d/COPYING", "Licensed under the ISC License."), (3, "d/e/x", "code")], "file_id long, path string, text string")
    assert {r["license"] for r in op9_license_scan.scan(tie).where("file_id = 3").collect()} == {"ISC"}


# 10


@pytest.mark.parametrize("hot", [20_000, 4])
def test_components_equal_brute_force(spark, hot):
    rng = np.random.default_rng(13)
    words = [f"w{k}" for k in range(50)]
    base = [list(rng.choice(words, 70)) for _ in range(25)]
    rows = []
    for k in range(400):
        own = list(base[k % 25])
        for at in rng.integers(0, 70, rng.integers(0, 7)):
            own[at] = f"x{at % 9}"
        rows.append((k, " ".join(own), "en", "s"))
    rows += [(900, None, None, None), (901, "", None, None), (902, "a b", None, None), (903, "A  b", None, None), (904, " ".join(base[0]), None, None), (904, " ".join(base[1]), None, None), (905, "long " + " ".join(f"q{k}" for k in range(250_000)), None, None)]
    shingler = op10_ngram_join.Shingler()
    sets = [shingler.set_of(t) for _, t, _, _ in rows]
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if op10_ngram_join.linked(sets[a], sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    got = op10_ngram_join.join_documents(odd_docs(spark, [*rows, (None, "a b", None, None)]), hot=hot).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len(s), find(r[0])) for r, s in zip(rows, sets, strict=True))
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_one_of_each_is_repeatable(spark):
    rows = [(1, "b " + "x y z w " * 9, "en", "s"), (1, "a other words that say something else here", "en", "s"), (1, "a other words that say something else here", "de", "s"), (2, "b " + "x y z w " * 9, "en", "s"), (None, "b " + "x y z w " * 9, "en", "s")]
    for order in (rows, rows[::-1]):
        out = op10_ngram_join.one_of_each(odd_docs(spark, order))
        assert out.columns == ODD
        assert sorted(((r["doc_id"] or 0), r["text"][0]) for r in out.collect()) == [(0, "b"), (1, "a")]


def test_unlinked_documents_of_stock_sentences_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(14)
    stock = [" ".join(f"s{k}w{j}" for j in range(12)) for k in range(40)]
    seen, plain = [], op10_ngram_join._pairs

    def counted(met):
        pairs = plain(met)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(op10_ngram_join, "_pairs", counted)
    for n in (500, 1_000):
        docs = spark.createDataFrame([(k, " ".join(stock[j] for j in rng.choice(40, 10, replace=False))) for k in range(n)], "doc_id long, text string")
        assert op10_ngram_join.join_documents(docs).where("component_id <> doc_id").isEmpty()
        assert max(seen[-2:]) <= 4 * n  # the first comparisons, and then the pairs that tiles leave open


def test_very_long_texts_and_ties(spark):
    long = "word " * 500_000
    docs = odd_docs(spark, [(1, long, "bb", "s"), (2, long, "aa", "s"), (3, "word", None, "s"), (None, long, None, None), (5, None, None, None)])
    queue, limit = op6_mixing.plan_mix(docs)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in op6_mixing.taken(queue, limit).collect()) == [(0, 500_000), (1, 500_000), (2, 500_000), (3, 1), (5, 0)]
    model = op5_toxicity.Model({"word": 3.0}, None, None, 0.25)
    assert {r["score"] for r in op5_toxicity.score(docs, model).collect()} == {0.25}
    assert op5_toxicity.Features({"word": 3.0}).of(long)[1] == pytest.approx(math.log1p(500_000))
    same = op7_language_id._unit(op7_language_id.Profiles().bundles([long]))[0]
    said = op7_language_id.identify(docs, {"bb": same, "aa": same}).collect()
    assert [r["lang_pred"] for r in sorted(said, key=lambda r: r["doc_id"] or 0)] == ["aa"] * 4 + ["und"]  # equal cosines: the smaller name
