"""The pipeline on a small corpus, against what plain Python keeps."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, finish string, lang_pred int"
LETTERS = {"en": "abcdefghijk", "xx": "pqrstuvwxyz"}


def corpus():
    """Rows, and the ids of those that are toxic, copies of others, letterless, contaminated, or hold one benchmark passage."""
    rng = np.random.default_rng(11)
    vocabulary = {lang: ["".join(rng.choice(list(s), rng.integers(3, 9))) for _ in range(400)] for lang, s in LETTERS.items()}
    items = [" ".join(rng.choice(vocabulary["en"], 12)) for _ in range(3)]
    rows, sets = [], {"toxic": set(), "copy": set(), "empty": set(), "leak": set(), "passage": set()}

    def add(text, lang, kind=None):
        rows.append((len(rows), text, lang, "abc"[len(rows) % 3] if len(rows) % 7 else None, None, "kept", "x", 7))
        if kind:
            sets[kind].add(len(rows) - 1)

    def prose(lang, n=60):
        return list(rng.choice(vocabulary[lang], n))

    for k in range(700):
        lang = ("en", "xx")[k % 2]
        if k % 4 == 3:
            words = prose(lang)
            for at in rng.integers(0, 60, 6):
                words[at] = "you Idiot!" if at % 2 else "moron"
            add(" ".join(words), lang, "toxic")
        else:
            add(" ".join(prose(lang)), lang)
    first = rows[0][1]
    for _ in range(3):
        add(first, "en", "copy")
    add(first.upper(), "en", "copy")
    add(first + " tail", "en", "copy")
    add("1234 --- 99", "en", "empty")
    add(None, None, "empty")
    add("", "en", "empty")
    add(" ".join([*prose("en"), items[0], *prose("en"), items[1]]), "en", "leak")
    add(" ".join([*prose("en", 80), items[2], *prose("en", 80)]), "en", "passage")
    return rows, items, sets


def mixed_by_hand(docs):
    """(doc_id, epoch) in mix order, from (doc_id, source, size)."""
    size = {}
    for _, source, n in docs:
        size[source] = size.get(source, 0) + n
    ranked = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}
    budget, target, free = 1.5 * sum(size.values()), {}, set(ranked)
    while free:
        rest = budget - sum(target.values())
        full = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        target |= {s: 2 * size[s] for s in full} if full else {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        free = free - full if full else set()
    copies, served = [], dict.fromkeys(ranked, 0)
    for place, i, source, n in sorted((hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest(), i, s, n) for i, s, n in docs):
        served[source] += n
        copies += [((served[source] + e * size[source]) / target[source], ranked.index(source), place, n, e, i) for e in (0, 1)]
    copies.sort(key=lambda c: c[:5])
    upto = np.cumsum([c[3] for c in copies])
    return [(c[5], c[4]) for c, total in zip(copies, upto, strict=True) if total <= budget]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items, sets = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([*rows, rows[1], (None, " ".join(LETTERS["en"][k % 9] * 3 + "ab" for k in range(30)), "en", "a", None, "kept", "x", 7)], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] in sets["toxic"])) for r in rows if r[0] < 700], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items, sets


def test_stages_drop_what_they_should_and_nothing_else(spark, tables):
    at, rows, items, sets = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {r[0] for r in rows} | {None}
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], (("toxic",), ("empty",), ("copy",), ("leak",)), strict=True):
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, at), f"test-{name}")
        for kind in gone:
            kept -= sets[kind]
        found = {r[0] for r in docs.select("doc_id").collect()}
        if name == "toxicity":  # learned from few rows: all toxic documents go, and at most one clean one in a hundred
            assert found <= kept and 100 * len(kept - found) <= len(kept)
            kept = found
        assert found == kept, name
        assert docs.columns == columns
        assert docs.select("score", "finish", "lang_pred").distinct().collect() == [("kept", "x", 7)]
        if name == "ngram_jaccard_join":
            assert docs.count() == len(kept)  # the repeated row is one, too
    (passage,) = sets["passage"]
    text = docs.where(F.col("doc_id") == passage).first()["text"]
    assert items[2] not in text and len(text.split()) == 160
    mix = corpus_pipeline.STAGES[4][1](spark, docs, at)
    assert mix.columns == [*docs.columns, "mix_finish", "mix_epoch"]
    got = [(r["doc_id"], r["mix_epoch"]) for r in mix.collect()]
    assert got == mixed_by_hand([(r["doc_id"], r["source"], len(r["text"].split())) for r in docs.collect()])


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
