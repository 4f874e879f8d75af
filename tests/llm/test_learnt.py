"""Toxicity, quality, licences: held-out accuracy and defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from needlework.llm import licenses, quality, toxicity
from needlework.llm.common import held_out, labelled_sample, table
from needlework.llm.queries import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def accuracy(spark, name, label):
    got = queries()[name](spark, SF)
    rows = got.join(table(spark, SF, "labels"), "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    full = got.toPandas()
    assert len(full) == 1000 and full.score.between(0, 1).all()
    return rows


def test_toxicity_held_out(spark):
    rows = accuracy(spark, "op1_toxicity", "toxic")
    assert (rows.predicted == rows.y).mean() > 0.93
    assert ((rows.predicted == 1) & (rows.y == 0)).sum() <= 1


def test_quality_held_out(spark):
    rows = accuracy(spark, "op10_quality", "quality")
    assert (rows.predicted == rows.y).mean() > 0.93


def test_sample_leaves_the_held_out_fifth(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    own = labelled_sample(docs, labels, "toxic", 10_000)
    assert own.where(held_out("doc_id")).count() == 0
    assert own.count() == labels.where(~held_out("doc_id")).count()
    assert 0 < labelled_sample(docs, labels, "toxic", 100).count() < 200


def test_folding():
    assert toxicity.fold("Ѕсum 1d10t!! m0r0n's") == " scum idiot moron s "
    assert toxicity.fold("") == "  "
    assert toxicity.fold("ｉｄｉｏｔ mo\u200bron 𝐬𝐜𝐮𝐦 été") == " idiot moron scum été "
    assert toxicity.fold("in 2024 10 a@b") == " in 2024 10 aab "


def test_hits_and_exceptions():
    model = toxicity.ToxicityModel({" trash ": 3.0, " idio": 2.0, " idiot ": 2.5}, ("trash can",))
    assert model.hits(toxicity.fold("The trash can. Trash!")) == (3.0, 4)
    assert model.hits(toxicity.fold("idiot idiocy")) == (4.5, 2)
    assert model.hits(toxicity.fold("tr4sh cans")) == (3.0, 2)
    assert toxicity.ToxicityModel({}, ()).score("anything") < 0.5


def plain_hits(folded, weights, exceptions):
    """Every place by itself: the heaviest entry that begins there, unless an exception runs over it."""
    total, best = 0.0, [max((w for e, w in weights.items() if folded.startswith(e, i)), default=None) for i in range(len(folded))]
    for i, w in enumerate(best):
        if w is not None and not any(folded.startswith(f" {x} ", j) and j <= i < j + len(x) + 1 for x in exceptions for j in range(len(folded))):
            total += w
    return total


def test_hits_by_definition():
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abc"), r.integers(1, 4)))
    for _ in range(150):
        weights = {f" {word()}" + " " * int(r.integers(2)): float(r.integers(1, 9)) for _ in range(r.integers(0, 6))}
        exceptions = tuple({" ".join(word() for _ in range(r.integers(1, 4))) for _ in range(r.integers(0, 5))})
        model = toxicity.ToxicityModel(weights, exceptions)
        folded = toxicity.fold(" ".join(word() for _ in range(r.integers(0, 25))))
        assert abs(model.hits(folded)[0] - plain_hits(folded, weights, exceptions)) < 1e-9


def test_hits_take_time_in_proportion():
    import time

    model = toxicity.ToxicityModel({" idiot ": 2.5, " trash ": 3.0}, ("trash can",))
    began = time.perf_counter()
    assert model.hits(toxicity.fold("idiot trash can " * 60_000))[0] == 60_000 * 2.5
    assert time.perf_counter() - began < 10


def test_exceptions_around_beginnings_are_learnt(spark):
    rows = [(i, f"they are all scumbags of no use number {i}", 1) for i in range(60)] + [(100 + i, f"clean the scum line of the pool {i}" if i % 4 == 0 else f"a calm day number {i}", 0) for i in range(400)]
    rows = [x for x in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert any(e.startswith(" scum") for e in model.weights)
    assert model.score("clean the scum line of the pool") < 0.5 <= model.score("they are all scumbags of no use")


def test_ids_of_any_type(spark):
    docs, labels = (table(spark, SF, t).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))) for t in ("documents", "labels"))
    scores = quality.quality_scores(docs, quality.fit_quality(docs, labels, bound=200))
    assert scores.schema["doc_id"].dataType.simpleString() == "string" and scores.count() == 1000


def test_pool_by_definition():
    r = np.random.default_rng(4)
    units = {u: i for i, u in enumerate(["red", "cat", "<l2", "<l1", "<s.1"])}
    vectors = r.normal(size=(len(units), quality.DIM)).astype(np.float32)
    for _ in range(30):
        text = " ".join(r.choice(["red", "Cat", "dog", ".", "ab", "longword"], r.integers(1, 20)))
        found = quality.tokens(text)
        mean = lambda names: sum((vectors[units[x]] for x in names if x in units), np.zeros(quality.DIM)) / len(found)
        out = quality.pool(text, units, vectors)
        assert np.allclose(out[: quality.DIM], mean([x.lower() for x in found]), atol=1e-5)
        assert np.allclose(out[quality.DIM : 2 * quality.DIM], mean([quality.shape(x) for x in found]), atol=1e-5)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "!!!", None, None, None), (4, "long " * 50_000, "en", "s", 1)], SCHEMA).withColumn("score", F.lit("x")).withColumn("y", F.lit(1)).withColumn("x", F.lit(1))


def test_odd_rows(spark, odd):
    labels = table(spark, SF, "labels")
    docs = table(spark, SF, "documents")
    tox = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.toxicity_scores(odd, tox).collect()
    assert len(rows) == 5 and all(0 <= r.score < 0.5 for r in rows)
    kept = toxicity.drop_toxic(odd, tox)
    assert kept.count() == 5 and kept.columns == odd.columns
    good = quality.fit_quality(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(odd, good).collect())
    empty = odd.where("false")
    assert toxicity.toxicity_scores(empty, tox).count() == quality.quality_scores(empty, good).count() == 0
    # no labels, or one class only
    none = labels.where("false")
    assert toxicity.fit_toxicity(docs, none).score("idiot") < 0.5
    assert all(r.score == 1.0 for r in quality.quality_scores(odd, quality.fit_quality(docs, none)).collect())
    assert len(licenses.corpus_negatives(empty, 5)) == 0


def test_network_and_temperature():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    layers = quality.train_network(x[:500], y[:500], epochs=200)
    z = quality._logits(x[500:], layers)
    assert ((z > 0) == y[500:]).mean() > 0.9
    z = r.normal(size=4000) * 3
    y = (r.random(4000) < 1 / (1 + np.exp(-z / 3))).astype(float)
    assert 2.5 < quality.fit_temperature(z, y) < 3.6


def test_word_vectors_gather_neighbours(spark):
    rows = spark.createDataFrame([(0, "red cat runs"), (1, "red dog runs"), (2, "old tin sinks")], "doc_id long, text string")
    units = {u: i for i, u in enumerate(["red", "cat", "dog", "runs", "old", "tin", "sinks"])}
    v = quality._context_sums(rows, units)
    like = lambda a, b: v[units[a]] @ v[units[b]] / np.linalg.norm(v[units[a]]) / np.linalg.norm(v[units[b]])
    assert like("cat", "dog") > 0.99 > like("cat", "tin") + 0.3
    assert np.allclose(v[units["cat"]], quality.index_vector("red") + quality.index_vector("runs"))


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.fit_licenses(licenses.corpus_negatives(table(spark, SF, "documents"), 400))


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("Thea of.\nLicensed under the Apache License, Version 2.0.\nAnd", "apache"),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("All rights reserved.", "proprietary"),
        ("word " * 300 + "Released under the MIT License. " + "word " * 300, "mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "mit"),
    ],
)
def test_licence_notices(license_model, text, family):
    assert {x[2] for x in license_model.scan(text, 0.6, 0.6)} == {family}


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or", "gpl"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "bsd"),
        ("Chapter one.\n\nNo part of this publication may be reproduced\nwithout the prior written permission of the publisher.\n\nIt was", "proprietary"),
    ],
)
def test_wrapped_notices(license_model, text, family):
    assert family in {x[2] for x in license_model.scan(text, 0.6, 0.6)}


def test_every_notice_counts(license_model):
    notice = "Released under the MIT License. "
    spans = license_model.scan(("word " * 300 + notice) * 5 + "word " * 300, 0.6, 0.6)
    assert [x[2] for x in spans] == ["mit"] * 5 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    short = "Released under the MIT License or licensed under the Apache License, Version 2.0"
    assert {x[2] for x in license_model.scan(short, 0.6, 0.6)} == {"apache", "mit"}
    assert len(license_model.scan(notice + "\n" + notice, 0.6, 0.6)) == 2
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert [x[2] for x in license_model.scan(t, 0.6, 0.6)] == [family]


def test_clean_texts_have_no_licence(license_model):
    for t in (*licenses.NEGATIVES, "the license was lost", "she was under the tree", None, "", "\n\n"):
        assert license_model.scan(t, 0.6, 0.6) == []


def test_licences_of_the_corpus(spark, odd, license_model):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in licenses.license_scan(docs, license_model).collect()}
    notices = docs.where(F.col("text").rlike("(?i)licensed under|released under the mit|all rights reserved"))
    assert {r.doc_id for r in notices.collect()} == {i for i, r in got.items() if r.n_licensed}
    assert licenses.license_scan(odd, license_model).count() == 5


def test_calibration_is_on_unseen_texts(license_model):
    report = license_model.report
    assert report["texts"] > 1000 and 0.25 <= report["temperature"] <= 2.0
    assert report["unseen_texts_right"] > 0.7 and report["unseen_families_unknown"] > 0.3


def test_scan_by_definition(license_model):
    """Every span is the family's by the model and holds enough of a template; every template in noise is found."""
    r = np.random.default_rng(6)
    noise = ["river", "stone", "walk", "under", "blue", "table", "of", "house"]
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            text = " ".join(r.choice(noise, 30)) + ".\n\n" + t + "\n\n" + " ".join(r.choice(noise, 30))
            found = license_model.scan(text, 0.6, 0.6)
            assert family in {x[2] for x in found}
            for a, b, own, p in found:
                inside = licenses.words(text[a:b])
                pairs = {" ".join(x) for x in zip(inside, inside[1:], strict=False)}
                plain = [{" ".join(x) for x in zip(licenses.words(u), licenses.words(u)[1:], strict=False)} for u in licenses.TEMPLATES[own]]
                assert any(len(pairs & u) >= 0.6 * len(u) for u in plain) and p >= 0.6
