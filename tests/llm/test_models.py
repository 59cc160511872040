"""Trained operators: held-out quality, defined cases, and brute force for the search and the scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.llm import _text, ann, langid, licenses, lmscore, toxicity

ODD = [None, "", " \n ", "a", "12 !!", "y " * 60_000, "same", "same"]


def test_language_id_holds_out_and_handles_odd_texts(spark, docs):
    folder = "/root/testdata/sf0.01"
    got = langid.op2_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert got.where("rejected").count() <= 0.01 * got.count() and got.where("score < 0 OR score > 1").count() == 0
    accepted = got.where("NOT rejected")
    assert accepted.where("lang = lang_pred").count() >= 0.999 * accepted.count()
    rows = [(1, "the cat and the dog of that house", "en"), (2, "der hund und die katze des hauses", "de"), (3, "no label", None), (4, None, "en")]
    model = langid.fit(docs(rows))
    assert model.langs == ["de", "en"]
    out = {r["doc_id"]: r for r in langid.identify(docs(ODD).withColumn("score", F.lit("x")), model).collect()}
    assert [out[i]["lang_pred"] == "und" for i in range(5)] == [True, True, True, False, True]
    assert out[0]["rejected"] and out[0]["score"] == 0.0
    none = langid.fit(docs([]))
    assert {r["lang_pred"] for r in langid.identify(docs(["text"]), none).collect()} == {"und"}
    assert langid.identify(docs([]), model).count() == 0


FOREIGN = [
    "zxq vbnrt kwqp fghj wxzz qqrt",
    "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie",
    "Suomen kieli on kaunis ja sitä puhuu noin viisi miljoonaa ihmistä",
    "Широкая электрификация южных губерний даст мощный толчок подъёму",
    "我们今天去公园散步看见很多美丽的花朵",
    "Saya pergi ke pasar untuk membeli sayuran dan buah segar setiap hari",
    "def main(argv):\n    for i in range(10):\n        print(i, argv[i])\n    return None",
]


def test_texts_of_no_learned_language_are_rejected(spark, docs):
    """Foreign texts, code and random letters go; at most one held-out document in a hundred does."""
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(table.where(~langid.held_out()))
    assert 0.02 < model.temperature < 5 and 0 < model.least_known < 1
    assert [r["doc_id"] for r in langid.identify(docs(FOREIGN), model).where("NOT rejected").collect()] == []
    rng = random.Random(9)
    texts = [r["text"] for r in table.where(langid.held_out()).where("lang IS NOT NULL AND length(text) > 300").limit(100).collect()]
    shuffled = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for t in texts]
    assert langid.identify(docs(shuffled), model).where("rejected").count() >= 0.9 * len(texts)
    held = langid.identify(table.where(langid.held_out()), model)
    assert held.where("rejected").count() <= 0.01 * held.count()


def test_language_scores_equal_the_plain_average(docs):
    model = langid.fit(docs([(k, t, lang) for k, (t, lang) in enumerate([("the of and", "en"), ("le de et la", "fr")] * 12)]))
    text = "The déjà of, x1 LÀ"
    data, offsets = _text.column_bytes(__import__("pyarrow").array([text]))
    parts = langid.ngrams(data, offsets)
    flat = np.concatenate([i for i, _ in parts])
    z = model.per_lang[:, flat].mean(axis=1) + model.bias
    row = langid.identify(docs([text]), model).first()
    assert row["score"] == pytest.approx(float(model.probabilities(z[None])[0].max()), rel=1e-5)


def test_toxicity_learns_words_and_their_forms(spark, docs):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in "ba ki lo mu re so ta ve".split() for b in "n r st l".split()]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 160))]
        if toxic:
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = "zorq" + rng.choice(["a", "en", "ung", "isch", "ette", "ou"])
        return " ".join(w)

    rows = [(k, text(k % 3 == 0)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(700, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs(rows), labels)
    out = toxicity.toxicity(docs(rows), net).where("doc_id >= 400").collect()
    hits = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in out]
    assert sum(p and t for p, t in hits) >= 0.9 * sum(t for _, t in hits)
    assert sum(p and not t for p, t in hits) <= 0.05 * sum(not t for _, t in hits)
    odd = toxicity.toxicity(docs(ODD).withColumn("predicted", F.lit("x")), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    late = "ban " * 3000 + "zorqung zorqen zorqisch " + "ban " * 3000  # far into a long text
    assert toxicity.toxicity(docs([late]), net).first()["score"] > toxicity.toxicity(docs(["ban " * 6000]), net).first()["score"]
    prior = toxicity.fit(docs(rows), labels.limit(0))
    assert {r["score"] for r in toxicity.toxicity(docs(["x"]), prior).collect()} == {0.0}


def test_toxicity_gradients_equal_differences():
    rng = np.random.default_rng(2)
    data, offsets = _text.column_bytes(__import__("pyarrow").array(["ab cd ef gh ab xy", "qq cd"]))
    words = _text.Words(data, offsets, _text.ALNUM)
    vocab = toxicity.Vocabulary(data, words)
    idx = np.full((2, 6), len(vocab))
    idx[0], idx[1, :2] = vocab.of[:6], vocab.of[6:]
    y = np.array([1.0, 0.0], np.float32)
    net = toxicity.Network(rng)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        x, _, _ = net.inputs(vocab)
        x = x.astype(np.float64)
        z = net.logits(x, idx).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    class Keep:
        def random(self, n):
            return np.zeros(n)  # keep every word

    g = net.gradients(vocab, idx, y, Keep())
    for k in ("Wf", "Ub", "cb", "uf", "A", "v", "w", "o"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, eps = net.p[k][at], 1e-2
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4), k


@pytest.mark.parametrize("copies", [0, 400])
def test_nearest_recall_against_brute_force(spark, copies):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 9))
    x[700 : 700 + copies] = x[700]
    x[800 : 800 + copies // 4] = x[700] + rng.normal(0, 1e-3, (copies // 4, 9))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 9), (2200, [float("nan")] * 9), (2300, [1.0, None] + [0.0] * 7), (2400, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).repartition(6)
    got = ann.nearest(df).orderBy("query_id", "rank").toPandas()
    assert got.equals(ann.nearest(df, broadcast_bytes=0, group_bytes=1 << 16).orderBy("query_id", "rank").toPandas())
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        mine = got[got["query_id"] == q]
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine["score"], d[mine["vec_id"]])
        hit, total = hit + len(set(want) & set(mine["vec_id"])), total + 10
    assert hit >= 0.97 * total and set(got["query_id"]) == set(range(0, 1500, 100))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)]
    assert ann.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize("scale, outliers", [(1.0, []), (1e-20, []), (1e20, []), (1e-300, []), (1e200, []), (1.0, [1e20]), (1.0, [1e20, 1e160, 1e300, -1e300, 1e7]), (1e-3, [1e30] * 30)])
@pytest.mark.parametrize("sent", [ann.BROADCAST_BYTES, 0])
def test_all_finite_vectors_find_their_nearest(spark, scale, outliers, sent):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12)) * scale
    for k, size in enumerate(outliers):  # queries among them
        x[100 * k // 2] *= size
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, broadcast_bytes=sent, group_bytes=1 << 16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.array([math.dist(v, x[q]) for v in x])
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        hit += sum(s <= d[want[-1]] * (1 + 1e-12) for _, s in found)
        assert len(found) == 10 and all(s == pytest.approx(d[i], rel=1e-12) for i, s in found)
    assert hit >= 0.95 * 10 * len(got)


@pytest.mark.parametrize("kind", ["plain", "unit", "offset", "heavy", "clusters"])
def test_recall_and_reranked_share_of_one_large_block(kind):
    """20,000 rows in one block, of which the codes let few be reranked: recall of 0.9 at least on any shape of data."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "offset":
        x = x * rng.lognormal(0, 0.5, (len(x), 1)) + 50
    elif kind == "heavy":
        x *= rng.lognormal(0, 1.5, (len(x), 1))
    elif kind == "clusters":
        x = 10 * rng.normal(size=(50, 64))[rng.integers(0, 50, len(x))] + x
    ids = rng.permutation(len(x))
    block = ann.Block(ids, x, ann.fit(x[:4096]))
    asked = np.arange(0, len(x), 400)
    of, rows, score, read = block.search(ids[asked], x[asked], 10)
    hit = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = of == ids[q]
        hit += len(set(ids[np.argsort(d)[:10]]) & set(rows[mine]))
        assert np.all(np.diff(score[mine]) >= 0)
    share = read / len(asked) / len(x)
    print(f"{kind}: recall {hit / len(asked) / 10:.3f}, reranked {share:.4f}")
    assert hit >= 0.95 * 10 * len(asked) and share < (0.3 if kind == "heavy" else 0.15)


def test_anisotropic_codes_lower_the_parallel_error():
    x = np.random.default_rng(4).normal(size=(600, 16)).astype(np.float32)
    books = ann.fit(x)
    plain = ann.Codebooks(16, books.centroids, 1.0)

    def parallel(codes):
        r = x - books.centroids[np.arange(8), codes].reshape(len(x), -1)
        return ((r * x).sum(axis=1) ** 2 / (x * x).sum(axis=1)).mean()

    assert parallel(books.codes(x)) < parallel(plain.codes(x))


def test_licences_are_found_and_prose_is_not(spark, docs):
    rows = {
        "intro\nLicensed under the Apache License, Version 2.0\nmore": ["apache-2.0"],
        "Some words. Released under the MIT License here": ["mit"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl"],
        "Licensed under CC BY-NC 4.0": ["cc-by-nc"],
        "SPDX-License-Identifier: BSD-3-Clause\nSPDX-License-Identifier: MIT": ["bsd", "mit"],
        "he renewed his driving licence and the license plate of the car": [],
        "the copyright lecture was dull": [],
        "plain text without any of it": [],
    }
    df = docs([*rows, *ODD]).withColumn("families", F.lit("x")).withColumn("line", F.lit(3))
    out = licenses.license_scan(df)
    got = {r["text"]: r["families"] for r in out.collect()}
    assert {t: got[t] for t in rows} == rows and out.count() == len(rows) + len(ODD)
    assert all(got[t] == [] for t in ODD)
    assert licenses.license_scan(docs([])).count() == 0


def test_reserved_lines_and_those_without_an_old_anchor_are_found(docs):
    rows = {
        "some words here\nAll rights reserved.\nmore words": ["reserved"],
        "Copyright 2020 Acme. All rights reserved.": ["reserved"],
        "Copyright the authors. All rights reserved.": ["reserved"],
        "he reserved a table and all agreed": [],
    }
    out = licenses.license_scan(docs(list(rows))).collect()
    assert {r["text"]: r["families"] for r in out} == rows


def test_unknown_notices_and_wrapped_notices_are_found(docs):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software\nwithout restriction, subject to the copyright notice"
    rows = {
        "SPDX-License-Identifier: ISC": ["unknown"],
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Zlib": ["mit", "unknown"],
        "Licensed under the Eclipse Public License 2.0": ["unknown"],
        f"a title\n\n{bsd}\n\nmore text": ["bsd"],
        mit: ["mit"],
        f"{bsd}\nSPDX-License-Identifier: EPL-2.0": ["bsd", "unknown"],
        "the bar was licensed to sell beer\nand the copyright lecture was dull": [],
    }
    out = {r["text"]: r for r in licenses.license_scan(docs(list(rows))).collect()}
    assert {t: out[t]["families"] for t in rows} == rows
    assert [x["line"] for x in out[f"a title\n\n{bsd}\n\nmore text"]["licences"]] == [2]


def test_repeated_rows_and_null_ids_get_the_same_licences(docs):
    texts = ["now released under the mit license", "the music is provided under a creative commons attribution noncommercial license", "x\n\nSPDX-License-Identifier: ISC"]
    once = {r["text"]: r["licences"] for r in licenses.license_scan(docs([(k, t) for k, t in enumerate(texts)])).collect()}
    rows = [(k % 2 or None, t) for k in range(4) for t in texts]
    again = licenses.license_scan(docs(rows)).collect()
    assert len(again) == len(rows) and all(r["licences"] == once[r["text"]] for r in again)


def test_threshold_is_calibrated_and_held_back_errors_are_few(spark):
    model = licenses.fit(spark)
    scored = licenses.held_back(spark, model)
    accepted = [right for p, right in scored if p >= model.threshold]
    assert 0 < model.threshold < 1 and len(accepted) >= 0.9 * sum(right for _, right in scored)
    assert accepted.count(False) <= licenses.CALIBRATE_SHARE * len(accepted)
    assert licenses.calibrated([(0.9, True), (0.8, False), (0.7, True)], 0.0) == 0.9
    assert licenses.calibrated([(0.9, False), (0.8, True)], 0.5) == 0.8 and licenses.calibrated([], 0.1) == float("inf")


def test_licence_query_covers_every_document(spark, tiny):
    """Counts and families of the registered query against the operator on the same rows."""
    rows = {r["doc_id"]: r for r in licenses.op3_license_scan(spark, tiny).collect()}
    each = licenses.license_scan(spark.read.parquet(f"{tiny}/documents.parquet")).collect()
    assert len(rows) == len(each) and sum(r["n_licences"] for r in rows.values()) > 0
    for r in each:
        mine = rows[r["doc_id"]]
        assert mine["n_licences"] == len(r["licences"]) and mine["families"] == ",".join(r["families"])
        assert mine["lines"] == ",".join(str(x) for x in sorted({x["line"] for x in r["licences"]}))


def test_a_confirmed_paragraph_cannot_lack_every_anchor():
    import math
    import re

    for template in (t for ts in licenses.TEMPLATES.values() for t in ts):
        words = set(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", template.lower()))
        bare = [w for w in words if not w.startswith(licenses.anchors())]
        assert len(bare) < math.ceil(licenses.CONFIRM * len(words) - 1e-9), template


def test_licence_probabilities_equal_the_plain_sum(spark, docs):
    import math
    import re

    model = licenses.fit(spark)
    text = "now released under the mit license"
    words = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())
    grams = {*words, *(" ".join(p) for p in zip(words, words[1:]))}
    z = [b + sum(model.weights[g][k] for g in grams if g in model.weights) for k, b in enumerate(model.bias)]
    p = math.exp(max(z)) / sum(map(math.exp, z))
    row = licenses.license_lines(docs([text]), model).first()
    assert row["family"] == model.families[z.index(max(z))] == "mit" and row["p"] == pytest.approx(p, rel=1e-6)


def test_lm_scores_equal_a_plain_forward_pass(docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ODD
    model = lmscore.fit(docs(texts))
    out = {r["doc_id"]: r for r in lmscore.lm_scores(docs([*texts, "aa zz bb"]).withColumn("pll", F.lit("x")), model).collect()}
    p, edge = model.p, len(model.p["emb"]) - 1
    for i, text in [(0, texts[0]), (7, texts[7]), (63, texts[63]), (68, "aa zz bb")]:
        data, offsets = _text.column_bytes(__import__("pyarrow").array([text]))
        tok = model.tokens(_text.Words(data, offsets, _text.ALNUM).hash).tolist()
        row = [t if t < model.n else model.n + ((t - model.n) >> (lmscore.RARE_BITS - lmscore.ROW_BITS)) for t in tok]
        total = 0.0
        for k, t in enumerate(tok):
            ctx = [row[k + s] if 0 <= k + s < len(tok) else edge for s in (-3, -2, -1, 1, 2, 3)]
            h = np.tanh(p["emb"][ctx].ravel() @ p["w"] + p["b"])
            z = h @ p["u"] + p["c"]
            c = t // model.size if t < model.n else model.classes
            total += z[c] - np.log(np.exp(z).sum())
            if t < model.n:
                words = slice(c * model.size, (c + 1) * model.size)
                z = p["v"][words] @ h + p["d"][words]
                total += z[t - c * model.size] - np.log(np.exp(z).sum())
            else:
                total += model.log_share[t - model.n]
        assert out[i]["n_tokens"] == len(tok) and out[i]["pll"] == pytest.approx(total, rel=1e-4)
    assert out[60]["pll"] == 0.0 and out[60]["pll_mean"] is None
    assert lmscore.lm_scores(docs([]), lmscore.fit(docs([]))).count() == 0


def test_lm_probabilities_of_all_words_add_up_to_one(docs):
    model = lmscore.fit(docs([f"w{k % 7} w{k % 11} w{k % 5}" for k in range(80)]))
    tokens, bound = np.array([0, 3, 1, 2, 4]), np.array([0, 5])
    total = 0.0
    for w in [*range(model.n), *range(model.n, model.n + (1 << lmscore.RARE_BITS))]:
        tokens[2] = w
        if w < model.n or w < model.n + 3:
            total += np.exp(model.log_probabilities(tokens, bound)[2]) if w < model.n else 0.0
    tokens[2] = model.n
    total += np.exp(model.log_probabilities(tokens, bound)[2] - model.log_share[0])  # the class of rare words
    assert total == pytest.approx(1.0, abs=1e-5)


def test_lm_scores_do_not_depend_on_partitions(docs):
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    df = docs(texts)
    scores = []
    for n in (3, 17):
        part = df.repartition(n)
        scores.append([r["pll"] for r in lmscore.lm_scores(part, lmscore.fit(part)).orderBy("doc_id").collect()])
    assert scores[0] == pytest.approx(scores[1], rel=1e-5)


def test_lm_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(2)
    model = lmscore.Model(np.arange(1, 11), np.ones(1 << lmscore.RARE_BITS, np.int64))
    model.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in model.p.items()}
    ctx, y = rng.integers(0, 12, (9, 6)), np.array([0, 1, 2, 3, 9, 9, 10, 40, 5])
    grads = {}
    monkeypatch.setattr(model, "_move", lambda name, at, grad, rate: grads.setdefault(name, np.zeros(model.p[name].shape)).__setitem__(at, grad))
    model.step(ctx, y, 0.0)
    kept, many = grads.copy(), len(y)
    for name in ("emb", "w", "b", "u", "c", "v", "d"):
        at = tuple(rng.integers(0, s) for s in kept[name].shape) if name != "emb" else (int(ctx[0, 0]), 3)
        old, loss = model.p[name][at], []
        for shift in (1e-5, -1e-5):
            model.p[name][at] = old + shift
            loss.append(model.step(ctx, y, 0.0))
        model.p[name][at] = old
        assert kept[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5 * many, rel=1e-3, abs=1e-6), name


def test_lm_takes_logits_in_pieces(monkeypatch):
    """No more rows of logits than PIECE at once, and the same steps and scores for pieces of any size."""
    rng = np.random.default_rng(4)
    ctx, y = rng.integers(0, 40, (300, 6)), rng.integers(0, 44, 300)
    taken, out = [], []
    exponentials = lmscore._exponentials
    monkeypatch.setattr(lmscore, "_exponentials", lambda z, bounded: (taken.append(len(z)), exponentials(z, bounded))[1])
    for piece in (7, 1000):
        monkeypatch.setattr(lmscore, "PIECE", piece)
        model = lmscore.Model(np.arange(1, 41), np.ones(1 << lmscore.RARE_BITS, np.int64))
        taken.clear()
        loss = model.step(ctx, y, 0.1)
        scores = model.log_probabilities(y, np.array([0, 120, 300]))
        assert max(taken) <= piece
        out.append((loss, scores, model.p))
    (a, x, p), (b, z, q) = out
    assert a == pytest.approx(b, rel=1e-5) and x == pytest.approx(z, rel=1e-4)
    assert all(p[k] == pytest.approx(q[k], abs=1e-4) for k in p)


def test_lm_learns_from_both_sides(docs):
    texts = [" ".join(["left", w, {"red": "stop", "green": "go"}[w]] * 10) for w in ("red", "green") for _ in range(100)]
    model = lmscore.fit(docs(texts))
    out = lmscore.lm_scores(docs([(0, "left red stop " * 10), (1, "left red go " * 10)]), model).orderBy("doc_id").collect()
    assert out[0]["pll"] > out[1]["pll"]


def test_models_take_any_column_and_draw_by_text_only(docs):
    df = docs([(k, f"the cat number {k} sat there" if k % 2 else f"der hund nummer {k} stand da", "en" if k % 2 else "de") for k in range(40)])
    odd = df.withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("s", F.struct(F.array(F.create_map(F.lit(1), F.lit(2))).alias("a")))
    plain = langid.fit(df, per_language=12)
    for other in (odd, df.withColumn("doc_id", F.col("doc_id") + 7).repartition(5), df.union(df)):
        model = langid.fit(other, per_language=12)
        assert model.langs == plain.langs and np.array_equal(model.per_lang, plain.per_lang)
    assert langid.identify(odd, plain).count() == 40
    assert lmscore.lm_scores(odd, lmscore.fit(odd)).where("pll < 0").count() == 40


def test_language_id_keeps_every_label(docs):
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(k, f"{w}ul {w}em {w}ox {w}ip {w}an", w) for k, w in enumerate(words)]
    assert langid.fit(docs(rows), most=1000).langs == sorted(words)


def test_toxicity_is_trained_in_a_task_not_in_the_driver(spark, monkeypatch):
    def here(rows, seed=11):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "train", here)
    docs = spark.createDataFrame([(k, f"{'vile' if k % 2 else 'kind'} word {k}") for k in range(40)], "doc_id long, text string")
    net = toxicity.fit(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    assert net.prior is None and net.p["word"].shape == (1 << toxicity.BITS, toxicity.DIM)


def test_language_model_is_trained_in_a_task_and_sent_in_few_bytes(docs, monkeypatch):
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    rows = docs([(k, f"{w}ul {w}em {w}ox {w}ip {w}an", w) for k, w in enumerate(words)])
    one = [(lang, *(np.frombuffer(langid._CODEC.decompress(x[c].as_py(), decompressed_size=4 * x["n"].as_py(), asbytes=True), np.int32) for c in ("grams", "counts"))) for b in langid._sample(rows.select("lang", "text").toArrow().to_batches(), "text") for x in [dict(zip(b.schema.names, r)) for r in zip(*b.columns)] for lang in [x["lang"].as_py()]]
    whole = langid.train(sorted(one, key=lambda r: r[0]))

    def here(rows, seed=7):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(langid, "train", here)
    model = langid.fit(rows, most=1000)
    assert model.langs == whole.langs and np.array_equal(model.known, whole.known)
    assert np.allclose(model.per_lang, whole.per_lang, atol=1e-5)
    assert (model.temperature, model.threshold, model.usual, model.least_known) == pytest.approx((whole.temperature, whole.threshold, whole.usual, whole.least_known))
    assert len(whole.packed()) < (4 * langid.DIM + len(words) / 4) * (1 << langid.BITS)
    assert langid.fit(rows.limit(0)).langs == []
