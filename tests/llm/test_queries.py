"""The registered queries of the text operators, on whole tables, against brute force; and the pipeline's stages on hard rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismal.llm import _store, _text, ann, bpe, langid, lmscore, queries, toxicity


def _texts(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_bpe_query_equals_the_library(spark, tiny):
    from tokenizers import Tokenizer

    tok, texts = Tokenizer.from_file(bpe.default_path()), _texts(spark, tiny)
    got = {r["doc_id"]: r for r in bpe.op10_bpe(spark, tiny).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nearest_query_finds_the_nearest(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows if r["embedding"] is not None}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(x))
    all_ = np.stack([x[i] for i in ids])
    got: dict[int, list] = {}
    for r in ann.op4_nearest(spark, tiny).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in ids.tolist() if i % 100 == 0]
    hit = total = 0
    for q, found in got.items():
        d = np.sqrt(((all_ - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        assert [r for r, *_ in found] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx(np.linalg.norm(x[i] - x[q])) for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit, total = hit + len(set(want) & {i for _, i, _ in found}), total + len(want)
    assert hit >= 0.9 * total


def test_language_and_toxicity_queries_hold_out_by_id(spark, tiny):
    texts = _texts(spark, tiny)
    lang = {r["doc_id"]: r for r in langid.op2_language_id(spark, tiny).collect()}
    toxic = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, tiny).collect()}
    assert sorted(lang) == sorted(toxic) == sorted(texts)
    for i, t in texts.items():
        crc = zlib.crc32(str(i).encode())
        assert lang[i]["held_out"] == (crc % 4 == 2) and toxic[i]["held_out"] == (crc % 3 == 1)
        assert 0 <= lang[i]["score"] <= 1 and (lang[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t))
        assert 0 <= toxic[i]["score"] <= 1 and toxic[i]["predicted"] == (toxic[i]["score"] >= 0.7)


def test_lm_query_scores_every_document(spark, tiny):
    texts = _texts(spark, tiny)
    got = {r["doc_id"]: r for r in lmscore.op8_lm_score(spark, tiny).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)))
        assert got[i]["n_tokens"] == n
        assert (got[i]["pll"] < 0 and got[i]["pll_mean"] == pytest.approx(got[i]["pll"] / n)) if n else (got[i]["pll"] == 0 and got[i]["pll_mean"] is None)


def test_toxicity_scores_equal_a_plain_forward_pass(docs):
    """All overlapping windows, word by word through the gates in both directions, pooled by attention."""
    rng = np.random.default_rng(3)
    net = toxicity.Network(rng)
    net.scale, net.shift = 1.3, -0.2
    texts = ["one two three", "", " ".join(f"w{k % 37}a" for k in range(150)), "Ünï " * 70]
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(texts), net).collect()}
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    for i, text in enumerate(texts):
        data, offsets = _text.column_bytes(pa.array([text]))
        words = _text.Words(data, offsets, _text.ALNUM)
        vocab, n, logits = toxicity.Vocabulary(data, words), len(words), []
        starts = [*range(0, max(0, n - toxicity.WINDOW), toxicity.STRIDE), max(0, n - toxicity.WINDOW)]
        for s in starts:
            xs = []
            for k in range(s, s + toxicity.WINDOW):
                if k < n:
                    v = vocab.of[k]
                    xs.append(np.concatenate([p["word"][vocab.bucket[v]], p["char"][vocab.grams[vocab.bound[v] : vocab.bound[v + 1]]].mean(axis=0)]))
                else:
                    xs.append(np.zeros(2 * toxicity.DIM))
            states = []
            for way in "fb":
                h, out = np.zeros(toxicity.HIDDEN), [None] * len(xs)
                for t in range(len(xs)) if way == "f" else reversed(range(len(xs))):
                    g, u = xs[t] @ p[f"W{way}"] + p[f"c{way}"], h @ p[f"U{way}"] + p[f"u{way}"]
                    z, r = np.split(sig(g[: 2 * toxicity.HIDDEN] + u[: 2 * toxicity.HIDDEN]), 2)
                    c = np.tanh(g[2 * toxicity.HIDDEN :] + r * u[2 * toxicity.HIDDEN :])
                    h = (1 - z) * c + z * h
                    out[t] = h
                states.append(np.array(out))
            both = np.concatenate(states, axis=1)
            e = np.tanh(both @ p["A"] + p["a"]) @ p["v"]
            e[np.arange(len(xs)) + s >= n] = -1e9
            w = np.exp(e - e.max())
            logits.append(w / w.sum() @ both @ p["w"] + p["o"][0])
        assert got[i]["n_windows"] == len(starts)
        assert got[i]["score"] == pytest.approx(sig(net.scale * max(logits) + net.shift), abs=1e-5)


def test_checkpoints_need_a_shared_folder_off_local_masters(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        _store.folder(Session)
    assert _store.folder(spark)


def test_stages_take_repeated_rows_clashing_columns_and_long_texts(spark, tiny):
    """Repeated rows get one result, columns that outputs of the operators are named like stay, a text of 5 MB passes."""
    schema = spark.read.parquet(f"{tiny}/documents.parquet").schema
    words = " ".join(f"the{k % 977} of{k % 613} and the house" for k in range(200_000))
    assert len(words) > 5_000_000
    rows = [(1, "the cat and the dog of that house\nwere here", "en", "s", 44)] * 3 + [(2, words, "en", "s", len(words)), (3, None, None, None, None), (4, "the cat", "en", "t", 7)]
    base = spark.createDataFrame(rows, schema).withColumn("removed", F.lit(7)).withColumn("block", F.lit("x")).withColumn("print", F.lit(1)).withColumn("component_id", F.lit("c"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, base, tiny)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(out.columns) >= set(base.columns), name
        found = out.groupBy("doc_id").count().collect()
        assert {r["doc_id"] for r in found} <= {1, 2, 3, 4} and out.count() <= len(rows), name
    lengths = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.encode(spark, base, tiny).collect()}
    assert lengths[2] > 600_000 and lengths[3] == 0 and math.isfinite(lengths[1])


def test_every_numbered_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
