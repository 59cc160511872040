"""Periodic runs, fill-in-middle and chat formatting: against brute force, exact round trips, and by case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.llm import chat, fim, periodic

ODD = [None, "", "  \n ", "a", "x" * 200_000, "same text here", "same text here", "é ß \x00 \U0001f600 <|endoftext|>"]


# periodic runs


def _runs(s, least, exponent):
    """Maximal stretches by every period in turn; of equal stretches the first period stays."""
    best = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in best.items())


def _collapsed(words, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def _sequence(rng):
    n, k = rng.randrange(150), rng.choice([1, 2, 3, 50])
    s = [rng.randrange(k) for _ in range(n)]
    kind = rng.randrange(5)
    if kind == 1 and n:
        p, a = rng.randrange(1, n + 1), rng.randrange(n)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    elif kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        s = b[:n]
    elif kind == 3:
        s = s * rng.randrange(1, 4) + [99] + s * rng.randrange(1, 5)
    elif kind == 4:
        s = [7] * rng.randrange(60) + s + [7] * rng.randrange(60)
    return s


def test_grammar_queries_equal_plain_extensions():
    rng = random.Random(1)
    for _ in range(60):
        docs = [_sequence(rng) for _ in range(rng.randrange(1, 6))]
        words, *_ = periodic._block([" ".join(map(str, d)).encode() for d in docs])
        if len(words) < 4:
            continue
        levels, w = periodic.grammar(words), words.tolist()
        assert len(levels[-1].symbols) == 1
        pairs = [(i, j) for i, j in ((rng.randrange(1, len(w)), rng.randrange(1, len(w))) for _ in range(80)) if i != j]
        i, j = np.array(pairs).reshape(-1, 2).T
        plain = [next(k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k]) for a, b in pairs]
        before = [next(k for k in range(len(w)) if w[a - k - 1] != w[b - k - 1]) for a, b in pairs]
        assert periodic.extend(levels, i, j).tolist() == plain
        assert periodic.extend(levels, i, j, back=True).tolist() == before


@pytest.mark.parametrize("least, exponent", [(24, 3), (4, 2), (9, 3), (30, 5)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(80):
        docs = [_sequence(rng) for _ in range(rng.randrange(1, 6))]
        words, begin, n, _ = periodic._block([" ".join(map(str, d)).encode() for d in docs])
        rows = periodic.find(words, begin, n, least, exponent, limit=rng.choice([1, 50, 1 << 20]))
        for d, s in enumerate(docs):
            assert sorted(map(tuple, rows[rows[:, 0] == d][:, 1:].tolist())) == _runs(s, least, exponent)


def test_runs_of_hard_rows_and_clashing_columns(docs):
    texts = [*ODD, "go " * 40, "a b c " * 8 + "d", ("x y " * 6 + "z ") * 5, "\x85 \xa0\x1c" * 30]
    got = {r["doc_id"]: r for r in periodic.find_runs(docs(texts).withColumn("runs", F.lit("other")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = _runs(words, 24, 3)
        assert [tuple(r) for r in got[i]["runs"]] == want and got[i]["n_words"] == len(words) and got[i]["m"] == {"k": 1}
        assert got[i]["collapsed"] == _collapsed(words, want)
    assert [tuple(r) for r in got[8]["runs"]] == [(0, 40, 1)]
    assert periodic.find_runs(docs([]).select("doc_id", "text")).collect() == []


def test_runs_query_equals_brute_force(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, tiny).collect()}
    assert len(got) == len(rows)
    sha, found = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if n > 4000:
            continue  # the plain search is quadratic
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = _runs(words, 24, 3)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)) and r["collapsed_sha256"] == sha(_collapsed(words, runs))
        found += len(runs)
    assert found > 5


def test_runs_query_takes_texts_without_words(spark, tmp_path):
    hit = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]  # ids whose words are planted
    rows = list(zip(hit, ["", " \t ", None, "go " * 40])) + [(-1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    for i in [*hit[:3], -1]:
        assert (got[i]["n_runs"], got[i]["start"], got[i]["runs_sha256"], got[i]["collapsed_sha256"]) == (0, None, empty, empty)
    assert got[hit[3]]["n_runs"] == 1


# fill-in-middle


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_middle_is_restored_whatever_the_part_size(docs, unit):
    long = "é" * 5000 + "\n" + "ab " * 3000 + "\U0001f600" * 2000
    texts = [*ODD, "x<P>y", "<S", "a\n\n\nb\r\nc", long] + [f"añ\U0001f600 b\nc{'<M' * (k % 2)}" * k for k in range(40)]
    df = docs(texts).withColumn("form", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    seen = set()
    for limit in (7, 64, fim.PART_BYTES):
        rows = fim.restore(fim.fill_in_middle(df, unit=unit, part_bytes=limit)).collect()
        assert len(rows) == len(texts) and all(r["restored"] == (r["text"] or "") for r in rows)
        seen.add(tuple(sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"]) for r in rows)))
    assert len(seen) == 1
    rule = {"char": r"(?s).", "word": r"\A[ \t-\r]+(?=[^ \t-\r])|[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    kinds = set()
    for i, n, form, before, middle, out in seen.pop():
        units = re.findall(rule, texts[i] or "")
        kinds.add(form)
        assert n == len(units)
        if form != "plain":
            p, m, s = ("".join(x) for x in (units[:before], units[before : before + middle], units[before + middle :]))
            assert out == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert kinds == {"plain", "psm", "spm"}


def test_sentinels_that_overlap_are_refused_and_others_work(docs):
    for bad in (("<a", "a>", "b"), ("x", "y", "xy"), ("aa", "b", "c"), ("a", "a", "b")):
        if bad != ("aa", "b", "c"):
            with pytest.raises(ValueError):
                fim.check_sentinels(bad)
    with pytest.raises(ValueError):
        fim.check_sentinels(("aba", "c", "d"))
    own = ("[*pre.]", "[*suf.]", "[*mid.]")
    df = docs([f"text {k} (a|b) [*" * 3 for k in range(30)])
    rows = fim.restore(fim.fill_in_middle(df, sentinels=own), sentinels=own).collect()
    assert all(r["restored"] == r["text"] for r in rows) and any("[*mid.]" in r["output"] for r in rows)


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one"), (None, "one"), (None, None)], "doc_id long, text string")
    rows = fim.fill_in_middle(df).collect()
    assert len(rows) == 3 and len({r["output"] for r in rows if r["text"]}) == 1
    assert fim.fill_in_middle(df.where("false")).collect() == []


# chat


ATOMS = ["<", "|", "\\", "im_end", "im_start", ">", "assistant\n", "é", "\U0001f600", " ok", "<|im_end|>", "<\\|", "<|image|>"]
TURNS = "conv_id string, turn int, role string, parts array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    said = lambda: "".join(rng.choice(ATOMS) for _ in range(rng.randrange(12)))
    rows = []
    for c in range(6):
        for t in range(rng.randrange(1, 40)):
            parts = [(k, said() if k in (None, "text") else None, f"ref{t}", 30, 50, 1.5, 3) for k in (rng.choice(["text", "text", "image", "audio", "document", None]) for _ in range(rng.randrange(5)))]
            rows.append((f"c{c}" if c else None, t, rng.choice(["user", "assistant", "sys\ntem<|\\n", None, "\\"]), parts if rng.random() < 0.95 else None))
    return rows


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(500):
        s = "".join(rng.choice(ATOMS) for _ in range(rng.randrange(12)))
        assert "<|" not in chat.escape(s) and chat.unescape(chat.escape(s)) == s
        assert "\n" not in chat.escape_role(s) and chat.unescape_role(chat.escape_role(s)) == s


def test_formatted_turns_read_back_whatever_the_segments(spark, turns):
    df = spark.createDataFrame(turns, TURNS)
    seen = set()
    for size in (1, 300, chat.SEGMENT_CHARS):
        segments = chat.format_turns(df, segment_chars=size, partitions=5)
        for s in (segments, chat.assemble(segments, 400)):
            seen.add(tuple(sorted((str(r["conv_id"]), *r[1:]) for r in chat.read_back(s).collect())))
    assert len(seen) == 1
    got = {r[0]: r for r in seen.pop()}
    for c in {str(r[0]) for r in turns}:
        all_, loss, chars, held = hashlib.sha256(), hashlib.sha256(), 0, []
        own = sorted((r for r in turns if str(r[0]) == c), key=lambda r: r[1])
        for _, _, role, parts in own:
            said = [(p[0] or "text", p[1] or "") for p in parts or []]
            held += [k for k, _ in said if k != "text"]
            all_.update(f"{role or ''}\n{''.join(t if k == 'text' else chat.PLACEHOLDER[k] for k, t in said)}\n".encode())
            if role == "assistant":
                spoken = "".join(t for k, t in said if k == "text")
                loss.update(spoken.encode())
                chars += len(spoken)
        tokens = {"image": 3 * 4, "audio": 38, "document": 768}
        assert got[c][1:5] == (len(own), all_.hexdigest(), chars, loss.hexdigest())
        assert got[c][6:] == (len(held), sum(tokens[k] for k in held))


def test_attachments_stand_where_their_placeholders_do(spark, turns):
    for r in chat.assemble(chat.format_turns(spark.createDataFrame(turns, TURNS), segment_chars=200)).collect():
        places = [(m[0][2:-2], m.start()) for m in re.finditer(r"<\|(?:image|audio|document)\|>", r["formatted"])]
        assert places == [(a["kind"], a["at"]) for a in r["attachments"]]


def test_a_long_conversation_is_written_by_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-7).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("one two").alias("text"))
    segments = chat.format_turns(df, segment_chars=1000, partitions=12)
    hot = segments.where("conv_id = -7")
    assert hot.select(F.spark_partition_id()).distinct().count() >= 3
    assert chat.read_back(segments).where("conv_id = -7").first()["loss_chars"] == 7 * 6667


def test_chat_cases(spark):
    kinds = "conv_id long, turn long, role string, text string, tie string"
    df = spark.createDataFrame([(None, None, None, None, "x"), (1, 0, "user", "a" * 50_000, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "b", "x")], kinds)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[1]["n_turns"] == 3
    assert chat.read_back(chat.format_turns(df.where("false"))).collect() == []
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_turns(df.select("conv_id", "turn", "role", F.array(F.struct(F.lit("video").alias("kind"))).alias("parts"))).collect()
