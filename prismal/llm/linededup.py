"""Line dedup by winnowing: later copies of runs of lines that an earlier place already holds.

Lines are hashed (trimmed of blanks; those without a word do not count). For every line the window is the
shortest run of lines from it with at least `min_words` words; its least line hash, the first of equal
ones, is a fingerprint. Any two equal runs of `min_words` words or more share one.

1. Of each document the distinct fingerprints are kept, each with its position and the starts of the
   windows that it is the least of (a stretch of lines).
2. Positions are joined by fingerprint; those found in one place only are settled.
3. Each position of a shared fingerprint is extended both ways: to the windows that start at its stretch, and
   from these, line by line, until the next start's window ends. Each is joined to the earliest place
   (by id, text hash, line) that holds the same lines, told by two hashes over all of them.
4. A window with an earlier place is a later copy. The lines of a maximal repeated run are the union of such
   windows, and they are deleted.

Everything before the joins happens inside a document's row, on arrays of its lines' hashes and numbers
of words. Both joins go by key and a salt drawn from the place, with the least place taken for each
salt first, so a line or passage that a third of all documents hold is dealt over `SALTS` tasks.

Defined cases: null text stays null; blank lines count no words and go only when they lie inside a
deleted run; texts below `min_words` words lose nothing; rows with equal id and text are one
document and all get its result; null ids are earliest; copies inside one document count, and
windows of a run of equal lines may overlap; an empty table gives no rows; other columns pass through (those
that an output name clashes with are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MIN_WORDS = 30
OUTPUTS = ("n_lines", "n_removed", "removed", "clean_text")
_BLANKS = " \t\r"
#: Tasks that the rows of one key are dealt over.
SALTS = 64


def _line_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, pos, h, g, nw): by document the places, two hashes and numbers of words of its lines with words."""
    trimmed = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_BLANKS)).alias("line")))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.filter(trimmed, lambda x: x["line"] != "").alias("lines"))
    own = own.where(F.size("lines") > 0)
    return own.select(
        "id", "tk", F.transform("lines", lambda x: x["pos"]).alias("pos"),
        F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(x["line"], F.lit(1))).alias("g"),
        F.transform("lines", lambda x: F.regexp_count(x["line"], F.lit("[ \t]+")) + 1).alias("nw"),
    ).repartition("id", "tk")


def _ends(min_words: int):
    """For each line, as an index, the last line of its window; null where the lines from it hold too few words."""
    one = 1 << 32  # lines are counted above the words

    def end(i):
        met = F.aggregate(F.slice("nw", i + 1, F.lit(min_words)), F.lit(0).cast("long"), lambda acc, n: F.when(acc % one >= min_words, acc).otherwise(acc + n + one))
        return F.transform(F.array(met), lambda m: F.when(m % one >= min_words, i + (m / one).cast("int") - 1))[0]

    return F.transform(F.sequence(F.lit(0), F.size("nw") - 1), end)


def _fingerprints(lines: DataFrame) -> DataFrame:
    """(id, tk, fp, fp_pos, start, stop): distinct fingerprints by position, and the first and last start of their windows."""

    def least(end, i):
        window = F.slice("h", i + 1, end - i + 1)
        place = F.transform(F.array(F.array_min(window)), lambda m: F.struct(m.alias("fp"), (i + F.array_position(window, m).cast("int") - 1).alias("at"), i.alias("i")))[0]
        return F.when(end.isNotNull(), place)

    each = F.explode(F.filter(F.transform("ends", least), lambda m: m.isNotNull()))
    return lines.select("id", "tk", each.alias("m")).groupBy("id", "tk", F.col("m.fp").alias("fp"), F.col("m.at").alias("fp_pos")).agg(F.min("m.i").alias("start"), F.max("m.i").alias("stop"))


def _with_earliest(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The rows of keys that are held by more than one place, plus `first`, the earliest of these."""
    at = F.struct(*place)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*place), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    whole = parts.groupBy(*keys).agg(F.min("_a").alias("first"), F.max("_b").alias("_last")).where("first <> _last").drop("_last")
    known = parts.select(*keys, "_salt").join(whole, keys)
    return salted.join(known, [*keys, "_salt"]).drop("_salt")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tk, lo, hi): the spans of lines, from and to, of all later copies; tk is the hash of the document's text."""
    lines = _line_arrays(docs, id_col, text_col).withColumn("ends", _ends(min_words))
    shared = _with_earliest(_fingerprints(lines), ["fp"], ["id", "tk", "fp_pos"])
    stretches = shared.groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_set(F.struct("start", "stop")).alias("stretches"))
    joined = lines.join(stretches, (F.col("tk") == F.col("_tk")) & F.col("id").eqNullSafe(F.col("_id")))
    starts = F.flatten(F.transform("stretches", lambda s: F.sequence(s["start"], s["stop"])))

    def windows(i):
        end, beyond = F.get("ends", i), F.coalesce(F.get("ends", i + 1), F.size("nw"))
        return F.transform(F.sequence(end, F.greatest(end, beyond - 1)), lambda j: window(i, j))

    def window(i, j):
        k1, k2 = F.xxhash64(F.slice("h", i + 1, j - i + 1)), F.xxhash64(F.slice("g", i + 1, j - i + 1))
        return F.struct(k1.alias("k1"), k2.alias("k2"), F.get("pos", i).alias("lo"), F.get("pos", j).alias("hi"))

    matched = joined.select("id", "tk", F.explode(F.flatten(F.transform(starts, windows))).alias("w")).select("id", "tk", "w.*")
    placed = _with_earliest(matched, ["k1", "k2"], ["id", "tk", "lo"])
    return placed.where(F.struct("id", "tk", "lo") > F.col("first")).select("id", "tk", "lo", "hi")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs plus n_lines, n_removed, removed (line numbers from 0, in order) and clean_text."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    spans = repeated_runs(docs, id_col, text_col, min_words).groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))
    lines_of = F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["lo"], s["hi"])))))
    gone = spans.select("_id", "_tk", lines_of.alias("removed"))
    # where a document has more than one row, each gets the same lines
    joined = docs.select(*keep, F.xxhash64(text_col).alias("_text_key")).join(gone, (F.col("_text_key") == F.col("_tk")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    joined = joined.withColumn("_lines", F.split(text_col, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
    stay = F.transform(left, lambda i: F.element_at("_lines", i + 1))
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *keep,
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        text.alias("clean_text"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every whole document, how many of them are later copies, which, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = line_dedup(docs)
    removed = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_lines", "n_removed", removed.alias("removed"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


OP5_SQL = f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS pos, trim(ls[i], ' ' || chr(9) || chr(13)) AS line FROM raw, unnest(range(1, len(ls) + 1)) AS u(i)),
w AS (SELECT doc_id, pos, line, len(string_split_regex(line, '[ \\t]+')) AS nw FROM l WHERE line <> ''),
c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS c1 FROM w),
d AS (SELECT *, c1 - nw AS c0 FROM c),
f AS (
  SELECT doc_id, min(pos) OVER a AS lo, max(pos) OVER a AS hi, sum(nw) OVER a AS words, list(line) OVER a AS k FROM d
  WINDOW a AS (PARTITION BY doc_id ORDER BY c0 RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
b AS (
  SELECT doc_id, min(pos) OVER a AS lo, max(pos) OVER a AS hi, sum(nw) OVER a AS words, list(line) OVER a AS k FROM d
  WINDOW a AS (PARTITION BY doc_id ORDER BY c1 RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
win AS (SELECT doc_id, lo, hi, array_to_string(k, chr(10)) AS k FROM (SELECT * FROM f UNION ALL SELECT * FROM b) WHERE words >= {MIN_WORDS}),
ranked AS (SELECT *, min((doc_id, lo)) OVER (PARTITION BY k) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM ranked, unnest(range(lo, hi + 1)) AS u(p) WHERE (doc_id, lo) > first),
per AS (SELECT doc_id, list(p ORDER BY p) AS ps FROM gone GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string(ps, ','), '') AS removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ls ELSE [ls[i] for i in range(1, len(ls) + 1) if NOT list_contains(ps, i - 1)] END, chr(10)), '')) AS clean_sha256
FROM documents x LEFT JOIN raw USING (doc_id) LEFT JOIN per USING (doc_id)
"""
