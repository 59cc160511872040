"""Benchmark decontamination: which training words lie inside a window of a benchmark item.

Windows are runs of `size` consecutive item words (an item of fewer words is one window). A
fixed table of their hashes goes to every task when its checked size allows; documents' token
windows are looked up there, each hash hit is verified word for word, and the covered words are
counted, cut out, or lead to the document's removal. Where the benchmark is larger than
`broadcast_windows`, the window table is dealt out by hash instead and the documents' window
hashes meet it in shuffle joins; the result is the same.

Defined cases: null or empty text has no words and no hits; null or empty items have no window
(an item with a null id cuts words but is not counted in n_items); item ids of any type are compared and returned as strings;
repeated rows are judged one by one; an empty benchmark leaves every document clean; other columns
of the documents pass through (columns that an output name clashes with are replaced).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
#: Windows up to which the table is sent to every task (a few hundred bytes each).
BROADCAST_WINDOWS = 200_000

_UPPER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(WORD)
OUTPUTS = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated", "clean_text")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def item_windows(batches, size: int):
    """(width, hash, words, item_id) of each distinct window of each item."""
    for batch in batches:
        out = {}
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            width = min(size, len(words))
            for k in range(len(words) - width + 1 if width else 0):
                out[(" ".join(words[k : k + width]), item)] = width
        keys = list(out)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([out[k] for k in keys], pa.int32()),
                pa.array([window_hash(w) for w, _ in keys], pa.int64()),
                pa.array([w for w, _ in keys], pa.string()),
                pa.array([i for _, i in keys], pa.string()),
            ],
            ["width", "hash", "words", "item_id"],
        )


def window_hash(window: str) -> int:
    data, offsets = _text.column_bytes(pa.array([window]))
    words = _text.Words(data, offsets, _text.ALNUM)
    return int(_text.window_hashes(words.hash, len(words)).view(np.int64)[0])


class Table:
    """The windows of one benchmark, for lookups inside a task."""

    def __init__(self, rows: list[tuple[int, int, str, str]]):
        self.by_hash: dict[tuple[int, int], dict[str, set[str]]] = {}
        for width, h, words, item in rows:
            self.by_hash.setdefault((width, h), {}).setdefault(words, set()).add(item)
        self.filters = {}
        for width in {w for w, _ in self.by_hash}:
            known = np.array([h for w, h in self.by_hash if w == width], dtype=np.int64).view(np.uint64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(known >> np.uint64(44)).astype(np.int64)] = True
            self.filters[width] = (bits, np.sort(known))

    def hits(self, words: _text.Words, data: np.ndarray):
        """(first word, width, items) of each verified occurrence in a block."""
        for width, (bits, known) in self.filters.items():
            h = _text.window_hashes(words.hash, width)
            if not len(h):
                continue
            maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            for k in maybe[known[at] == h[maybe]].tolist():
                if np.searchsorted(words.bound, k, "right") != np.searchsorted(words.bound, k + width - 1, "right"):
                    continue
                text = " ".join(_word(words, data, i) for i in range(k, k + width))
                if items := self.by_hash[(width, int(h[k : k + 1].view(np.int64)[0]))].get(text):
                    yield k, width, items


def _word(words: _text.Words, data: np.ndarray, i: int) -> str:
    return _text.LOWER[data[words.start[i] : words.end[i]]].tobytes().decode()


def _spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as (first, last + 1)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _scan(batches, table: Table, text_col: str, keep: list[str]):
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, text_col):
            words = _text.Words(data, offsets, _text.ALNUM)
            found: dict[int, list] = {}
            for k, width, items in table.hits(words, data):
                found.setdefault(int(np.searchsorted(words.bound, k, "right")) - 1, []).append((k, width, items))
            yield _result(rows, data, offsets, words, found, text_col, keep)


def _result(rows, data, offsets, words, found, text_col, keep):
    """The rows of a block with their outputs; found: for a row, its (first word, width, items)."""
    n = len(rows)
    n_words = np.diff(words.bound)
    n_hit, items_of, spans_of = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
    clean = rows.column(text_col)
    texts = clean.to_pylist() if found else None
    for d, hits in found.items():
        first = words.bound[d]
        marks = np.zeros(n_words[d], dtype=bool)
        for k, width, _ in hits:
            marks[k - first : k - first + width] = True
        n_hit[d] = marks.sum()
        items_of[d] = sorted(i for i in set().union(*(i for _, _, i in hits)) if i is not None)
        raw = data[offsets[d] : offsets[d + 1]]
        chars = np.cumsum((raw & 0xC0) != 0x80)
        left, parts = 0, []
        for a, b in _spans(marks):
            lo, hi = words.start[first + a] - offsets[d], words.end[first + b - 1] - offsets[d]
            lo, hi = int(chars[lo]) - 1, int(chars[hi - 1])
            spans_of[d].append((lo, hi))
            parts.append(texts[d][left:lo])
            left = hi
        texts[d] = "".join([*parts, texts[d][left:]])
    arrays = [rows.column(c) for c in keep] + [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit),
        pa.array([len(i) for i in items_of], pa.int64()),
        pa.array(items_of, pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans_of], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array(n_hit > 0),
        pa.array(texts, pa.string()) if found else clean.cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, [*keep, *OUTPUTS])


def _schema(docs: DataFrame, keep: list[str]) -> T.StructType:
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(span), T.BooleanType(), T.StringType()]
    return T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(OUTPUTS, kinds)])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs plus n_words, n_hit, n_items, item_ids, hit_spans (code points), contaminated and clean_text (hit spans cut out)."""
    spark = docs.sparkSession
    windows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: item_windows(batches, size), "width int, hash long, words string, item_id string"
    )
    keep = [c for c in docs.columns if c not in OUTPUTS]
    schema = _schema(docs, keep)
    rows = [tuple(r) for r in windows.limit(broadcast_windows + 1).collect()]
    if len(rows) > broadcast_windows:
        return _by_join(docs, windows, keep, schema, text_col)
    table = spark.sparkContext.broadcast(rows)
    return docs.select(*{*keep, text_col}).mapInArrow(lambda batches: _scan(batches, Table(table.value), text_col, keep), schema)


def _by_join(docs: DataFrame, windows: DataFrame, keep: list[str], schema: T.StructType, text_col: str) -> DataFrame:
    """For a benchmark of any size: documents' windows meet the item windows in a join on their hash."""
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most `size` values
    key = F.sha2(F.col(text_col), 256)

    def positions(batches):
        for batch in batches:
            for rows, data, offsets in _text.blocks(batch, text_col):
                words = _text.Words(data, offsets, _text.ALNUM)
                for width in widths:
                    h = _text.window_hashes(words.hash, width)
                    first = np.arange(len(h))
                    doc = words.doc
                    whole = doc[first] == doc[first + width - 1] if len(h) else np.zeros(0, bool)
                    first = first[whole]
                    d = doc[first]
                    keys = rows.column("_text_key")
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(d)), pa.array((first - words.bound[d]).astype(np.int32)), pa.array(np.full(len(d), width, np.int32)), pa.array(h[first].view(np.int64))],
                        ["_text_key", "pos", "width", "hash"],
                    )

    # only hashes travel; the windows' words come back with the hits and are compared in the text
    texts = docs.select(text_col, key.alias("_text_key")).dropDuplicates(["_text_key"])
    places = texts.mapInArrow(positions, "_text_key string, pos int, width int, hash long")
    once = windows.groupBy("width", "hash", "words").agg(F.collect_set("item_id").alias("items")).groupBy("width", "hash").agg(F.collect_list(F.struct("words", "items")).alias("known"))
    hits = places.join(once, ["width", "hash"]).groupBy("_text_key").agg(F.collect_list(F.struct("pos", "width", "known")).alias("_hits"))

    def cut(batches):
        for batch in batches:
            for rows, data, offsets in _text.blocks(batch, text_col):
                words = _text.Words(data, offsets, _text.ALNUM)
                found: dict[int, list] = {}
                for d, hits in enumerate(rows.column("_hits").to_pylist()):
                    for h in hits or ():
                        at = int(words.bound[d]) + h["pos"]
                        text = " ".join(_word(words, data, i) for i in range(at, at + h["width"]))
                        for known in h["known"]:
                            if known["words"] == text:
                                found.setdefault(d, []).append((at, h["width"], set(known["items"])))
                yield _result(rows, data, offsets, words, found, text_col, keep)

    return docs.withColumn("_text_key", key).join(hits, "_text_key", "left").mapInArrow(cut, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text_col: str = "text", remove: str = "spans", max_share: float = 0.5) -> DataFrame:
    """The documents with contamination removed; the columns of docs.

    remove="spans" cuts the hit spans and drops a document only if more than `max_share` of its
    words are hit; remove="documents" drops every document with a hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove}")
    scored = contamination(docs, benchmark, size, text_col)
    if remove == "documents":
        return scored.where(~F.col("contaminated")).select(*docs.columns)
    kept = scored.where(F.col("n_hit") <= max_share * F.col("n_words"))
    return kept.select(*(F.col("clean_text").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: hit words and items of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scored.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS width, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS words
  FROM iw, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS u(k) WHERE len(ws) > 0),
widths AS (SELECT DISTINCT width FROM win),
dw AS (
  SELECT doc_id, k, width, array_to_string(ws[k : k + width - 1], ' ') AS words
  FROM w, widths, unnest(range(1, len(ws) - width + 2)) AS u(k)),
hit AS (SELECT doc_id, k, dw.width, item_id FROM dw JOIN win ON dw.width = win.width AND dw.words = win.words),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + width)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
