"""MinHash near-duplicates of whole documents, confirmed on their full shingle sets.

1. One pass takes each document's distinct word shingles, the minima of `BANDS * ROWS` universal
   hashes, one key for each band, a sketch of one byte for every other minimum and a fingerprint
   of the set. Documents with equal sets are one class from here on.
2. In each bucket (classes with an equal band key) every member is paired with the least one only.
   A sketch that disagrees too much rules a pair out, full sets decide, and components follow.
3. Buckets that now lie in one component are settled. In the others every pair across components
   is compared by sketch and by bitmap, inside tasks and in bounded blocks of members, and full sets
   decide again. A bitmap holds one bit for each shingle's hash; bits that one set has and the other
   lacks bound their common shingles from above, so it rules out no pair that is similar enough.
   So no pair that shares a bucket is left out but those that are connected anyway, and pairs
   within a component, however large, are never listed.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75**6)**56 = 2e-5.

Defined cases: null, empty and blank texts have no shingles and no links; a document with fewer
words than a shingle has one, its whole sequence; a null id takes no part in links and is kept;
rows that share an id are one node with the links of any of them; other columns pass through
(those that an output name clashes with are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._store import checkpointed
from .components import components

SHINGLE = 5
#: Similarity from which documents are linked, as a percentage.
PERCENT = 75
ROWS, BANDS = 6, 56
SKETCH = ROWS * BANDS // 2
#: Sketches agree in a share of bytes with standard deviation 0.033 at similarity 0.75; five of them below it.
SKETCH_LEAST = 0.58
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
BITMAP = 2048
#: Tasks that the copies of one set are dealt over.
SALTS = 64
_TEXT_BLOCK = 1 << 18
#: Pairs whose full sets are unpacked at once.
_PAIRS = 256
_SEED = np.random.default_rng(20)
_A = _SEED.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_C = _SEED.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    words = _text.Words(data, offsets, _text.NONSPACE)
    full = _text.window_hashes(words.hash, size)
    out = []
    for a, b in zip(words.bound[:-1].tolist(), words.bound[1:].tolist()):
        out.append(np.unique(full[a : b - size + 1] if b - a >= size else _text.window_hashes(words.hash[a:b], b - a) if b > a else full[:0]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of all hashes for each (non-empty) set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(_A), len(sets)), dtype=np.uint64)
    work = np.empty_like(flat)
    for k in range(len(_A)):
        np.multiply(flat, _A[k], out=work)
        work += _B[k]
        np.minimum.reduceat(work, at, out=out[k])
    return (out >> np.uint64(32)).T


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), dtype=np.uint64)
    for k in range(BANDS):
        keys[:, k] = _text.mix((_text.mix(sig[:, k * ROWS : (k + 1) * ROWS] * _C) * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(k))
    return keys.view(np.int64)


def _profiles(batches, id_col: str, text_col: str):
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, text_col, _TEXT_BLOCK):
            sets = shingle_sets(data, offsets)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, prints, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if some:
                sig = signatures([sets[i] for i in some])
                bands = band_keys(sig)
                small = (sig[:, ::2] & np.uint64(255)).astype(np.uint8)
                for n, i in enumerate(some):
                    keys[i], sketch[i] = bands[n], small[n].tobytes()
                    s = sets[i]
                    prints[i] = np.array([len(s), s.sum(dtype=np.uint64), _text.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(id_col),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ],
                ["id", "n_shingles", "print", "bands", "sketch"],
            )


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP, dtype=bool)
    bits[(_text.mix(s) % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_common(n: int, bits: np.ndarray, others_n: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the shingles that a set shares with others, by their sizes and bitmaps."""
    both = np.bitwise_count(others & bits).sum(axis=1, dtype=np.int64)
    mine, theirs = int(np.bitwise_count(bits).sum()), np.bitwise_count(others).sum(axis=1, dtype=np.int64)
    return np.minimum(n - (mine - both), others_n - (theirs - both))


def _sets(batches, text_col: str):
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, text_col, _TEXT_BLOCK):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())],
                ["id", "size", "set", "bits"],
            )


def _agree(batches):
    """Pairs whose sketches agree in enough bytes."""
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= SKETCH_LEAST))


def _confirm(batches, percent: int):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for at in range(0, len(batch), _PAIRS):
            part = batch.slice(at, _PAIRS)
            for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                common = both - len(np.union1d(x, y)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * common >= percent * (both - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(members: pa.Table, percent: int) -> pa.Table:
    """Pairs of one block of one bucket across components that sketches and bitmaps do not rule out."""
    sketch = np.frombuffer(b"".join(members.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    bits = np.frombuffer(b"".join(members.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
    ids, size, part = members.column("id"), members.column("size").to_numpy(), members.column("part").to_numpy()
    comp = members.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    same_part = members.column("i")[0].as_py() == members.column("j")[0].as_py()
    main = np.bincount(comp).argmax()
    left, right = [], []
    for k in np.flatnonzero(comp != main).tolist():  # every pair across components has a member outside the largest
        may = (comp != comp[k]) & ((comp == main) | (np.arange(len(comp)) > k))
        may &= (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k])) & (same_part | (part != part[k]))
        other = np.flatnonzero(may)
        other = other[(sketch[other] == sketch[k]).mean(axis=1) >= SKETCH_LEAST]
        common = most_common(size[k], bits[k], size[other], bits[other])
        other = other[100 * common >= percent * (size[k] + size[other] - common)]
        left += [k] * len(other)
        right += other.tolist()
    return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})


def _confirmed(pairs: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(lambda b: _confirm(b, percent), f"a {kind}, b {kind}")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components of (node, component) after further links, which are followed between components only."""
    of_a, of_b = groups.select(F.col("node").alias("a"), F.col("component").alias("of_a")), groups.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = checkpointed(components(between, "a", "b"))
    old = groups.join(moved.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return old.unionAll(moved).groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; kept marks the least id of a component."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profile = checkpointed(source.mapInArrow(lambda b: _profiles(b, "id", "text"), f"id {kind}, n_shingles long, print binary, bands array<long>, sketch binary"))
    linkable = profile.where("id IS NOT NULL AND print IS NOT NULL")
    classes = checkpointed(linkable.groupBy("print").agg(F.min("id").alias("id")))
    places = linkable.join(classes, ["print", "id"]).select("id", F.explode("bands").alias("bucket"))
    # one exchange for both uses; a bucket holds a class at most once, so no more than 1/BANDS of the rows
    places = places.repartition("bucket")
    shared = places.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(places.join(shared, "bucket"))

    # the full sets of all classes that share a bucket, from their texts
    involved = members.select("id").distinct()
    sets = checkpointed(source.join(involved.hint("shuffle_hash"), "id").mapInArrow(lambda b: _sets(b, "text"), f"id {kind}, size long, set binary, bits binary"))

    sketches = linkable.select("print", "id", "sketch").join(involved, "id", "left_semi").join(classes, ["print", "id"], "left_semi").select("id", "sketch")
    first = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    first = first.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    agreed = first.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agree, f"a {kind}, b {kind}").distinct()
    links = checkpointed(_confirmed(agreed, sets, kind, percent))
    groups = checkpointed(components(links, "a", "b"))

    # buckets that lie in more than one component: all pairs across components
    placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least <> _most").select("bucket")
    todo = placed.join(open_, "bucket", "left_semi").join(sketches, "id").join(sets.select("id", "size", "bits"), "id")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    todo = todo.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j"))))
    todo = todo.select("bucket", "id", "component", "sketch", "size", "bits", "part", pair.alias("_pair")).select("bucket", "id", "component", "sketch", "size", "bits", "part", "_pair.*")
    across = todo.groupBy("bucket", "i", "j").applyInArrow(lambda t: _across(t, percent), f"a {kind}, b {kind}")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = checkpointed(_confirmed(across, sets, kind, percent))
    if not more.isEmpty():
        groups = checkpointed(_merged(groups, more))

    of_class = classes.select("print", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    of_class = of_class.groupBy("print").agg(F.min("component_id").alias("component_id"))
    # copies of one set may be a third of all rows: they meet their class by set and salt
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt")
    of_part = linkable.select("print", salt).distinct().join(of_class, "print")
    result = profile.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("print")).alias("print"), salt).join(of_part, ["print", "_salt"], "left")
    result = result.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of docs, one (of least id) for each group of near-duplicates."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query: the component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + least(5, len(ws)) - 1], ' ') AS sh
  FROM w, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS u(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common.c >= 75 * (x.c + y.c - common.c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, edge.b FROM reach JOIN edge ON edge.a = reach.r),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.d = w.doc_id
"""
