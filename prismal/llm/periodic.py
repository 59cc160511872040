"""Periodic runs: stretches of words that repeat with a period, found by recompression of word sequences.

The words of a block of documents, each document closed by a symbol of its own, are compressed level by level into a
run-length grammar: block compression turns a run of equal symbols into one symbol, pair compression splits the
alphabet by a drawn bit and turns each (left, right) pair into one symbol, until one symbol is left. Equal stretches are
compressed alike but for a few symbols at their borders, so a longest common extension climbs the levels from two
positions while their borders agree and descends where the symbols differ: a few steps a level, and exact, since
symbols of a level are equal just where what they stand for is compressed alike.

Every run of length L and period q holds two positions q apart on a grid with step L - q; for a least length and
a least exponent the grids of all periods are harmonic: n log n candidates in all. Candidates with equal words are
extended both ways by grammar queries; where the whole stretch is long enough it is a run, and of equal stretches
the least period is the smallest one. All queries of a block go through the levels together, as arrays.

Each task works on whole documents in blocks of bounded size, without a shuffle. A document longer than a block is a block
of its own; the grammar holds about 60 bytes a word of the block, and the candidates pass in pieces of bounded number.

Defined cases: null text has no words; texts with fewer words than the least length have no runs; runs may overlap;
repeated rows get equal results; an empty table gives no rows; other columns pass through (those that an output
name clashes with are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Candidates that are extended together.
CANDIDATES = 1 << 20
OUTPUTS = ("n_words", "runs", "collapsed")
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


@dataclass
class Level:
    """One sequence of the grammar. up: the symbol of the next level that holds each symbol; first: the first
    symbol of the level below of each symbol (and an end); paired: whether the next level was made by pairs."""

    symbols: np.ndarray
    first: np.ndarray | None = None
    up: np.ndarray | None = None
    paired: bool = False


def _named(*keys: np.ndarray) -> np.ndarray:
    """Numbers of equal combinations of keys: equal just where all keys are."""
    one = keys[0].astype(np.int64)
    for k in keys[1:]:
        k = k.astype(np.int64)
        span = int(k.max()) + 1
        if int(one.max()) >= (1 << 62) // span:
            one = np.unique(one, return_inverse=True)[1]
        one = one * span + k
    return np.unique(one, return_inverse=True)[1].astype(np.int32)


def _block_step(s: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """First symbols and names after every run of equal symbols became one; None where there is no such run."""
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    if len(first) == len(s):
        return None
    return first, _named(s[first], np.diff(np.append(first, len(s))))


def _pair_step(s: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First symbols and names after every pair of a left and a right symbol became one; neighbours in s differ."""
    best = None
    for k in range(2):  # of two drawn partitions the one with more pairs
        bits = _text.mix(s.astype(np.uint64) + np.uint64((2 * level + k) * 0x9E3779B97F4A7C15 % (1 << 64)))
        left = (bits & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(left[:-1] & ~left[1:])
        if best is None or len(pair) > len(best):
            best = pair
    starts = np.ones(len(s), dtype=bool)
    starts[best + 1] = False
    first = np.flatnonzero(starts)
    two = np.zeros(len(s), dtype=bool)
    two[best] = True
    second = np.where(two[first], s[np.minimum(first + 1, len(s) - 1)] + 1, 0)
    return first, _named(s[first], second)


def grammar(words: np.ndarray) -> list[Level]:
    """The levels over a sequence whose last symbol occurs nowhere else."""
    levels, drawn = [Level(np.unique(words, return_inverse=True)[1].astype(np.int32))], 0
    while len(levels[-1].symbols) > 1:
        low = levels[-1]
        made = _block_step(low.symbols)
        paired = made is None
        if paired:
            made, drawn = _pair_step(low.symbols, drawn), drawn + 1
            if len(made[0]) == len(low.symbols):
                continue  # no pair in either draw; the next draws differ
        first, symbols = made
        low.up, low.paired = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(low.symbols)))), paired
        levels.append(Level(symbols, np.append(first, len(low.symbols)).astype(np.int32)))
    return levels


def extend(levels: list[Level], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """For pairs of different positions, how many words from them on (back: before them) are equal.

    The sequence must begin and end with symbols that occur once, so no query leaves it, and no position may be its first.
    """
    step = -1 if back else 1
    a, b = (a - 1, b - 1) if back else (a, b)
    origin, n = a.copy(), len(a)
    ia, ib = a.astype(np.int64), b.astype(np.int64)
    top = np.zeros(n, dtype=np.int32)
    live = np.arange(n)

    def climb(level: Level, higher: Level, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose positions now begin (or end) a symbol of the higher level, and those that differ here."""
        x, y = ia[rows], ib[rows]
        ux, uy = level.up[x], level.up[y]
        edge_x, edge_y = (higher.first[ux + 1] - 1, higher.first[uy + 1] - 1) if back else (higher.first[ux], higher.first[uy])
        inside = np.flatnonzero((edge_x != x) | (edge_y != y))
        same = level.symbols[x[inside]] == level.symbols[y[inside]]
        stay = inside[~same]
        go = inside[same]
        if level.paired:
            length = 1
        else:  # what is left of the two runs
            rest = [np.abs((higher.first[u[go]] - 1 if back else higher.first[u[go] + 1]) - v[go]) for u, v in ((ux, x), (uy, y))]
            length = np.minimum(*rest)
            stay = np.concatenate([stay, go[rest[0] != rest[1]]])
        x[go] += step * length
        y[go] += step * length
        ia[rows], ib[rows] = x, y
        ends = np.zeros(len(rows), dtype=bool)
        ends[stay] = True
        return rows[~ends], rows[ends]

    for h in range(len(levels) - 1):
        if not len(live):
            break
        live, ended = climb(levels[h], levels[h + 1], live)
        top[ended] = h
        ia[live], ib[live] = levels[h].up[ia[live]], levels[h].up[ib[live]]
    top[live] = len(levels) - 1
    for h in range(int(top.max()) - 1 if n else -1, -1, -1):
        low, high = levels[h], levels[h + 1]
        rows = np.flatnonzero(top > h)
        ux, uy = ia[rows], ib[rows]
        x, y = (high.first[ux + 1] - 1, high.first[uy + 1] - 1) if back else (high.first[ux], high.first[uy])
        x, y = x.astype(np.int64), y.astype(np.int64)
        same = np.flatnonzero(low.symbols[x] == low.symbols[y])
        length = 1 if low.paired else np.minimum(*(high.first[u[same] + 1] - high.first[u[same]] for u in (ux, uy)))
        x[same] += step * length
        y[same] += step * length
        ia[rows], ib[rows] = x, y
    return np.abs(ia - origin)


def _candidates(begin: np.ndarray, n: np.ndarray, least: int, exponent: int, limit: int):
    """Pieces of (document, period, position): the grid points of every period of every document."""
    most = np.where(n >= least, n // exponent, 0)
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least - period, (exponent - 1) * period)
    count = (n[doc] - 1 - period) // step + 1
    total = np.cumsum(count)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        c = count[at:to]
        which = np.repeat(np.arange(at, to), c)
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield doc[which], period[which], begin[doc[which]] + k * step[which]
        at = to


def find(words: np.ndarray, begin: np.ndarray, n: np.ndarray, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT, limit: int = CANDIDATES) -> np.ndarray:
    """Rows (document, start, length, period), in this order, of all runs of a block; document d's n[d] words begin at begin[d].

    Every document must be followed by a symbol that occurs once in words, and one must stand before the first.
    """
    levels, found = None, []
    for doc, q, i in _candidates(begin, n, least, exponent, limit):
        equal = words[i] == words[i + q]
        doc, q, i = doc[equal], q[equal], i[equal]
        if not len(i):
            continue
        levels = levels or grammar(words)
        right = extend(levels, i, i + q)
        left = extend(levels, i, i + q, back=True)
        length = left + right + q
        good = length >= np.maximum(least, exponent * q)
        rows = np.stack([doc[good], (i - left - begin[doc])[good], length[good], q[good]], axis=1)
        found.append(np.unique(rows, axis=0))
    rows = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *found]), axis=0)
    new = np.ones(len(rows), dtype=bool)  # of equal stretches the least period
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Word numbers with closing symbols, where each document begins, its number of words, and the words."""
    number: dict[bytes, int] = {}
    split = [t.split() for t in texts]  # bytes split at space and U+0009 to U+000D
    put = number.setdefault
    n = np.array([len(w) for w in split], dtype=np.int64)
    begin = np.cumsum(n + 1) - n
    out = np.empty(int(n.sum()) + len(n) + 1, dtype=np.int64)
    out[0] = -1
    for d, (w, a) in enumerate(zip(split, begin.tolist())):
        out[a : a + len(w)] = [put(x, len(number)) for x in w]
        out[a + len(w)] = -2 - d
    return out, begin, n, split


def _runs(batches, text_col: str, keep: list[str], least: int, exponent: int, schema):
    for batch in batches:
        for part, data, offsets in _text.blocks(batch, text_col):
            raw = data.tobytes()
            words, begin, n, split = _block([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            rows = find(words, begin, n, least, exponent)
            bound = np.searchsorted(rows[:, 0], np.arange(len(n) + 1))
            runs, collapsed = [], []
            for d, own in enumerate(split):
                mine = rows[bound[d] : bound[d + 1], 1:]
                mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in mine.tolist()])
                if len(mine):
                    edge = np.zeros(len(own) + 1, np.int64)  # + where the repeats of a run begin, - behind it
                    np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
                    np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n), pa.array(runs, schema.field("runs").type), pa.array(collapsed, pa.string())], [*keep, *OUTPUTS])


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with n_words, runs (start, length, period by start and period) and collapsed, the words without the repeats of any run.

    A run is a stretch of at least min_length words and min_exponent periods that cannot grow; of its words
    all after the first period are repeats.
    """
    if min_exponent < 2 or min_length < 2 * min_exponent:
        raise ValueError("runs need at least two periods, and a least length of two words a period")
    keep = [c for c in docs.columns if c not in OUTPUTS]
    if text_col not in docs.columns or text_col in OUTPUTS:
        raise ValueError(f"text_col must be a column of docs beside the outputs, not {text_col}")
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    kinds = pa.schema([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))])
    return docs.select(*keep, *[text_col] * (text_col not in keep)).mapInArrow(lambda it: _runs(it, text_col, keep, min_length, min_exponent, kinds), schema)


def _planted(docs: DataFrame) -> DataFrame:
    """The contract's words: of every tenth document by a hash of its id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.withColumn("_h", h).withColumn("_w", F.when(h % 10 == 0, words))
    n, g = F.nullif(F.size("_w"), F.lit(0)), F.floor(F.col("_h") / 10)  # null without words: a remainder by zero is an error
    own = own.withColumn("_a", g % n).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    source = lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1).cast("int")))
    text = F.when(n > 0, F.array_join(F.transform("_w", source), " ")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: the runs of every whole document, with some planted, and digests of runs and of what is left without repeats."""
    found = find_runs(_planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # greatest exponent: a > b where length(a) * period(b) > length(b) * period(a); the first of equal ones stays, runs being in order
    none = F.lit(None).cast(RUN)
    first = F.aggregate("runs", none, lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    most = F.col("_most")
    return found.withColumn("_most", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), most["start"].alias("start"), most["length"].alias("length"), most["period"].alias("period"),
        F.floor(1000 * most["length"] / most["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
