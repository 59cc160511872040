"""Fill-in-middle: documents cut into prefix, middle and suffix and written in another order.

A document is cut between two drawn places into three pieces of whole units (code points, words with the blanks
after them, or lines). Form `psm` writes prefix, suffix, middle, form `spm` suffix, prefix, middle, each after its
sentinel; form `plain` is the text itself, for texts that are empty, hold a sentinel, or are drawn to stay.
The sentinels do not overlap one another or themselves, so the first occurrences of each in an output
are those that were written, and `restore` rebuilds the exact text from output and form.

The draws are Spark expressions over a digest of seed and key, the same for every partitioning. The texts go through
pyarrow.compute in blocks of bounded size: units become a list array, are flattened with the indices of their
parents, numbered within the document, filtered by role, gathered into lists again and joined to pieces. A document
longer than a block is cut into parts at the borders of units; each part's units keep their numbers within the
document, and the pieces of the parts are joined, so what is held beside a block is the document itself.

Defined cases: null text counts as empty; an empty text is plain; a null key draws as an empty one; repeated
rows with equal keys are cut alike; an empty table gives no rows; other columns pass through (those that an
output name clashes with are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _text

#: The sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text whose units are held as an array at once.
PART_BYTES = 1 << 20
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")
_DRAWS = ("_h1", "_h2", "_h3", "_h4")
_ROLES = ("prefix", "middle", "suffix")


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws for a key: the first digits of the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _starts(data: np.ndarray, unit: str) -> np.ndarray:
    """For each byte, whether a unit starts there; the first byte of a document does in any case."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    mask = np.zeros(len(data), dtype=bool)
    if unit == "line":
        mask[1:] = data[:-1] == 10
    else:
        word = _text.NONSPACE[data]
        mask[1:] = word[1:] & ~word[:-1]
    return mask


def _parts(data: np.ndarray, offsets: np.ndarray, unit: str, limit: int):
    """Groups of parts of at most `limit` bytes (or one unit): (document, start, end) by part, with starts of units as a mask."""
    docs, start, end, size = [], [], [], 0
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b > a:
            to = b
            if size + b - a > limit:
                if size:
                    yield docs, start, end
                    docs, start, end, size = [], [], [], 0
                to = min(b, a + limit)
                while to < b:  # on to the next start of a unit
                    ahead = np.flatnonzero(_starts(data[to - 1 : to + 4096], unit)[1:])
                    if len(ahead):
                        to += int(ahead[0])
                        break
                    to = min(b, to + 4096)
            docs.append(d)
            start.append(a)
            end.append(to)
            size += to - a
            a = to
    if docs:
        yield docs, start, end


def _units(data: np.ndarray, start: list[int], end: list[int], unit: str) -> pa.ListArray:
    """The units of each part, as a list array over the block's own bytes."""
    lengths = np.array(end) - np.array(start)
    own = data[start[0] : end[-1]]  # parts of a group follow one another; empty documents between them hold no bytes
    mask = _starts(own, unit)
    first = np.concatenate([[0], np.cumsum(lengths)])
    mask[first[:-1]] = True
    at = np.flatnonzero(mask)
    offsets = np.append(at, len(own)).astype(np.int32)
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), values)


def _cut(units: pa.ListArray, base: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, pa.Array]:
    """By role the joined units of each part. base: number of the part's first unit; low, high: where prefix and middle end."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    first = pc.subtract(pa.array(base), pc.cast(units.offsets.slice(0, len(units)), pa.int64()))
    ordinal = pc.add(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(first, parent))
    before, after = (pc.less(ordinal, pc.take(pa.array(x), parent)) for x in (low, high))
    role = {"prefix": before, "middle": pc.and_not(after, before), "suffix": pc.invert(after)}
    out = {}
    for name, mask in role.items():
        counts = np.bincount(pc.filter(parent, mask).to_numpy(), minlength=len(units))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        out[name] = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, mask)), "")
    return out


def _written(pieces: dict[str, pa.Array], form: pa.Array, text: pa.Array, sentinels) -> pa.Array:
    """The output of each document, by its form."""
    marked = {r: pc.binary_join_element_wise(s, pieces[r], "") for r, s in zip(("prefix", "suffix", "middle"), sentinels)}
    orders = [pc.binary_join_element_wise(*[marked[r] for r in order], "") for order in (("prefix", "suffix", "middle"), ("suffix", "prefix", "middle"))]
    return pc.if_else(pc.equal(form, "plain"), text, pc.if_else(pc.equal(form, "psm"), orders[0], orders[1]))


def _transform(batches, text_col: str, keep: list[str], unit: str, rates: tuple[int, int], sentinels, limit: int):
    plain_from, spm_below = rates
    for batch in batches:
        for part, data, offsets in _text.blocks(batch, text_col, limit):
            text = pc.fill_null(part.column(text_col), "").cast(pa.string())
            n_docs = len(part)
            h = [part.column(c).to_numpy().astype(np.int64) for c in _DRAWS]
            groups = list(_parts(data, offsets, unit, limit))
            sizes = []  # units of each part; of one group at a time the array is held
            for docs, start, end in groups:
                sizes.append(pc.list_value_length(_units(data, start, end, unit)).to_numpy().astype(np.int64))
            owner = np.array([d for docs, _, _ in groups for d in docs], dtype=np.int64)
            flat = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            n = np.bincount(owner, weights=flat, minlength=n_docs).astype(np.int64)
            a, b = h[0] % (n + 1), h[1] % (n + 1)
            low, high = np.minimum(a, b), np.maximum(a, b)
            held = np.zeros(n_docs, dtype=bool)
            for s in sentinels:
                held |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
            plain = (n == 0) | held | (h[2] % 100 >= plain_from)
            form = np.where(plain, "plain", np.where(h[3] % 100 < spm_below, "spm", "psm"))
            base = np.cumsum(flat) - flat
            if len(flat):
                base -= base[np.searchsorted(owner, owner)]  # numbers start anew in each document
            cut, at = {r: [] for r in _ROLES}, 0
            for docs, start, end in groups:
                to = at + len(docs)
                for r, piece in _cut(_units(data, start, end, unit), base[at:to], low[owner[at:to]], high[owner[at:to]]).items():
                    cut[r].append(piece)
                at = to
            by_doc = pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32))
            pieces = {r: pc.binary_join(pa.ListArray.from_arrays(by_doc, pa.concat_arrays(cut[r] or [pa.array([], pa.string())])), "") for r in _ROLES}
            out = _written(pieces, pa.array(form.tolist(), pa.string()), text, sentinels)
            count = {r: pa.array(x, mask=plain) for r, x in (("prefix", low), ("middle", high - low))}
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(n), pa.array(form.tolist(), pa.string()), count["prefix"], count["middle"], out],
                [*keep, *OUTPUTS],
            )


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1,
    fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (units of each, null if plain) and output.

    unit: char, word or line; fim_percent of the keys are cut, of these spm_percent in form spm.
    """
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unit must be char, word or line, not {unit}")
    check_sentinels(sentinels)
    keep = [c for c in docs.columns if c not in OUTPUTS]
    rest = [c for c in keep if c not in _DRAWS]
    if text_col not in docs.columns or text_col in OUTPUTS:
        raise ValueError(f"text_col must be a column of docs beside the outputs, not {text_col}")
    drawn = docs.select(*rest, *[h.alias(name) for h, name in zip(draws(F.col(key), seed), _DRAWS)])
    schema = T.StructType([docs.schema[c] for c in rest])
    for name in OUTPUTS:
        schema.add(name, T.StringType() if name in ("form", "output") else T.LongType())
    return drawn.mapInArrow(lambda it: _transform(it, text_col, rest, unit, (fim_percent, spm_percent), sentinels, part_bytes), schema)


def check_sentinels(sentinels) -> None:
    """Fails unless the sentinels can be told apart wherever texts and sentinels meet."""
    for a in sentinels:
        for b in sentinels:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or a != b and a in b:
                raise ValueError(f"sentinels overlap: {a} and {b}")
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text of an output, by its form: the pieces between the first occurrences of the sentinels."""
    p, s, m = sentinels

    def pieces(first: str, second: str) -> list[Column]:
        body = F.split(F.substr(output, F.lit(len(first) + 1)), _literal(second), 2)
        tail = F.split(body[1], _literal(m), 2)
        return [body[0], tail[0], tail[1]]

    psm, spm = pieces(p, s), pieces(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))


def _literal(text: str) -> str:
    """text as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c in "<>" else f"\\{c}" for c in text)


def restore(docs: DataFrame, out_col: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (with form and output) plus the text that each output was written from."""
    return docs.withColumn(out_col, restored(F.col("output"), F.col("form"), sentinels))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole document in its form, with digests of output and rebuilt text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = restore(fill_in_middle(docs).drop("text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
r AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
  CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
