"""BPE encoding and decoding of a corpus by way of a table of its distinct words.

Texts are normalised and split into words in blocks of documents (in Spark tasks, with the
tokenizer's own rules); each block keeps its documents as positions into the block's own list of
distinct words. The blocks' lists are dealt out by word, so that every distinct word of the corpus
is encoded once, by the task that owns it, and the ids return to their blocks, where they are
joined to the positions; the text is decoded through a table of the vocabulary's pieces. What is
shuffled are a block's distinct words and its compressed positions, not a row for each word, so
a word that makes up a third of the corpus costs one row a block.

The tokenizer file is a parameter; its place is not copied into the repository. Its splitting rules are
read from it, and a file with other kinds of rules than a byte-level BPE without decoder is refused.
The documents are read twice (for words and for positions) and must come in the same order both times, as
from files or a checkpoint. A block ends by the number and the size of its rows (with all their columns),
wherever Arrow batches end; its key holds a hash of its content, so a block read differently has no
partner and the job fails instead of returning wrong rows.

Defined cases: null text counts as empty; an empty text has no tokens and decodes to ""; literal
special tokens in a text become their single id; repeated rows are encoded one by one; other
columns pass through (those that an output name clashes with are replaced).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _text

#: Bytes of text and other columns in a block (a longer row is a block of its own), and its rows at most.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 17
#: Rows that one task encodes before it passes their ids on.
ENCODE_ROWS = 300_000
#: Words whose ids and pieces are joined at once (a longer text is taken alone).
JOIN_WORDS = 1 << 18
_ZSTD = pa.Codec("zstd", 6)
OUTPUTS = ("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")
WEIGHT = "_bytes"

#: The splitting rule and the normalisation for which texts of low code points have a short cut.
_LATIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_NORMAL = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
_LATIN = 0x17F
_SPACES = "\t\n\v\f\r \x85\xa0"


def _latin_pattern() -> re.Pattern:
    """The splitting rule of the tokenizer for texts without characters over U+017F, after lower-casing."""
    def of(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(_LATIN + 1) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers = of("L"), of("N")
    other = f"[^{re.escape(_SPACES)}{letters}{numbers}]+"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|{other}")


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a normaliser or pre-tokenizer as the file states them."""
    return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]


class Splitter:
    """Texts to words, as the tokenizer's normaliser and pre-tokenizer do."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        rules = json.loads(self.tok.to_str())
        cuts, normal = _steps(rules["pre_tokenizer"], "pretokenizers"), _steps(rules["normalizer"], "normalizers")
        added = rules["added_tokens"]
        if rules["model"]["type"] != "BPE" or rules["model"]["dropout"] or rules["decoder"] is not None or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: not a BPE without decoder and with plain added tokens")
        if not cuts or cuts[-1]["type"] != "ByteLevel" or cuts[-1]["add_prefix_space"]:
            raise ValueError(f"{path}: words are not written by byte letters without a prefix")
        split = [(c.get("pattern"), c.get("behavior"), c.get("invert")) for c in cuts[:-1]]
        known = split == [({"Regex": _LATIN_SPLIT}, "Removed", True)] and not cuts[-1]["use_regex"]
        self.latin = _latin_pattern() if known and [(n["type"], n.get("pattern"), n.get("content")) for n in normal] == _LATIN_NORMAL else None
        self.special = {a["content"]: a["id"] for a in added}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special))
        self.byte_of = {c: b for b, c in byte_letters().items()}

    def _part(self, text: str, plain: bool) -> list[str]:
        if plain and self.latin is not None:
            return self.latin.findall(text.lower())
        text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str, plain: bool) -> list[str]:
        """plain: the text has no character over U+017F."""
        if self.special_split is None or self.special_start not in text:
            return self._part(text, plain)
        out = []
        for part in self.special_split.split(text):
            out += [part] if part in self.special else self._part(part, plain) if part else []
        return out

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        letters = byte_letters()
        return [t.id for t in self.tok.model.tokenize("".join(letters[b] for b in word.encode()))]


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def pieces_of(path: str) -> list[str]:
    """The piece of each id; as many as the vocabulary has."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.id_to_token(i) or "" for i in range(max(tok.get_vocab(with_added_tokens=True).values()) + 1)]


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document, whether all its characters are below U+0180 (lead bytes up to 0xC5)."""
    high = np.flatnonzero(data >= 0xC6)
    out = np.ones(len(offsets) - 1, dtype=bool)
    out[np.searchsorted(offsets, high, "right") - 1] = False
    return out


class _Open:
    """A block that rows are still added to."""

    def __init__(self):
        self.rows, self.docs, self.vocab, self.size = [], [], {}, 0
        self.data, self.lengths = hashlib.blake2b(digest_size=8), hashlib.blake2b(digest_size=8)

    def add(self, part, data, offsets, weights, text_col: str, cut: Splitter) -> None:
        put, vocab = self.vocab.setdefault, self.vocab
        for text, p in zip(part.column(text_col).to_pylist(), _plain(data, offsets).tolist()):
            self.docs.append(np.array([put(w, len(vocab)) for w in cut.words(text or "", p)], dtype=np.int32))
        self.rows.append(part)
        self.data.update(data)
        self.lengths.update(np.diff(offsets))
        self.size += int(weights.sum())

    def done(self):
        return self.rows, self.docs, list(self.vocab), int.from_bytes(self.data.digest(), "little") ^ int.from_bytes(self.lengths.digest(), "big")


def _blocks(batches, path: str, text_col: str, limits: tuple[int, int]):
    """Blocks of whole documents that follow one another: (rows, positions by document, distinct words, key).

    Where a block ends depends on the rows from its first one on, not on the batches they come in.
    """
    cut, now = splitter(path), _Open()
    most, most_rows = limits
    for batch in batches:
        for part, data, offsets in _text.blocks(batch, text_col):
            weights = part.column(WEIGHT).to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(weights)])
            at = 0
            while at < len(part):
                room = int(np.searchsorted(total, total[at] + most - now.size, "right")) - 1
                to = min(len(part), room, at + most_rows - len(now.docs))
                if to <= at and not now.docs:
                    to = at + 1
                if to > at:
                    own = offsets[at : to + 1]
                    now.add(part.slice(at, to - at), data[own[0] : own[-1]], own - own[0], weights[at:to], text_col, cut)
                    at = to
                if at < len(part):
                    yield now.done()
                    now = _Open()
    if now.docs:
        yield now.done()


def _key(seal: int, partition: int, k: int) -> int:
    """A block's key: its content and its place, so that equal blocks stay apart."""
    return int.from_bytes(hashlib.blake2b(f"{partition} {k} {seal}".encode(), digest_size=8).digest(), "little", signed=True)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes: the high bytes are nearly constant and vanish."""
    return _ZSTD.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(raw, decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _ranks(words: list[str]) -> np.ndarray:
    """Each word's place among the sorted words."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return rank


def _block_words(batches, path, text_col, limits):
    """The distinct words of each block with their places in sorted order."""
    for k, (_, _, words, seal) in enumerate(_blocks(batches, path, text_col, limits)):
        words.sort()
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([_key(seal, _partition(), k)] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32))],
                ["word", "block", "at"],
            )


def _block_positions(batches, path, text_col, keep, limits):
    """One row a block: its other columns as an Arrow stream and its words' positions, both compressed.

    A position is a word's place by falling frequency; `places` leads from there to the sorted order.
    """
    for k, (rows, docs, words, seal) in enumerate(_blocks(batches, path, text_col, limits)):
        table = pa.Table.from_batches([r.select(keep) for r in rows])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_key(seal, _partition(), k)]),
                pa.array([[len(words), len(docs), len(flat)]], pa.list_(pa.int64())),
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                pa.array([_pack(lengths)], pa.binary()),
                pa.array([_pack(_ranks(words)[order])], pa.binary()),
                pa.array([_pack(place[flat])], pa.binary()),
            ],
            ["block", "sizes", "rows", "lengths", "places", "positions"],
        )


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _encode(batches, path):
    """Each distinct word's ids, once: equal words follow one another. One row for each block and run of rows."""
    cut, last = splitter(path), None
    which, block, at, ids, size, done = [], [], [], [], [], 0

    def packed():
        flat, sizes = np.array(ids, np.int64), np.array(size, np.int64)
        start = np.cumsum(sizes) - sizes
        w, b, a = np.array(which), np.concatenate(block), np.concatenate(at).astype(np.int64)
        order = np.lexsort((a, b))
        w, b, a = w[order], b[order], a[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
        out = []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = sizes[w[x:y]]
            got = _gather(flat, start[w[x:y]], n)
            out.append((int(b[x]), [y - x, len(got)], _pack(np.diff(a[x:y], prepend=0)), _pack(n), _pack(got)))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "counts", "steps", "lens", "ids"])

    for batch in batches:
        for word in batch.column("word").to_pylist():
            if word != last or not size:
                last, got = word, cut.encode(word)
                ids += got
                size.append(len(got))
            which.append(len(size) - 1)
        block.append(batch.column("block").to_numpy())
        at.append(batch.column("at").to_numpy())
        done += len(batch)
        if done >= ENCODE_ROWS:
            yield packed()
            which, block, at, ids, size, done, last = [], [], [], [], [], 0, None
    if done:
        yield packed()


def _join_back(positions: pa.Table, encoded: pa.Table, pieces: list[str], keep: list[str], digests: bool) -> pa.Table:
    """One block: ids joined to its positions, and pieces to the ids."""
    n_words, n_docs, n_flat = positions.column("sizes")[0].as_py() if positions.num_rows == 1 else (-1, 0, 0)
    parts = list(zip(*(encoded.column(c).to_pylist() for c in ("counts", "steps", "lens", "ids"))))
    if n_words != sum(c[0] for c, *_ in parts):
        raise RuntimeError("a block was read differently the second time: checkpoint the documents first")
    rank = np.concatenate([np.cumsum(_unpack(s, c[0])) for c, s, _, _ in parts] or [np.zeros(0, np.int64)])
    size = np.concatenate([_unpack(x, c[0]) for c, _, x, _ in parts] or [np.zeros(0, np.int64)])
    flat = np.concatenate([_unpack(x, c[1]) for c, _, _, x in parts] or [np.zeros(0, np.int64)])
    start = np.cumsum(size) - size
    order = np.argsort(rank)[_unpack(positions.column("places")[0].as_py(), n_words)]  # by falling frequency
    start, size = start[order], size[order]
    with pa.ipc.open_stream(positions.column("rows")[0].as_buffer()) as stream:
        rows = stream.read_all().combine_chunks()
    at = _unpack(positions.column("positions")[0].as_py(), n_flat)
    first = np.concatenate([[0], np.cumsum(_unpack(positions.column("lengths")[0].as_py(), n_docs))])  # words before each document
    letters, tables, lo = pa.array(pieces, pa.string()), [], 0
    while lo < n_docs:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + JOIN_WORDS, "right")) - 1)
        own = at[first[lo] : first[hi]]
        before = np.concatenate([[0], np.cumsum(size[own])])[first[lo : hi + 1] - first[lo]]  # tokens before each document
        ids = pa.array(_gather(flat, start[own], size[own]).astype(np.int32))
        tables.append(_joined(rows.slice(lo, hi - lo), ids, pa.array(before.astype(np.int32)), letters, keep, digests))
        lo = hi
    return pa.concat_tables(tables)


def _joined(rows: pa.Table, ids: pa.Array, before: pa.Array, letters: pa.Array, keep: list[str], digests: bool) -> pa.Table:
    """Documents with their ids, numbered from `before`, and pieces or the digests of both."""
    text = pc.binary_join(pa.ListArray.from_arrays(before, letters.take(ids)), " ")
    count = pa.array(np.diff(before.to_numpy()).astype(np.int64))
    if digests:
        numbers = pc.binary_join(pa.ListArray.from_arrays(before, ids.cast(pa.string())), " ")
        out = [count, *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c.to_pylist()], pa.string()) for c in (numbers, text))]
    else:
        out = [pa.ListArray.from_arrays(before, ids), count, text]
    return pa.Table.from_arrays([*(rows.column(c) for c in keep), *out], [*keep, *_outputs(digests)])


def _outputs(digests: bool) -> list[str]:
    return ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "n_tokens", "decoded"]


def _weight(docs: DataFrame, columns: list[str]) -> Column:
    """About how many bytes a row of these columns takes; the same whatever other columns are read with it."""
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType)
    sized = [F.coalesce(F.octet_length(F.col(c) if isinstance(docs.schema[c].dataType, (T.StringType, T.BinaryType)) else F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns if not isinstance(docs.schema[c].dataType, fixed)]
    return functools.reduce(lambda a, b: a + b, sized, F.lit(8 * len(columns)).cast("long"))


def tokenize(
    docs: DataFrame, path: str, text_col: str = "text", digests: bool = False, keep_text: bool = True, limits: tuple[int, int] = (BLOCK_BYTES, BLOCK_ROWS)
) -> DataFrame:
    """docs with ids, n_tokens and decoded, or with SHA-256 digests of both instead of the arrays and texts.

    The digests are of the ids in decimal, joined by one space, and of the decoded text in UTF-8.
    keep_text=False leaves the text column out, which then need not travel with the positions.
    """
    keep = [c for c in docs.columns if c not in (*OUTPUTS, WEIGHT) and (keep_text or c != text_col)]
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, kinds.get(n, T.StringType())) for n in _outputs(digests)])
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(path))  # as large as the vocabulary
    weighed = docs.withColumn(WEIGHT, _weight(docs, list(dict.fromkeys([*keep, text_col]))))
    words = weighed.select(text_col, WEIGHT).mapInArrow(lambda b: _block_words(b, path, text_col, limits), "word string, block long, at int")
    positions = weighed.select(*dict.fromkeys([*keep, text_col, WEIGHT])).mapInArrow(
        lambda b: _block_positions(b, path, text_col, keep, limits), "block long, sizes array<long>, rows binary, lengths binary, places binary, positions binary"
    )
    encoded = words.repartition("word").sortWithinPartitions("word").mapInArrow(lambda b: _encode(b, path), "block long, counts array<long>, steps binary, lens binary, ids binary")

    def join_back(a: pa.Table, b: pa.Table) -> pa.Table:
        return _join_back(a, b, pieces.value, keep, digests)

    return positions.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(join_back, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens plus the text of their ids (null for null): a join of each id with its piece, by the vocabulary's table.

    An id out of the vocabulary decodes to nothing, as in the library. Rows are told apart by a
    digest of their ids, so equal lists are decoded once.
    """
    spark = tokens.sparkSession
    pieces = spark.createDataFrame([(i, p) for i, p in enumerate(pieces_of(path))], "_id int, _piece string")
    keyed = tokens.drop(out_col).withColumn("_key", F.sha2(F.col(ids_col).cast("string"), 256))
    distinct = keyed.select("_key", F.col(ids_col).alias("_ids")).where(F.col("_key").isNotNull()).dropDuplicates(["_key"])
    each = distinct.select("_key", F.posexplode("_ids").alias("_pos", "_id")).join(F.broadcast(pieces), "_id")
    texts = each.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_pos", "_piece"))).alias("_each"))
    texts = texts.select("_key", F.array_join(F.transform("_each", lambda s: s["_piece"]), " ").alias("_text"))
    decoded = F.when(F.col("_key").isNotNull(), F.coalesce("_text", F.lit("")))
    return keyed.join(texts, "_key", "left").withColumn(out_col, decoded).drop("_key", "_text")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: token count and digests of ids and decoded text of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenize(docs, default_path(), digests=True, keep_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
