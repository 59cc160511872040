"""Secret scans: fixed credential patterns plus values that would be costly to guess.

Three base patterns (assignments, access keys, long hex runs) give the base spans. Beside them,
every value in a credential context (`pwd: ...`, `client_secret=...`, `Authorization: Bearer ...`)
is segmented at minimum guessing cost by dynamic programming over its characters, the values of base
spans too: their costs are part of the result. A segment is

* a known word, in any case and with the usual digits for letters;
* a date: a year, year and month, year, month and day, day and month with or without a year;
* a repeat: three or more equal characters, or a block of 2 characters or more twice or more;
* a keyboard or alphabet walk of four characters or more;
* or, else, brute force over its characters' classes.

Blocks may be of any width, and repeats and walks begin and end anywhere, however long the value. The programme keeps two
costs for each position (after brute force and after another segment), so its result is the least over all
segmentations into these pieces. Beyond `WHOLE` characters it takes the repeats from the maximal repetitions of the value (blocks that are
no repeats themselves; others cost more) and keeps of their starts those that may still be the best, as costs grow with the logarithm of the length: time
and memory are n log n. Values are costed whole. A value whose
cheapest segmentation needs 10**`min_guesses_log10` guesses or more is reported as kind "guess", unless a base span
already covers it. Without ":" or "=" before it, a value of letters in the case of prose (lower, or one capital at the
start) may be a word of prose that the list lacks, and needs 10**`PROSE_GUESSES_LOG10` guesses, save after "bearer".

Known words are `COMMON` and then the corpus's own: a Spark count of the texts that hold a word outside of
credential values. Words of `MIN_TEXTS` texts or more are ranked by it and broadcast, `WORDS` of them at most
(rarer ones cost about as much as brute force anyway). Unless a word list is given, the texts scanned are counted.

Defined cases: null text counts as empty and has no spans; texts are scanned whole; repeated rows are judged
one by one; an empty table gives no rows; other columns pass through (those that an output name clashes with
are replaced).
"""

from __future__ import annotations

import collections
import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

OUTPUTS = ("spans", "costs", "n_assign", "n_access", "n_hex", "n_guess")
KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES_LOG10 = 10.0
#: The same for what may be a word of prose: more than 14 letters by brute force.
PROSE_GUESSES_LOG10 = 20.0
#: Length of values whose repeats and walks are tried one by one, and pairs of places that are compared at once in longer ones.
WHOLE, PAIRS = 256, 1 << 20
#: Bound of the broadcast word list, and its letters a word and texts a word.
WORDS, WORD_LETTERS, MIN_TEXTS = 100_000, (3, 32), 5


def _either_case(words: str) -> str:
    """A pattern for ASCII letters in either case, without the wider case folding of a flag."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    "(?:" + _either_case("password|passwd|passphrase|passcode|pwd|secret|token|api_?key|access_?key|private_?key|auth|authorization|credentials?|bearer") + ")"
    r"""["']?(?:\x20*(?:[:=]|=>)\x20*|\x20+is\x20+|\x20+)["']?([^\s"'<>|,;]{8,})"""
)
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_CONTEXT_HINTS = (*_HINTS, "passphrase", "passcode", "pwd", "accesskey", "access_key", "privatekey", "private_key", "auth", "credential", "bearer")

# Common words of passwords, most frequent first; the rank is the number of guesses.
COMMON = (
    "password 123456 qwerty letmein admin welcome login monkey dragon master abc123 iloveyou secret "
    "test root user guest changeme default sample example token key pass access hello sunshine "
    "princess football baseball shadow superman batman trustno1 freedom whatever ninja mustang "
    "summer winter spring autumn january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday "
    "database server system manager service account company internet computer network security "
    "love lucky magic happy orange purple yellow silver golden coffee cookie flower garden"
).split()
_LEET = str.maketrans("4@310$57!", "aaeiosstl")
_KEYS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {a + b for row in _KEYS for a, b in [*zip(row, row[1:]), *zip(row[::-1], row[::-1][1:])]}
_DAY, _MONTH, _SIGN = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", "[-/.]?"
_DATE = re.compile(rf"(?:19|20)\d\d(?:{_SIGN}{_MONTH}(?:{_SIGN}{_DAY})?)?|{_DAY}{_SIGN}{_MONTH}(?:{_SIGN}(?:19|20)?\d\d)?")


def _brute(c: str) -> float:
    """log10 of the size of the character's class."""
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33)


class Words:
    """Ranks of known words: COMMON, then others from the most frequent on."""

    def __init__(self, more: list[str] = ()):
        ranked = dict.fromkeys([*COMMON, *more])
        self.rank = {w: i + 1 for i, w in enumerate(ranked)}
        self.longest = max(map(len, ranked))
        self.starts = {w[:3] for w in ranked}
        self.cost = functools.lru_cache(maxsize=50_000)(lambda value: guesses_log10(value, self))

    def pieces(self, low: str, plain: str, value: str, i: int) -> list[tuple[int, str, float]]:
        """Words that start at i: (end, kind, cost)."""
        out = []
        for text, extra in ((low, 0.0), (plain, math.log10(4))):
            if text[i : i + 3] in self.starts:
                for j in range(i + 3, min(len(value), i + self.longest) + 1):
                    if rank := self.rank.get(text[i:j]):
                        out.append((j, "word", math.log10(rank + 1) + (0.0 if value[i:j].islower() else math.log10(2)) + extra))
        return out


_COMMON = Words()


def _runs(value: str) -> dict[int, list[int]]:
    """By width: for each place, how many characters from it on equal those `width` further on; widths with a repeat only."""
    x = np.array([ord(c) for c in value], np.int64)
    n, out = len(x), {}
    for width in range(1, (n // 2 if n > 3 else 1) + 1):
        differ = np.append(np.flatnonzero(x[:-width] != x[width:]), n - width) if n > width else np.zeros(1, np.int64)
        at = np.arange(max(n - width, 0))
        run = differ[np.searchsorted(differ, at)] - at
        if (run >= (2 if width == 1 else width)).any():
            out[width] = run.tolist()
    return out


def _repetitions(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of each stretch of at least twice its least period that no neighbour extends, by start."""
    x = np.array([ord(c) for c in value], np.int64)
    n = len(x)
    classes = [np.unique(x, return_inverse=True)[1]]  # of the stretches of 2**k characters, until all differ
    while 2 << (len(classes) - 1) <= n and classes[-1].max() + 1 < len(classes[-1]):
        c, half = classes[-1], 1 << (len(classes) - 1)
        classes.append(np.unique(c[:-half] * np.int64(n + 1) + c[half:], return_inverse=True)[1])

    def equal(a, b, way):
        """How many characters from a and b on (way 1), or before them (-1), are equal."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(classes) - 1, -1, -1):
            c, step = classes[k], 1 << k
            i, j = (a + got, b + got) if way > 0 else (a - got - step, b - got - step)
            inside = (i >= 0) & (j < len(c))
            got += np.where(inside & (c[np.where(inside, i, 0)] == c[np.where(inside, j, 0)]), step, 0)
        return got

    # a repetition holds two neighbouring multiples of its period; nothing longer than 2**len(classes) - 1 occurs twice
    periods = np.arange(1, min(n // 2, 2 << len(classes)) + 1)
    count = (n - 1) // periods
    upto, found = np.cumsum(count), []
    for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(upto // PAIRS)) + 1):
        p = np.repeat(periods[part], count[part])
        a = p * (np.arange(len(p)) - np.repeat(np.cumsum(count[part]) - count[part], count[part]))
        after, before = equal(a, a + p, 1), equal(a, a + p, -1)
        good = after + before >= p
        found.append(np.unique(np.stack([a - before, a + p + after, p])[:, good], axis=1))
    found = np.concatenate(found, axis=1)
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    first = np.append(True, (np.diff(found[:2], axis=1) != 0).any(axis=0))[: found.shape[1]]  # the least period of a stretch
    return [tuple(r) for r in found[:, first].T.tolist()]


class _Starts:
    """The best start for each end, where a piece from start i to end j costs what i costs plus log10(j - i).

    Ends are asked for one after the other. An older start gains on a newer one with every step, so a stack of those that may still be
    the best, the newest on top, with the end from which on the one below is better, is all that is kept.
    """

    def __init__(self, least: int):
        self.least, self.waiting, self.stack = least, collections.deque(), []

    def add(self, i: int, cost: float) -> None:
        """A start whose pieces end at i + least or later."""
        self.waiting.append((i, cost))

    def best(self, j: int) -> tuple[float, int] | None:
        """(cost, start) of the cheapest piece that ends at j."""
        stack = self.stack
        while stack and stack[-1][2] <= j:
            stack.pop()
        if self.waiting and self.waiting[0][0] + self.least <= j:
            i, cost = self.waiting.popleft()
            if not stack or cost + math.log10(j - i) < stack[-1][1] + math.log10(j - stack[-1][0]):
                while stack and (until := self._until(i, cost, *stack[-1][:2])) >= stack[-1][2]:
                    stack.pop()
                stack.append((i, cost, until if stack else math.inf))
        return (stack[-1][1] + math.log10(j - stack[-1][0]), stack[-1][0]) if stack else None

    @staticmethod
    def _until(i: int, cost: float, older: int, its: float) -> float:
        """The end from which on the older start is better than i."""
        gap = 10 ** (cost - its)
        return (gap * i - older) / (gap - 1) if gap > 1 else math.inf


class _Open:
    """The repeats and walks of a long value that are under way at a position."""

    def __init__(self, value: str, walk: list[int], total: list[float]):
        self.total, self.runs = total, collections.defaultdict(list)
        for start, end, width in _repetitions(value):
            if end - start >= (3 if width == 1 else 2 * width):
                self.runs[start].append((start, end, width, "repeat", 3 if width == 1 else 2, {}))
        at = 0
        while at < len(value):
            if walk[at] >= 4:
                self.runs[at].append((at, at + walk[at], 1, "walk", 4, {}))
            at += walk[at]
        self.now = []

    def ended(self, j: int):
        """(start, kind, cost from the value's start on) of the best piece of each run that ends at j."""
        self.now = [r for r in self.now if r[1] >= j]
        for start, _, width, kind, _, places in self.now:
            at, rest = divmod(j - start, width)
            if rest in places and (best := places[rest].best(at)):
                yield start + rest + width * best[1], kind, best[0]

    def begin(self, i: int, before: float) -> None:
        """Pieces may begin at i; all before costs `before`."""
        self.now += self.runs.get(i, ())
        for start, end, width, kind, least, places in self.now:
            if i + least * width <= end:
                at, rest = divmod(i - start, width)
                cost = math.log10(40) if kind == "walk" else self.total[i + width] - self.total[i]
                places.setdefault(rest, _Starts(least)).add(at, before + cost)


def segments(value: str, words: Words | None = None) -> list[tuple[int, int, str, float]]:
    """The segmentation of least log10 guesses: (start, end, kind, cost).

    Each segment costs log10 of its guesses and each further segment log10(2) more, for the
    number of ways to order the kinds.
    """
    words = words or _COMMON
    n, low = len(value), value.lower()
    low = low if len(low) == n else value
    plain, runs, single = low.translate(_LEET), _runs(value) if n <= WHOLE else {}, [_brute(c) for c in value]
    total = np.concatenate([[0.0], np.cumsum(single)]).tolist()
    walk = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] + 1 if low[i] + low[i + 1] in _NEXT else 1
    # after another segment (or at the start), and after brute force
    other, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    back: list[tuple[int, str, float]] = [(0, "", 0.0)] * (n + 1)
    begun = [0] * (n + 1)  # where the brute force that ends here begins
    under_way = _Open(value, walk, total) if n > WHOLE else None
    for i in range(n + 1):
        if under_way:
            for start, kind, cost in under_way.ended(i):
                if cost < other[i]:
                    other[i], back[i] = cost, (start, kind, cost - min(other[start], brute[start]))
        if i == n:
            break
        more, here = (math.log10(2) if i else 0.0), min(other[i], brute[i])
        if under_way:
            under_way.begin(i, here + more)
        if other[i] + more <= brute[i]:
            brute[i + 1], begun[i + 1] = other[i] + more + single[i], i
        else:
            brute[i + 1], begun[i + 1] = brute[i] + single[i], begun[i]
        options = words.pieces(low, plain, value, i)
        if value[i].isdigit():
            options += [(j, "date", math.log10(365 * (120 if j - i > 4 else 1))) for j in range(i + 4, min(n, i + 10) + 1) if _DATE.fullmatch(value, i, j)]
        for width, run in runs.items():
            same = run[i] if i < len(run) else 0
            if width == 1 and same >= 2:
                options += [(j, "repeat", single[i] + math.log10(j - i)) for j in range(i + 3, i + same + 2)]
            elif width > 1 and same >= width:
                options += [(j, "repeat", total[i + width] - total[i] + math.log10((j - i) // width)) for j in range(i + 2 * width, i + same + width + 1, width)]
        if walk[i] >= 4 and not under_way:
            options += [(j, "walk", math.log10(40 * (j - i))) for j in range(i + 4, i + walk[i] + 1)]
        for j, kind, cost in options:
            if here + more + cost < other[j]:
                other[j], back[j] = here + more + cost, (i, kind, more + cost)
    out, j = [], n
    while j:
        if brute[j] < other[j]:
            i = begun[j]
            out.append((i, j, "brute", total[j] - total[i] + (math.log10(2) if i else 0.0)))
            j = i
            if j and other[j] < math.inf:  # what comes before brute force is another segment
                i, kind, cost = back[j]
                out.append((i, j, kind, cost))
                j = i
        else:
            i, kind, cost = back[j]
            out.append((i, j, kind, cost))
            j = i
    return out[::-1]


def guesses_log10(value: str, words: Words | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of a value needs."""
    return sum(cost for *_, cost in segments(value, words))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by start, then kind in the order of KINDS."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _prose(context: str, value: str) -> bool:
    """Whether a value is a word of prose after a word of the context: no explicit sign, letters in the case of prose."""
    explicit = ":" in context or "=" in context or context.lower().startswith("bearer")
    return not explicit and value.isalpha() and value[1:].islower()


def values_of(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, prose) of the values in a credential context and of those of base assignments, in order."""
    low = text.lower()
    found = {}
    if any(h in low for h in _CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,:!?)]}")
            if len(value) >= 8:
                found[m.start(1), m.start(1) + len(value)] = _prose(text[m.start() : m.start(1)], value)
    if any(h in low for h in _HINTS):
        found |= {m.span(2): False for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    return [(*k, v) for k, v in sorted(found.items())]


def scan(text: str | None, min_guesses_log10: float = MIN_GUESSES_LOG10, words: Words | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float]]]:
    """The spans of a text by start, then kind, and (start, end, log10 guesses) of each value that was segmented."""
    text = text or ""
    base = base_spans(text)
    spans, costs = list(base), []
    for lo, hi, prose in values_of(text):
        cost = (words or _COMMON).cost(text[lo:hi])
        costs.append((lo, hi, cost))
        if cost >= (max(min_guesses_log10, PROSE_GUESSES_LOG10) if prose else min_guesses_log10) and not any(a <= lo and hi <= b for _, a, b in base):
            spans.append(("guess", lo, hi))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), costs


def ranked_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The words of the most texts, outside of credential values; WORDS at most."""
    text = F.col(text_col)
    hinted = functools.reduce(lambda a, b: a | b, (F.lower(text).contains(h) for h in _CONTEXT_HINTS))
    bare = F.when(hinted, F.regexp_replace(text, CONTEXT.pattern, " ")).otherwise(text)
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counts = each.where(F.length("w").between(*WORD_LETTERS)).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(WORDS).collect()]


def secret_spans(docs: DataFrame, text_col: str = "text", min_guesses_log10: float = MIN_GUESSES_LOG10, words: list[str] | None = None) -> DataFrame:
    """docs plus spans (kind, start, end in code points, end exclusive), costs (start, end, log10 of the guesses of each value) and the counts of spans by kind."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    cost = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("guesses_log10", T.DoubleType())])
    counts = [T.StructField(n, T.LongType()) for n in OUTPUTS[2:]]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", T.ArrayType(span)), T.StructField("costs", T.ArrayType(cost)), *counts])
    places = [("start", pa.int32()), ("end", pa.int32())]
    of_spans, of_costs = pa.list_(pa.struct([("kind", pa.string()), *places])), pa.list_(pa.struct([*places, ("guesses_log10", pa.float64())]))

    sent = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col) if words is None else words)

    def scanned(batches):
        known = Words(sent.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                found = [scan(x, min_guesses_log10, known) for x in rows.column(text_col).to_pylist()]
                arrays = [rows.column(c) for c in keep]
                arrays.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s, _ in found], of_spans))
                arrays.append(pa.array([[{"start": a, "end": b, "guesses_log10": g} for a, b, g in c] for _, c in found], of_costs))
                arrays += [pa.array([sum(x[0] == k for x in s) for s, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *OUTPUTS])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(scanned, schema)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", min_guesses_log10: float = MIN_GUESSES_LOG10, words: list[str] | None = None) -> DataFrame:
    """docs with every span of `text_col` replaced by `mask`; overlapping spans are replaced together."""
    sent = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col) if words is None else words)

    def cut(batches):
        known = Words(sent.value)
        for batch in batches:
            out = []
            for x in batch.column(text_col).to_pylist():
                if x is not None:
                    parts, left = [], 0
                    for _, a, b in scan(x, min_guesses_log10, known)[0]:
                        if a >= left:
                            parts += [x[left:a], mask]
                        left = max(left, b)
                    x = "".join([*parts, x[left:]])
                out.append(x)
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(out, pa.string()))

    return docs.mapInArrow(cut, docs.schema)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: base and added spans of every whole document, and the cost of each value segmented."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_guess", F.transform("costs", lambda c: F.round(c["guesses_log10"], 3)).alias("costs"))
