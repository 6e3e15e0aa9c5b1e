"""Pack tokenised documents into sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder. The remainders' histogram over length
classes is a cutting-stock problem: a linear program over patterns of classes, whose columns
are priced by a knapsack dynamic program at smoothed duals. Remainders up to ``EXACT`` tokens
have classes of their own length and sequences of their own; longer ones have classes of
``UNIT`` tokens; so the programs are of fixed size. Patterns are rounded down, what is left is
packed best fit decreasing. Documents of a class are ranked, and the r-th takes the
r-th place that the patterns have for its class. Offsets then close the gaps between the
class and the length, so that padding is at the end only.

Defined results: a null text is an empty one, whose only token is the end mark; texts of
any length are cut; equal rows are packed one by one; an empty table gives no rows. Extra
columns of the pieces are kept, those named like an added one replaced.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm import tokens
from linewarden.llm.common import running_start, ship_package, stored, without

LENGTH = 1024
END = 0
SALTS = 1024
#: Lengths up to here are classes of their own, so short pieces waste nothing.
EXACT = 64
#: Tokens of a longer class; padding is half of it for each of its pieces, on average.
UNIT = 8
#: Relative distance to the bound of the linear program at which pricing stops.
GAP = 1e-3
#: Share of the best duals so far in those that price a column.
SMOOTH = 0.8
#: Parts that a Python worker remembers; beyond, it keeps those used since the last time it
#: was full, and starts again.
REMEMBERED = 300_000
#: Texts of only these characters are split by the plain rules below.
PLAIN = r"[\t\n\r -~À-ÖØ-öø-ɏ]*"
# Kinds of bytes of such texts: others, letters, digits, spaces, other white space, apostrophes.
_OTHER, _LETTER, _DIGIT, _SPACE, _BLANK, _QUOTE = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[32] = _SPACE
_KIND[[9, 10, 13]] = _BLANK
_KIND[39] = _QUOTE
#: Whether a part may end between two bytes of these kinds: an apostrophe may begin a
#: contraction, and white space belongs to what follows in ways that need the rules.
_CUT = np.zeros((6, 6), bool)
for _a in (_OTHER, _LETTER, _DIGIT):
    for _b in (_OTHER, _LETTER, _DIGIT):
        _CUT[_a, _b] = _a != _b
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"

_encoders: dict[str, Encoder] = {}


class _Remembered(dict):
    """Ids by text, in two generations."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids


class Encoder:
    """Texts to 32 bit ids of a tokenizer file.

    A text is split where no token can cross: at spaces between other characters, and between
    letters, digits and other signs. Parts of a batch are numbered, only distinct ones are
    tokenised, and their ids are remembered, since parts repeat.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokenize = self.tokenizer.model.tokenize
        self.plain = re.compile(PLAIN)
        pre_tokens = re.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
        )
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves,
        # the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        special = tuple(self.tokenizer.get_added_tokens_decoder().values())
        self.marks = [t.content for t in special]

        def part_ids(part: str) -> bytes:
            whole = part.isalpha() or (part[0] == " " and part[1:].isalpha())
            ids: list[int] = []
            for word in [part] if whole else pre_tokens.findall(part):
                seen = word.encode().decode("latin-1").translate(alphabet)
                ids += [t.id for t in tokenize(seen)]
            return array("I", ids).tobytes()

        self.of_part = _Remembered(part_ids)

    def whole(self, text: str) -> bytes:
        """Ids of a text that the rules for parts do not cover."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def is_plain(self, text: str) -> bool:
        return bool(self.plain.fullmatch(text)) and not any(m in text for m in self.marks)

    def __call__(self, text: str) -> bytes:
        ids, _ = self.batch(pa.array([text.encode()], pa.binary()))
        return ids.tobytes()

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and how many each text has."""
        texts = pa.concat_arrays([texts])  # drops the offset of a slice
        _, offsets, data = texts.buffers()
        places = np.frombuffer(offsets, np.int32)[: len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data or b"", np.uint8)[: places[-1]]
        decoded = texts.cast(pa.string()).to_pylist()
        plain = np.array([self.is_plain(t) for t in decoded], bool)

        # A space belongs to the part that it precedes, unless white space surrounds it.
        kind = _KIND[raw]
        gap = (kind == _SPACE) | (kind == _BLANK)
        edge = np.zeros(len(raw) + 1, bool)
        edge[1 : len(raw) - 1] = (kind[1:-1] == _SPACE) & ~gap[:-2] & ~gap[2:]
        edge[1 : len(raw)] |= _CUT.ravel()[6 * kind[:-1] + kind[1:]]
        edge[places] = True  # each text starts a part
        cuts = np.flatnonzero(edge[:-1])
        parts = pa.Array.from_buffers(
            pa.binary(),
            len(cuts),
            [None, pa.py_buffer(np.append(cuts, len(raw)).astype(np.int32)), data or pa.py_buffer(b"")],
        )
        row = np.searchsorted(places, cuts, "right") - 1
        split = plain[row]
        coded = parts.filter(pa.array(split)).dictionary_encode()
        known = [self.of_part[p] for p in coded.dictionary.cast(pa.string()).to_pylist()]
        odd = np.flatnonzero(~plain)
        known += [self.whole(decoded[i]) for i in odd.tolist()]
        known.append(end)

        # In the order of texts: their parts or their whole, then the end.
        n = len(known) - 1
        rows = np.concatenate([row[split], odd, np.arange(len(texts))])
        code = np.concatenate(
            [coded.indices.to_numpy(False), n - len(odd) + np.arange(len(odd)), np.full(len(texts), n)]
        ).astype(np.int64)
        code = code[np.argsort(rows, kind="stable")]
        rows.sort()
        size = np.array([len(k) // 4 for k in known], np.int64)
        start = np.cumsum(size) - size
        counts = size[code]
        at = np.repeat(start[code] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        ids = np.frombuffer(b"".join(known), "<u4")[at]
        return ids, np.bincount(rows, counts, len(texts)).astype(np.int64)


def encoder(path: str) -> Encoder:
    """One per worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The tokens of every document, each followed by ``end``, cut at ``length``.

    ``ids`` holds 32 bit little-endian numbers. ``tokenizer`` is a file that the workers
    can read, a byte-level vocabulary of the tokenizers library.
    """
    ship_package(docs.sparkSession)
    stop = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in tokens.slices(batches, "text"):
            ids, n = encode.batch(batch.column("text"), stop)
            count = -(-n // length)
            row = np.repeat(np.arange(len(n)), count)
            start = length * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            size = np.minimum(n[row] - start, length)
            ends = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(size),
                    pa.Array.from_buffers(
                        pa.binary(),
                        len(row),
                        [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)],
                    ),
                    pa.array(n[row]),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(cut, PIECES)


def best_pattern(lengths: np.ndarray, duals: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of each length with the largest sum of duals."""
    value = np.zeros(room + 1)
    for n, gain in zip(lengths.tolist(), duals.tolist(), strict=True):
        # Places n apart form a chain along which any number of this length may be taken.
        rows = room // n + 1
        chain = np.full(rows * n, -np.inf)
        chain[: room + 1] = value
        worth = gain * np.arange(rows)[:, None]
        chain = np.maximum.accumulate(chain.reshape(rows, n) - worth, axis=0) + worth
        value = chain.ravel()[: room + 1]
        if len(value) <= room:
            value = np.append(value, np.full(room + 1 - len(value), -np.inf))
    value = np.maximum.accumulate(value)
    counts, c = np.zeros(len(lengths)), room
    while c > 0 and value[c] > 1e-12:
        fits = np.flatnonzero(lengths <= c)
        near = np.abs(value[c - lengths[fits]] + duals[fits] - value[c])
        best = near.argmin() if len(fits) else -1
        if len(fits) and near[best] <= 1e-9 * max(1.0, value[c]):
            counts[fits[best]] += 1
            c -= int(lengths[fits[best]])
        else:
            c -= 1
    return float(counts @ duals), counts


def patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: count) and how often each is used; they use up the histogram.

    There are at most as many basic patterns as lengths, and what rounding leaves fills
    less than one sequence for each of them, so the list is bounded by ``room``.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0))
    if not len(lengths):
        return []
    demand = np.array([histogram[int(k)] for k in lengths], float)
    basis = np.diag((room // lengths).astype(float))
    inverse = np.diag(1.0 / (room // lengths))
    amounts = inverse @ demand
    # Prices in proportion to length are feasible, so their worth bounds the optimum.
    center = lengths / room
    bound = center @ demand
    idle = 0
    while idle < 500 and (used := amounts.sum()) - bound > GAP * used:
        duals = inverse.sum(axis=0)
        mix = SMOOTH * center + (1 - SMOOTH) * duals
        gain, column = best_pattern(lengths, mix, room)
        if gain > 0 and mix @ demand / gain > bound:
            bound, center = mix @ demand / gain, mix / gain
        if column @ duals <= 1 + 1e-9:
            gain, column = best_pattern(lengths, duals, room)
            if gain <= 1 + 1e-9:
                break
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        ratios = np.maximum(amounts[rows], 0) / direction[rows]
        leave = rows[ratios.argmin()]
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        amounts = inverse @ demand
        idle = idle + 1 if amounts.sum() > used * (1 - 1e-9) else 0
    out: list[tuple[dict[int, int], int]] = []
    left = {int(k): int(v) for k, v in zip(lengths, demand, strict=True)}
    for j in np.argsort(-amounts):
        items = {int(k): int(n) for k, n in zip(lengths, basis[:, j], strict=True) if n > 0}
        times = int(amounts[j] + 1e-6)
        times = min([times, *(left[k] // n for k, n in items.items())])
        if times > 0:
            out.append((items, times))
            for k, n in items.items():
                left[k] -= n * times
    # Best fit decreasing for the rest.
    open_: dict[int, list[Counter]] = defaultdict(list)
    bins: list[Counter] = []
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            at = next((c for c in range(k, room) if open_[c]), None)
            if at is None:
                b, at = Counter(), room
                bins.append(b)
            else:
                b = open_[at].pop()
            b[k] += 1
            open_[at - k].append(b)
    rest = Counter(tuple(sorted(b.items())) for b in bins)
    return out + [(dict(p), n) for p, n in sorted(rest.items())]


def places(found: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """class, first_rank, n_ranks, sequence, per_sequence."""
    next_rank: Counter = Counter()
    rows, sequence = [], 0
    for items, times in found:
        for k in sorted(items, reverse=True):
            rows.append((k, next_rank[k], items[k] * times, sequence, items[k]))
            next_rank[k] += items[k] * times
        sequence += times
    return rows


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """All pieces with sequence_id and offset. ``cut`` has doc_id, start and length."""
    spark = cut.sparkSession
    cut = stored(without(cut, "sequence_id", "offset"), "pieces")
    # Short classes are negative lengths, the others numbers of units.
    units = F.ceil(F.col("length") / UNIT)
    kind = F.when(F.col("length") <= EXACT, -F.col("length")).otherwise(units)
    classed = cut.withColumn("__class", kind.cast("int"))
    # At most ``EXACT + length / UNIT`` classes.
    counts = {r["__class"]: r["count"] for r in classed.groupBy("__class").count().collect()}
    room = length // UNIT
    full = counts.pop(room, 0)
    found = patterns({k: n for k, n in counts.items() if k > 0}, room)
    short = patterns({-k: n for k, n in counts.items() if k < 0}, length)
    found += [({-k: n for k, n in items.items()}, times) for items, times in short]
    rows = places(found + ([({room: 1}, full)] if full else []))
    where = spark.createDataFrame(
        rows, "__of long, first_rank long, n_ranks long, sequence long, per long"
    )
    salted = classed.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    order = ["doc_id", "start", "doc_tokens"]
    ranked = running_start(salted, ["__class"], "__salt", order, F.lit(1), "__rank")
    # As many rows as the patterns have classes: bounded, whatever the input.
    k = F.col("__rank") - F.col("first_rank")
    found = (
        ranked.join(
            F.broadcast(where),
            (F.col("__class") == F.col("__of"))
            & (F.col("__rank") >= F.col("first_rank"))
            & (F.col("__rank") < F.col("first_rank") + F.col("n_ranks")),
        )
        .withColumn("sequence_id", (F.col("sequence") + F.floor(k / F.col("per"))).cast("long"))
        .drop("__salt", *where.columns)
    )
    # A sequence has at most ``length`` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__class", "__rank")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    ).drop("__class", "__rank")
