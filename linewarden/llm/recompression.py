"""Remove repeated passages of documents, found by recompression of their words.

Words are symbols of level zero. A round names the runs of equal symbols, then the pairs of
neighbours whose first symbol falls into one half of all names and the second into the
other. A name is a hash of what it stands for, so it is the same in every task and round,
and what a round does at a place depends on the symbols next to it only. So the symbols in
the interior of equal passages are equal; ``levels`` keeps the words that each
boundary of symbols depends on. Every window takes as its anchor a boundary of the
highest level that all windows have (``LEVELS``), known from the words of the window alone;
the least name of ``NAMED`` words decides among several. Then

1. documents whose symbols all agree are copies: they merge into the first of them;
2. anchors are counted by name; a window whose anchor has a name of its own is unique;
3. windows at shared anchors are verified: a digest of 128 bits of their words meets its
   first place, and each word of a later place goes.

Places are numbered over the whole table: blocks of ``BLOCK`` words belong to one document,
blocks follow the order of documents, so a place is one long.

Defined results: a null text has no words; a null id comes before all others. Rows that
share an id are ordered by a hash of the text; equal rows are one place, neither
comes before the other, and they get equal results. A text shorter than a window stays
as it is; an empty table gives no rows. Extra columns are kept, those named like an added
one replaced.

Memory: a task holds about ``tokens.SLICE_BYTES`` of text, or one longer text. Hot names and
digests are added up before they are exchanged; the join on names is one that Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm import tokens
from linewarden.llm.common import ship_package, stored, without

WINDOW = 20
#: Words whose digest names an anchor.
NAMED = 6
#: Rounds whose boundaries every window of mixed words knows.
LEVELS = 2
#: Words of a block of places, a power of two.
BLOCK_BITS = 9
BLOCK = 1 << BLOCK_BITS
FAR = 1 << 40

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROT = np.uint64(0xBF58476D1CE4E5B9)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _ROT
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit digest of the ``width`` values from each place on, where so many follow."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    base = np.uint64(seed | 1)
    powers = np.full(width, base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    out = np.zeros(len(values) - width + 1, np.uint64)
    for k in range(width):
        out += values[k : k + len(out)] * powers[width - 1 - k]
    return _scramble(out)


class Level:
    """Boundaries of symbols: place, the words that decide it, and the symbols' names."""

    def __init__(self, at, low, high, name, edge):
        self.at, self.low, self.high, self.name, self.edge = at, low, high, name, edge

    def keep(self, stays: np.ndarray, name: np.ndarray) -> Level:
        """Next half of a round: a boundary rests on the symbols on both of its sides."""
        low = np.concatenate([[-FAR], self.low[:-1]])
        high = np.concatenate([self.high[1:], [FAR]])
        low[self.edge], high[self.edge] = -FAR, FAR
        return Level(self.at[stays], low[stays], high[stays], name, self.edge[stays])


def levels(names: np.ndarray, edge: np.ndarray, rounds: int) -> list[Level]:
    """Boundaries after each round over the words of documents that follow each other.

    ``edge`` marks the first word of a document; no symbol crosses it, and nothing that depends
    on it is known inside a window.
    """
    at = np.arange(len(names), dtype=np.int64)
    now = Level(at, at.copy(), at.copy(), names, edge)
    out = [now]
    for r in range(1, rounds + 1):
        # Runs.
        new = now.edge.copy()
        new[1:] |= now.name[1:] != now.name[:-1]
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(new))).astype(np.uint64)
        name = now.name[first]
        name = np.where(length > 1, _scramble(name + length * _MIX), name)
        now = now.keep(new, name)
        # Pairs.
        half = (_scramble(now.name ^ np.uint64(r)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(half), bool)
        joins[1:] = ~half[:-1] & half[1:] & ~now.edge[1:]
        first = np.flatnonzero(~joins)
        name = now.name[first]
        paired = np.append(joins[1:], False)[first]
        right = now.name[np.minimum(first + 1, len(half) - 1)]
        name = np.where(paired, _scramble(_scramble(name * _MIX) + right + np.uint64(r)), name)
        now = now.keep(~joins, name)
        out.append(now)
    return out


def _least(keys: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Index of the least key in each range [start, stop), the first if several; ranges not empty."""
    best = [np.arange(len(keys))]
    width = stop - start
    for k in range(1, int(width.max()).bit_length()):
        one, two = best[-1][: -(1 << (k - 1))], best[-1][1 << (k - 1) :]
        best.append(np.where(keys[two] < keys[one], two, one))
    out = np.empty(len(start), np.int64)
    log = np.frexp(width.astype(float))[1] - 1
    for k in np.unique(log):
        rows = np.flatnonzero(log == k)
        one, two = best[k][start[rows]], best[k][stop[rows] - (1 << k)]
        out[rows] = np.where(keys[two] < keys[one], two, one)
    return out


def anchors(names: np.ndarray, edge: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of the window at each of ``starts``, and the name at each place."""
    grams = rolling(names, NAMED, 0x2545F4914F6CDD1D)
    chosen = np.full(len(starts), -1, np.int64)
    open_ = np.arange(len(starts))
    for level in reversed(levels(names, edge, LEVELS)):
        if not len(open_):
            break
        usable = level.high - level.low <= WINDOW
        usable &= level.at + NAMED <= len(names)
        at, low, high = level.at[usable], level.low[usable], level.high[usable]
        # A window knows a boundary if it holds the words that decide it and those that name it.
        from_ = np.maximum(high, at + NAMED) - WINDOW
        s = starts[open_]
        start = np.searchsorted(low, s, "left")
        stop = np.searchsorted(from_, s, "right")
        some = start < stop
        if some.any():
            chosen[open_[some]] = at[_least(grams[at], start[some], stop[some])]
        open_ = open_[~some]
    return chosen, grams


def _parsed(texts: pa.Array):
    """Hashes of all words, document of each, first word of each document, and window starts."""
    firsts, lanes = tokens.hashed_words(texts)
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)
    edge = np.zeros(len(rows), bool)
    edge[firsts[:-1][counts > 0]] = True
    # The last words of a document start no window.
    drop = np.zeros(len(rows) + 1, np.int64)
    ends = firsts[1:]
    np.add.at(drop, np.maximum(ends - WINDOW + 1, firsts[:-1]), 1)
    np.add.at(drop, ends, -1)
    starts = np.flatnonzero(np.cumsum(drop)[: len(rows)] == 0)
    return lanes, rows, firsts, edge, starts


def _whole(lane: np.ndarray, firsts: np.ndarray, seed: int) -> np.ndarray:
    """Digest of all symbols of each document, its topmost symbol."""
    place = (np.arange(len(lane)) - np.repeat(firsts[:-1], np.diff(firsts))).astype(np.uint64)
    mixed = _scramble(lane * np.uint64(seed | 1) + _scramble(place + np.uint64(seed)))
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    return _scramble(sums[firsts[1:]] - sums[firsts[:-1]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


SYMBOLS = "ord long, hash long, n_words long, top long, next long, names array<long>, spots array<int>"


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: number of words, its topmost symbol, names and places of its anchors."""
    for batch in tokens.slices(batches, "text"):
        lanes, rows, firsts, edge, starts = _parsed(batch.column("text"))
        chosen, grams = anchors(lanes[0], edge, starts)
        taken = np.zeros(len(rows), bool)
        taken[chosen] = True
        spots = np.flatnonzero(taken)
        offsets = pa.array(np.searchsorted(spots, firsts).astype(np.int32))
        places = pa.array((spots - firsts[rows[spots]]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("ord"),
                batch.column("hash"),
                pa.array(np.diff(firsts)),
                _signed(_whole(lanes[0], firsts, 0xD1B54A32D192ED03)),
                _signed(_whole(lanes[1], firsts, 0x8CB92BA72F3D8DD7)),
                pa.ListArray.from_arrays(offsets, _signed(grams[spots])),
                pa.ListArray.from_arrays(offsets, places),
            ],
            names=["ord", "hash", "n_words", "top", "next", "names", "spots"],
        )


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and absolute place of entries of array<struct<block, within: array<smallint>>>."""
    rows, out = [], []
    for i, blocks in enumerate(lists.to_pylist()):
        for b in blocks or ():
            out.append(np.array(b["within"], np.int64) + (b["block"] << BLOCK_BITS))
            rows.append(np.full(len(out[-1]), i))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out)


def _candidates(batch: pa.RecordBatch, parsed) -> np.ndarray:
    """Starts of the windows whose anchor is among the shared places of their document."""
    lanes, _, firsts, edge, starts = parsed
    row, place = _flat(batch.column("shared"))
    marked = np.zeros(len(edge) + 1, bool)
    place = place + firsts[row]
    marked[place[place < firsts[row + 1]]] = True
    chosen, _ = anchors(lanes[0], edge, starts)
    return starts[marked[chosen]]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and place of every candidate window; of equal ones in a slice, the first."""
    for batch in tokens.slices(batches, "text"):
        parsed = _parsed(batch.column("text"))
        lanes, rows, firsts, _, _ = parsed
        starts = _candidates(batch, parsed)
        one = rolling(lanes[0], WINDOW, 0x369DEA0F31A53F85)[starts]
        two = rolling(lanes[1], WINDOW, 0xDB4F0B9175AE2165)[starts]
        base = batch.column("base").to_numpy(False)
        place = base[rows[starts]] + starts - firsts[rows[starts]]
        order = np.lexsort((place, two, one))
        one, two, place = one[order], two[order], place[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        yield pa.RecordBatch.from_arrays(
            [_signed(one[new]), _signed(two[new]), pa.array(place[new])],
            names=["one", "two", "place"],
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document without the words of its repeated windows."""
    for batch in tokens.slices(batches, "text"):
        parsed = _parsed(batch.column("text"))
        _, _, firsts, edge, _ = parsed
        later = np.zeros(len(edge) + 1, bool)
        later[_candidates(batch, parsed)] = True
        row, place = _flat(batch.column("earliest"))
        later[place + firsts[row]] = False
        change = np.zeros(len(edge) + WINDOW + 1, np.int64)
        at = np.flatnonzero(later)
        change[at] += 1
        change[at + WINDOW] -= 1
        gone = np.cumsum(change)[: len(edge)] > 0
        copy = batch.column("is_copy").to_numpy(False)
        gone |= np.repeat(copy, np.diff(firsts))
        texts = batch.column("text").to_pylist()
        kept, removed = [], []
        for i, text in enumerate(texts):
            drop = gone[firsts[i] : firsts[i + 1]]
            words = text.split()
            if drop.any():
                words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            kept.append(b" ".join(words))
            removed.append(int(drop.sum()))
        columns = {
            "n_words": pa.array(np.diff(firsts)),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        }
        yield pa.RecordBatch.from_pydict({"__row": batch.column("__row"), **columns})


def _blocks(places: DataFrame, out: str) -> DataFrame:
    """Places by block: each list has at most ``BLOCK`` entries."""
    within = F.col("place").bitwiseAND(BLOCK - 1).cast("smallint")
    return places.groupBy(F.shiftright("place", BLOCK_BITS).alias("block")).agg(
        F.collect_set(within).alias(out)
    )


def _by_document(places: DataFrame, firsts: DataFrame, out: str) -> DataFrame:
    """ord, hash, and the places of the document by its own blocks."""
    last = F.shiftright(F.col("base") + F.col("n_words") - 1, BLOCK_BITS)
    first = F.shiftright("base", BLOCK_BITS)
    owned = firsts.select(
        "ord", "hash", first.alias("first"), F.explode(F.sequence(first, last)).alias("block")
    )
    entry = F.struct((F.col("block") - F.col("first")).alias("block"), "within")
    return (
        owned.join(_blocks(places, "within"), "block")
        .groupBy("ord", "hash")
        .agg(F.collect_list(entry).alias(out))
    )


def numbered(symbols: DataFrame) -> DataFrame:
    """ord, hash, n_words, base: the place of the first word, in order of documents; is_copy."""
    docs = symbols.where(F.col("n_words") >= WINDOW).groupBy("ord", "hash").agg(
        F.max("n_words").alias("n_words"), F.max("top").alias("top"), F.max("next").alias("next")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            blocks = -(-batch.column("n_words").to_numpy(False) // BLOCK)
            ends = before + np.cumsum(blocks)
            yield batch.append_column("own", pa.array(ends - blocks)).append_column(
                "end", pa.array(ends)
            )
            before = int(ends[-1]) if len(ends) else before

    ordered = docs.repartitionByRange("ord", "hash").sortWithinPartitions("ord", "hash")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = "ord long, hash long, n_words long, top long, next long, part int, own long, end long"
    ordered = stored(ordered.mapInArrow(run, schema), "ordered", True)
    # One row per task.
    ends = ordered.groupBy("part").agg(F.max("end").alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.coalesce(F.sum("end").over(before), F.lit(0)).alias("before"))
    based = ordered.join(stored(ends, "ends"), "part")
    based = based.withColumn("base", F.shiftleft(F.col("before") + F.col("own"), BLOCK_BITS))
    least = based.groupBy("top", "next").agg(F.min("base").alias("least"))
    based = based.join(stored(least, "tops", True), ["top", "next"])
    return based.select(
        "ord", "hash", "n_words", "base", (F.col("base") > F.col("least")).alias("is_copy")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_removed and kept, the words that stay joined by one space."""
    ship_package(docs.sparkSession)
    docs = without(docs, "n_words", "n_removed", "kept")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select(place.alias("ord"), F.xxhash64("text").alias("hash"), text.alias("text"))
    symbols = stored(keyed.mapInArrow(_symbols, SYMBOLS), "symbols", True)
    known = stored(numbered(symbols), "numbered", True)
    firsts = known.where(~F.col("is_copy")).drop("is_copy")

    # Round over names: anchors of documents that copy no other.
    entry = F.explode(F.arrays_zip("names", "spots")).alias("e")
    named = symbols.join(firsts.select("ord", "hash", "base"), ["ord", "hash"])
    named = named.select("base", entry)
    named = named.select(
        F.col("e.names").alias("name"), (F.col("base") + F.col("e.spots")).alias("place")
    )
    # Exchanged twice rather than stored: the names are most of the data.
    often = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    shared = named.join(stored(often, "shared", True), "name").select("place")
    shared = stored(_by_document(shared, firsts, "shared"), "shared-places", True)

    # Verification: the first place of every candidate window.
    held = keyed.join(shared, ["ord", "hash"]).join(
        firsts.select("ord", "hash", "base"), ["ord", "hash"]
    )
    found = held.select("text", "base", "shared").mapInArrow(
        _windows, "one long, two long, place long"
    )
    earliest = found.groupBy("one", "two").agg(F.min("place").alias("place")).select("place")
    earliest = stored(_by_document(earliest, firsts, "earliest"), "earliest", True)

    marks = known.select("ord", "hash", "is_copy")
    marks = marks.join(shared, ["ord", "hash"], "left").join(earliest, ["ord", "hash"], "left")
    whole = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("__row"),
        place.alias("ord"),
        F.xxhash64("text").alias("hash"),
        text.alias("text"),
    ).join(marks, ["ord", "hash"], "left")
    whole = whole.select(
        "__row", "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "shared", "earliest"
    )
    row = whole.schema["__row"].dataType
    out = whole.mapInArrow(
        _cleaned,
        f"__row {row.simpleString()}, n_words long, n_removed long, kept binary",
    )
    kept = F.col("kept").cast("string")
    return out.select("__row.*", "n_words", "n_removed", kept.alias("kept"))


def digest(kept: str = "kept"):
    """Hexadecimal SHA-256 of the kept words; hashlib's, as Spark's."""
    return F.sha2(kept, 256)


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """doc_id, n_words, n_removed, kept_sha256 by a dictionary of all windows; for tests."""
    seen: dict[tuple, tuple] = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(texts, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), (i, s))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
