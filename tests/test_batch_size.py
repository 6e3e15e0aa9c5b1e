"""What one file, one batch and one task of a stream may hold."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from linewarden.operators.tags import CONTEXT_FIELDS, REQUIRED_FIELDS
from linewarden.plans import fixtures
from linewarden.schema import StreamConfig
from linewarden.sources.streams import land
from linewarden.streaming import stateful
from linewarden.streaming.windows import WindowRun


def test_landed_files_are_small(spark, tmp_path):
    path = str(tmp_path / "landed")
    assert land(spark.range(600_000), "id", path) == 2
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "landed").glob("part-*")]
    assert sum(sizes) == 600_000 and max(sizes) <= 1 << 17


def test_filed_readings_lie_in_order_of_windows(spark, sf_dir, tmp_path):
    run = WindowRun(spark, str(tmp_path / "run"), StreamConfig(window_min=120, allowed_lateness_min=5))
    run.process(fixtures.readings(spark, sf_dir).orderBy(F.xxhash64("seq")), 0)
    for file in (tmp_path / "run/readings").rglob("part-*.parquet"):
        found = pq.read_table(file, partitioning=None)["assigned_window"].to_pylist()
        assert found == sorted(found, key=lambda w: (w is not None, w))


class _Handle:
    """The state of one key, kept in dicts."""

    def getMapState(self, *_):
        kept = {}
        return SimpleNamespace(iterator=lambda: iter(list(kept.items())), updateValue=kept.__setitem__)

    def getValueState(self, *_):
        kept = []
        return SimpleNamespace(
            exists=lambda: bool(kept), get=lambda: kept[-1], update=lambda v: kept.append(v)
        )


def _batch(rows):
    names = ["seq", "pos", "line_id", "field", "value", "source_us", "is_flush"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    columns = zip(names, kinds, zip(*rows, strict=True), strict=True)
    return pa.record_batch({n: pa.array(v, k) for n, k, v in columns})


def test_ranges_hold_no_more_than_a_step(spark, tmp_path):
    path = str(tmp_path / "landed")
    assert land(spark.range(1000), "id", path, per_step=90) == 1
    files = [pq.read_table(f)["id"].to_pylist() for f in (tmp_path / "landed").glob("part-*")]
    assert sorted(x for f in files for x in f) == list(range(1000))
    assert len(files) == 12 and max(map(len, files)) <= 90
    assert all(max(f) - min(f) < 90 for f in files)


def test_packed_changes_give_the_batches_of_a_loop(monkeypatch):
    monkeypatch.setattr(stateful, "PACK_ROWS", 50)
    monkeypatch.setattr(stateful, "GIVE_ROWS", 7)
    rng = random.Random(3)
    rows = []
    for i in range(900):
        line = rng.choice(["a", "b", None])
        if rng.random() < 0.05:
            rows.append((i // 2, i % 2, line, None, None, None, True))
            continue
        field = rng.choice([*CONTEXT_FIELDS, "batch_id", "batch_id", "other"])
        value = rng.choice([None, *(f"v{k}" for k in range(4))])
        us = rng.choice([None, rng.randrange(10**15, 2 * 10**15)])
        rows.append((i // 2, i % 2, line, field, value, us, False))
    wanted = []
    for line in ("a", "b", None):
        held, newest = {}, None
        for seq, _, own, field, value, us, flush in rows:
            if own != line:
                continue
            before = held.get("batch_id")
            if before is not None and (flush or (field == "batch_id" and value != before)):
                lacks = [f for f in REQUIRED_FIELDS if f not in held]
                fields = [held.get(f) for f in CONTEXT_FIELDS]
                wanted.append((seq, line, before, newest, *fields, flush, lacks))
            if not flush:
                held[field] = value
                newest = us if newest is None else newest if us is None else max(us, newest)
    got = []
    states = {}
    for part in (rows[:400], rows[400:]):
        mixed = rng.sample(part, len(part))
        packed = list(stateful._packed(_batch(mixed[k : k + 30]) for k in range(0, len(mixed), 30)))
        bodies = pd.concat([p.to_pandas() for p in packed])
        assert len(bodies) <= 3 * (len(part) // 50 + 1)
        for line in ("a", "b", None):
            if line not in states:
                states[line] = stateful.TagAssembly()
                states[line].init(_Handle())
            own = bodies[bodies["line_id"].isna() if line is None else bodies["line_id"] == line]
            for frame in states[line].handleInputRows((line,), iter([own]), None):
                assert len(frame) <= 7
                got += frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
