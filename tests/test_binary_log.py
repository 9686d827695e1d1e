import io
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlog import types as ty
from strandlog.sources import binary_log as b

LONG = ty.Prim("ulong", ty.Prim("long"))
SYMBOL = ty.Record((("id", LONG), ("symbol", ty.Array(ty.Prim("char")))))
QUOTE = ty.tup(LONG, ty.Record((("side", ty.enum("Buy", "Sell")), ("size", LONG), ("price", LONG))))
SERIES = [("symbols", SYMBOL), ("quotes", QUOTE)]


def quotes(n):
    for i, s in enumerate("aapl ibm msft ms gs tsla".split()):
        yield "symbols", 0, {"id": i, "symbol": s}
    for i in range(n):
        k = i % 6
        yield "quotes", 1_700_000_000_000_000 + 4 * i, [k, {"side": "Buy" if i % 4 == 0 else "Sell", "size": k * 100 + i % 16, "price": 1000 + k * 31337}]


def test_round_trip():
    events = list(quotes(1000))
    assert list(b.decode(io.BytesIO(b.encode(SERIES, events)), SERIES)) == events


@given(st.lists(st.integers(0, 1 << 62), max_size=30))
def test_times_are_within_a_microsecond(ts):
    raw = b.encode([("t", ty.UNIT)], [("t", t, None) for t in ts])
    got = [t for _, t, _ in b.decode(io.BytesIO(raw))]
    assert all(0 <= t - g <= 1 for t, g in zip(ts, got, strict=True))


def test_time_widths():
    out, last, got, widths = b.Out(), 0, [], []
    t = 1_000_000_000_000_001
    for ts in (t, t + 5, t + 8, t + 7):
        before = len(out.buffer)
        last = b.put_time(ts, last, out)
        got.append(last - t)
        widths.append(len(out.buffer) - before)
    assert (got, widths) == ([0, 4, 8, 7], [9, 2, 2, 9])


@pytest.mark.parametrize("d, x", [
    (ty.Prim("int128"), -(1 << 100)), (ty.Prim("double"), 0.1), (ty.FixedArray(ty.Prim("short"), ty.Nat(2)), [1, -2]), (ty.Array(ty.Prim("bool")), [True, False]),
    (ty.Variant((("a", ty.UNIT), ("b", ty.Prim("int")))), ["b", 7]), (ty.Prim("datetime", ty.Prim("long")), 5),
])
def test_values(d, x):
    raw = b.encode([("s", d)], [("s", 1, x)])
    assert next(iter(b.decode(io.BytesIO(raw))))[2] == x


def test_errors_and_ends():
    raw = b.encode(SERIES, list(quotes(3)))
    with pytest.raises(EOFError):
        list(b.decode(io.BytesIO(raw[:-1])))
    with pytest.raises(ValueError, match="no reader"):
        list(b.decode(io.BytesIO(raw), SERIES[:1]))
    with pytest.raises(ValueError, match="not an event log"):
        list(b.decode(io.BytesIO(b"PAR1PAR1")))
    assert list(b.decode(io.BytesIO(b.encode([], [])))) == []
    assert (b.kind(raw), b.kind(b"PAR1")) == ("plain", None)


def test_many_series_widen_their_numbers():
    series = [(f"s{i}", LONG) for i in range(300)]
    events = [(f"s{i}", 10 * i, i) for i in (0, 254, 255, 256, 299)]
    assert list(b.decode(io.BytesIO(b.encode(series, events)))) == events


def test_data_source(spark, tmp_path):
    (tmp_path / "one").write_bytes(b.encode(SERIES, list(quotes(50))))
    (tmp_path / "two").write_bytes(b.encode(SERIES, list(quotes(5))))
    spark.dataSource.register(b.BinaryLog)
    df = spark.read.format("binary_log").load(str(tmp_path))
    assert {(r.file, r["count"]) for r in df.groupBy("file").count().collect()} == {("one", 56), ("two", 11)}
    first = df.where("file = 'one' and seq = 7").first()
    assert (first.series, json.loads(first.value)) == ("quotes", [0, {"side": "Buy", "size": 0, "price": 1000}])


def test_sink_writes_segments(spark, tmp_path):
    """A file and an index line for each segment, a partition for each that is not skipped; a folder with files is refused."""
    rows = [(i // 10, i + 1, "symbols" if i == 25 else "quotes", 10**15 + 4 * i, json.dumps({"id": i, "symbol": "x"} if i == 25 else [i, {"side": "Buy", "size": i, "price": 7}])) for i in range(40)]
    df = spark.createDataFrame(rows, "seg long, seq long, series string, ts_us long, value string").repartition(3)
    path = b.save(df, SERIES, f"{tmp_path}/log")
    names = ["seg", "seq", "series", "ts_us", "value"]
    assert sorted(tuple(r) for r in b.load(spark, path).select(*names).collect()) == rows
    assert [tuple(r) for r in b.index(spark, path).orderBy("seg").collect()][2] == ("seg-000000000002", 2, 21, 10, ["quotes", "symbols"])
    for options, n, want in (({"series": "symbols"}, 1, rows[25:26]), ({"segments": "0,3"}, 2, rows[:10] + rows[30:]), ({"series": "none"}, 0, [])):
        part = b.load(spark, path, **options)
        assert part.rdd.getNumPartitions() <= max(1, n)
        assert sorted(tuple(r) for r in part.select(*names).collect()) == want
    assert b.defined(path, "seg-000000000000") == SERIES
    with pytest.raises(Exception, match="already has files"):
        b.save(df, SERIES, path)


def test_sink_of_no_and_one_event(spark, tmp_path):
    one = spark.createDataFrame([(0, 1, "quotes", 2, '[1, {"side": "Buy", "size": 1, "price": 1}]')], "seg long, seq long, series string, ts_us long, value string")
    assert b.load(spark, b.save(one.where("false"), SERIES, f"{tmp_path}/none")).count() == 0
    assert b.load(spark, b.save(one, SERIES, f"{tmp_path}/one")).first().ts_us == 2


def test_seventy_series(spark):
    from strandlog.plans import eventlog

    log = spark.createDataFrame([(i // 10, i + 1, f"s{i % 70}") for i in range(140)], "seg long, seq long, series string")
    reg = eventlog.registry(log)
    index = eventlog.segment_index(log, reg)
    for name in ("s0", "s62", "s63", "s69"):
        i = int(name[1:])
        assert sorted(r.seq for r in eventlog.pruned(log, index, reg, name).collect()) == [i + 1, i + 71]
    assert eventlog.pruned(log, index, reg, "none").count() == 0


def test_following_waits_for_more(spark, tmp_path):
    from strandlog.streaming import tail

    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/log")
    seen = []
    query = tail.follow(tail.stream(spark, f"{tmp_path}/log"), lambda batch, n: seen.append(batch.count()), f"{tmp_path}/state", wait="200 milliseconds")
    query.processAllAvailable()
    spark.range(7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 12
