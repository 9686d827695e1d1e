import pytest
from pyspark.sql import functions as F

from strandlog.functions import numbers, text, times, values
from strandlog.operators import codes, frequencies, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


def test_strings(spark):
    for s, d, want in (("a,,b", ",", ["a", "", "b"]), ("", ",", [""]), ("abc", ",", ["abc"]), ("a.b", ".", ["a", "b"]), ("abc", "", ["abc"])):
        assert one(spark, text.split_all(lit(s), d)) == want
    assert tuple(one(spark, text.split_first(lit("a.b.c"), "."))) == ("a", "b.c")
    assert tuple(one(spark, text.split_last(lit("a.b.c"), "."))) == ("a.b", "c")
    assert tuple(one(spark, text.split_first(lit("abc"), "."))) == ("abc", "")
    assert tuple(one(spark, text.split_last(lit("abc"), "."))) == ("", "abc")
    assert one(spark, text.lower_ascii(lit("ÀBC"))) == "Àbc"
    assert one(spark, text.to_number(lit("x7"))) == 0


def test_times(spark):
    for us, want in ((0, "0s"), (1, "1us"), (-1500, "-1ms500us"), (90061001002, "1d1h1m1s1ms2us")):
        assert one(spark, times.timespan_text(lit(us).cast("long"))) == want
    assert one(spark, times.datetime_text(F.expr("timestamp_ntz'1970-01-01 00:00:00.000001'"))) == "1970-01-01T00:00:00.000001"
    assert one(spark, times.seconds(lit(1500), 1, 1000)) == 1.5
    assert one(spark, times.microseconds(lit(1500), 1, 1000)) == 1_500_000


def test_numbers(spark):
    for x, want in ((1, 1), (2, 2), (3, 4), (1024, 1024), (1025, 2048)):
        assert one(spark, numbers.pow2_ceil(lit(x).cast("long"))) == want
    for x, want in ((0, 1), (255, 1), (256, 2), (1 << 32, 5)):
        assert one(spark, numbers.least_bytes(lit(x).cast("long"))) == want
    assert one(spark, numbers.reversed_bits(lit(1).cast("long"))) == 128
    assert one(spark, numbers.aligned(lit(17), 16)) == 32
    assert one(spark, numbers.narrowed(lit(65535).cast("long"), 16)) == 65535
    with pytest.raises(Exception, match="does not fit"):
        one(spark, numbers.narrowed(lit(65536).cast("long"), 16))


def test_values(spark):
    assert one(spark, values.tuple_text(lit(1), lit(2))) == "(1, 2)"
    assert one(spark, values.record_text(a=lit(1), b=lit(2))) == "{ a=1, b=2 }"
    assert one(spark, values.enum_text(lit(0), ["A"])) == "|A|"
    assert one(spark, values.enum_text(lit(7), ["A"])) == "?value=7?"
    assert one(spark, values.unrolled(F.array(lit(1), lit(2)))) == "(1, (2, ()))"
    assert one(spark, F.struct(lit(1), lit(5)) < F.struct(lit(2), lit(0)))
    assert not one(spark, F.struct(lit(2), lit(0)) <= F.struct(lit(1), lit(9)))
    with pytest.raises(Exception, match="no case for c"):
        one(spark, values.case(values.variant(lit("c"), a=lit(1)), a=lambda x: x))


def log(spark, xs, name="x"):
    return spark.createDataFrame([(i + 1, 1, x) for i, x in enumerate(xs)], f"seq long, seg long, {name} " + ("string" if isinstance(xs[0], str) else "long"))


def test_sequences(spark):
    got = log(spark, [0, 0, 5, 5, 3]).select("seq", sequences.repeats("x").alias("r")).orderBy("seq").collect()
    assert [r.r for r in got] == [True, True, False, True, False]
    assert sequences.score(["seg"], log(spark, list("xxxy")), "x").first().score == 5
    assert sequences.score(["seg"], log(spark, list("xxx")), "x").first().score == sequences.MAX_SCORE
    t = 1_000_000_000_000_001
    q = sequences.quantised(log(spark, [t, t + 5, t + 8, t + 7], "ts_us")).orderBy("seq").collect()
    assert [(r.quantised - t, r.width) for r in q] == [(0, 9), (4, 2), (8, 2), (7, 9)]
    ranges = frequencies.ranges(log(spark, list("aaabcccc")), "x")
    assert [(r.x, r.low, r.high) for r in ranges.orderBy("x").collect()] == [("a", 0, 3), ("b", 3, 4), ("c", 4, 8)]
    probes = spark.createDataFrame([(3,), (7,)], "v long")
    assert {(r.v, r.x) for r in frequencies.find(ranges, probes, "x").collect()} == {(3, "b"), (7, "c")}
    rates = sequences.copy_rates(log(spark, [1] * 128 + [2, 1] * 64), "x", F.lit(1)).first()
    assert (rates.n, rates.n_same, rates.copies) == (256, 192, True)
    xs = [5, 7, 7, -2]
    coded = log(spark, xs).select("seg", "seq", sequences.delta("x").alias("d"))
    assert [r.x for r in coded.select("seq", sequences.undelta("d").alias("x")).orderBy("seq").collect()] == xs


def test_lzw():
    assert codes.encode([b"abababa"]) == [[97, 98, 256, 258, 0]]
    texts = [b"", b"a", b"aaaa", b"abcabcabc", b"abc", bytes(range(256))]
    assert codes.decode(codes.encode(texts)) == texts


def test_streamed_blocks(spark, tmp_path):
    from strandlog.streaming import tail

    spark.createDataFrame([(k, i) for k in "ab" for i in range(10 if k == "a" else 3)], "k string, i long").repartition(3).write.parquet(str(tmp_path / "in"))
    rows = tail.blocks(tail.stream(spark, str(tmp_path / "in")), "k", 4)
    q = rows.writeStream.format("memory").queryName("blocks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r.k, r.block) for r in spark.table("blocks").collect()) == [("a", 0), ("a", 1)]


def test_empty_log(spark):
    from strandlog.plans import eventlog

    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    rows = eventlog.from_events(empty)
    reg = eventlog.registry(rows)
    assert eventlog.segment_index(rows, reg).count() == 0
    assert sequences.quantised(rows).count() == 0


def test_dictionary_coding_is_by_blocks(spark):
    from strandlog.operators import codes

    strings = [None, "", *(f"key{i % 7}é{i}" for i in range(60))]
    log = spark.createDataFrame([(i % 2, i, s) for i, s in enumerate(strings)], "seg long, seq long, props string").repartition(3)
    for block in (codes.BLOCK, 50):
        got = {r.seq: (r.block, r.codes) for r in codes.lzw(log, "props", block).collect()}
        for seg in (0, 1):
            blocks, size = {}, 0
            for i in range(seg, len(strings), 2):
                blocks.setdefault(size // block, []).append(i)
                size += len((strings[i] or "").encode())
            for b, rows in blocks.items():
                coded = codes.encode((strings[i] or "").encode() for i in rows)
                assert [got[i] for i in rows] == [(b, ",".join(map(str, c))) for c in coded]
                assert [x.decode() for x in codes.decode(coded)] == [strings[i] or "" for i in rows]


def test_running_sums_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from strandlog.operators import frequencies, ranges

    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k", "id % 5 as n")
    got = {r.k: r.before for r in ranges.running(df.repartition(8), "k", F.col("n")).collect()}
    at = 0
    for k, n in sorted((r.k, r.n) for r in df.collect()):
        assert got[k] == at
        at += n
    table = frequencies.ranges(spark.range(500).selectExpr("if(id < 400, 0, id) as s"), "s")
    found = {r.v: r.s for r in frequencies.find(table, spark.range(500).withColumnRenamed("id", "v"), "s").collect()}
    assert found == {v: 0 if v < 400 else v for v in range(500)}


def test_spark_types_have_descriptions():
    from pyspark.sql import types as T

    from strandlog import types as ty

    schema = "a binary, b date, c decimal(9,2), d map<string, int>, e variant, f interval year to month, g array<struct<x: tinyint>>"
    assert ty.text(ty.from_spark(T._parse_datatype_string(schema)))
