"""Each operator as a query over the supplied tables, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as ty
from .functions import numbers, text, times, values
from .operators import frequencies, measures, sequences
from .operators.codes import lzw
from .plans import eventlog
from .plans.eventlog import within
from .sources import binary_log
from .streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The log of the events, as eventlog.from_events() has it.
_LOG = """WITH log AS (
  SELECT event_id, ts, user_id, event_type AS series, value, props, row_number() OVER (ORDER BY ts, event_id) AS seq,
    date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::BIGINT AS seg, epoch_us(ts) AS ts_us, CAST(floor(value * 100) AS BIGINT) AS cents
  FROM events),
reg AS (SELECT series, min(seq) AS first_seq, count(*) AS n_events, row_number() OVER (ORDER BY min(seq)) AS id FROM log GROUP BY series)"""
_W = "(PARTITION BY seg ORDER BY seq)"


def query(sql: str | None = None, log: bool = False):
    """Registers a function of (spark, sf_dir), or of (log, registry)."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not log:
                return f(spark, sf_dir)
            rows = _log(spark, sf_dir)
            return f(rows, eventlog.registry(rows))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = _LOG + sql if log else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.from_events(_table(spark, sf_dir, "events"))


def _r6(c: Column) -> Column:
    return F.round(c, 6)


#: What each series of the events holds.
EVENT = ty.Record((("user_id", ty.Prim("long")), ("cents", ty.Prim("long"))))


def _stored(log: DataFrame) -> str:
    """The folder of the log in its binary format, a file for each segment."""
    names = [r.series for r in log.select("series").distinct().orderBy("series").collect()]  # a row for each series
    rows = log.select("seg", "seq", "series", "ts_us", F.to_json(F.struct("user_id", "cents")).alias("value"))
    return binary_log.save(rows, [(n, EVENT) for n in names])


def _loaded(log: DataFrame, path: str, **options: str) -> DataFrame:
    return binary_log.typed(binary_log.load(log.sparkSession, path, **options), EVENT).select("seq", "seg", "series", "ts_us", "value.user_id", "value.cents")


# The log


@query(" SELECT seq, ts_us, user_id, cents FROM log WHERE series = 'purchase'", log=True)
def series_scan(log, reg):
    return log.where("series = 'purchase'").select("seq", "ts_us", "user_id", "cents")


@query(" SELECT seq, id AS series_id, log.series, ts_us, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' (' || log.series || '): ' || user_id AS line FROM log JOIN reg ON log.series = reg.series", log=True)
def event_replay(log, reg):
    line = F.concat(times.datetime_text(F.col("ts")), F.lit(" ("), F.col("series"), F.lit("): "), F.col("user_id").cast("string"))
    return eventlog.replay(log, reg).select("seq", "series_id", "series", "ts_us", "user_id", line.alias("line"))


@query(" SELECT id, series, first_seq, n_events FROM reg", log=True)
def series_registry(log, reg):
    return reg.select("id", "series", "first_seq", "n_events")


@query(
    """ SELECT n.name, reg.id, CASE WHEN reg.id IS NULL THEN 'no such series' WHEN reg.first_seq > 1 THEN 'not yet defined' ELSE 'defined' END AS status
    FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) AS n(name) LEFT JOIN reg ON n.name = reg.series""",
    log=True,
)
def series_lookup(log, reg):
    names = log.sparkSession.createDataFrame([(n,) for n in ("click", "error", "purchase", "refund", "signup", "view")], "name string")
    return eventlog.lookup(reg, names, at=1)


#: What the supplied tables are expected to be.
EXPECTED = {
    "region": "{r_regionkey:int, r_name:[char]}",
    "nation": "{n_nationkey:int, n_name:[char], n_regionkey:int}",
    "events": "{event_id:long, ts:datetime, user_id:long, event_type:[char], value:double, props:[char]}",
    "labels": "{doc_id:long, quality:int, toxic:int}",
    "supplier": "{s_suppkey:long, s_name:[char], s_nationkey:int, s_acctbal:float}",
}


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', '{t.replace('s_acctbal:float', 's_acctbal:double')}', {str(n != 'supplier').upper()})" for n, t in EXPECTED.items()) + ") AS v(series, expected, found, valid)"
)
def schema_validate(spark, sf_dir):
    found = {n: ty.text(ty.from_spark(_table(spark, sf_dir, n).schema)) for n in EXPECTED}
    return spark.createDataFrame([(n, t, found[n], found[n] == t) for n, t in EXPECTED.items()], "series string, expected string, found string, valid boolean")


@query(" SELECT seg, (id - 1) // 63 AS word, min(seq) AS first_seq, count(*) AS n_events, bit_or(1::BIGINT << ((id - 1) % 63)::INT)::BIGINT AS series_bits FROM log JOIN reg USING (series) GROUP BY seg, word", log=True)
def segment_index(log, reg):
    return eventlog.segment_index(log, reg)


@query(" SELECT seg, seq, user_id FROM log WHERE series = 'error'", log=True)
def segment_prune(log, reg):
    """Segments without the series are not opened: the index has left their partitions out."""
    return _loaded(log, _stored(log), series="error").select("seg", "seq", "user_id")


@query(" SELECT seq, series, user_id FROM log WHERE seg = (SELECT min(seg) + 2 FROM log)", log=True)
def segment_seek(log, reg):
    path = _stored(log)
    at = binary_log.index(log.sparkSession, path).agg(F.min("seg") + 2).first()[0]
    return _loaded(log, path, segments=str(at)).select("seq", "series", "user_id")


@query(" SELECT seg, count(*) AS n, sum(cents)::BIGINT AS cents, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY seg", log=True)
def segment_parallel_scan(log, reg):
    return log.groupBy("seg").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(" SELECT seq, bytes, (coalesce(sum(bytes) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536)::BIGINT AS segment FROM (SELECT seq, 20 + strlen(props) AS bytes FROM log)", log=True)
def segment_assign(log, reg):
    return eventlog.rollover(log, F.octet_length("props") + 20, 65536)


@query(
    """ SELECT first_seq AS seq, 0 AS command, series AS name FROM reg
    UNION ALL SELECT min(seq), 1, NULL FROM log GROUP BY seg HAVING min(seq) > 1 UNION ALL SELECT max(seq) + 1, 2, NULL FROM log""",
    log=True,
)
def control_commands(log, reg):
    return eventlog.control(log)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN c < 65536 THEN c END AS short_value, c AS long_value FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS c FROM lineitem)")
def checked_narrow(spark, sf_dir):
    c = F.floor("l_extendedprice").cast("long")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.try_narrowed(c, 16).alias("short_value"), numbers.narrowed(c, 32).alias("long_value"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n FROM embeddings")
def array_len_guard(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(numbers.guarded(F.col("embedding"))).cast("long").alias("n"))


@query("SELECT event_type AS series, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def tail_available_now(spark, sf_dir):
    return tail.counted(spark, f"{sf_dir}/events.parquet")


# Dictionaries and times


@query(" SELECT seq, series, reg.id AS symbol, seq = reg.first_seq AS is_new FROM log JOIN reg USING (series)", log=True)
def symbol_intern(log, reg):
    return sequences.interned(log, "series", []).select("seq", "series", "symbol", "is_new")


@query(
    """, f AS (SELECT seg, series, min(seq) AS first, row_number() OVER (PARTITION BY seg ORDER BY min(seq)) AS symbol FROM log GROUP BY seg, series)
    SELECT seq, series, symbol, seq = first AS is_new FROM log JOIN f USING (seg, series)""",
    log=True,
)
def symbol_intern_by_segment(log, reg):
    return sequences.interned(log, "series", ["seg"]).select("seq", "series", "symbol", "is_new")


@query(f" SELECT seq, ts_us - lag(ts_us, 1, 0) OVER {_W} AS delta FROM log", log=True)
def ts_delta(log, reg):
    return log.select("seq", sequences.delta("ts_us").alias("delta"))


@query(" SELECT seq, ts_us AS decoded FROM log", log=True)
def ts_delta_decode(log, reg):
    coded = log.select("seg", "seq", sequences.delta("ts_us").alias("delta"))
    return coded.select("seq", sequences.undelta("delta").alias("decoded"))


_V2 = f""", p AS (SELECT *, lag(ts_us) OVER {_W} AS prev FROM log),
a AS (SELECT *, last_value(CASE WHEN prev IS NULL OR ts_us < prev OR ts_us - prev >= 2147483648 THEN ts_us END IGNORE NULLS) OVER (PARTITION BY seg ORDER BY seq ROWS UNBOUNDED PRECEDING) AS anchor FROM p),
q AS (SELECT *, ts_us - ((ts_us - anchor) & 1) AS quantised, prev IS NULL OR ts_us < prev OR ts_us - prev >= 2147483648 AS new FROM a)"""


@query(_V2 + " SELECT seq, quantised FROM q", log=True)
def ts_v2_quantize(log, reg):
    return sequences.quantised(log).select("seq", "quantised")


@query(_V2 + f" SELECT seq, CASE WHEN new THEN 9 WHEN half < 16384 THEN 2 WHEN half < 4194304 THEN 3 ELSE 4 END AS width FROM (SELECT seq, new, (quantised - lag(quantised) OVER {_W}) >> 1 AS half FROM q)", log=True)
def ts_v2_width(log, reg):
    return sequences.quantised(log).select("seq", "width")


@query(_V2 + " SELECT seq, seg, series, quantised AS ts_us, user_id, cents FROM q", log=True)
def sink_roundtrip(log, reg):
    """Through the binary log, whose times have steps of two microseconds."""
    return _loaded(log, _stored(log))


@query(" SELECT 'plain' AS format, count(DISTINCT seg) AS files FROM log UNION ALL VALUES ('plain, version 1', 1), ('segmented', 1), (NULL, 2)", log=True)
def format_sniff(log, reg):
    """Of the log's files, its index and three others."""
    path = binary_log.with_other_formats(_stored(log))
    return binary_log.sniffed(log.sparkSession, path).groupBy("format").agg(F.count("*").alias("files"))


@query(" SELECT seg, user_id, cents FROM log WHERE series = 'purchase'", log=True)
def series_dynamic(log, reg):
    """A series read, and written again, by the description that its log holds alone."""
    spark, path = log.sparkSession, _stored(log)
    found = binary_log.defined(path, binary_log.index(spark, path).first()["file"])
    again = binary_log.save(binary_log.load(spark, path, series="purchase"), found)
    return binary_log.typed(binary_log.load(spark, again), dict(found)["purchase"]).select("seg", "value.user_id", "value.cents")


QUOTE = ty.tup(ty.Prim("long"), ty.Record((("side", ty.enum("Buy", "Sell")), ("size", ty.Prim("long")), ("price", ty.Prim("long")))))
QUOTES = 1_000_000  # the workload's own size


@query(
    f"""SELECT i % 6 AS symbol, CASE WHEN i % 4 = 0 THEN 'Buy' ELSE 'Sell' END AS side, count(*) AS n, sum(i % 6 * 100 + i % 16)::BIGINT AS size, sum(1000 + i % 6 * 31337)::BIGINT AS price
    FROM range({QUOTES}) AS r(i) GROUP BY 1, 2"""
)
def quotes_replay(spark, sf_dir):
    """Writes a million quotes to a log and replays them."""
    k = F.col("id") % 6
    quote = F.struct(F.when(F.col("id") % 4 == 0, "Buy").otherwise("Sell").alias("side"), (k * 100 + F.col("id") % 16).alias("size"), (1000 + k * 31337).alias("price"))
    value = F.concat(F.lit("["), k.cast("string"), F.lit(","), F.to_json(quote), F.lit("]"))
    rows = spark.range(QUOTES).select((F.col("id") / 50_000).cast("long").alias("seg"), (F.col("id") + 1).alias("seq"), F.lit("quotes").alias("series"), (1_700_000_000_000_000 + 4 * F.col("id")).alias("ts_us"), value.alias("value"))
    read = binary_log.load(spark, binary_log.save(rows, [("quotes", QUOTE)]))
    schema = "struct<side: string, size: long, price: long>"
    read = read.select(F.get_json_object("value", "$[0]").cast("long").alias("symbol"), F.from_json(F.get_json_object("value", "$[1]"), schema).alias("q"))
    return read.groupBy("symbol", "q.side").agg(F.count("*").alias("n"), F.sum("q.size").alias("size"), F.sum("q.price").alias("price"))


@query(f" SELECT seq, user_id = lag(user_id, 1, 0) OVER {_W} AS repeated FROM log", log=True)
def identifier_repeat(log, reg):
    return log.select("seq", sequences.repeats("user_id").alias("repeated"))


@query(", n AS (SELECT * FROM log JOIN reg USING (series)) SELECT seq, " + " || ',' || ".join(f"lag(id, {i}, 0) OVER {_W}" for i in range(1, 6)) + " AS last FROM n", log=True)
def lookback_k(log, reg):
    return eventlog.with_id(log, reg).select("seq", F.array_join(sequences.lookback("series_id").cast("array<string>"), ",").alias("last"))


@query(f" SELECT prev, next, count(*) AS n FROM (SELECT lag(series) OVER {_W} AS prev, series AS next FROM log) WHERE prev IS NOT NULL GROUP BY prev, next", log=True)
def event_transition(log, reg):
    return sequences.transitions(log, "series")


@query(
    " SELECT DISTINCT seg, prev, next FROM (" + " UNION ALL ".join(f"SELECT seg, lag(series, {i}) OVER {_W} AS prev, series AS next FROM log" for i in range(1, 6)) + ") WHERE prev IS NOT NULL",
    log=True,
)
def predecessor_links(log, reg):
    return sequences.predecessors(log, "series")


# Frequencies

_RANGES = ", r AS (SELECT series, n, (sum(n) OVER (ORDER BY series))::BIGINT AS high FROM (SELECT series, count(*) AS n FROM log GROUP BY series))"


@query(_RANGES + " SELECT series, n, high - n AS low, high FROM r", log=True)
def cumfreq_range(log, reg):
    return frequencies.ranges(log, "series").select("series", "n", "low", "high")


@query(_RANGES + ", v AS (SELECT i * (SELECT count(*) FROM log) // 100 AS v FROM range(100) AS x(i)) SELECT v::BIGINT AS v, series FROM v JOIN r ON v >= high - n AND v < high", log=True)
def cumfreq_find(log, reg):
    total = log.agg(F.count("*").alias("n"))
    probes = log.sparkSession.range(100).crossJoin(F.broadcast(total)).select(F.expr("id * n div 100").alias("v"))  # one row
    return frequencies.find(frequencies.ranges(log, "series"), probes, "series")


@query("SELECT p_brand, n, greatest(1, n * 16383 // sum(n) OVER ())::BIGINT AS scaled FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def freq_normalize(spark, sf_dir):
    return frequencies.normalised(_table(spark, sf_dir, "part"), "p_brand")


@query(" SELECT seq, row_number() OVER (PARTITION BY seg, series ORDER BY seq) - 1 AS symbol_before, row_number() OVER (PARTITION BY seg ORDER BY seq) - 1 AS all_before FROM log", log=True)
def symbol_freq_running(log, reg):
    counts = [(F.row_number().over(within(*by)) - 1).cast("long").alias(n) for n, by in (("symbol_before", ["series"]), ("all_before", []))]
    return log.select("seq", *counts)


@query(
    " SELECT seq, round((1 + coalesce(sum((cents > 5000)::BIGINT) OVER (PARTITION BY seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (1 + row_number() OVER (PARTITION BY seg ORDER BY seq)), 6) AS p FROM log",
    log=True,
)
def bool_adaptive_p(log, reg):
    return log.select("seq", _r6(frequencies.adaptive(F.col("cents") > 5000)).alias("p"))


@query("SELECT i::INT AS byte_no, (l_partkey >> (8 * i)::INT) & 255 AS byte, count(*) AS n FROM lineitem, range(4) AS r(i) GROUP BY 1, 2")
def byte_histogram(spark, sf_dir):
    return frequencies.byte_histogram(_table(spark, sf_dir, "lineitem"), "l_partkey", 4)


_MAX = str(sequences.MAX_SCORE)


def _score_sql(rows: str, groups: str, value: str) -> str:
    return f"SELECT {groups}, CASE WHEN count(*) <= 1 THEN {_MAX} ELSE (sum(f * f) // count(*))::BIGINT END AS score FROM (SELECT {groups}, {value}, count(*) AS f FROM {rows} GROUP BY {groups}, {value}) GROUP BY {groups}"


@query(_score_sql("(SELECT l_returnflag, i::INT AS byte_no, (l_partkey >> (8 * i)::INT) & 255 AS byte FROM lineitem, range(4) AS r(i))", "l_returnflag, byte_no", "byte"))
def byte_score(spark, sf_dir):
    each = F.array(*(F.struct(F.lit(i).alias("byte_no"), F.shiftright("l_partkey", 8 * i).bitwiseAND(255).alias("byte")) for i in range(4)))
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.explode(each).alias("b")).select("l_returnflag", "b.*")
    return sequences.score(["l_returnflag", "byte_no"], rows, "byte")


@query(", f AS (SELECT seg, series, count(*) AS f FROM log GROUP BY seg, series) SELECT seg, sum(f)::BIGINT AS n, round(sum(f) * log2(sum(f)) - sum(f * log2(f)), 6) AS bits FROM f GROUP BY seg", log=True)
def ideal_code_bits(log, reg):
    return frequencies.code_bits(log, ["seg"], "series").withColumn("bits", _r6(F.col("bits")))


@query(
    """, a AS (SELECT sum(f) AS n, (sum(f) * log2(sum(f)) - sum(f * log2(f))) / sum(f) AS h FROM (SELECT count(*) AS f FROM log GROUP BY series)),
    b AS (SELECT sum(n * log2(n) - s) / sum(n) AS h FROM (SELECT user_id, sum(f) AS n, sum(f * log2(f)) AS s FROM (SELECT user_id, count(*) AS f FROM log GROUP BY user_id, series) GROUP BY user_id))
    SELECT a.n::BIGINT AS n, round(a.h, 6) AS h, round(b.h, 6) AS h_given FROM a, b""",
    log=True,
)
def conditional_entropy(log, reg):
    return frequencies.entropies(log, "series", "user_id").select("n", _r6(F.col("h")).alias("h"), _r6(F.col("h_given")).alias("h_given"))


# Model choice


@query(", s AS (" + _score_sql("log", "seg", "series") + ") SELECT * FROM s", log=True)
def sequence_score(log, reg):
    return sequences.score(["seg"], log, "series")


@query("SELECT l_partkey, n, row_number() OVER (ORDER BY n DESC, l_partkey) AS code FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) QUALIFY code <= 255")
def value_intern(spark, sf_dir):
    return frequencies.interned(_table(spark, sf_dir, "lineitem"), "l_partkey")


@query(f" SELECT seq, cents - lag(cents, 1, 0) OVER {_W} AS delta FROM log", log=True)
def value_delta(log, reg):
    return log.select("seq", sequences.delta("cents").alias("delta"))


_MODELS = {"intern": "cents", "diff": "diff"} | {f"b{i}": f"((cents >> {8 * i}) & 255)" for i in range(4)}
_ONE = {n: f"CASE WHEN d_{n} <= 1 THEN {_MAX} ELSE (s_{n} // d_{n})::BIGINT END" for n in _MODELS}


@query(
    f""", x AS (SELECT *, cents - lag(cents, 1, 0) OVER {_W} AS diff, (row_number() OVER {_W} - 1) // 256 AS block FROM log),
    k AS (SELECT seg, seq, block, {", ".join(f"row_number() OVER (PARTITION BY seg, {e} ORDER BY seq) AS k_{n}" for n, e in _MODELS.items())} FROM x),
    c AS (SELECT seg, block, {", ".join(f"sum(2 * k_{n} - 1) OVER {_W} AS s_{n}, sum((k_{n} = 1)::INT) OVER {_W} AS d_{n}" for n in _MODELS)} FROM k),
    e AS (SELECT seg, block, {", ".join(f"max(s_{n}) AS s_{n}, max(d_{n}) AS d_{n}" for n in _MODELS)} FROM c GROUP BY seg, block),
    z AS (SELECT seg, block, CASE WHEN least({", ".join(f"d_b{i}" for i in range(4))}) <= 1 THEN {_MAX} ELSE {" + ".join(f"(s_b{i} // d_b{i})::BIGINT" for i in range(4))} END AS bytes_score,
      {_ONE["intern"]} AS intern_score, {_ONE["diff"]} AS diff_score FROM e)
    SELECT *, CASE WHEN bytes_score >= greatest(intern_score, diff_score) THEN 'bytes' WHEN intern_score >= diff_score THEN 'intern' ELSE 'diff' END AS chosen FROM z""",
    log=True,
)
def model_select(log, reg):
    return sequences.model_scores(log, "cents")


@query(
    f""", x AS (SELECT seg, (row_number() OVER {_W} - 1) // 256 AS block, series = lag(series) OVER {_W} AS same FROM log)
    SELECT seg, block, count(*) AS n, count(*) FILTER (same) AS n_same, 2 * count(*) FILTER (same) >= count(*) AS copies FROM x GROUP BY seg, block""",
    log=True,
)
def pred_copy_rate(log, reg):
    return sequences.copy_rates(log, "series", F.lag("series").over(within()))


@query(
    f""", x AS (SELECT seg, (row_number() OVER {_W} - 1) // 256 AS block, abs(user_id - lag(user_id, 1, 0) OVER {_W}) AS d1, abs(user_id - lag(user_id, 2, 0) OVER {_W}) AS d2 FROM log)
    SELECT seg, block, sum(d1)::BIGINT AS sum_1, sum(d2)::BIGINT AS sum_2, CASE WHEN sum(d1) <= sum(d2) THEN 1 ELSE 2 END::BIGINT AS best FROM x GROUP BY seg, block""",
    log=True,
)
def pred_diff_sum(log, reg):
    return sequences.difference_sums(log, "user_id")


_FIELDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = {b}) AS n_same, sum(abs({a} - {b}))::BIGINT AS sum_diff FROM lineitem" for i, b in enumerate(_FIELDS) for a in _FIELDS[:i]))
def field_correlation(spark, sf_dir):
    return sequences.field_pairs(_table(spark, sf_dir, "lineitem"), _FIELDS)


# Values

_PAIR = "SELECT seq, {} AS {} FROM (SELECT seq, series AS a, user_id AS b, lag(series) OVER (PARTITION BY seg ORDER BY seq) AS c, lag(user_id) OVER (PARTITION BY seg ORDER BY seq) AS d FROM log) WHERE c IS NOT NULL"


def _pairs(log: DataFrame) -> DataFrame:
    now = F.struct(F.col("series"), F.col("user_id"))
    return log.select("seq", now.alias("x"), F.lag(now).over(within()).alias("y")).where("y is not null")


@query(" " + _PAIR.format("a = c AND b = d", "eq"), log=True)
def struct_eq(log, reg):
    return _pairs(log).select("seq", (F.col("x") == F.col("y")).alias("eq"))


@query(" " + _PAIR.format("a < c OR a = c AND b < d", "lt"), log=True)
def struct_lt(log, reg):
    return _pairs(log).select("seq", (F.col("x") < F.col("y")).alias("lt"))


@query(" " + _PAIR.format("a < c OR a = c AND b <= d", "lte"), log=True)
def struct_lte(log, reg):
    return _pairs(log).select("seq", (F.col("x") <= F.col("y")).alias("lte"))


@query(
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(l_quantity {o} (l_tax + 1), 6) AS {n}_a, round(l_extendedprice {o} (l_discount + 1), 6) AS {n}_b" for n, o in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/"))) + " FROM lineitem"
)
def struct_arith(spark, sf_dir):
    a, b = [F.col("l_quantity"), F.col("l_extendedprice")], [F.col("l_tax") + 1, F.col("l_discount") + 1]
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(values.arith(o, a, b, ["a", "b"]).alias(n) for n, o in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/"))))
    return rows.select("l_orderkey", "l_linenumber", *(_r6(F.col(f"{n}.{f}")).alias(f"{n}_{f}") for n in ("add", "sub", "mul", "div") for f in "ab"))


@query("SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity) GROUP BY n")
def struct_hash_groups(spark, sf_dir):
    key = F.xxhash64(F.struct("l_returnflag", "l_linestatus", "l_quantity"))
    return _table(spark, sf_dir, "lineitem").groupBy(key.alias("h")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


@query(" SELECT seq, '{ series=|' || series || '|, user=(' || user_id || ', ' || seg || ') }' AS shown, '|' || series || '=' || cents || '|' AS tagged FROM log", log=True)
def value_show(log, reg):
    shown = values.record_text(series=F.concat(F.lit("|"), F.col("series"), F.lit("|")), user=values.tuple_text(F.col("user_id"), F.col("seg")))
    return log.select("seq", shown.alias("shown"), values.variant_text(F.col("series"), F.col("cents")).alias("tagged"))


#: An enum without one of the constructors that occur, and the explicit values of its ordinals.
KINDS, KIND_VALUES = ["click", "view", "purchase", "signup"], [10, 20, 40, 80]
_ORDINAL = "CASE series WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END"


@query(f" SELECT seq, ({_ORDINAL})::BIGINT AS ordinal FROM log", log=True)
def enum_ordinal(log, reg):
    return log.select("seq", values.ordinal(F.col("series"), KINDS).cast("long").alias("ordinal"))


@query(f" SELECT seq, (CASE {_ORDINAL} WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 40 WHEN 3 THEN 80 ELSE 0 END)::BIGINT AS value FROM log", log=True)
def enum_value_map(log, reg):
    return log.select("seq", values.enum_value(values.ordinal(F.col("series"), KINDS), KIND_VALUES).alias("value"))


@query(" SELECT seq, CASE user_id % 6 WHEN 0 THEN '|click|' WHEN 1 THEN '|view|' WHEN 2 THEN '|purchase|' WHEN 3 THEN '|signup|' ELSE '?value=' || user_id % 6 || '?' END AS shown FROM log", log=True)
def enum_show(log, reg):
    return log.select("seq", values.enum_text(F.col("user_id") % 6, KINDS).alias("shown"))


@query(" SELECT seq, CASE series WHEN 'purchase' THEN cents WHEN 'error' THEN -user_id ELSE 0 END AS result FROM log", log=True)
def variant_case(log, reg):
    tag = F.when(F.col("series").isin("purchase", "error"), F.col("series")).otherwise("other")
    union = values.variant(tag, purchase=F.col("cents"), error=F.col("user_id"), other=F.lit(0).cast("long"))
    rows = log.select("seq", union.alias("u"))
    return rows.select("seq", values.case(F.col("u"), purchase=lambda x: x, error=lambda x: -x, other=lambda x: x).alias("result"))


@query(" SELECT seq, CASE WHEN series = 'purchase' THEN cents END AS amount, series = 'purchase' AS is_some FROM log", log=True)
def optional_some(log, reg):
    amount = values.some(F.col("series") == "purchase", F.col("cents"))
    return log.select("seq", amount.alias("amount"), amount.isNotNull().alias("is_some"))


@query("SELECT p_partkey, p_name[:8] AS name FROM part")
def bounded_string(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.bounded(F.col("p_name"), 8).alias("name"))


@query("SELECT l_orderkey, string_agg('(' || l_linenumber || ', ', '' ORDER BY l_linenumber) || '()' || repeat(')', count(*)::INT) AS list FROM lineitem GROUP BY l_orderkey")
def recursive_unroll(spark, sf_dir):
    items = F.sort_array(F.collect_list("l_linenumber"))  # of one order
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items")).select("l_orderkey", values.unrolled(F.col("items")).alias("list"))


# Scalars


@query(" SELECT seq, user_id::VARCHAR AS shown, user_id AS parsed, 0::BIGINT AS failed FROM log", log=True)
def str_from_to(log, reg):
    shown = F.col("user_id").cast("string")
    return log.select("seq", shown.alias("shown"), text.to_number(shown).alias("parsed"), text.to_number(F.col("series")).alias("failed"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower FROM documents")
def str_lcase_ascii(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.lower_ascii(F.col("text")).alias("lower"))


@query("SELECT doc_id, len(string_split(text, '. '))::BIGINT AS n, string_split(text, '. ')[1] AS first FROM documents")
def str_csplit(spark, sf_dir):
    parts = text.split_all(F.col("text"), ". ")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.get(parts, F.lit(0)).alias("first"))


@query("SELECT p_partkey, CASE WHEN p > 0 THEN s[:p - 1] ELSE s END AS l, CASE WHEN p > 0 THEN s[p + 1:] ELSE '' END AS r FROM (SELECT p_partkey, p_type AS s, instr(p_type, ' ') AS p FROM part)")
def str_lsplit(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.split_first(F.col("p_type"), " ").alias("s")).select("p_partkey", F.col("s.left").alias("l"), F.col("s.right").alias("r"))


@query("SELECT p_partkey, CASE WHEN instr(s, ' ') > 0 THEN s[:length(s) - length(string_split(s, ' ')[-1]) - 1] ELSE '' END AS l, string_split(s, ' ')[-1] AS r FROM (SELECT p_partkey, p_type AS s FROM part)")
def str_rsplit(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.split_last(F.col("p_type"), " ").alias("s")).select("p_partkey", F.col("s.left").alias("l"), F.col("s.right").alias("r"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def str_cdelim(spark, sf_dir):
    return _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.joined(F.sort_array(F.collect_list("n_name")), "; ").alias("names"))


@query(
    "SELECT lpad(n_nationkey::VARCHAR, greatest(11, max(length(n_nationkey::VARCHAR)) OVER ())::INT, ' ') || ' ' || lpad(n_name, greatest(6, max(length(n_name)) OVER ())::INT, ' ') || ' ' || n_regionkey AS line FROM nation"
)
def table_render(spark, sf_dir):
    return text.rendered(_table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"]).select("line")


_NUM = "SELECT l_orderkey, l_linenumber, {} AS {} FROM lineitem"


def _num(spark: SparkSession, sf_dir: str, c: Column, name: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias(name))


@query(_NUM.format("((l_partkey + 15) // 16 * 16)::BIGINT", "aligned"))
def num_align(spark, sf_dir):
    return _num(spark, sf_dir, numbers.aligned(F.col("l_partkey"), 16), "aligned")


@query(_NUM.format("CASE WHEN l_partkey <= 1 THEN 1 ELSE 1::BIGINT << length(bin(l_partkey - 1))::INT END", "power"))
def num_pow2ceil(spark, sf_dir):
    return _num(spark, sf_dir, numbers.pow2_ceil(F.col("l_partkey")), "power")


@query(_NUM.format("CASE WHEN c < 256 THEN 1 WHEN c < 65536 THEN 2 WHEN c < 16777216 THEN 3 ELSE 4 END::BIGINT", "bytes").replace("FROM lineitem", "FROM (SELECT *, floor(l_extendedprice)::BIGINT AS c FROM lineitem)"))
def num_least_bytes(spark, sf_dir):
    return _num(spark, sf_dir, numbers.least_bytes(F.floor("l_extendedprice").cast("long")), "bytes")


@query(_NUM.format("(" + " + ".join(f"((l_partkey >> {i}) & 1) * {1 << (7 - i)}" for i in range(8)) + ")::BIGINT", "reversed"))
def num_reverse_bits(spark, sf_dir):
    return _num(spark, sf_dir, numbers.reversed_bits(F.col("l_partkey")), "reversed")


@query(" SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS shown FROM log", log=True)
def datetime_format(log, reg):
    return log.select("seq", times.datetime_text(F.col("ts")).alias("shown"))


_SPAN = " || ".join(f"CASE WHEN d {f'% {times.PARTS[i - 1][1]} ' if i else ''}// {s} > 0 THEN (d {f'% {times.PARTS[i - 1][1]} ' if i else ''}// {s})::VARCHAR || '{n}' ELSE '' END" for i, (n, s) in enumerate(times.PARTS))


@query(f" SELECT seq, CASE WHEN x = 0 THEN '0s' ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || {_SPAN} END AS shown FROM (SELECT seq, x, abs(x) AS d FROM (SELECT seq, (ts_us - lag(ts_us, 1, ts_us) OVER {_W}) * (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) AS x FROM log))", log=True)
def timespan_format(log, reg):
    gap = (F.col("ts_us") - F.lag("ts_us").over(within())) * F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    return log.select("seq", times.timespan_text(F.coalesce(gap, F.lit(0).cast("long"))).alias("shown"))


@query(" SELECT seq, cents::DOUBLE * 1 / 1000 AS seconds FROM log", log=True)
def duration_seconds(log, reg):
    return log.select("seq", times.seconds(F.col("cents"), 1, 1000).alias("seconds"))


@query(" SELECT seq, (cents * 1000000 // 60)::BIGINT AS micros FROM log WHERE cents >= 0", log=True)
def duration_micros(log, reg):
    return log.where("cents >= 0").select("seq", times.microseconds(F.col("cents"), 1, 60).alias("micros"))


# Schemas

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _described(spark: SparkSession, sf_dir: str, f: Callable[[ty.Desc], tuple], schema: str) -> DataFrame:
    rows = [(n, *f(ty.from_spark(_table(spark, sf_dir, n).schema))) for n in _TABLES]
    return spark.createDataFrame(rows, f"name string, {schema}")


def _columns_sql(time: str, name: str) -> str:
    kinds = {"INTEGER": "int", "BIGINT": "long", "DOUBLE": "double", "VARCHAR": "[char]", "FLOAT[]": "[float]", "TIMESTAMP": time}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items())
    tables = ", ".join(f"'{t}'" for t in _TABLES)
    return f"SELECT table_name AS name, '{{' || string_agg(column_name || ':' || CASE data_type {cases} END, ', ' ORDER BY ordinal_position) || '}}' AS {name} FROM information_schema.columns WHERE table_name IN ({tables}) GROUP BY table_name"


@query(_columns_sql("datetime", "description"))
def schema_describe(spark, sf_dir):
    return _described(spark, sf_dir, lambda d: (ty.text(d),), "description string")


@query()
def schema_fingerprint(spark, sf_dir):
    return _described(spark, sf_dir, lambda d: (ty.fingerprint(d), ty.decode(ty.encode(d)) == d), "fingerprint string, round_trip boolean")


@query(_columns_sql("long", "representation"))
def schema_normalize(spark, sf_dir):
    return _described(spark, sf_dir, lambda d: (ty.text(ty.representation(d)),), "representation string")


_ENDS = "list_reduce([0] || {}, lambda e, x: (e + x - 1) // x * x + x)"


@query(
    f"""WITH c AS (
      SELECT table_name AS name, list(column_name ORDER BY ordinal_position) AS n, list(CASE data_type WHEN 'INTEGER' THEN 4 ELSE 8 END ORDER BY ordinal_position) AS s
      FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in _TABLES)}) GROUP BY table_name)
    SELECT name, (({_ENDS.format("s")} + list_max(s) - 1) // list_max(s) * list_max(s))::BIGINT AS size, list_max(s)::BIGINT AS alignment,
      array_to_string(list_transform(range(1, len(s) + 1), lambda i: n[i] || '@' || ({_ENDS.format("s[:i]")} - s[i])), ',') AS offsets FROM c"""
)
def schema_layout(spark, sf_dir):
    return _described(spark, sf_dir, lambda d: (*ty.layout(d), ",".join(f"{n}@{at}" for n, at in ty.offsets(d))), "size long, alignment long, offsets string")


@query(" SELECT seq, user_id AS a, cents AS b_c, seg AS b_d_0, ts_us AS b_d_1 FROM log", log=True)
def flatten_record(log, reg):
    inner = F.struct(F.col("seg").alias("_0"), F.col("ts_us").alias("_1"))
    nested = log.select("seq", F.struct(F.col("user_id").alias("a"), F.struct(F.col("cents").alias("c"), inner.alias("d")).alias("b")).alias("r"))
    paths = [p for p, _ in measures.leaves(nested.schema["r"].dataType)]
    return nested.select("seq", *(F.col(".".join(("r", *p))).alias("_".join(x.removeprefix("_") for x in p)) for p in paths))


# Measures

_LONG = ", m AS (SELECT seg, series, unnest(['user', 'cents', 'props']) AS path, unnest([user_id, cents, strlen(props)]) AS value FROM log)"


def _measures(log: DataFrame) -> DataFrame:
    return measures.long_form(log, ["seg", "series"], {"user": F.col("user_id"), "cents": F.col("cents"), "props": F.octet_length("props")})


@query(_LONG + " SELECT seg, series, path, (2 * value + 1)::BIGINT AS value FROM m", log=True)
def measure_map(log, reg):
    return measures.mapped(_measures(log), lambda x: 2 * x + 1)


@query(_LONG + " SELECT path, (sum(value) FILTER (series = 'click') - sum(value) FILTER (series = 'view'))::BIGINT AS value FROM m GROUP BY path", log=True)
def measure_zip(log, reg):
    m = _measures(log)
    a, b = (measures.added(m.where(F.col("series") == s), []) for s in ("click", "view"))
    return measures.zipped(a, b, lambda x, y: x - y)


@query(_LONG + " SELECT seg, sum(value)::BIGINT AS total FROM m GROUP BY seg", log=True)
def measure_total(log, reg):
    return measures.total(_measures(log), ["seg"])


@query(_LONG + " SELECT series, path, sum(value)::BIGINT AS value FROM m GROUP BY series, path", log=True)
def measure_add(log, reg):
    return measures.added(_measures(log), ["series"])


@query(
    " SELECT series, path, sum(value)::BIGINT AS value FROM (SELECT series, unnest(['user_id', 'cents', 'props']) AS path, unnest([strlen(user_id::VARCHAR), strlen(cents::VARCHAR), strlen(props)]) AS value FROM log) GROUP BY series, path",
    log=True,
)
def measure_storage(log, reg):
    return measures.storage(log.select("series", "user_id", "cents", "props"), ["series"])


@query(
    """SELECT path, sum(value)::BIGINT AS value FROM (
      SELECT unnest(['key', 'items[]', 'items[].line', 'items[].flag', 'items[].at.mode']) AS path, unnest([8, count(*), 4 * count(*), sum(strlen(l_returnflag)), sum(strlen(l_linestatus))]) AS value FROM lineitem GROUP BY l_orderkey) GROUP BY path"""
)
def measure_nested(spark, sf_dir):
    item = F.struct(F.col("l_linenumber").cast("int").alias("line"), F.col("l_returnflag").alias("flag"), F.struct(F.col("l_linestatus").alias("mode")).alias("at"))
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))  # of one order
    return measures.added(measures.long_form(orders, [], measures.sizes(orders.select(F.struct(F.col("l_orderkey").alias("key"), "items").alias("r")).schema["r"].dataType, F.struct(F.col("l_orderkey").alias("key"), "items"))), [])


@query()
def lzw_codes(spark, sf_dir):
    return lzw(_log(spark, sf_dir), "props")

