"""Joins by time, sketches, search, plug-in parsers and metrics."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sawmill.config import Plugin
from sawmill.operators import sketches as sk
from sawmill.operators.asof import asof_join
from sawmill.operators.compact import compact
from sawmill.operators.extract import parse
from sawmill.operators.ranges import interval_join, overlap_counts
from sawmill.operators.search import files_with, index_words, search
from sawmill.plans.view import open_logs
from sawmill.queries import EVENTS, QUERIES, REGISTRY, _line_parser
from sawmill.sources.lines import split_texts
from sawmill.sources.store import file_table, read_entries, write_entries
from sawmill.streaming import plugins
from sawmill.streaming.ingest import ingest_stream, stream_id
from sawmill.streaming.metrics import Metrics, ProgressListener

# --- joins ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [20_000, 7])
def test_interval_join_against_all_pairs(spark, block):
    rng = random.Random(block)
    span = lambda: rng.choice([0, 0, 1, 5, 50, 3000])
    make = lambda n: [(i, b, b + span()) for i, b in ((i, rng.choice([500, rng.randrange(-2000, 2000)])) for i in range(n))] + [(n, None, 3), (n + 1, 9, 2)]
    a, b = make(120), make(150)
    left, right = spark.createDataFrame(a, "i int, b long, e long"), spark.createDataFrame(b, "j int, c long, d long")
    found = [(r.i, r.j) for r in interval_join(left, right, ("b", "e"), ("c", "d"), 16, block=block).collect()]
    good = lambda rows: [r for r in rows if r[1] is not None and r[1] <= r[2]]
    expected = {(i, j) for i, lo, hi in good(a) for j, c, d in good(b) if lo <= d and c <= hi}
    assert len(found) == len(set(found)) and set(found) == expected
    counts = Counter(i for i, _ in expected)
    got = overlap_counts(left, right, "i", ("b", "e"), ("c", "d"), 16, block).collect()
    assert {r.i: r.n for r in got} == {i: counts[i] for i, *_ in a}


def test_interval_join_has_no_nested_loop(spark):
    t = spark.range(100).select(F.timestamp_seconds("id").alias("t"))
    plan = interval_join(t, t.withColumnRenamed("t", "u"), ("t", "t"), ("u", "u"), 1_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_counts_make_no_pairs(spark):
    left = spark.createDataFrame([(1, 0, 10), (1, 5, 5), (2, -(1 << 62), 1 << 62), (3, 9, 8), (4, None, 3), (None, 3, 1 << 40)], "i int, b long, e long")
    right = spark.range(5000).selectExpr("id % 10 AS c", "id % 10 + shiftleft(1L, int(id % 50)) AS d").union(spark.createDataFrame([(-(1 << 61), -(1 << 60))], "c long, d long"))
    counts = overlap_counts(left, right, "i", ("b", "e"), ("c", "d"), 16)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert not [step for step in plan.splitlines() if "Join" in step and "<=" in step]  # places meet by equality only
    rows = [(r.c, r.d) for r in right.collect()]
    meet = lambda lo, hi: sum(lo <= d and c <= hi for c, d in rows)
    assert {r.i: r.n for r in counts.collect()} == {1: meet(0, 10) + meet(5, 5), 2: 5001, 3: 0, 4: 0, None: meet(3, 1 << 40)} and counts.count() == 5


def test_a_subquery_over_fields_is_joined_by_hash(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    found = {r.event_id: r.k for r in QUERIES["field_correlated"](spark, "/root/testdata/sf0.001").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription().split("Initial Plan")[0] for i in range(runs.size())]
    joins = [p for p in plans if "Generate" in p and "Join" in p]
    assert joins and "ShuffledHashJoin" in joins[-1] and spark.conf.get(name) == before
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    assert found == {r.event_id: r.k for r in rows.collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_slices_is_asof(spark, strict):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([0, 0, 0, 1, None]), rng.choice([None, *range(200)]), i) for i in range(400)], "g int, t int, i int")
    right = spark.createDataFrame([(g, t, f"{g}-{t}") for g in (0, 1, None) for t in rng.sample(range(200), 40)], "g int, t int, v string")
    plain = sorted(map(str, asof_join(left, right, "t", ["g"], strict).collect()))
    assert sorted(map(str, asof_join(left, right, "t", ["g"], strict, slices=13).collect())) == plain
    one = right.where("g = 0").drop("g")
    whole = asof_join(left.withColumn("k", F.lit(0)), one.withColumn("k", F.lit(0)), "t", ["k"], strict).drop("k")
    assert sorted(map(str, asof_join(left, one, "t", [], strict, slices=8).collect())) == sorted(map(str, whole.collect()))


def test_a_hot_group_is_spread_by_slices(spark):
    left = spark.range(4000).select(F.lit(1).alias("g"), F.timestamp_seconds("id").alias("t"), "id")
    right = spark.range(40).select(F.lit(1).alias("g"), F.timestamp_seconds(F.col("id") * 100).alias("t"), F.col("id").alias("v"))
    out = asof_join(left, right, "t", ["g"], slices=16)
    assert out.where(F.col("v") != F.floor(F.col("id") / 100)).count() == 0 and out.count() == 4000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan.split("Window")[1]


# --- sketches and search -------------------------------------------------------------------------


def entries(spark, lines):
    return parse(split_texts(spark.createDataFrame([("x", "\n".join(lines))], "s string, t string"), "s", "t"), EVENTS)[0]


def line(i, user, more=""):
    return f"{datetime(2025, 8, 1, tzinfo=timezone.utc) + timedelta(hours=i):%Y-%m-%dT%H:%M:%SZ} {('INFO', 'WARN', 'ERROR')[i % 3]} view event_id={i} user_id={user} response_time_ms={i}.5 k=1{more}"


def test_sketches_within_bounds_and_without_entries(spark, tmp_path):
    root, fields = str(tmp_path), {"user_id": "long", "response_time_ms": "double", "event_type": "string", "absent": "long"}
    found = entries(spark, [line(i, i * 7 % 1500) for i in range(3000)])
    for part in (0, 1, 1):  # a part put in again counts once
        sk.sketch_part(found.where(F.pmod(F.hour("Timestamp"), F.lit(2)) == part), fields, root, f"p{part}")
    stored = sk.sketch_table(spark, root).current()
    assert all("/sketches/" in f for f in stored.inputFiles())
    by = {r.field: r for r in sk.merged(stored, "field").select("field", "n", sk.approx_distinct().alias("d"), sk.approx_quantile(0.5).alias("q")).collect()}
    assert set(by) == {"user_id", "response_time_ms", "event_type"} and all(r.n == 3000 for r in by.values())
    assert abs(by["user_id"].d - 1500) < 90 and by["event_type"].d == 1 and by["event_type"].q is None
    assert abs(by["response_time_ms"].q - 1500) < 60
    days = sk.merged(stored, "day", "Level").agg(F.sum("n")).first()[0]
    assert days == 9000


def test_search_opens_few_files(spark, tmp_path):
    root = str(tmp_path)
    rare = {77: " zebra-crossing", 800: " zebra.x", 1400: " xzebra"}
    write_entries(entries(spark, [line(i, i % 9, rare.get(i, "")) for i in range(1500)]), root)
    n_files = file_table(spark, root).current().count()
    assert index_words(spark, root) == n_files >= 60 and index_words(spark, root) == 0
    assert files_with(spark, root, ["zebra"]).count() < n_files / 10
    found = search(spark, root, "zebra")
    assert len(found.inputFiles()) < n_files / 10 and {r.Message[-8:] for r in found.collect()} == {"crossing", " zebra.x"}
    for text in (" zebra", "zebra-cro", "user_id=3 ", "a-text-that-is-nowhere", "xzebra"):
        like = read_entries(spark, root).where(F.col("Message").contains(text)).count()
        assert search(spark, root, text, words=False).count() == like, text
    write_entries(entries(spark, [line(9000, 1, " zebra late")]), root)  # no filter yet: its file counts
    assert search(spark, root, "zebra").count() == 3
    compact(spark, root, -1)
    assert index_words(spark, root) > 0 and search(spark, root, "zebra").count() == 3


# --- parsers of users ----------------------------------------------------------------------------


def rows_of(frame):
    return sorted((r.Message, str(r.Timestamp), r.Level, sorted((f.Key, f.StringValue or f.LongValue or f.DoubleValue) for f in r.Fields)) for r in frame.collect())


def test_a_plugin_equals_the_regex_parser(spark, tmp_path):
    texts = [line(i, i % 9) + ("\n  more " + str(i) if i % 4 == 0 else "") for i in range(50)]
    lines = split_texts(spark.createDataFrame([(f"s{k}", "\n".join(texts[k::3])) for k in range(3)] + [(None, "x")], "s string, t string"), "s", "t")

    class OneLine(_line_parser()):
        def flush(self):
            head, *rest = self.held.split("\n")
            self.held, held = head, self.held
            for e in super().flush():
                e.message = held
                yield e

    by_regex, _ = parse(lines, EVENTS)
    by_plugin, _ = plugins.parse_whole(lines, OneLine)
    assert rows_of(by_plugin) == rows_of(by_regex) and by_plugin.count() == 50


def pairing():
    """A class that goes to the workers by value."""
    class Pairs(plugins.LogParser):
        """Pairs of lines; what it holds goes on in the next batch."""

        held = ""

        def parse(self, lines):
            for text in lines:
                if text.startswith("bad"):
                    yield plugins.Failure("no pair", text)
                elif self.held:
                    yield plugins.Entry(f"{self.held}+{text}", fields={"n": 2, "ok": True})
                    self.held = ""
                else:
                    self.held = text

        def flush(self):
            if self.held:
                yield plugins.Entry(self.held, fields={"n": 1})

        def state(self):
            return self.held

        def restore(self, state):
            self.held = state

    return Pairs


def test_a_plugin_in_a_stream_keeps_its_state(spark, tmp_path):
    parser = pairing()
    plugins.register_plugin("pairs", parser)
    logs, root, mark = tmp_path / "logs", str(tmp_path / "d"), str(tmp_path / "c")
    logs.mkdir()
    plugin, metrics = Plugin("p", "pairs"), Metrics()

    def run():
        ingest_stream(spark, str(logs), plugin, root, mark, flush_seconds=0, available_now=True, max_bytes=6, metrics=metrics).awaitTermination()
        return sorted(r.Message for r in read_entries(spark, root).select("Message").collect())

    (logs / "a.log").write_text("a1\na2\nbad\na3\n")
    (logs / "b.log").write_text("b1\n")
    assert run() == ["a1+a2"]
    for name, text in (("a", "a4\na5\n"), ("b", "b2\n")):
        with (logs / f"{name}.log").open("a") as f:
            f.write(text)
    assert run() == ["a1+a2", "a3+a4", "b1+b2"]
    plugins.flush(spark, root, parser, stream_id(spark, mark))
    assert sorted(r.Message for r in read_entries(spark, root).select("Message").collect()) == ["a1+a2", "a3+a4", "a5", "b1+b2"]
    assert plugins.state_table(spark, root).current().count() == 0
    assert [r.Text for r in spark.read.parquet(f"{root}/rejects").collect()] == ["bad"]
    assert metrics.entries == 3 and metrics.rejects == 1 and metrics.batches >= 4


# --- metrics -------------------------------------------------------------------------------------


def test_metrics_of_a_stream_and_its_lag(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "d")
    logs.mkdir()
    metrics = Metrics()
    listener = ProgressListener(metrics)
    spark.streams.addListener(listener)
    query = ingest_stream(spark, str(logs), EVENTS, root, str(tmp_path / "c"), flush_seconds=0.2, interval="0 seconds", metrics=metrics)
    try:
        stamp = datetime.now(timezone.utc)
        (logs / "a.log").write_text("left over\n" + "".join(f"{stamp:%Y-%m-%dT%H:%M:%SZ} INFO view event_id={i} user_id=1\n" for i in range(20)))
        until = time.time() + 90
        while metrics.entries < 20 and time.time() < until:
            time.sleep(0.3)
        assert open_logs(spark, root, REGISTRY).count() == 20
        while metrics.input_rows < 21 and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    assert metrics.entries == 20 and metrics.rejects == 1 and metrics.input_rows >= 21 and 0 < metrics.lag < 90
    assert "# TYPE sawmill_entries counter\nsawmill_entries 20\n" in metrics.render()
