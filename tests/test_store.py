"""Config, registry, view, store, compaction and the tailing stream."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sawmill.cli import run_query
from sawmill.config import FieldRule, ParserConfig, Plugin, Settings, load_config, validate_config
from sawmill.functions import fields as ff
from sawmill.operators.asof import asof_join
from sawmill.operators.compact import candidates, compact, recover
from sawmill.operators.extract import parse, parse_json
from sawmill.operators.templates import rebuilt, template_table, unknown_templates
from sawmill.plans.view import Registry, between, logs_view, open_logs
from sawmill.sources.lines import glob_regex, read_lines, reconcile, split_texts
from sawmill.sources.store import LANDING, REJECTS, file_stats, file_table, indexed_stats, promotions, write_batch, read_entries, read_files_between, read_nested, reindex, write_entries
from sawmill.sources.state import StateTable
from sawmill.sources.tail import TailReader
from sawmill.streaming.ingest import ingest, ingest_stream, ingest_streams, tracked_files

CONFIG = ParserConfig(
    r"^\d{4}-\d{2}-\d{2}", r"^(\S+Z)", level_regex=r"\b(INFO|ERROR)\b",
    fields_regexes=(FieldRule("http_status", r"status=(\S+)", "long"), FieldRule("note", r'note="([^"]+)"')),
)
REGISTRY = Registry({"http_status": "long", "note": "string"})


def some(spark, n=6):
    text = "\n".join(f"2025-08-{18 + i % 2}T0{i % 10}:00:00Z INFO status={'OK' if i == 2 else 200 + i} note=\"a b\"" for i in range(n))
    return parse(split_texts(spark.createDataFrame([("x", text)], "s string, t string"), "s", "t"), CONFIG)[0]


def test_config_spellings_and_checks(tmp_path):
    data = {"LogPaths": ["/logs"], "DataPath": "d", "Plugins": [{"Name": "p", "Include": ["*.log"], "Parser": {"StartOfEntryRegex": "^x", "fields_regexes": [{"FieldName": "a", "Regex": "a=(\\d)", "Type": "long"}]}}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(data))
    settings = load_config(str(path))
    assert settings.plugins[0].parser.fields_regexes[0] == FieldRule("a", "a=(\\d)", "long")
    assert validate_config(settings) == []
    bad = Settings(plugins=(Plugin(parser=ParserConfig("(", fields_regexes=(FieldRule("level", "x"), FieldRule("q", "x", "int")))),))
    assert len(validate_config(bad)) == 3
    with pytest.raises(ValueError):
        load_config({"nonsense": 1})


def test_registry_keeps_the_first_type(spark, tmp_path):
    r = Registry({"a": "long"})
    assert not r.register("a", "string") and r.types == {"a": "long"}
    r.save(spark, str(tmp_path / "r"))
    assert Registry.load(spark, str(tmp_path / "r")).types == {"a": "long"}
    with pytest.raises(ValueError):
        r.register("MESSAGE", "string")


def test_view_fields_and_raw(spark):
    logs = logs_view(some(spark), REGISTRY)
    rows = logs.select("http_status", "http_status__raw").collect()
    assert sum(r.http_status is None for r in rows) == 1 and {r.http_status__raw for r in rows} == {"200", "201", "OK", "203", "204", "205"}
    assert logs.select(ff.render().alias("x")).first().x.endswith("note='a b'")
    assert logs.where(ff.has("http_status", lambda f: f.LongValue > 203)).count() == 2


def test_store_stats_compaction(spark, tmp_path):
    root = str(tmp_path / "s")
    assert read_entries(spark, root).count() == 0
    for _ in range(3):
        write_entries(some(spark), root)
    before = sorted(map(str, read_entries(spark, root).drop("Fields").collect()))
    stats = file_stats(spark, root)
    assert stats.agg(F.sum("entries")).first()[0] == 18
    start, end = datetime(2025, 8, 19), datetime(2025, 8, 19, 3)
    assert read_files_between(spark, stats, start, end).count() == 3
    day = between(open_logs(spark, root, REGISTRY), start, end)
    assert day.count() == 3 and "year" in day._jdf.queryExecution().optimizedPlan().toString()
    assert candidates(spark, root, 3600) == []
    assert len(compact(spark, root, -1, promote={"http_status": "long"})) == 2
    assert sorted(map(str, read_entries(spark, root).select(*[c for c in some(spark).columns if c != "Fields"], "year", "month", "day").collect())) == before
    folder = f"{root}/optimized/year=2025/month=08/day=18"
    assert "_COMPACTION_COMPLETE" in os.listdir(folder) and len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == 1
    logs = open_logs(spark, root, REGISTRY)
    assert logs.where("http_status = 205").count() == 3
    write_entries(some(spark), root)  # late entries make the day a candidate again
    assert len(candidates(spark, root, -1)) == 2 and read_entries(spark, root).count() == 24
    assert run_query(spark, "SELECT count(*) FROM logs", "json") == 0 and run_query(spark, "SELECT nothing FROM logs", "csv") == 1


def test_nested_landing_folders(spark, tmp_path):
    root = str(tmp_path / "n")
    some(spark).coalesce(1).write.parquet(f"{root}/year=2025/month=08/day=18/landing")
    some(spark).coalesce(1).write.mode("append").parquet(f"{root}/year=2025/month=08/day=18")
    assert read_nested(spark, root).count() == 12


def test_globs_and_reconcile(spark):
    import re

    assert re.search(glob_regex("*.log"), "file:/a/b/x.log") and not re.search(glob_regex("*.log"), "file:/a/x.log.1")
    assert re.search(glob_regex("a/**/x.log"), "/q/a/b/c/x.log")
    a = spark.createDataFrame([("x", 2), ("y", 1), ("n", 1)], "path string, mtime int")
    b = spark.createDataFrame([("x", 1), ("y", 1), ("o", 1)], "path string, mtime int")
    assert {tuple(r) for r in reconcile(a, b).collect()} == {("x", "Changed"), ("n", "Added"), ("o", "Removed")}


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (1, None)], "g int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "g int, t int, v string")
    assert {tuple(r) for r in asof_join(left, right, "t", ["g"]).collect()} == {(1, 5, "b"), (1, 1, None), (2, 9, None), (1, None, None)}
    assert {tuple(r) for r in asof_join(left, right, "t", ["g"], strict=True).collect()} == {(1, 5, "a"), (1, 1, None), (2, 9, None), (1, None, None)}


def test_batch_ingest(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in ("a.log", "b.log", "c.txt"):
        (logs / name).write_text("".join(f"2025-08-18T0{i}:00:00Z INFO status={i}\n more\n" for i in range(5)))
    settings = Settings((str(logs),), str(tmp_path / "d"), (Plugin(include=("*.log",), exclude=("b.*",), parser=CONFIG),))
    ingest(spark, settings)
    assert read_entries(spark, settings.data_path).count() == 5
    assert read_lines(spark, str(logs), exclude=("*.txt",)).count() == 20


def test_tail_matches_batch_and_resumes(spark, tmp_path):
    logs, root, mark = tmp_path / "logs", str(tmp_path / "d"), str(tmp_path / "c")
    logs.mkdir()
    path = logs / "a.log"

    def run(flush):
        ingest_stream(spark, str(logs), CONFIG, root, mark, flush_seconds=flush, available_now=True).awaitTermination()
        return sorted(r.Message for r in read_entries(spark, root).collect())

    path.write_text("2025-08-18T01:00:00Z INFO status=1\n more\n2025-08-18T02:00:00Z INFO status=2\n part")
    assert run(1000) == ["2025-08-18T01:00:00Z INFO status=1\n more"]
    with path.open("a") as f:
        f.write("ial\n2025-08-18T03:00:00Z INFO status=3\n")
    assert len(run(1000)) == 2
    assert run(0)[1:] == ["2025-08-18T02:00:00Z INFO status=2\n partial", "2025-08-18T03:00:00Z INFO status=3"]
    os.rename(path, logs / "a.log.1")  # rotation: the old file is known, the new one starts anew
    path.write_text("2025-08-18T04:00:00Z ERROR status=4\n")
    assert len(run(0)) == 4


@pytest.mark.parametrize("head", ["", " no start\n" * 50, "2025 INFO long\n" + " more\n" * 100, "2025 INFO " + "x" * 700 + "\n"])
def test_tail_goes_on_past_the_batch_limit(tmp_path, head):
    last = "2025 INFO last\n"
    text = head + "2025 INFO a\n b\n" + last
    (tmp_path / "a.log").write_text(text)

    def read(flush):
        reader = TailReader({"path": str(tmp_path), "startregex": "^2025", "flushseconds": flush, "maxbytesperbatch": "64"})
        got, before = "", {"files": "{}"}
        for _ in range(40):
            now = reader.latestOffset()
            got += "".join(value + "\n" for part in reader.partitions(before, now) for *_, value in reader.read(part))
            before = now
        return got

    assert read("1000") == text.removesuffix(last)
    assert read("0") == text


@pytest.mark.parametrize("published", [False, True])
def test_interrupted_compaction(spark, tmp_path, published, monkeypatch):
    from sawmill.operators import compact as c

    root = str(tmp_path / "s")
    write_entries(some(spark), root)
    write_entries(some(spark), root)

    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(c, "_finish", stop)
        with pytest.raises(KeyboardInterrupt):
            compact(spark, root, -1)
    if not published:  # as if it had stopped before the renames
        new = [f for f in (tmp_path / "s" / "optimized").rglob("*.parquet")]
        for f in new:
            f.unlink()
    assert read_entries(spark, root).count() == 12
    recover(spark, root)
    assert read_entries(spark, root).count() == 12 and not list((tmp_path / "s" / "_manifests").glob("*.json"))
    compact(spark, root, -1)
    assert read_entries(spark, root).count() == 12


def test_promoted_columns_in_mixed_stores(spark, tmp_path):
    """Compacted days with a column, late entries without, and files of another promotion."""
    root = str(tmp_path / "m")
    write_entries(some(spark), root)
    compact(spark, root, -1, promote={"http_status": "long"})
    plan = open_logs(spark, root, REGISTRY).where("http_status > 203")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(http_status,203)" in plan
    write_entries(some(spark), root)
    logs = open_logs(spark, root, REGISTRY)
    assert logs.where("http_status > 203").count() == 4 and logs.where("http_status is null").count() == 2
    compact(spark, root, -1, promote={"note": "string"})
    logs = open_logs(spark, root, REGISTRY)
    assert promotions(spark, root) == ({"http_status": "long", "note": "string"}, {})
    assert logs.where("http_status > 203").count() == 4 and logs.where("note = 'a b'").count() == 12
    assert "http_status" not in read_entries(spark, root).columns
    with pytest.raises(ValueError):
        compact_again = some(spark)
        write_entries(compact_again, root)
        compact(spark, root, -1, promote={"note": "long"})


def test_a_batch_is_published_once(spark, tmp_path, monkeypatch):
    from sawmill.sources import publish

    root = str(tmp_path / "b")
    reject = spark.createDataFrame([("s", "e", "t")], "Source string, Error string, Text string")
    parts = {LANDING: some(spark), REJECTS: reject}
    write_batch(parts, root, "q", 0)
    write_batch(parts, root, "q", 0)  # as after a crash before its commit
    write_batch(parts, root, "q", 1)
    assert read_entries(spark, root).count() == 12 and spark.read.parquet(f"{root}/rejects").count() == 2
    done = publish.write_text

    def stops_at(place):
        def write(spark, path, text):
            if place in path:
                raise OSError("stopped")
            done(spark, path, text)

        return write

    for place in ("_moves.json", "_batches"):  # before the step counts as done; after all files were moved
        monkeypatch.setattr(publish, "write_text", stops_at(place))
        with pytest.raises(OSError):
            write_batch(parts, root, "q", 2)
    monkeypatch.setattr(publish, "write_text", done)
    write_batch(parts, root, "q", 2)
    assert read_entries(spark, root).count() == 18 and spark.read.parquet(f"{root}/rejects").count() == 3
    assert indexed_stats(spark, root).agg(F.sum("entries")).first()[0] == 18
    write_batch(parts, root, "q", 2)
    assert read_entries(spark, root).count() == 18 and os.listdir(f"{root}/_staging") == [] and len(os.listdir(f"{root}/_batches")) <= 2


def test_streams_of_all_plugins_and_paths(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.log").write_text("2025-08-18T01:00:00Z INFO status=200\n more\n2025-08-18T02:00:00Z ERROR status=500\n")
        (tmp_path / folder / "b.json").write_text('{"ts": "2025-08-18T03:00:00Z", "level": "warn", "msg": "m", "code": "7"}\nnot json\n')
    rules = (FieldRule("code", "", "long"),)
    plugins = (Plugin("json", "json", ("*.json",), parser=ParserConfig(fields_regexes=rules)), Plugin("text", include=("*",), parser=CONFIG))
    settings = Settings((str(tmp_path / "x"), str(tmp_path / "y")), str(tmp_path / "d"), plugins, flush_seconds=0)
    for query in ingest_streams(spark, settings, str(tmp_path / "c"), available_now=True):
        query.awaitTermination()
    logs = open_logs(spark, settings.data_path, Registry({"code": "long", "http_status": "long"}))
    assert sorted((r.Level, r.code, r.http_status) for r in logs.where("Level <> 'WARN'").collect()) == [("ERROR", None, 500)] * 2 + [("INFO", None, 200)] * 2
    assert [(r.code, r.Message) for r in logs.where("Level = 'WARN'").collect()] == [(7, "m")] * 2
    assert spark.read.parquet(f"{settings.data_path}/rejects").count() == 2


def test_approximate_queries_are_near(spark):
    from sawmill.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    exact = {r.Level: r.users for r in QUERIES["distinct_users"](spark, sf).collect()}
    for r in QUERIES["approx_users"](spark, sf).collect():
        assert abs(r.users - exact[r.Level]) <= max(2, 0.15 * exact[r.Level])
    n, sample = events.count(), QUERIES["sampled_logs"](spark, sf).collect()
    assert 0.05 * n < len(sample) < 0.16 * n and {r.event_id for r in sample} <= {r.event_id for r in events.collect()}


# --- files followed ------------------------------------------------------------------------------

HEADS = [f"2025-08-18T{h:02d}:{m:02d}:00Z INFO status={h * 60 + m} " for h in range(24) for m in range(60)]


def text_of(first, n):
    return "".join(f"{HEADS[i]}{'x' * 30}\n more {i}\n" for i in range(first, first + n))


def stored(spark, root):
    return sorted(r.Message.split(" ", 1)[0] for r in read_entries(spark, root).collect())


def stamps(first, n):
    return [HEADS[i].split(" ")[0] for i in range(first, first + n)]


@pytest.mark.parametrize("limit", [{"max_bytes": 4000}, {"max_entries": 37}])
def test_available_now_reads_all_in_batches_within_the_limit(spark, tmp_path, limit):
    logs, root, mark = tmp_path / "logs", str(tmp_path / "d"), str(tmp_path / "c")
    logs.mkdir()
    (logs / "a.log").write_text(text_of(0, 300))
    (logs / "b.log").write_text(text_of(300, 60))
    run = ingest_stream(spark, str(logs), CONFIG, root, mark, flush_seconds=0, available_now=True, **limit)
    run.awaitTermination()
    assert stored(spark, root) == stamps(0, 360) and not run.isActive
    sizes = indexed_stats(spark, root).select("entries").collect()
    assert len(sizes) >= 8
    batches = sorted(os.listdir(f"{mark}/offsets"), key=lambda n: int(n) if n.isdigit() else -1)
    assert sum(n.isdigit() for n in batches) >= 8
    per_batch = {}
    for name, n in [(r.path.rsplit("/", 1)[1].rsplit("-part", 1)[0], r.entries) for r in indexed_stats(spark, root).collect()]:
        per_batch[name] = per_batch.get(name, 0) + n
    assert max(per_batch.values()) <= (37 if "max_entries" in limit else 4000 // 74)
    again = ingest_stream(spark, str(logs), CONFIG, root, mark, flush_seconds=0, available_now=True, **limit)
    again.awaitTermination()
    assert len(stored(spark, root)) == 360


def test_a_new_stream_on_an_old_path_keeps_its_batches(spark, tmp_path):
    import shutil

    logs, root, mark = tmp_path / "logs", str(tmp_path / "d"), str(tmp_path / "c")
    logs.mkdir()
    for first in (0, 100):
        (logs / "a.log").write_text(text_of(first, 50))
        ingest_stream(spark, str(logs), CONFIG, root, mark, flush_seconds=0, available_now=True).awaitTermination()
        shutil.rmtree(mark)
    assert stored(spark, root) == stamps(0, 50) + stamps(100, 50)


class Reading:
    """The source without a query: batches as Spark would ask for them."""

    def __init__(self, folder, **options):
        self.options = {"path": str(folder), "startregex": "^2025", "flushseconds": "0", "include": "*.log", **options}
        self.reader, self.offset = TailReader(self.options), {"files": "{}"}

    def plan(self):
        before, self.offset = self.offset, self.reader.latestOffset()
        return self.reader.partitions(before, self.offset)

    def read(self, parts=None):
        return [value for part in parts or self.plan() for *_, value in self.reader.read(part) if value.startswith("2025")]

    def restart(self):
        self.reader = TailReader({**self.options, "known": self.offset["files"]})


def heads(first, n):
    return [HEADS[i] + "x" * 30 for i in range(first, first + n)]


@pytest.mark.parametrize("restarted", [False, True])
def test_renamed_between_planning_and_reading(tmp_path, restarted):
    path = tmp_path / "app.log"
    path.write_text(text_of(0, 5))
    source = Reading(tmp_path)
    parts = source.plan()
    os.rename(path, tmp_path / "app.log.1")
    path.write_text(text_of(50, 9))
    if restarted:
        source.restart()
        parts = source.reader.partitions({"files": "{}"}, source.offset)
    assert source.read(parts) == heads(0, 5)
    assert source.read() == heads(50, 9)
    with (tmp_path / "app.log.1").open("a") as f:  # the old name's last lines, though no pattern takes the new name
        f.write(text_of(5, 2))
    assert source.read() == heads(5, 2)


@pytest.mark.parametrize("restarted", [False, True])
def test_cut_and_grown_beyond_its_place(tmp_path, restarted):
    path = tmp_path / "app.log"
    path.write_text(text_of(0, 5))
    source = Reading(tmp_path)
    assert source.read() == heads(0, 5)
    path.write_text(text_of(50, 20))  # the same inode, longer than before
    if restarted:
        source.restart()
    assert source.read() == heads(50, 20)


def test_copied_then_cut(tmp_path):
    path = tmp_path / "app.log"
    path.write_text(text_of(0, 5))
    source = Reading(tmp_path)
    assert source.read() == heads(0, 5)
    (tmp_path / "app.log.1").write_text(text_of(0, 7))
    path.write_text(text_of(90, 1))
    assert sorted(source.read()) == heads(5, 2) + heads(90, 1)


def test_inode_used_again_and_same_beginning(tmp_path):
    path = tmp_path / "app.log"
    path.write_text(text_of(0, 40))
    source = Reading(tmp_path)
    assert source.read() == heads(0, 40)
    source.reader.known[next(iter(source.reader.known))].node = "0:0"  # as on another mount: found by its content
    with path.open("a") as f:
        f.write(text_of(40, 1))
    assert source.read() == heads(40, 1)
    path.write_text(text_of(0, 20) + text_of(60, 40))  # begins alike, goes on otherwise
    assert source.read() == heads(0, 20) + heads(60, 40)
    path.write_text(text_of(0, 20))  # cut to a shorter one of the same beginning: read before
    with pytest.warns(UserWarning):
        assert source.read() == []
    with path.open("a") as f:
        f.write(text_of(200, 1))
    assert source.read() == heads(200, 1)


def test_lost_ranges_are_never_read_from_another_file(tmp_path):
    path = tmp_path / "app.log"
    path.write_text(text_of(0, 5))
    source = Reading(tmp_path)
    parts = source.plan()
    path.write_text(text_of(50, 9))
    with pytest.raises(FileNotFoundError):
        source.read(parts)
    skipping = Reading(tmp_path, onlost="skip")
    with pytest.warns(UserWarning):
        assert skipping.read(parts) == []


def test_files_take_turns_within_a_batch(tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.log").write_text(text_of(0, 30))
    source = Reading(tmp_path, maxbytesperbatch="800")
    sizes = []
    for _ in range(12):
        parts = source.plan()
        sizes.append(sum(p.end - p.begin for p in parts))
        source.read(parts)
    assert max(sizes) <= 800 and sum(sizes) == 3 * len(text_of(0, 30))


# --- batch ingestion, the registry, the index ----------------------------------------------------


def messages(spark, settings):
    return sorted(r.Message for r in read_entries(spark, settings.data_path).collect())


def test_ingest_again_changed_and_removed_files(spark, tmp_path):
    logs = tmp_path / "lo gs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("2025-08-18T01:00:00Z INFO status=1\n more\n2025-08-18T02:00:00Z INFO status=2\n")
    b.write_text("2025-08-18T03:00:00Z INFO status=3\n")
    settings = Settings((str(logs),), str(tmp_path / "d"), (Plugin(include=("*.log",), parser=CONFIG),))
    assert ingest(spark, settings) == {"Added": 2, "Changed": 0, "Removed": 0}
    first = messages(spark, settings)
    assert len(first) == 3 and ingest(spark, settings) == {"Added": 0, "Changed": 0, "Removed": 0} and messages(spark, settings) == first
    with a.open("a") as f:
        f.write(" late\n2025-08-18T04:00:00Z INFO status=4\n")
    b.write_text("2025-08-19T05:00:00Z INFO status=5\n2025-08-19T06:00:00Z INFO status=6\n")  # another file of that name
    for path in (a, b):
        os.utime(path, (2e9, 2e9))
    assert ingest(spark, settings)["Changed"] == 2
    assert messages(spark, settings) == sorted([*first, "2025-08-18T04:00:00Z INFO status=4", "2025-08-19T05:00:00Z INFO status=5", "2025-08-19T06:00:00Z INFO status=6"])
    assert [(r.Error, r.Text) for r in spark.read.parquet(f"{settings.data_path}/rejects").collect()] == [("Late line of a stored entry", " late")]
    a.unlink()
    assert ingest(spark, settings) == {"Added": 0, "Changed": 0, "Removed": 1} and len(messages(spark, settings)) == 6
    tracked = tracked_files(spark, settings.data_path)
    assert [r.path.rsplit("/", 1)[1] for r in tracked.current().collect()] == ["b.log"]
    tracked.vacuum()
    assert tracked.current().count() == 1 and len(tracked.files()) >= 1


def test_new_files_are_not_numbered(spark, tmp_path, monkeypatch):
    from sawmill.streaming import ingest as module

    called, plain = [], module.numbered
    monkeypatch.setattr(module, "numbered", lambda *a: (called.append(1), plain(*a))[1])
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("orphan\n2025-08-18T01:00:00Z INFO status=1\n more\n2025-08-18T02:00:00Z INFO status=2\n")
    settings = Settings((str(logs),), str(tmp_path / "d"), (Plugin(include=("*.log",), parser=CONFIG),))
    ingest(spark, settings)
    row = tracked_files(spark, settings.data_path).current().first()
    assert not called and (row.lines, row.entries) == (4, 2) and len(messages(spark, settings)) == 2


def test_interrupted_ingest_is_ended_or_dropped(spark, tmp_path, monkeypatch):
    from sawmill.sources import publish

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("2025-08-18T01:00:00Z INFO status=1\n")
    settings = Settings((str(logs),), str(tmp_path / "d"), (Plugin(include=("*.log",), parser=CONFIG),))
    for step in ("write_text", "_end"):  # before the step counts as done; right after
        with monkeypatch.context() as m:
            m.setattr(publish, step, lambda *a, **b: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                ingest(spark, settings)
    ingest(spark, settings)
    assert len(messages(spark, settings)) == 1 and tracked_files(spark, settings.data_path).current().count() == 1


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), "t", ("k",), "k string, v int")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert table.current().count() == 0
    table.upsert(frame(("a", 1), ("b", 2)))
    table.upsert(frame(("a", 3), (None, 4)))
    table.delete(frame(("b", 0)))
    now = lambda: {(r.k, r.v) for r in table.current().collect()}
    assert now() == {("a", 3), (None, 4)}
    assert table.vacuum() and now() == {("a", 3), (None, 4)}
    table.upsert(frame(("b", 9)))
    assert now() == {("a", 3), (None, 4), ("b", 9)}


def test_registry_merges_over_runs_and_writers(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("2025-08-18T01:00:00Z INFO status=7 code=12\n2025-08-18T02:00:00Z INFO status=8 code=x9\n")
    rule = lambda name, key, kind: ParserConfig("^2025", r"^(\S+Z)", fields_regexes=(FieldRule(name, key + r"=(\S+)", kind),))
    root = str(tmp_path / "d")
    for parser in (rule("code", "code", "long"), rule("status", "status", "long"), rule("code", "status|code", "string")):
        settings = Settings((str(logs),), root, (Plugin(include=("*.log",), parser=parser),))
        (logs / "a.log").touch()
        tracked_files(spark, root).delete(spark.createDataFrame([(r.path,) for r in tracked_files(spark, root).current().collect()], "path string"))
        ingest(spark, settings)
    registry = Registry.load(spark, f"{root}/registry")
    assert registry.types == {"code": "long", "status": "long"}
    rows = {(r.code, r.code__raw, r.status) for r in open_logs(spark, root, registry).collect()}
    assert rows == {(12, "12", None), (None, "x9", None), (None, None, 7), (None, None, 8)}
    rejects = sorted((r.Error, r.Text) for r in spark.read.parquet(f"{root}/rejects").collect())
    assert rejects == [("Field code is long", "x9")] * 2
    other = Registry({"code": "double", "more": "string"})
    assert other.save(spark, f"{root}/registry") == ["code"] and other.types == {"code": "long", "status": "long", "more": "string"}


def test_index_opens_only_the_files_of_a_range(spark, tmp_path):
    """All other files are spoilt: whoever opened one would fail."""
    root = str(tmp_path / "s")
    for _ in range(2):
        write_entries(some(spark, 20).coalesce(1), root)
    assert {(r.zone, r.entries) for r in file_table(spark, root).current().collect()} == {("landing", 10)}
    for f in (tmp_path / "s" / "landing" / "year=2025" / "month=08" / "day=18").glob("*.parquet"):
        f.write_bytes(b"spoilt")
    spark.catalog.clearCache()
    found = read_files_between(spark, indexed_stats(spark, root), datetime(2025, 8, 19), datetime(2025, 8, 20))
    assert found.count() == 20 and len(found.inputFiles()) == 2
    for f in (tmp_path / "s" / "landing" / "year=2025" / "month=08" / "day=18").glob("*"):
        f.unlink()
    assert reindex(spark, root) == 2 and indexed_stats(spark, root).count() == 2
    compact(spark, root, -1)
    stats = indexed_stats(spark, root).collect()
    assert [(r.zone, r.entries) for r in stats] == [("optimized", 20)] and os.path.getsize(stats[0].path) == stats[0].bytes
    assert sorted(map(str, file_stats(spark, root).select("entries", "min_timestamp", "max_timestamp").collect())) == [str(r) for r in indexed_stats(spark, root).select("entries", "min_timestamp", "max_timestamp").collect()]


# --- templates and JSON lines --------------------------------------------------------------------


def test_templates_of_any_rules_and_messages_rebuilt(spark, tmp_path):
    rules = (
        FieldRule("status", r"status=(\d+)", "long"), FieldRule("kind", r" (?:INFO|WARN|ERROR) (\w+) "), FieldRule("pair", r"((a|b)=(\w+))"),
        FieldRule("word", r"\bw\w+"), FieldRule("opt", r"opt=(\d)?;"), FieldRule("flag", r"flag=(true|false)", "boolean"),
    )
    parser = ParserConfig(r"^2025", r"^(\S+Z)", level_regex=r"\b(INFO|WARN)\b", fields_regexes=rules, template_hashes=True)
    lines = [
        "2025-08-18T01:00:00Z INFO login status=200 a=q {x} wide", "2025-08-18T02:00:00Z INFO login status=404 a=zz {x} wild",
        "2025-08-18T03:00:00Z WARN logout status=1 status=2 flag=true", "2025-08-18T04:00:00Z odd opt=; {{\n second WARN }", "2025-08-18T04:00:00Z odd opt=3;",
    ]
    entries, _ = parse(split_texts(spark.createDataFrame([("x", "\n".join(lines))], "s string, t string"), "s", "t"), parser)
    plugin, root = Plugin(parser=parser), str(tmp_path)
    table = template_table(spark, root)
    for _ in range(2):  # the second batch adds nothing
        table.upsert(unknown_templates(entries, plugin, root))
    known = {r.template for r in table.current().collect()}
    assert known == {
        "{Timestamp} {Level} {kind} status={status} {pair} {{x}} {word}", "{Timestamp} {Level} {kind} status=1 status={status} flag={flag}",
        "{Timestamp} odd opt=; {{{{\n second {Level} }}", "{Timestamp} odd opt={opt};",
    }
    assert sum(1 for _ in table.files()) >= 1 and table._latest(table.files()).count() == 4
    back = entries.join(table.current(), "TemplateHash").select(rebuilt(F.col("template")).alias("m"), "Message").collect()
    assert len(back) == 5 and all(r.m == r.Message for r in back)


def test_each_batch_parses_its_own_lines(spark, monkeypatch):
    from sawmill import queries

    seen, plain = [], queries.parse
    monkeypatch.setattr(queries, "parse", lambda lines, *a, **b: (seen.append(lines.count()), plain(lines, *a, **b))[1])
    found = queries.QUERIES["template_rebuild"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and sum(seen) == 1000 and min(seen) > 0 and found.count() == found.select("event_id").distinct().count() == 1000
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]  # templates are cut before the join


def test_json_lines_edges(spark):
    parser = ParserConfig(message_regex=r"said (\w+)", fields_regexes=(FieldRule("code", "", "long"),), template_hashes=True)
    lines = ['{"ts": 1755500400, "msg": "a said hello", "code": 7}', '{"ts": "1755500400123", "msg": "code 8 here", "code": "8"}', '{"ts": 1755500400, "msg": "code 9 here", "code": 9}', '{"a": 1} x', '{"a": 1} {"b": 2}', '{"a": 1}]']
    entries, rejects = parse_json(split_texts(spark.createDataFrame([("x", "\n".join(lines))], "s string, t string"), "s", "t"), parser)
    rows = entries.select(F.unix_millis("Timestamp").alias("t"), "Message", "TemplateHash").collect()
    assert [(r.t, r.Message) for r in rows] == [(1755500400000, "hello"), (1755500400123, "code 8 here"), (1755500400000, "code 9 here")]
    assert rows[1].TemplateHash == rows[2].TemplateHash != rows[0].TemplateHash and rejects.count() == 3
