"""General operators against brute force, with nulls, ties, repeats, empty inputs and clashing column names."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import charclass, regexlit, strptime
from tarnlake.operators import changes, instants, logparse, skew, substrings, templates, tokens
from tarnlake.operators.ordered import carry_forward, running_total
from tarnlake.plans import planner

T0 = dt.datetime(2024, 1, 1)
OBS = "obs_id long, index_name string, last_file string, last_file_time timestamp, size_bytes long, content_sum string, seen_at timestamp, version string"
RUNS = "run_id long, index_name string, started_at timestamp, finished_at timestamp, run_status string, last_file string, last_file_time timestamp, n_files int, obs_id long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def expected_changes(obs, runs):
    obs = list({o[0]: o for o in obs}.values())
    has = {o[1] for o in obs if o[5] is not None}
    out, by = set(), {}
    for o in obs:
        v = o[5] if o[1] in has else (o[3], o[4])
        if v is not None and v != (None, None) and o[6] is not None:
            by.setdefault(o[1], []).append((o[6], o[0], o[2], v))
    for index in {r[1] for r in runs}:
        held = {}
        for r in sorted({r[0]: r for r in runs if r[1] == index and r[4] == "ok" and r[2]}.values(), key=lambda r: (r[2], r[0])):
            seen = {}
            for o in sorted(by.get(index, [])):
                if o[0] <= r[2]:
                    seen[o[2]] = o
            for f, o in seen.items():
                if held.get(f, "none") != o[3]:
                    out.add((r[0], o[1]))
                held[f] = o[3]
    return out


def test_changed_files_equals_replay(spark):
    rng = random.Random(5)
    obs, runs = [], []
    for i in range(500):
        index = rng.choice(["hot", "hot", "hot", "b", "nosum", None])
        csum = None if index == "nosum" or rng.random() < 0.1 else f"s{rng.randint(0, 3)}"
        seen = None if rng.random() < 0.02 else at(rng.randint(0, 600))
        obs.append((i, index, rng.choice(["f1", "f2", "f3", None]), at(rng.randint(0, 3)), rng.randint(0, 2), csum, seen, "clash"))
    for i in range(60):
        runs.append((i, rng.choice(["hot", "hot", "b", "nosum", None]), None if i == 7 else at(rng.randint(0, 600)), None, rng.choice(["ok", "ok", "failed", None]), None, None, 0, 9))
    obs += obs[:40]
    runs += runs[:10]
    rng.shuffle(obs)
    got = changes.changed_files(spark.createDataFrame(obs, OBS), spark.createDataFrame(runs, RUNS))
    rows = [tuple(r) for r in got.select("run_id", "obs_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected_changes(obs, runs)
    empty = changes.changed_files(spark.createDataFrame([], OBS), spark.createDataFrame(runs, RUNS))
    assert empty.count() == 0


def test_change_feed_survives_a_failure_without_skips_or_repeats(spark, tmp_path):
    feed = lambda: changes.ChangeFeed(spark, str(tmp_path / "state"), "k", "v", "o", partitions=3)
    rows = [(f"f{i}", "a", i) for i in range(20)]
    df = lambda r: spark.createDataFrame(r, "k string, v string, o long")
    assert feed().run(df(rows)) == 1
    rows += [("f1", "b", 30), ("f2", "a", 31), ("new", "a", 32)]

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        feed().run(df(rows), fails)
    more = rows + [("f1", "c", 40)]
    assert feed().run(df(more)) == 2  # the plan written before the failure, though the log has grown
    second = {(r["k"], r["v"]) for r in feed().sink().where("batch = 2").collect()}
    assert second == {("f1", "b"), ("new", "a")}
    assert feed().run(df(more)) == 3
    assert [(r["k"], r["v"]) for r in feed().sink().where("batch = 3").collect()] == [("f1", "c")]
    assert feed().run(df(more)) == 4 and feed().sink().where("batch = 4").count() == 0


def test_change_feed_with_tied_times_gives_the_rows_of_changed_files(spark, tmp_path):
    rng = random.Random(8)
    obs = [(i, "ix", rng.choice(["f1", "f2", "f3"]), None, 1, f"s{rng.randint(0, 2)}", at(rng.randint(0, 8)), "clash") for i in range(60)]
    states = [(1, "failed", 2), (2, "ok", 2), (3, "ok", 4), (4, None, 7), (5, "failed", 7), (6, "ok", 7), (7, "ok", 9)]
    runs = [(i, "ix", at(m), None, status, None, None, 0, 9) for i, status, m in states]
    want = {(r["run_id"], r["obs_id"]) for r in changes.changed_files(spark.createDataFrame(obs, OBS), spark.createDataFrame(runs, RUNS)).collect()}

    def fails(_):
        raise RuntimeError("lost")

    log, got = changes.change_log(spark.createDataFrame(obs, OBS)).cache(), set()
    for i, status, m in states:
        feed = changes.ChangeFeed(spark, str(tmp_path / "s"), "last_file", "version", ("offset_us", "obs_id"), partitions=2)
        seen = log.where(F.col("offset_us") <= F.unix_micros(F.lit(at(m))))
        if status == "ok":
            n = feed.run(seen)
            got |= {(i, r["obs_id"]) for r in feed.sink().where(F.col("batch") == n).collect()}
        else:
            with pytest.raises(RuntimeError):
                feed.run(seen, fails)
    assert got == want


def test_change_feed_takes_late_ties_and_refuses_equal_offsets(spark, tmp_path):
    df = lambda r: spark.createDataFrame(r, "k string, v string, t long, i long")
    feed = changes.ChangeFeed(spark, str(tmp_path / "a"), "k", "v", ("t", "i"), partitions=1)
    feed.run(df([("f", "a", 5, 1)]))
    feed.run(df([("f", "a", 5, 1), ("f", "b", 5, 2)]))
    assert [r["v"] for r in feed.sink().where("batch = 2").collect()] == ["b"]
    with pytest.raises(ValueError):
        changes.ChangeFeed(spark, str(tmp_path / "b"), "k", "v", "t").run(df([("f", "a", 5, 1), ("f", "b", 5, 2)]))


@pytest.mark.parametrize("step", ["plan", "process", "write", "commit"])
def test_run_feed_over_arrivals_with_a_failure_at_each_step(spark, tmp_path, monkeypatch, step):
    rng = random.Random(11)
    obs = [(i, rng.choice(["hot", "hot", "nosum"]), rng.choice(["f1", "f2", "f3", None]), at(rng.randint(0, 3)), rng.randint(0, 2), f"s{rng.randint(0, 2)}", at(i // 3), "clash") for i in range(120)]
    obs = [o[:5] + (None,) + o[6:] if o[1] == "nosum" else o for o in obs]
    runs = [(i, rng.choice(["hot", "nosum"]), at(2 * i + 1), None, rng.choice(["ok", "ok", "failed", None]), None, None, 0, 9) for i in range(20)]
    table, state, got = str(tmp_path / "obs"), str(tmp_path / "state"), None
    for part in range(3):
        upto = at(13 * (part + 1))
        rows = [o for o in obs if at(13 * part) <= o[6] < upto or part == 2 and o[6] >= upto]
        spark.createDataFrame(rows + rows[:5], OBS).coalesce(1).write.mode("append").parquet(table)
        known = spark.createDataFrame([r for r in runs if r[2] < upto or part == 2], RUNS)
        feed = lambda: changes.RunFeed(spark, state, partitions=3)  # noqa: E731, B023
        arrived = lambda: changes.with_arrival(spark.read.parquet(table))
        if part == 1:
            real, calls = changes.ChangeFeed._write, []

            def fails(self, name, content, real=real, calls=calls):
                calls.append(name)
                if name.startswith("plans" if step == "plan" else "commits"):
                    raise RuntimeError("lost")
                return real(self, name, content)

            if step in ("plan", "commit"):
                monkeypatch.setattr(changes.ChangeFeed, "_write", fails)
            elif step == "process":
                monkeypatch.setattr(changes, "place", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            else:
                monkeypatch.setattr(changes, "_cases", lambda c: c.select(F.raise_error(F.lit("lost")).cast("long").alias("run_id")))
            with pytest.raises(Exception, match="lost"):
                feed().advance(arrived(), known)
            monkeypatch.undo()
        feed().advance(arrived(), known)
        got = [(r["run_id"], r["obs_id"]) for r in feed().processed().collect()]
        assert len(got) == len(set(got))
    assert set(got) == expected_changes(obs, runs)
    assert feed().advance(arrived(), known) == 4 and feed().processed().where("batch = 4").count() == 0


def test_a_late_record_is_not_passed_over(spark, tmp_path):
    df = lambda r: spark.createDataFrame(r, "k string, v string, t long, arrived long")
    feed = changes.ChangeFeed(spark, str(tmp_path / "a"), "k", "v", "arrived", partitions=1, order=["t"])
    rows = [("f", "a", 10, 1), ("g", "a", 10, 2)]
    feed.run(df(rows))
    rows += [("h", "late", 9, 3), ("f", "tie", 10, 4)]
    feed.run(df(rows))
    assert {(r["k"], r["v"]) for r in feed.sink().where("batch = 2").collect()} == {("h", "late"), ("f", "tie")}
    feed.run(df([*rows, ("f", "tie", 11, 5)]))
    assert feed.sink().where("batch = 3").count() == 0 and feed.state()["held"].count() == 3


def test_ordered_operators(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), i * rng.choice([1, 1, 3]), rng.choice([None, None, i]), 5) for i in range(400)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "k string, p long, v long, __pid long").drop("__pid")
    for parts, strict in ((7, False), (5, True), (None, True)):
        got = {(r["k"], r["p"]): r["x"] for r in carry_forward(df, ["k"], ["p"], "v", "x", strict, parts).collect()}
        last = {}
        for k, p, v, _ in sorted(rows, key=lambda r: r[1]):
            seen = last.get(k)
            last[k] = v if v is not None else seen
            assert got[(k, p)] == (seen if strict else last[k])
    total = {(r["k"], r["p"]): r["s"] for r in running_total(df.withColumn("n", F.lit(2).cast("long")), ["k"], ["p"], "n", "s", 5).collect()}
    for k in ("a", None):
        for i, p in enumerate(sorted(r[1] for r in rows if r[0] == k), 1):
            assert total[(k, p)] == 2 * i
    # a value carried over partitions that hold none, small Arrow batches, repeated rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    long = spark.createDataFrame([("z", i, 1 if i == 3 else None) for i in range(60)] * 2, "k string, p long, v long")
    assert {r["x"] for r in carry_forward(long, ["k"], ["p"], "v", "x", partitions=9).where("p > 3").collect()} == {1}
    assert running_total(long.withColumn("n", F.lit(1)), [], ["p"], "n", "s", 9).agg(F.max("s"), F.count_distinct("s")).first() == (120, 120)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert carry_forward(df.limit(0), ["k"], ["p"], "v", "x").count() == 0
    assert running_total(df.limit(0).withColumn("n", F.lit(1)), ["k"], ["p"], "n", "s", 3).count() == 0


@pytest.mark.parametrize("fan_bits", [2, 10])
def test_keyed_quantiles_are_exact(spark, fan_bits):
    rng = random.Random(2)
    rows = [("hot", rng.randint(-(10**12), 10**12)) for _ in range(800)] + [("ties", 7)] * 50 + [(None, 3), ("", None), ("nulls", None), ("one", 5)]
    rows += [(f"k{i % 90}", rng.randint(0, 10**6)) for i in range(300)]
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["k"]: r for r in skew.keyed_quantiles(spark.createDataFrame(rows, "k string, v long"), "k", "v", probs, fan_bits).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        want = [values[max(1, math.ceil(p * len(values))) - 1] for p in probs] if values else None
        assert got[key]["n_rows"] == sum(k == key for k, _ in rows) and got[key]["quantiles"] == want, key
    # with the cells joined instead of broadcast, and for heavy keys alone
    df = spark.createDataFrame(rows, "k string, v long")
    if fan_bits == 2:
        joined = {r["k"]: tuple(r) for r in skew.keyed_quantiles(df, "k", "v", [0.5], 9, broadcast_bytes=0).collect()}
        assert joined == {r["k"]: tuple(r) for r in skew.keyed_quantiles(df, "k", "v", [0.5], 9).collect()}
        heavy = skew.heavy_keys(df, "k", "v", 50 / len(rows)).collect()
        assert {r["k"] for r in heavy} == {"hot", "ties"} and {r["k"]: r["quantiles"] for r in heavy}["ties"] == [7]
    assert skew.keyed_quantiles(spark.createDataFrame([], "k string, v long"), "k", "v", probs).count() == 0


def test_token_profile_handles_nulls_and_repeats(spark):
    stream = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3)], "token string, rg long")
    postings = spark.createDataFrame([("a", [3, 1, 1, None]), ("a", None), ("a", []), ("b", [1]), (None, [9])], "token string, inverted_index array<long>")
    got = {r["token"]: (r["n_rows"], r["n_rgs"]) for r in skew.token_profile(stream, postings).collect()}
    assert got == {"a": (2, 2), None: (1, 1), "": (1, 0), "b": (0, 1)}


LAYOUTS = {
    "a": lambda i, c, m: f"2024-02-16 12:47:{i % 60:02d},636 info  [{c}] {m}",
    "b": lambda i, c, m: f"2024-05-04T18:52:{i % 60:02d}.437923Z  WARN {c}: {m}",
    "c": lambda i, c, m: f"17:20:{i % 60:02d}.323 |\x1b[31mcrit\x1b[0m| {c} | {m}\r",
    "d": lambda i, c, m: f'time=2025-01-13T16:24:{i % 60:02d}Z level=dbg pid=7 component={c} msg="{m}"',
    "e": lambda i, c, m: f"Feb  7 03:24:{i % 60:02d} host-{i % 3} {c}[{i}]: {m}",
    "f": lambda i, c, m: f'{{"ts": "2024-12-11T08:38:{i % 60:02d}.952+00:00", "lvl": "ERR", "logger": "{c}", "msg": "{m}"}}',
}
LEVEL = {"a": "INFO", "b": "WARN", "c": "FATAL", "d": "DEBUG", "e": "", "f": "ERROR"}
MESSAGES = ["opened segment {0} for shard m{0}", "query q{0} returned {0} rows: limit={0}", "poll found nothing", "config key k=on applied now {0}", "clock moved back by {0} ms"]


def test_log_entries_from_mined_layouts(spark):
    rows, want, i = [], {}, 0
    for name, form in LAYOUTS.items():
        for f in range(3):
            file = f"{name}{f}"
            rows.append((i, file, 0, "    at early.part(X.java:3)", 1))
            i += 1
            current = None
            for n in range(1, 40):
                kind = random.Random(i).random()
                if kind < 0.2:
                    rows.append((i, file, n * 2, random.Random(i).choice(["", None, "\tat a.b(C.java:1)", "    2024-07-24 18:12:01 x=0", "}", '  "k": 3,']), 1))
                    if current is not None:
                        want[current][0] += 1
                else:
                    c, m = random.Random(i).choice(["fm.builder", "rg_writer", "io.pool-3"]), MESSAGES[i % len(MESSAGES)].format(i)
                    rows.append((i, file, n * 2, form(i, c, m), 1))
                    current = i
                    want[i] = [1, LEVEL[name], c, m]
                i += 1
    rows += rows[::7]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no long, log_vector string, entry int").repartition(3)
    layouts = logparse.layouts_of((df, "log_vector"))
    got = {r["line_id"]: [r["n_lines"], r["log_level"], r["component"], r["message"]] for r in logparse.log_entries(df, layouts).collect()}
    assert got == want
    single = {r["line_id"]: r["message"] for r in logparse.single_lines(df.where("line_id < 5"), layouts, text="log_vector").collect()}
    assert single[0] == "at early.part(X.java:3)"
    empty = df.limit(0)
    assert logparse.layouts_of((empty, "log_vector")) == [] and logparse.log_entries(empty, []).count() == 0


def test_a_stray_line_does_not_cost_a_layout_its_headers():
    header = logparse.atoms_of("2024-02-16 12:47:01 [INFO] core: flushed pages")
    stray = logparse.atoms_of("2024-02-16 12:47:01 INFO one two three four five")
    assert logparse.block_of(header) == logparse.block_of(stray)
    found = logparse.merge_templates([(header, 1_000_000), (stray, 1)])
    kept = logparse.classify([{"template": list(t), "n": n} for t, n in found.items()])
    assert max(k["n"] for k in kept) >= 1_000_000


def test_common_subsequences_keep_order_and_mark_gaps():
    assert logparse.lcs(("a", "b", "c", "d"), ("a", "x", "c", "d")) == ["a", "*", "c", "d"]
    assert logparse.unescape('said \\"a\\" \\u00e9\\n') == 'said "a" é\n'


FILES = [(1, "%Y-%m-%d %T", "Europe/Berlin"), (2, "%b %e %H:%M:%S", None), (3, None, "UTC"), (4, "%a %b %d %H:%M:%S %Z %Y", "America/New_York"), (5, "%d.%m.%Y %H:%M:%S,%f", "Asia/Tokyo"), (6, "%Q bad", "Nowhere/None")]
STAMPS = [
    (1, 1, " 2024-10-27 02:30:00 ", None, "2024-10-27T00:30:00"),  # twice on the clock: the earlier
    (2, 1, "2024-03-31 02:30:00", 1711846410, "2024-03-31T00:53:30"),  # never on the clock: the stored time
    (3, 1, "2024-03-31 02:30:00", -1, None),
    (4, 2, "Feb 29 10:00:00", None, "2024-02-29T10:00:00"),
    (5, 2, "Dec 31 23:59:59", None, "2023-12-31T23:59:59"),
    (6, 3, "1704085760", None, "2024-01-01T05:09:20"),
    (7, 3, "1704085760123456789", None, "2024-01-01T05:09:20.123456"),
    (8, 3, "2025-01-04 18:30:55.527616707+0530", None, "2025-01-04T13:00:55.527616"),
    (9, 3, "253402300799", 253402300799, None),
    (10, 4, "Thu Dec 14 21:25:49 EST 2023", None, "2023-12-15T02:25:49"),
    (11, 5, "18.05.2023 15:19:16,928", None, "2023-05-18T06:19:16.928"),
    (12, 5, "32.05.2023 15:19:16,928", 1684423156, "2023-05-18T15:19:16"),
    (13, 6, "2024-01-01T00:00:00Z", None, "2024-01-01T00:00:00"),
    (14, 99, None, 1704085760000, "2024-01-01T05:09:20"),
    (15, None, "", None, None),
]


def test_instants(spark):
    closed = dt.datetime(2024, 6, 1)
    files = spark.createDataFrame([(i, f, z, closed, 1) for i, f, z in FILES], "file_id long, prefix_format string, zone_name string, closed_at timestamp, utc_us int")
    stamps = spark.createDataFrame([(*s[:4], 1) for s in STAMPS + STAMPS[:3]], "stamp_id long, file_id long, prefix_text string, epoch_ts long, posterior int")
    got = {r["stamp_id"]: r["utc_us"] for r in instants.normalise_instants(stamps, files).collect()}
    assert len(got) == len(STAMPS)
    for s in STAMPS:
        want = None if s[4] is None else round((dt.datetime.fromisoformat(s[4]) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        assert got[s[0]] == want, s
    assert instants.normalise_instants(stamps.limit(0), files.limit(0)).count() == 0
    assert strptime.java_pattern("%Y-%m-%d %T") == "yyyy-MM-dd HH:mm:ss" and strptime.compile_format("no directive") is None


def test_ambiguous_values_are_marked(spark):
    files = spark.createDataFrame([(1, "%H%M%S%y%m%d", None, None)], "file_id long, prefix_format string, zone_name string, closed_at timestamp")
    stamps = spark.createDataFrame([(1, 1, "101112240513", None), (2, 1, "1704085760", None)], "stamp_id long, file_id long, prefix_text string, epoch_ts long")
    got = {r["stamp_id"]: r for r in instants.normalise_instants(stamps, files).collect()}
    assert got[1]["interpretation"] == "declared" and got[2]["interpretation"] == "epoch" and not got[2]["ambiguous"]


def test_repeated_wall_times_and_years_are_ambiguous_unless_resolved(spark):
    closed = dt.datetime(2024, 10, 28)
    spec = "file_id long, prefix_format string, zone_name string, closed_at timestamp"
    files = spark.createDataFrame([(1, "%Y-%m-%d %T", "Europe/Berlin", closed), (2, "%b %e %H:%M:%S", None, dt.datetime(2024, 6, 1)), (3, "%b %e %H:%M:%S", None, dt.datetime(2024, 6, 1))], spec)
    us = lambda text: round((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    twice, early, late = "2024-10-27 02:30:00", us("2024-10-27T00:30:00"), us("2024-10-27T01:30:00")
    rows = [(1, 1, twice, None, early, None, True), (2, 1, twice, early // 10**6, early, early, False), (3, 1, twice, late // 10**6, early, late, True), (4, 1, twice, 1, early, None, True)]
    rows += [(5, 1, "2024-10-27 04:30:00", None, us("2024-10-27T03:30:00"), us("2024-10-27T03:30:00"), False)]
    rows += [(6, 2, "May 30 10:00:00", None, us("2024-05-30T10:00:00"), us("2024-05-30T10:00:00"), False)]
    rows += [(7, 3, "Jun  2 10:00:00", us("2022-06-02T10:00:00") // 10**6, us("2023-06-02T10:00:00"), us("2022-06-02T10:00:00"), True)]
    stamps = spark.createDataFrame([r[:4] for r in rows], "stamp_id long, file_id long, prefix_text string, epoch_ts long")
    got = {r["stamp_id"]: r for r in instants.normalise_instants(stamps, files).collect()}
    for i, _, _, _, want, likely, ambiguous in rows:
        assert (got[i]["utc_us"], got[i]["interpretation"], got[i]["ambiguous"]) == (want, "declared", ambiguous), i
        assert likely is None or got[i]["likely_us"] == likely, i


def test_the_order_of_a_date_is_told_by_its_source(spark):
    """EM decides what neither a declared format nor any fixed precedence can: a source without format whose days tell the order of its other dates."""
    closed = dt.datetime(2024, 12, 30)
    files = spark.createDataFrame([(1, None, None, closed), (2, None, "Europe/Berlin", closed), (3, "%Y", None, None), (4, None, None, closed)], "file_id long, prefix_format string, zone_name string, closed_at timestamp")
    stamps = [(100 + d, 1, f"{d:02d}/07/2024 10:00:00", None) for d in range(1, 29)] + [(200 + d, 2, f"07/{d:02d}/2024 10:00", None) for d in range(1, 29)]
    stamps += [(1, 1, "03/04/2024 10:00:00", None), (2, 2, "03/04/2024 10:00:00", None), (3, 3, "03/04/2024 10:00:00", None), (4, 1, "03/04/2024 10:00:00", 1_709_546_400)]
    stamps += [(5, 4, "2024.03.04 10:00:00.25 +02:00", None), (6, 4, "4 Mar 2024 10:00:00 PM", 99), (7, 4, "31/02/2024 10:00:00", None), (8, 4, "12:00", None)]
    df = spark.createDataFrame(stamps, "stamp_id long, file_id long, prefix_text string, epoch_ts long")
    got = {r["stamp_id"]: r for r in instants.normalise_instants(df, files).collect()}
    us = lambda text: round((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    assert (got[1]["likely_us"], got[1]["likely_as"], got[1]["ambiguous"], got[1]["utc_us"]) == (us("2024-04-03T10:00:00"), "dmy", False, None)
    assert (got[2]["likely_us"], got[2]["likely_as"]) == (us("2024-03-04T09:00:00"), "mdy")
    assert got[3]["ambiguous"] and got[3]["utc_us"] is None  # nothing tells
    assert (got[4]["utc_us"], got[4]["interpretation"]) == (1_709_546_400_000_000, "stored")  # the rule; what ingest stored speaks for the other order
    assert got[4]["likely_as"] == "mdy" and got[4]["likely_us"] == us("2024-03-04T10:00:00")
    assert (got[5]["likely_us"], got[5]["likely_as"]) == (us("2024-03-04T08:00:00.250000"), "ymd")
    assert (got[6]["likely_us"], got[6]["interpretation"]) == (us("2024-03-04T22:00:00"), "none")
    assert got[7]["likely_us"] is None and got[8]["likely_us"] is None


def test_epoch_units_are_weighed_apart():
    ms, ns = [None, None, None, None, 0], [0, None, None, None, 0]
    w = instants.em([(1, ms, 90), (3, ns, 10)], 12)
    assert w["epoch_ms"] > 0.85 and w["epoch_s"] == 0 and w["declared"] > w["epoch_ns"]


def test_planner_never_loses_a_row_group(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "beta:gamma", "x", "10036", "naïve", "a-b", "INFO"] + [f"t{i}" for i in range(60)]
    rows = [(i, i // 5, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))) for i in range(200)]
    lines = spark.createDataFrame(rows, "line_no long, rg long, log string").cache()
    index = planner.Index.of(tokens.inverted_index(lines).cache(), 40, 20)
    for _ in range(12):
        text = rng.choice(rows)[2]
        b = rng.randrange(len(text))
        q = text[b : b + rng.randint(1, 12)]
        found = planner.candidate_row_groups(index, [q])
        allowed = {r["rg"] for r in found.collect()} if found is not None else set(range(40))
        assert {r[1] for r in rows if q in r[2]} <= allowed, q
    assert planner.pieces(" : ") == [] and planner.candidate_row_groups(index, ["zzz absent"]).count() == 0


def test_classes_and_regex_literals(spark):
    for text in ["", "rep-113", "ABC", "xyz9", "é"]:
        assert spark.range(1).select(charclass.type_mask(F.lit(text)).alias("m")).first()["m"] == charclass.mask_of(text)
    assert charclass.mask_of("rep-113") == 53 and charclass.supersets(63) == [63]
    assert regexlit.required_literals("ab(c|d)ef*g") == ["ab", "e", "g"] and regexlit.required_literals("a.b") == []
    assert regexlit.parse("a*b*c").as_dict()["kind"] == "concat" and "star" in regexlit.pretty("a*b*c")
    with pytest.raises(regexlit.Unsupported):
        regexlit.parse("(a")


def test_compaction_and_dictionary_edges(spark):
    parts = spark.createDataFrame([(1, "a", [3, 1]), (1, "a", [1, 2]), (1, "half", [0, 1]), (4, "c", None)], "type int, token string, row_groups array<bigint>")
    merged = {r["token"]: list(r["row_groups"]) for r in tokens.compact_postings(parts).collect()}
    assert merged == {"a": [1, 2, 3], "half": [0, 1], "c": []}
    kept, common = tokens.split_dictionary(tokens.compact_postings(parts), 4)
    assert {r["token"] for r in common.collect()} == {"a"} and kept.count() == 2  # exactly half stays


def test_substrings_and_templates(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "banana"), (3, ""), (4, None)], "k long, t string")
    assert [r["n"] for r in df.where("k = 1").select(substrings.fm_count(F.col("t"), "aa").alias("n")).collect()] == [3]
    order = [r["start"] for r in substrings.suffix_array(df, "k", "t").where("k = 2").orderBy("rank").collect()]
    assert order == sorted(range(6), key=lambda i: "banana"[i:])
    lines = spark.createDataFrame([("took 5 ms",), ("took 7 ms",), ("odd",), (None,)], "log string")
    assert [tuple(r) for r in templates.mine_templates(lines, "log", 2).select("template", "n_lines").collect()] == [("took <*> ms", 2)]
