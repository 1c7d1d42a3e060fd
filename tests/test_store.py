"""Stored index: searches equal a plain scan, whatever the row group size; ingest keeps what it must keep."""

import os
import random

import pytest

from tarnlake import api, cli
from tarnlake.functions import strptime
from tarnlake.sources import lines as L
from tarnlake.sources import store
from tarnlake.streaming import tail
from tarnlake.streaming.tail import settle, start_tail

WORDS = ["INFO", "a:b", "rep-113", "naïve", "10036", "worker=7", "flush", "x", "2024-01-01", "[core]", "日本", "tab\there"]


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    rng = random.Random(3)
    for f in range(4):
        rows = []
        for i in range(150):
            rows.append(f"2024-01-0{f + 1} 00:00:{i % 60:02d} " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) + f" id{f}_{i}")
            if i % 40 == 0:
                rows.append("")
            if i % 50 == 0:
                rows.append("no stamp here\r")
        (d / f"{f}.log").write_text("\n".join(rows) + ("" if f == 2 else "\n"), newline="")
    (d / "_hidden").write_text("hidden secret\n")
    (d / ".dot").write_text("hidden secret\n")
    return str(d)


def plain(directory):
    out = []
    for name in sorted(os.listdir(directory)):
        if name[0] not in "_.":
            out += [x for x in open(f"{directory}/{name}", newline="").read().split("\n") if x]
    return out


@pytest.mark.parametrize("row_group", [7, 100_000])
def test_pruned_search_equals_scan(spark, logs, tmp_path, row_group):
    index = str(tmp_path / "ix")
    api.index_logs(spark, logs, index, prefix_bytes=19, prefix_format="%Y-%m-%d %T", row_group=row_group)
    lines = plain(logs)
    for q in ["id1_77", "rep-1", "naïve", "a:b INFO", ": ", "0036 f", "absent!", "日", "here\r"]:
        got = sorted(r["log"] for r in api.search(spark, index, q, 10_000).collect())
        assert got == sorted(x for x in lines if q in x), q
    got = sorted(r["log"] for r in api.search(spark, index, "id(1|2)_7", 10_000, mode="regex").collect())
    assert got == sorted(x for x in lines if "id1_7" in x or "id2_7" in x)
    assert api.search(spark, index, "hidden secret", 5).count() == 0
    if row_group == 7:
        assert any(read < n for _, n, read in api.explain_search(spark, index, "id1_77"))


def test_limits_overwrite_and_times(spark, logs, tmp_path):
    index = str(tmp_path / "ix")
    api.index_logs(spark, logs, index, prefix_bytes=19, prefix_format="%Y-%m-%d %T", row_group=50)
    assert api.search(spark, index, "INFO", 5).count() == 5
    with pytest.raises(FileExistsError):
        api.index_logs(spark, logs, index)
    rows = spark.read.parquet(f"{index}/lines").orderBy("line_no").collect()
    assert [r["log"] for r in rows] == plain(logs) and [r["line_no"] for r in rows] == list(range(len(rows)))
    stampless = [r for r in rows if r["log"].startswith("no stamp")]
    assert stampless and all(r["epoch"] > 1_700_000_000 for r in stampless)
    assert api.search(spark, str(tmp_path / "none"), "x", 5).count() == 0
    found = api.search(spark, index, "no stamp", 10, distinct=True).collect()
    assert len(found) == 1


def test_splits_newest_first_and_compaction(spark, logs, tmp_path):
    files = store.list_files(spark, logs)
    size = files[0][1]
    planned = store.plan_files(files, size, 2 * size)
    assert [g for _, g, _ in planned] == sorted(g for _, g, _ in planned) and planned[-1][2] >= 1
    index = str(tmp_path / "ix")
    store.write_split(store.ingest_group(spark, planned, row_group=50), index, 50)
    assert store.splits_of(spark, index)[0] == planned[-1][2]
    first = api.search(spark, index, "id", 3).collect()
    assert {r["split"] for r in first} == {planned[-1][2]}
    merged = str(tmp_path / "merged")
    api.compact_split(spark, index, store.splits_of(spark, index), merged, row_group=50)
    assert sorted(r["log"] for r in spark.read.parquet(f"{merged}/lines").collect()) == sorted(plain(logs))
    assert api.search(spark, merged, "id2_14", 1000).count() == sum("id2_14" in x for x in plain(logs))


def test_distinct_lines_count_once_over_splits(spark, tmp_path):
    texts = {3: [f"hit {i}" for i in range(6)] * 2, 2: [f"hit {i}" for i in range(2, 8)], 1: ["hit 0", "miss"], 0: [f"hit old {i}" for i in range(9)]}
    rows = [(s, f"f{s}", i, i // 4, None, x) for s, lines in texts.items() for i, x in enumerate(lines)]
    store.write_split(spark.createDataFrame(rows, api.RESULT), str(tmp_path / "ix"), 4)
    first = {}
    for s, _, i, _, _, x in sorted(rows, key=lambda r: (-r[0], r[2])):
        if "hit" in x:
            first.setdefault(x, (s, i, x))
    for limit in (5, 6, 7, 10, 30):
        got = [(r["split"], r["line_no"], r["log"]) for r in api.search(spark, str(tmp_path / "ix"), "hit", limit, distinct=True).collect()]
        assert got == list(first.values())[:limit], limit


@pytest.mark.parametrize("codec", ["snappy", "lz4"])
def test_codecs_round_trip(spark, tmp_path, codec):
    df = spark.createDataFrame([(0, "f", 0, 0, None, "This is a test string for compression.")], api.RESULT)
    store.write_split(df, str(tmp_path / codec), codec=codec)
    assert [r["log"] for r in spark.read.parquet(str(tmp_path / codec / "lines")).collect()] == ["This is a test string for compression."]


def test_names_with_blanks_percent_and_glob_signs(spark, tmp_path):
    d = tmp_path / "odd"
    d.mkdir()
    names = ["a.log", "b c.log", "d%20e.log", "f+g.log", "h[1].log", "i*.log", "ünï.log", "j{k,l}.log", "m?.log"]
    for n in names:
        (d / n).write_text("".join(f"{n} row {i}\n" for i in range(50)))
    index = str(tmp_path / "ix")
    api.index_logs(spark, str(d), index, row_group=20)
    got = store.committed(spark, index, "lines").orderBy("line_no").collect()
    assert [(r["file"], r["log"]) for r in got] == [(n, f"{n} row {i}") for n in sorted(names) for i in range(50)]
    assert [r["line_no"] for r in got] == list(range(50 * len(names)))
    with pytest.raises(Exception, match="no split is planned"):
        L.number_file_lines(L.read_lines(spark, str(d)), spark.createDataFrame([("a.log", 0)], "name string, split int")).collect()


@pytest.mark.parametrize("step", ["_write_grams", "_commit"])
def test_a_broken_write_shows_nothing_and_is_taken_up_again(spark, logs, tmp_path, monkeypatch, step):
    index = str(tmp_path / "ix")
    files = store.list_files(spark, logs)
    args = dict(index_interval=0, compaction_interval=0, row_group=50, splits_a_job=1)
    calls, real = [], getattr(store, step)

    def fails(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(store, step, fails)
    with pytest.raises(RuntimeError):
        api.index_logs(spark, logs, index, **args)
    monkeypatch.undo()
    assert store.splits_of(spark, index) == [1, 0]  # the third split is not there at all
    assert api.search(spark, index, "id2_", 1000).count() == 0 and api.search(spark, index, "id1_", 1000).count() == 150
    assert api.index_logs(spark, logs, index, resume=True, **args) == len(files)
    got = store.committed(spark, index, "lines").orderBy("split", "line_no").collect()
    assert [r["log"] for r in got] == plain(logs)
    with pytest.raises(FileExistsError):
        store.write_split(store.committed(spark, index, "lines"), index, splits=[1])


def test_a_missing_index_table_is_an_error(spark, logs, tmp_path):
    index = str(tmp_path / "ix")
    api.index_logs(spark, logs, index, row_group=50)
    store.remove(spark, f"{index}/grams")
    store.remove(spark, f"{index}/_commits/0")
    store.write_marker(spark, f"{index}/_commits/0", {"lines": 5, "row_groups": 1, "grams": 0})
    with pytest.raises(FileNotFoundError):
        api.search(spark, index, "flush", 5)


def test_compaction_in_place_replaces_splits_at_once(spark, logs, tmp_path):
    index = str(tmp_path / "ix")
    api.index_logs(spark, logs, index, index_interval=0, compaction_interval=0, row_group=40)
    before = {q: sorted(r["log"] for r in api.search(spark, index, q, 10_000).collect()) for q in ("flush", "id1_77", "rep-1", "a:b INFO")}
    store.compact_splits(spark, index, [0, 1, 2], index, 9, 40)
    assert store.splits_of(spark, index) == [9, 3]
    assert {q: sorted(r["log"] for r in api.search(spark, index, q, 10_000).collect()) for q in before} == before
    assert [(n, c) for n, _, c in api.explain_search(spark, index, "id1_77")] == [(9, 1), (3, 0)]
    rows = store.committed(spark, index, "lines").where("split = 9").orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == list(range(len(rows)))
    with pytest.raises(FileExistsError):
        store.compact_splits(spark, index, [3], index, 9)
    with pytest.raises(FileNotFoundError):
        store.compact_splits(spark, index, [0], index, 10)


def test_waves_of_splits_and_limits(spark, tmp_path):
    rows = [(s, f"f{s}", i, i // 3, None, f"word{s % 3} n{s}_{i}") for s in range(12) for i in range(7)]
    index = str(tmp_path / "ix")
    store.write_split(spark.createDataFrame(rows, api.RESULT), index, 3)
    want = [(s, i) for s in range(11, -1, -1) for i in range(7) if s % 3 == 1]
    for limit in (3, 7, 8, 20, 100):
        got = [(r["split"], r["line_no"]) for r in api.search(spark, index, "word1", limit).collect()]
        assert got == want[:limit]


def test_tail_leaves_the_active_file_and_indexes_the_rest(spark, tmp_path):
    d, inbox, index = tmp_path / "in", str(tmp_path / "inbox"), str(tmp_path / "ix")
    d.mkdir()
    for i in range(3):
        (d / f"{i} x.log").write_text("".join(f"line {i} {k} tail\n" for k in range(20)))
        os.utime(d / f"{i} x.log", (1_700_000_000 + i, 1_700_000_000 + i))
    assert len(settle(spark, str(d), inbox)) == 2 and [x for x in os.listdir(d) if not x.startswith(".")] == ["2 x.log"]
    run = lambda **k: start_tail(spark, inbox, index, index_bytes=100, once=True, row_group=10, **k).awaitTermination()
    run()
    assert api.search(spark, index, "tail", 1000).count() == 40
    assert {r["file"] for r in api.search(spark, index, "tail", 1000).collect()} == {"0 x.log", "1 x.log"}
    (d / "3.log").write_text("line 3 newest\n")
    settle(spark, str(d), inbox)
    run()
    assert api.search(spark, index, "line 2", 1000).count() == 20 and len(store.splits_of(spark, index)) == 2
    # a name that is used again is a new file; splits are merged once they hold enough
    os.utime(d / "3.log", (1_700_000_009, 1_700_000_009))
    (d / "0 x.log").write_text("line 0 again\n" * 20)
    os.utime(d / "0 x.log", (1_700_000_008, 1_700_000_008))
    settle(spark, str(d), inbox)
    run(compaction_bytes=1)
    assert len(store.splits_of(spark, index)) == 1 and api.search(spark, index, "line", 1000).count() == 80
    assert len([x for x in os.listdir(inbox) if not x.startswith(".")]) == 1  # only the files of the last batch are left


@pytest.mark.parametrize("where", ["before commit", "after commit"])
def test_a_replayed_batch_is_indexed_once(spark, tmp_path, monkeypatch, where):
    index, inbox = str(tmp_path / "ix"), str(tmp_path / "inbox")
    batch = lambda n: spark.createDataFrame([(f"{n:013d}-f{n}", 0, f"batch {n} line {i}") for i in range(30)], "name string, block_start long, log string").coalesce(1)
    take = lambda n: tail.take_batch(batch(n), n, inbox, index, 10, 1 << 40, 0, None, 10)
    take(0)
    name = {"before commit": "_commit", "after commit": None, "after sweep": None}[where]
    if name:
        monkeypatch.setattr(store, name, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            take(1)
        monkeypatch.undo()
    elif where == "after commit":
        monkeypatch.setattr(tail, "_sweep", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            take(1)
        monkeypatch.undo()
    else:
        take(1)
    take(1)
    take(2)
    got = sorted(r["log"] for r in store.committed(spark, index, "lines").collect())
    assert got == sorted(f"batch {n} line {i}" for n in range(3) for i in range(30))
    assert store.splits_of(spark, index) == [2, 1, 0]


def test_formats_at_ingest(spark, tmp_path):
    assert strptime.java_pattern("%A %h %n") == "EEEE MMM  " and strptime.java_pattern("%s") == strptime.EPOCH_SECONDS
    with pytest.raises(ValueError):
        strptime.java_pattern("%s %Y")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("1700000000 one\nno stamp\n12 old\n1700000007 two\n")
    api.index_logs(spark, str(tmp_path / "in"), str(tmp_path / "ix"), prefix_bytes=10, prefix_format="%s", row_group=2)
    got = [r["epoch"] for r in store.committed(spark, str(tmp_path / "ix"), "lines").orderBy("line_no").collect()]
    assert got == [1700000000, 1700000000, 1700000000, 1700000007]


def test_command_line(spark, logs, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    index, out = str(tmp_path / "ix"), str(tmp_path / "out")
    assert cli.main(["index", "--dir", logs, "--index_name", index, "--row_group", "50"]) == 0
    assert cli.main(["search", "--index_path", index, "--query", "id1_7", "--output", out]) == 0
    assert spark.read.parquet(out).count() == sum("id1_7" in x for x in plain(logs))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        cli.main(["search", "--index_path", index, "--query", "id1_7", "--output", out])
    assert cli.main(["search", "--index_path", index, "--query", "id1_7", "--output", out, "--overwrite", "--distinct"]) == 0


def test_line_reader_keeps_carriage_returns(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\ntwo")
    assert sorted(r["log"] for r in L.read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["one\r", "two"]
