import gzip
import os

import pytest

from courtlake.plans.queries_sources import put_lines
from courtlake.sources import feeds
from courtlake.sources.ingest import Landing

SCHEMA = "Season INT, Gamecode INT, Name STRING"


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)
    return path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_are_read_once_and_broken_records_put_aside(spark, tmp_path):
    land, x = tmp_path / "land", Landing(spark, str(tmp_path / "read"), SCHEMA)
    put(land, "s=1/a b+c%.json", '{"Season": 1, "Gamecode": 1, "Name": "A"}\n{"Season": 1, "Gam\n{"Season": "x", "Gamecode": 1}\n{"Season": 1, "Name": "no game"}\n')
    got = x.load([str(land), str(tmp_path / "nowhere"), str(land / "s=9*")])
    assert got == (1, 1, 1, 3)
    assert x.load([str(land)]) == (0, 0, 0, 0)
    put(land, "s=2/b.json.gz", gzip.compress(b'{"Season": 2, "Gamecode": 5, "Name": "B"}\n'))
    put(land, "s=2/empty.json", "")
    assert x.load([str(land)]) == (2, 1, 1, 0)
    assert rows(x.rows()) == [(1, 1, "A"), (2, 5, "B")]
    aside = x.aside().collect()
    assert sorted(r.reason for r in aside) == ["no Gamecode", "unreadable record", "unreadable record"] and all("s=1" in r.file for r in aside)
    assert {r.record for r in aside} >= {'{"Season": 1, "Gam'}
    assert sorted((r.load, os.path.basename(r.file)[0]) for r in x.ledger().collect()) == [(1, "a"), (2, "b")]


def test_a_changed_file_is_read_again(spark, tmp_path):
    x, path = Landing(spark, str(tmp_path / "read"), SCHEMA, "csv"), put(tmp_path / "land", "a.csv", "1,1,A\n")
    x.load([path])
    put(tmp_path / "land", "a.csv", "1,1,A\n1,2,B\n1,?,C\n")
    assert x.load([path]) == (2, 1, 2, 1)
    assert rows(x.rows()) == [(1, 1, "A"), (1, 1, "A"), (1, 2, "B")]


def test_a_broken_parquet_file_is_put_aside(spark, tmp_path):
    land, x = str(tmp_path / "land"), Landing(spark, str(tmp_path / "read"), SCHEMA, "parquet")
    spark.createDataFrame([(1, 1, "A"), (None, 2, "B")], SCHEMA).coalesce(1).write.parquet(land)
    put(land, "broken.parquet", b"PAR1 this is no parquet file PAR1")
    assert x.load([land])[1:] == (2, 1, 2)
    assert sorted((r.reason, os.path.basename(r.file) == "broken.parquet") for r in x.aside().collect()) == [("no Season", False), ("unreadable file", True)]


def test_nothing_landed(spark, tmp_path):
    x = Landing(spark, str(tmp_path / "read"), SCHEMA)
    assert x.load([str(tmp_path / "nowhere")]) == (0, 0, 0, 0)
    assert x.rows().collect() == x.aside().collect() == x.ledger().collect() == []
    assert feeds.read_boxscores(spark, str(tmp_path / "no.json")).collect() == []
    assert feeds.read_shots(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).columns


def test_of_two_loads_at_once_one_starts_again(spark, tmp_path, monkeypatch):
    land = put(tmp_path / "land", "a.json", '{"Season": 1, "Gamecode": 1, "Name": "A"}\n')
    one, two = (Landing(spark, str(tmp_path / "read"), SCHEMA) for _ in range(2))
    read = one._read
    monkeypatch.setattr(one, "_read", lambda names: (two.load([land]), read(names))[1])
    with pytest.raises(RuntimeError):
        one.load([land])
    assert rows(one.rows()) == [(1, 1, "A")] and one.load([land]) == (0, 0, 0, 0)


def test_many_files_are_looked_up_by_few_tasks(spark, tmp_path):
    context = spark.sparkContext
    most, key = 4 * context.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    names = [put(tmp_path, f"{n}.json", f'{{"Season": 1, "Gamecode": {n}, "Name": "A"}}\n') for n in range(most + 40)]
    before = spark.conf.get(key)
    context.setJobGroup("lookup", "lookup")
    try:
        read = Landing(spark, str(tmp_path / "read"), SCHEMA)._read(names)
        tracker = context.statusTracker()
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("lookup") for s in tracker.getJobInfo(j).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= most and spark.conf.get(key) == before
    assert sorted(r.Gamecode for r in read.collect()) == list(range(most + 40))


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    context, n, key = spark.sparkContext, 240, "spark.sql.files.maxPartitionBytes"
    for i in range(n):
        put(tmp_path / "land", f"g={i}/a.json", f'{{"Season": 1, "Gamecode": {i}, "Name": "A"}}\n')
    before = spark.conf.get(key)
    spark.conf.set(key, "16m")
    context.setJobGroup("many", "many")
    try:
        assert Landing(spark, str(tmp_path / "read"), SCHEMA).load([str(tmp_path / "land" / "g=*")]) == (1, n, n, 0)
        tracker = context.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("many") for s in tracker.getJobInfo(j).stageIds]
        tasks = [x.numTasks for s in stages if (x := tracker.getStageInfo(s))]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(key, before)
    assert tasks and max(tasks) <= 4 * context.defaultParallelism


def test_lines_land_as_one_file_a_game(spark, tmp_path):
    want = {(g % 2, 2024 + g // 50, g): [f"line {g} {k} é" for k in range(3)] for g in range(100)}
    lines = spark.createDataFrame([(*key, v) for key, vs in want.items() for v in vs], "half int, s int, g int, value string").repartition(7)
    put_lines(lines, str(tmp_path / "land"))
    found = [os.path.join(d, n) for d, _, names in os.walk(tmp_path / "land") for n in names]
    assert len(found) == len(want) and {os.path.basename(f) for f in found} == {"game.txt"}
    for (half, s, g), vs in want.items():
        with open(tmp_path / "land" / f"half={half}" / f"s={s}" / f"g={g}" / "game.txt", encoding="utf-8") as f:
            assert sorted(f.read().splitlines()) == sorted(vs)
