import random

from courtlake.operators import box as B, live_box as P, sequences as Q
from courtlake.plans.league import League
from courtlake.sources import files
from courtlake.streaming import live as R
from courtlake.streaming.log import FAN, GameLog, last_batches, of_batches
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

SF = "/root/testdata/sf0.001"


def plain_players(plays):
    """Seconds, points and rebounds per (team, player) from a game's plays, one by one."""
    plays = sorted(plays, key=lambda r: r.true_numberofplay)
    at = lambda r: r.period * 600 - r.clock_secs if r.period <= 4 else 2400 + (r.period - 4) * 300 - r.clock_secs
    now = max(at(r) for r in plays if r.markertime)
    out = {}
    for r in plays:
        if r.player_id:
            p = out.setdefault((r.codeteam, r.player_id), {"points": 0, "total_rebounds": 0, "subs": []})
            p["points"] += {"2FGM": 2, "3FGM": 3, "FTM": 1}.get(r.playtype, 0)
            p["total_rebounds"] += r.playtype in ("O", "D")
            if r.playtype in ("IN", "OUT"):
                p["subs"].append((r.playtype, at(r)))
    for p in out.values():
        subs = p.pop("subs")
        on, seconds = (0 if not subs or subs[0][0] == "OUT" else None), 0
        for kind, t in subs:
            seconds += t - on if on is not None else 0
            on = t if kind == "IN" else None
        p["seconds"] = max(seconds + (now - on if on is not None else 0), 0)
    return out


def test_stored_plays_are_not_sent_through_the_driver(spark, tmp_path):
    pbp = League(spark, SF).pbp
    pbp.where("true_numberofplay <= 60").write.parquet(f"{tmp_path}/stored")
    fresh = R.not_stored(pbp, spark.read.schema(pbp.schema).parquet(f"{tmp_path}/stored"))
    assert "BroadcastExchange" not in fresh._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(tuple, df.select(*R.PLAY_KEY).collect()))
    assert key(fresh) == key(pbp.where("true_numberofplay > 60"))


def test_slices_end_like_the_batch(spark, tmp_path):
    """A feed delivered in slices, the last plays first and one slice twice, is at any time what the plays so far say."""
    lg = League(spark, SF)
    raw = lg.raw("play_by_play").filter("Gamecode = 4")
    landing, out, cp = (str(tmp_path / n) for n in ("landing", "live", "cp"))
    batch = lg.pbp.filter("gamecode = 4")
    box = lg.box.filter("gamecode = 4")
    seen = set()
    for lo, hi in [(60, 100), (25, 70), (25, 70), (1, 30)]:
        raw.filter(f"TRUE_NUMBEROFPLAY BETWEEN {lo} AND {hi}").write.mode("append").parquet(landing)
        R.write_live_games(R.play_stream(spark, landing), box, out, cp).awaitTermination()
        seen |= set(range(lo, hi + 1))
        want = plain_players([r for r in batch.collect() if r.true_numberofplay in seen])
        got = {(r.team_code, r.player_id): r for r in R.latest_table(spark, out, "players").collect()}
        assert got.keys() == {k for k, p in want.items() if p["seconds"] > 0}
        assert all(r.points == want[k]["points"] and r.total_rebounds == want[k]["total_rebounds"] and round(r.minutes * 60) == want[k]["seconds"] for k, r in got.items())
    assert R.stored_plays(spark, out).count() == batch.count() == 100
    assert R.latest_table(spark, out, "scores").first() == Q.live_score(batch).first()
    wp = sorted((r.play_number, r.home_wp) for r in R.latest_table(spark, out, "win_probability").collect())
    assert wp == sorted((r.play_number, r.home_wp) for r in Q.win_probability_timeline(batch).collect())
    cur = {r.team: r.lineup for r in R.latest_table(spark, out, "current_lineups").collect()}
    assert cur == {r.team: r.lineup for r in R.current_lineups(batch, box).collect()}
    for name, want in (("run_history", Q.run_stoppers(batch)), ("active_run", Q.active_run(batch))):
        got = R.latest_table(spark, out, name)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_counts_add_up_in_any_slices(spark):
    plays = League(spark, SF).pbp.filter("gamecode < 4")
    whole = P.play_counts(plays)
    parts = [P.play_counts(plays.filter(f"true_numberofplay % 3 = {k}")) for k in (2, 0, 1)]
    order = lambda df: sorted(map(str, P.live_boxscore(df).collect()))
    assert order(P.add_counts(*parts)) == order(P.add_counts(P.add_counts(parts[0], parts[1]), parts[2])) == order(whole)
    assert B.advanced_stats(P.live_boxscore(whole)).count() == whole.filter("player_id IS NOT NULL").count()


SCHEMA = StructType([StructField(c, IntegerType()) for c in ("season", "gamecode", "n")])


def test_log_stays_small_and_whole(spark, tmp_path):
    """Twenty micro-batches: every row once, few segments and files, old ones gone."""
    log, rows = GameLog(spark, str(tmp_path / "log"), SCHEMA, ["n"]), []
    rng = random.Random(1)
    for n in range(20):
        new = [(2024 + rng.randrange(2), rng.randrange(300), 100 * n + k) for k in range(30)]
        rows += new
        segments = log.append(n, spark.createDataFrame(new, SCHEMA), len(new), {(s, g % 64) for s, g, _ in new})
        levels = [s["level"] for s in segments]
        assert all(levels.count(k) < FAN for k in levels) and len(segments) <= 2 * FAN
        assert len(files.names(spark, f"{tmp_path}/log/segments")) <= 4 * FAN
    assert sorted((r.season, r.gamecode, r.n) for r in log.read().collect()) == sorted(rows)
    held = {f.split("/")[-1] for s in log.segments() for f, season, bucket in s["files"] if (season, bucket) == (2024, 7)}
    some = log.read({(2024, 7)})
    assert {f.split("/")[-1] for f in some.inputFiles()} == held and len(held) <= 2 * FAN
    assert sorted(r.n for r in some.collect()) == sorted(n for s, g, n in rows if s == 2024 and g % 64 == 7)


def test_a_segment_of_many_files_is_indexed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("courtlake.streaming.log.FILE_ROWS", 50)
    monkeypatch.setattr("courtlake.streaming.log.SMALL_ROWS", 10)
    log, rows = GameLog(spark, str(tmp_path / "log"), SCHEMA, ["n"]), [(2024, k % 40, k) for k in range(400)]
    log.append(0, spark.createDataFrame(rows, SCHEMA), 400, {(2024, k) for k in range(40)})
    some = log.read({(2024, 3)})
    assert 1 <= len(some.inputFiles()) <= 2 < len(log.read().inputFiles()) and sorted(r.n for r in some.collect()) == list(range(3, 400, 40))


def test_a_log_of_many_seasons(spark, tmp_path):
    """The index has two numbers a season and file, and a choice of places is not spelt out in the query."""
    log, rows = GameLog(spark, str(tmp_path / "log"), SCHEMA), [(s, g, 0) for s in range(2000, 4000) for g in (3, 66, 127)]
    log.append(0, spark.createDataFrame(rows, SCHEMA), len(rows), {(s, g % 64) for s, g, _ in rows})
    assert len(files.read_text(spark, log._manifest(0))) < 40 * 2000
    assert {(season, bucket) for s in log.segments() for _, season, bucket in s["files"]} == {(s, b) for s, g, _ in rows for b in (2, 3, 63)}
    wanted = {(s, b) for s in range(2000, 4000, 2) for b in (3, 63)}
    got = log.read(wanted)
    assert sorted((r.season, r.gamecode) for r in got.collect()) == sorted((s, g) for s, g, _ in rows if (s, g % 64) in wanted)
    assert log.read({s: 1 << 2 for s in range(2000, 4000)}).count() == 2000 and log.read({1999: 1 << 3}).count() == 0


def test_a_repeated_micro_batch_replaces_itself(spark, tmp_path):
    log = GameLog(spark, str(tmp_path / "log"), SCHEMA)
    for n in range(5):
        for _ in range(1 + (n in (0, 3, 4))):  # at 3 the segments are merged
            log.append(n, spark.createDataFrame([(2024, 1, n)], SCHEMA), 1, {(2024, 1)})
    assert sorted(r.n for r in log.read().collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.n for r in log.read(before=4).collect()) == [0, 1, 2, 3]


def test_rows_that_no_longer_count_go_when_merged(spark, tmp_path):
    log, games = (GameLog(spark, str(tmp_path / n), SCHEMA) for n in ("log", "games"))
    for n in range(8):
        rows = spark.createDataFrame([(2024, 1, n), (2024, 2 + n, n)], SCHEMA)
        places = {(2024, 1), (2024, 2 + n)}
        games.append(n, rows, 2, places, lambda df: last_batches(df).withColumn("n", F.lit(0)))
        log.append(n, rows, 2, places, lambda df: of_batches(df, last_batches(games.read())))
    got = of_batches(log.read(), last_batches(games.read()))
    assert sorted((r.gamecode, r.n) for r in got.collect()) == [(1, 7)] + [(2 + n, n) for n in range(8)]
    assert log.read().count() < 16


def test_an_empty_log(spark, tmp_path):
    log = GameLog(spark, str(tmp_path / "log"), SCHEMA)
    assert log.read().collect() == [] and log.segments() == []
    log.append(0, spark.createDataFrame([], SCHEMA), 0, set())
    assert log.read().collect() == []


def test_claims(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    assert files.claim(spark, path, "a")
    assert not files.claim(spark, path, "b") and files.read_text(spark, path) == "a" and files.names(spark, str(tmp_path / "m")) == ["1.json"]
