import pytest
from conftest import box_row, play

from courtlake.sources import constraints as K, files
from courtlake.sources.store import Conflict, Store, publish, transact

TEAMS = "team_code string, team_name string"
GAMES = "season int, gamecode int, home_team string, away_team string"


def teams(spark, *codes):
    return spark.createDataFrame([(c, f"Club {c}") for c in codes], TEAMS)


def games(spark, *rows):
    return spark.createDataFrame(list(rows), GAMES)


def load(spark, root, name, df):
    return transact(spark, root, lambda store: store.stage(name, df))[0].version


def codes(spark, root):
    return sorted(r.team_code for r in Store(spark, root).read("teams").collect())


def test_versions_and_seasons(spark, tmp_path):
    root = str(tmp_path)
    assert load(spark, root, "teams", teams(spark, "A", "B")) == 1
    assert load(spark, root, "games", games(spark, (2023, 1, "A", "B"), (2024, 1, "A", "B"))) == 2
    assert load(spark, root, "games", games(spark, (2024, 2, "B", "A"))) == 3
    got = Store(spark, root).read("games")
    assert sorted((r.season, r.gamecode) for r in got.collect()) == [(2023, 1), (2024, 2)]
    assert len(Store(spark, root).read("games", [2023]).inputFiles()) == 1
    assert files.names(spark, f"{root}/manifest") == [f"{n:012d}.json" for n in (1, 2, 3)]


def test_the_second_of_two_loads_of_one_version_fails(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, "teams", teams(spark, "A"))
    one, two = Store(spark, root), Store(spark, root)
    one.stage("teams", teams(spark, "A", "B"))
    two.stage("teams", teams(spark, "A", "C"))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert codes(spark, root) == ["A", "B"] and two.staged == []
    assert len(files.names(spark, f"{root}/teams")) == 2  # what it had staged is gone


def test_a_load_that_was_overtaken_is_made_again(spark, tmp_path):
    """Both loads' rows are there at the end, none is lost."""
    root, tries = str(tmp_path), []

    def add(code, first=lambda: None):
        def build(store):
            tries.append(code)
            stored = store.read("teams")
            if tries.count(code) == 1:
                first()
            store.stage("teams", stored.unionByName(teams(spark, code), allowMissingColumns=True))

        return transact(spark, root, build)[0].version

    assert add("C", first=lambda: add("A")) == 2
    assert codes(spark, root) == ["A", "C"] and tries == ["C", "A", "C"]


def test_a_load_that_is_always_overtaken_gives_up(spark, tmp_path):
    root = str(tmp_path)

    def build(store):
        store.stage("teams", teams(spark, "A"))
        other = Store(spark, root)
        other.stage("teams", teams(spark, "B"))
        other.commit()

    with pytest.raises(Conflict):
        transact(spark, root, build, attempts=2)
    assert Store(spark, root).version == 2 and codes(spark, root) == ["B"]


@pytest.mark.parametrize("bad, rule", [
    ((2024, None, "A", "B"), "gamecode is null"), ((2024, 2, "A", None), "away_team is null"), ((2024, 1, "B", "A"), "key is not unique"), ((2024, 9, "A", "X"), "away_team not in teams"),
])
def test_a_bad_load_changes_nothing(spark, tmp_path, bad, rule):
    root = str(tmp_path)
    load(spark, root, "teams", teams(spark, "A", "B"))
    with pytest.raises(K.ConstraintError) as e:
        load(spark, root, "games", games(spark, (2024, 1, "A", "B"), bad))
    assert e.value.found == [("games", rule, 1)]
    assert Store(spark, root).version == 1 and Store(spark, root).read("games").count() == 0


def test_references_may_be_met_by_the_same_load(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.stage("games", games(spark, (2024, 1, "A", "B")))
    store.stage("teams", teams(spark, "A", "B"))
    assert store.commit() == 1


def test_catalog_tables_follow_the_manifest(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, "teams", teams(spark, "A", "B"))
    load(spark, root, "teams", teams(spark, "A", "B", "C"))
    load(spark, root, "games", games(spark, (2023, 1, "A", "B"), (2024, 1, "A", "C")))
    load(spark, root, "games", games(spark, (2024, 2, "B", "C"), (2024, 3, "B", "A")))
    assert publish(spark, root, "league_test") == 4 == publish(spark, root, "league_test")
    assert spark.table("league_test.teams").count() == 3 and spark.table("league_test.boxscores").count() == 0
    assert sorted((r.season, r.gamecode) for r in spark.table("league_test.games").collect()) == [(2023, 1), (2024, 2), (2024, 3)]
    assert len(spark.table("league_test.games").where("season = 2024").inputFiles()) < len(spark.table("league_test.games").inputFiles())


def test_a_season_is_one_file_however_many_tasks_there_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("courtlake.sources.store.PARTITIONS_PER_STATEMENT", 7)
    root, conf = str(tmp_path), "spark.sql.adaptive.coalescePartitions.enabled"
    store, rows = Store(spark, root), [(s, g, "A", "B") for s in range(2000, 2030) for g in range(12)]
    spark.conf.set(conf, "false")
    try:
        store.stage("games", games(spark, *rows))
    finally:
        spark.conf.unset(conf)
    store.commit(checked=False)
    assert len(store.read("games").inputFiles()) == 30
    publish(spark, root, "seasons")
    assert sorted((r.season, r.gamecode) for r in spark.table("seasons.games").collect()) == [(s, g) for s, g, _, _ in rows]


def test_old_versions_can_go(spark, tmp_path):
    root = str(tmp_path)
    for n in range(4):
        load(spark, root, "teams", teams(spark, *"ABCD"[: n + 1]))
    Store(spark, root).tidy(keep=2)
    assert codes(spark, root) == list("ABCD") and len(files.names(spark, f"{root}/teams")) == 2
    assert load(spark, root, "teams", teams(spark, "Z")) == 5


def test_season_aggregates_are_made_by_a_small_plan(spark, make):
    """What several branches read is written in between, so that the driver does not hold it once per branch."""
    from courtlake.plans.season import aggregate_seasons

    class Kept:
        def __init__(self):
            self.spark, self.plan, self.rows = spark, "", []

        def read(self, name, seasons):
            if name == "boxscores":
                return make.box([box_row(f"{t}{i}", t, int(t == "A")) for t in "AB" for i in range(5)])
            return make.pbp([play(1, "2FGM", "A0", "A"), play(2, "OUT", "A0", "A"), play(3, "IN", "A7", "A"), play(4, "3FGM", "B1", "B")])

        def stage(self, name, df):
            self.plan, self.rows = df._jdf.queryExecution().executedPlan().toString(), df.collect()

    kept = Kept()
    aggregate_seasons(kept, [2024])
    assert 0 < kept.plan.count("Exchange") < 30
    assert {r.player_id: r.on_events for r in kept.rows}["A1"] == 4
