"""Assists, the shots they created, and shot quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X
from courtlake.functions.scans import running

_G = C.GAME_KEYS


def assist_pairs(pbp: DataFrame, block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Every AS row whose last non-AS row before it is a made two or three by the same team."""
    basket = F.when(
        F.col("playtype") != "AS",
        F.struct("playtype", "codeteam", "player_id", "player", "period", "clock_secs", F.col("numberofplay")),
    )
    rows = running(pbp, _G, C.PLAY_ORDER, previous={"shot": basket}, block=block)
    linked = (F.col("playtype") == "AS") & F.col("shot.playtype").isin("2FGM", "3FGM") & (
        F.col("shot.codeteam") == F.col("codeteam")
    )
    return rows.filter(linked).select(
        *_G, F.col(C.PLAY_ORDER).alias("assist_play"), F.col("player_id").alias("passer_id"), F.col("player").alias("passer_name"),
        F.col("shot.player_id").alias("shooter_id"), F.col("shot.player").alias("shooter_name"),
        F.col("codeteam").alias("team"), F.when(F.col("shot.playtype") == "3FGM", 3).otherwise(2).alias("shot_value"),
        F.col("shot.playtype").alias("play_type"), F.col("shot.period").alias("period"),
        F.col("shot.clock_secs").alias("clock_secs"), F.col("shot.numberofplay").alias("numberofplay"),
    )


def assist_network(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(
        *_G, F.col("passer_id").alias("assister_id"), F.col("passer_name").alias("assister_name"),
        F.col("shooter_id").alias("scorer_id"), F.col("shooter_name").alias("scorer_name"), "team",
    ).agg(
        F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("play_type")), ", ").alias("play_types")
    )


def assist_matrix(links: DataFrame, value: str = "count") -> DataFrame:
    """The matrix of passers and scorers in long form: a row per cell that is not zero, for every player.
    A passer's row as a map is ``map_from_entries(collect_list(struct(shooter_id, value)))`` over it."""
    cell = F.count(F.lit(1)) if value == "count" else F.sum(value)
    return links.groupBy("season", "team", "passer_id", "shooter_id").agg(cell.alias(value))


def link_assists_to_shots(pairs: DataFrame, shots: DataFrame) -> DataFrame:
    """Assist pairs with the coordinates of the matching made shot and its expected points.

    In play order, each assist takes the nearest shot in time of the same (game, shooter, action) that no earlier one has taken, of equally near
    ones the first. Assists and shots meet in one exchange; the match is a fold over a group's assists whose state is the shots left.
    A group is what one player made in one game by one kind of action.
    """
    key = ["season", "gamecode", "shooter_id", "play_type"]
    rest = [c for c in pairs.columns if c not in key]
    at = (F.col("period") - 1) * 10 + (10 - F.col("clock_secs") / 60.0)
    asked = pairs.select(*key, F.struct("assist_play", at.cast("double").alias("at"), F.struct(*rest).alias("pair")).alias("asked"), F.lit(None).alias("made"))
    shot = F.struct("num_anot", F.col("minute").cast("double").alias("at"), "coord_x", "coord_y", "zone")
    made = shots.filter((F.col("points") > 0) & F.col("id_player").isNotNull()).select(
        *_G, F.col("id_player").alias("shooter_id"), F.col("id_action").alias("play_type"), F.lit(None).alias("asked"), shot.alias("made"))
    group = asked.unionByName(made).groupBy(*key).agg(F.array_sort(F.collect_list("asked")).alias("asked"), F.array_sort(F.collect_list("made")).alias("free"))
    group = group.where(F.size("asked") > 0)

    none = F.lit(None).cast(group.schema["free"].dataType.elementType)
    start = F.struct(F.col("free").alias("free"), F.filter(F.array(F.struct(F.element_at("asked", 1)["pair"].alias("pair"), none.alias("shot"))), lambda x: F.lit(False)).alias("done"))

    def take(state, a):
        near = F.array_min(F.transform(state["free"], lambda s: F.struct(F.abs(s["at"] - a["at"]).alias("d"), s["num_anot"].alias("n"), s.alias("shot"))))["shot"]
        left = F.filter(state["free"], lambda s: ~s.eqNullSafe(near))
        return F.struct(left.alias("free"), F.concat(state["done"], F.array(F.struct(a["pair"].alias("pair"), near.alias("shot")))).alias("done"))

    linked = group.select(*key, F.explode(F.aggregate("asked", start, take, lambda state: state["done"])).alias("x"))
    out = linked.select(*key, "x.pair.*", *[F.col(f"x.shot.{c}").alias(c) for c in ("coord_x", "coord_y", "zone", "num_anot")])
    return out.select(*pairs.columns, "coord_x", "coord_y", "zone", "num_anot").withColumn("xp", X.baseline_xp("coord_x", "coord_y", "shot_value"))


def passer_quality(links: DataFrame, min_assists: int = 10) -> DataFrame:
    return links.groupBy("season", "passer_id", "passer_name", "team").agg(
        F.count("*").alias("total_assists"), F.avg("xp").alias("aaq")
    ).filter(F.col("total_assists") >= min_assists)


def finisher_quality(links: DataFrame) -> DataFrame:
    return links.groupBy("season", "shooter_id", "shooter_name", "team").agg(
        F.count("*").alias("assisted_shots"), F.sum("xp").alias("axp_total"), F.avg("xp").alias("axp_avg")
    )


def duo_quality(links: DataFrame) -> DataFrame:
    return links.groupBy("season", "passer_id", "passer_name", "shooter_id", "shooter_name", "team").agg(
        F.count("*").alias("assists"), F.sum("xp").alias("duo_xp")
    )


def shot_quality(shots: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Player points against what the zones he shot from usually return, per ``scope`` (default: season)."""
    scope = scope or ["season"]
    zones = shots.filter(F.col("zone").isNotNull()).groupBy(*scope, "zone").agg(
        F.count("*").alias("n"), F.sum("made").alias("m"), F.sum("shot_value").alias("v")
    ).select(*scope, "zone", (F.col("m") / F.col("n") * (F.col("v") / F.col("n"))).alias("expected_pts"))
    # Players are summed per zone first, so the join carries zone rows instead of shots.
    per_zone = shots.groupBy(*scope, "id_player", "player", "team", "zone").agg(
        F.count("*").alias("n"), F.sum("made").alias("m"), F.sum("points").alias("p")
    )
    exp = F.col("expected_pts")
    return (
        per_zone.join(zones, [*scope, "zone"], "left")
        .groupBy(*scope, "id_player", "player", "team")
        .agg(
            F.sum("n").alias("total_shots"), F.sum("m").alias("makes"), F.sum("p").alias("actual_pts"),
            (F.sum(exp * F.col("n")) / F.sum(F.when(exp.isNotNull(), F.col("n")))).alias("avg_expected_pts"),
            F.coalesce(F.sum(exp * F.col("n")), F.lit(0.0)).alias("total_expected_pts"),
        )
        .withColumns(
            {
                "fg_pct": F.col("makes") / F.col("total_shots"),
                "shot_quality_diff": F.col("actual_pts") - F.col("total_expected_pts"),
            }
        )
    )


def field_goals(shots: DataFrame) -> DataFrame:
    return shots.filter(F.col("id_action").isin(C.FIELD_GOAL_PLAYS)).withColumn(
        "outcome", F.when(F.col("points") > 0, "Made").otherwise("Missed")
    )


def shooting_summary(shots: DataFrame) -> DataFrame:
    fg = field_goals(shots).filter(F.col("coord_x").isNotNull() & F.col("coord_y").isNotNull())
    two, three, made = F.col("id_action").startswith("2"), F.col("id_action").startswith("3"), F.col("points") > 0
    pct = lambda n, d: X.ratio0(n, d)
    return fg.groupBy(*_G, "id_player", "player", "team").agg(
        F.count("*").alias("attempts"), F.count_if(made).alias("made"),
        F.count_if(two).alias("fga2"), F.count_if(two & made).alias("fgm2"),
        F.count_if(three).alias("fga3"), F.count_if(three & made).alias("fgm3"),
    ).withColumns({"fg_pct": pct("made", "attempts"), "fg2_pct": pct("fgm2", "fga2"), "fg3_pct": pct("fgm3", "fga3")})


def zone_summary(shots: DataFrame) -> DataFrame:
    return field_goals(shots).filter(F.col("zone").isNotNull()).groupBy(*_G, "zone").agg(
        F.count("*").alias("shots"), F.count_if(F.col("points") > 0).alias("made")
    ).withColumn("fg_pct", F.col("made") / F.col("shots"))


def shot_density(shots: DataFrame, bin_size: int = 50) -> DataFrame:
    return field_goals(shots).filter(F.col("coord_x").isNotNull() & F.col("coord_y").isNotNull()).groupBy(
        "season", "team", F.floor(F.col("coord_x") / bin_size).alias("bin_x"), F.floor(F.col("coord_y") / bin_size).alias("bin_y")
    ).agg(F.count("*").alias("shots"))
