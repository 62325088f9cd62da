"""Feature tables, Spark ML pipelines and batch scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X
from courtlake.functions.scans import running
from courtlake.operators import windows as W

_G = C.GAME_KEYS


# -- game outcome -------------------------------------------------------------
def _attach_sides(fixtures: DataFrame, per_team: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    for side in ("home", "away"):
        values = per_team.select(*keys, F.col("team_code").alias(f"{side}_team"), F.col(column).alias(f"{side}_{name}"))
        fixtures = fixtures.join(values, [*keys, f"{side}_team"], "left")
    return fixtures


def _with_ratings(df: DataFrame, efficiency: DataFrame) -> DataFrame:
    df = _attach_sides(df, efficiency, ["season"], "net_rtg", "net_rtg").na.fill(0.0, ["home_net_rtg", "away_net_rtg"])
    return df.withColumns(
        {"net_rtg_diff": F.col("home_net_rtg") - F.col("away_net_rtg"), "home_court_adv": F.lit(1)}
    )


def game_features(games: DataFrame, efficiency: DataFrame, played_only: bool = True) -> DataFrame:
    """Net ratings, form, rest and the label of every game."""
    df = games.select(*_G, "round", "home_team", "away_team", "home_score", "away_score", "played")
    if played_only:
        df = df.filter(F.col("played") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    df = _with_ratings(df, efficiency)
    df = _attach_sides(df, W.recent_form(games), _G, "form", "form_5")
    df = _attach_sides(df, W.rest_days(games), _G, "rest_days", "rest_days")
    return df.select(
        *_G, "round", "home_team", "away_team", *C.GAME_FEATURES,
        F.when(F.col("home_score") > F.col("away_score"), 1).otherwise(0).alias("home_win"),
    )


def _scaled(features: list[str], mean: bool = True) -> list:
    return [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=mean, withStd=True),
    ]


TRAINING_TASKS = 16
ROW_KEYS = ["season", "gamecode", "team", "lineup", "team_code", "month_index"]


def _training_rows(df: DataFrame, min_rows: int, tasks: int = TRAINING_TASKS) -> tuple[DataFrame | None, int]:
    """The training rows, kept, dealt to a fixed number of tasks by the hash of their key and ordered by it; boosting passes over
    them hundreds of times. Its subsample is drawn by task and position, so the layout must depend neither on the rows' count nor on
    how they arrive."""
    keys = [c for c in ROW_KEYS if c in df.columns]
    rows = df.repartition(tasks, *keys).sortWithinPartitions(*keys).persist()
    n = rows.count()
    if n < min_rows:
        rows.unpersist()
        return None, n
    return rows, n


def train_win_model(features: DataFrame, min_rows: int = 20) -> PipelineModel | None:
    """Standardised logistic regression over all seasons given; None below ``min_rows`` games."""
    features, n = _training_rows(features, min_rows)
    if features is None:
        return None
    clf = LogisticRegression(labelCol="home_win", maxIter=1000, regParam=1.0 / n, standardization=False)
    return Pipeline(stages=[*_scaled(C.GAME_FEATURES), clf]).fit(features)


def predict_games(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """Probabilities of home wins; no rows without a model."""
    if model is None:
        return features.select(*_G, "home_team", "away_team", F.lit(None).cast("double").alias("home_win_prob")).filter(F.lit(False))
    scored = model.transform(features)
    return scored.select(*_G, "home_team", "away_team", vector_to_array("probability")[1].alias("home_win_prob"))


def fixture_features(fixtures: DataFrame, games: DataFrame, efficiency: DataFrame, as_of) -> DataFrame:
    """Features of games still to come: today's ratings, last five results, rest up to ``as_of``."""
    last = Window.partitionBy("season", "team_code").orderBy(F.desc("round"), F.desc("gamecode"))
    from courtlake.operators.league import team_games

    played = team_games(games).filter(F.col("played") & F.col("pts_for").isNotNull() & F.col("pts_against").isNotNull())
    form = played.withColumn("n", F.row_number().over(last)).filter("n <= 5").groupBy("season", "team_code").agg(
        F.avg(F.col("pts_for") - F.col("pts_against")).alias("form")
    )
    rest = W.rest_days_latest(games, as_of)
    df = _with_ratings(fixtures.select(*_G, "home_team", "away_team"), efficiency)
    df = _attach_sides(df, form, ["season"], "form", "form_5").na.fill(0.0, ["home_form_5", "away_form_5"])
    return _attach_sides(df, rest, ["season"], "rest_days", "rest_days").na.fill(3, ["home_rest_days", "away_rest_days"])


# -- lineups ------------------------------------------------------------------
def player_season_features(adv: DataFrame) -> DataFrame:
    """Nine season rates per player; possessions estimated from the player's own attempts, floored at 1."""
    cols = ["points", "fgm2", "fga2", "fgm3", "fga3", "ftm", "fta", "off_rebounds", "def_rebounds", "total_rebounds",
            "assists", "steals", "turnovers", "blocks_favour"]
    df = adv.filter(F.col("seconds") > 0).groupBy("season", "player_id").agg(
        F.sum("seconds").alias("seconds"), *[F.sum(c).alias(c) for c in cols],
        F.min_by("player_name", "gamecode").alias("player_name"), F.min_by("team_code", "gamecode").alias("team_code"),
        F.countDistinct("gamecode").alias("games"),
    )
    df = df.withColumn("fga", F.greatest(F.col("fga2") + F.col("fga3"), F.lit(1)))
    poss100 = F.greatest(X.possessions100("fga", "fta", "off_rebounds", "turnovers"), F.lit(100))
    used100 = X.involvement100("fga", "fta", "turnovers", "assists")
    reb = F.greatest(F.col("total_rebounds"), F.lit(1))
    stops = F.col("steals") + F.col("blocks_favour") + F.col("def_rebounds")
    rates = {
        "ts_pct": F.col("points") * 50 / (F.col("fga") * 100 + F.col("fta") * 44),
        "true_usg_pct": used100 / poss100, "stop_rate": stops * 100 / poss100,
        "off_rating": F.col("points") * 100 / poss100 * 100,
        "assist_ratio": F.col("assists") * 100 / used100,
        "orb_pct": F.col("off_rebounds") / reb, "drb_pct": F.col("def_rebounds") / reb,
        "three_pt_rate": F.col("fga3") / F.col("fga"), "ft_rate": F.col("fta") / F.col("fga"),
    }
    return df.select(
        "season", "player_id", "player_name", "team_code", "games",
        (F.col("seconds") / 60.0 / F.greatest("games", F.lit(1))).alias("minutes_pg"), *[c.alias(n) for n, c in rates.items()],
    )


def lineup_features(lineups: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """Means, spreads, best stop rate and assist sum of five known players. ``keys`` identify a lineup row."""
    feats = players.select("season", "player_id", *C.PLAYER_MODEL_FEATURES)
    return (
        lineups.select(*keys, F.explode("lineup").alias("player_id"))
        .join(feats.hint("merge"), ["season", "player_id"])
        .groupBy(*keys)
        .agg(
            F.count("*").alias("known"), *[F.avg(c).alias(f"mean_{c}") for c in C.PLAYER_MODEL_FEATURES],
            F.stddev_samp("ts_pct").alias("std_ts_pct"), F.stddev_samp("true_usg_pct").alias("std_true_usg_pct"),
            F.max("stop_rate").alias("max_stop_rate"), F.sum("assist_ratio").alias("sum_assist_ratio"),
        )
        .filter("known = 5").drop("known")
    )


def lineup_training_set(stats: DataFrame, players: DataFrame, min_events: int = 30) -> DataFrame:
    keys = ["season", "team", "lineup"]
    enough = stats.filter(F.col("events") >= min_events)
    return lineup_features(enough, players, keys).join(enough.select(*keys, "net_rtg").hint("merge"), keys).na.fill(0.0)


def train_lineup_model(training: DataFrame, min_rows: int = 30, trees: int = 200) -> PipelineModel | None:
    training, _ = _training_rows(training, min_rows)
    if training is None:
        return None
    gbt = GBTRegressor(labelCol="net_rtg", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=42)
    return Pipeline(stages=[*_scaled(C.LINEUP_FEATURES), gbt]).fit(training)


def predict_lineups(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    if model is None:
        return features.withColumn("predicted_net_rtg", F.lit(None).cast("double")).filter(F.lit(False))
    return model.transform(features).withColumnRenamed("prediction", "predicted_net_rtg").drop("raw", "features")


def fifth_player_candidates(stats: DataFrame, players: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Every four-man core of a used lineup with every other team-mate of the season.

    Cores come from the five subsets of each lineup and candidates through an
    equi join on season and team, so the row count follows the rosters. With
    boxscores a player is a team-mate of every club played for in the season;
    without them, of the first club only.
    """
    cores = stats.select("season", "team", F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.filter(
            F.transform("lineup", lambda p, j: F.when(j != i, p)), lambda p: p.isNotNull()))
    ).alias("core")).distinct()
    mates = players.select("season", F.col("team_code").alias("team"), F.col("player_id").alias("candidate"))
    if box is not None:
        played = box.filter(F.col("seconds") > 0).select("season", F.col("team_code").alias("team"), F.col("player_id").alias("candidate")).distinct()
        mates = played.join(mates.select("season", "candidate").hint("merge"), ["season", "candidate"], "left_semi")
    return cores.join(mates.hint("merge"), ["season", "team"]).filter(~F.array_contains("core", F.col("candidate"))).withColumn(
        "lineup", F.array_sort(F.array_append("core", F.col("candidate")))
    )


def best_fifth_player(model: PipelineModel | None, stats: DataFrame, players: DataFrame, n: int = 1, box: DataFrame | None = None) -> DataFrame:
    """Best candidates per core by predicted net rating; each distinct lineup is scored once."""
    cand = fifth_player_candidates(stats, players, box)
    keys = ["season", "team", "lineup"]
    scored = predict_lineups(model, lineup_features(cand.select(*keys).distinct(), players, keys)).select(*keys, "predicted_net_rtg")
    order = Window.partitionBy("season", "team", "core").orderBy(F.desc("predicted_net_rtg"), "candidate")
    return cand.join(scored.hint("merge"), keys).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("lineup")


def lineup_radar(features: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the season's players strictly below each lineup measure, averaged per category.

    Player values and lineup values are put on one axis per (season, measure)
    and counted with a running sum over distinct values. Values are cut into
    approximate percentile buckets first, so the running sum is spread over
    tasks; the buckets only steer partitioning, the counts stay exact. Values
    are compared at twelve digits: the order of addition must not decide a tie.
    """
    base = {m: m.split("_", 1)[1] for cols in C.RADAR_CATEGORIES.values() for m in cols}
    category = {m: cat for cat, cols in C.RADAR_CATEGORIES.items() for m in cols}
    asked = features.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(category[m]).alias("category"), F.lit(m).alias("measure"), F.lit(b).alias("stat"), F.round(m, 12).alias("value"))
        for m, b in base.items()
    ])).alias("x")).select(*keys, "x.*")
    pool = players.select("season", F.explode(F.array(*[
        F.struct(F.lit(b).alias("stat"), F.round(b, 12).alias("value")) for b in sorted(set(base.values()))
    ])).alias("x")).select("season", "x.*")
    size = pool.groupBy("season", "stat").agg(
        F.count("value").alias("n"), F.percentile_approx("value", [i / 32 for i in range(1, 32)]).alias("cuts")
    )
    axis = (
        pool.withColumn("one", F.lit(1)).unionByName(asked.select("season", "stat", "value").withColumn("one", F.lit(0)))
        .groupBy("season", "stat", "value").agg(F.sum("one").alias("here"))
        .join(size.select("season", "stat", "cuts"), ["season", "stat"])
        .withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    )
    counted = running(axis, ["season", "stat"], "value", sums={"upto": F.col("here")}, block=F.col("bucket"))
    below = counted.select("season", "stat", "value", (F.col("upto") - F.col("here")).alias("below"))
    return (
        asked.join(below, ["season", "stat", "value"]).join(size.select("season", "stat", "n"), ["season", "stat"])
        .groupBy(*keys, "category").agg(F.avg(X.ratio("below", "n") * 100).alias("score"))
    )


# -- seasonal form ------------------------------------------------------------
def train_form_model(monthly: DataFrame, min_rows: int = 20, trees: int = 150) -> PipelineModel | None:
    rows, _ = _training_rows(monthly.select("season", "team_code", *C.FORM_FEATURES, "net_rtg").na.fill(0.0, C.FORM_FEATURES), min_rows)
    if rows is None:
        return None
    gbt = GBTRegressor(labelCol="net_rtg", maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=42)
    return Pipeline(stages=[*_scaled(C.FORM_FEATURES), gbt]).fit(rows)


def predict_form(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    features = features.na.fill(0.0, C.FORM_FEATURES)
    if model is None:
        return features.withColumn("x_net_rtg", F.lit(None).cast("double")).filter(F.lit(False))
    return model.transform(features).withColumnRenamed("prediction", "x_net_rtg").drop("raw", "features")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# -- team style ---------------------------------------------------------------
def standardise(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Population z-scores within ``keys``; a constant column becomes 0. Moments are a joined aggregate."""
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mu") for c in columns], *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns]
    )
    z = {f"{c}_z": F.when(F.col(f"{c}_sd") > 0, (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd")).otherwise(0.0) for c in columns}
    return df.join(moments, keys).withColumns(z).drop(*[f"{c}_{s}" for c in columns for s in ("mu", "sd")])


def cluster_teams(factors: DataFrame, k: int = 4, seed: int = 42):
    """Style clusters and two principal components over season-standardised factors.

    Returns the scored rows, the k-means model and the PCA model; no rows and no models where there are fewer than k
    team-seasons. Names are assigned to the k centroids, a k x 4 table.
    """
    if factors.limit(k).count() < k:
        none = {"cluster_id": "int", "cluster_name": "string", "pc1": "double", "pc2": "double"}
        return factors.where(F.lit(False)).withColumns({c: F.lit(None).cast(t) for c, t in none.items()}), None, None
    z = standardise(factors, C.FOUR_FACTORS, ["season"])
    vec = VectorAssembler(inputCols=[f"{c}_z" for c in C.FOUR_FACTORS], outputCol="features").transform(z)
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id", maxIter=50).fit(vec)
    pca = PCA(k=2, inputCol="features", outputCol="pcs").fit(vec)
    names = name_clusters(np.array(km.clusterCenters()))
    scored = pca.transform(km.transform(vec)).select(
        *factors.columns, "cluster_id", F.element_at(X.literal_map(names), F.col("cluster_id")).alias("cluster_name"),
        vector_to_array("pcs")[0].alias("pc1"), vector_to_array("pcs")[1].alias("pc2"),
    )
    return scored, km, pca


def name_clusters(centroids: np.ndarray) -> dict[int, str]:
    """Best remaining (centroid, template) score first; leftover centroids are numbered."""
    weights = pd.DataFrame(C.STYLE_TEMPLATES).reindex(C.FOUR_FACTORS).fillna(0.0)
    scores = pd.DataFrame(centroids @ weights.to_numpy(), columns=weights.columns)
    names: dict[int, str] = {}
    for (ci, name), _ in scores.stack().sort_values(ascending=False, kind="stable").items():
        if ci not in names and name not in names.values():
            names[ci] = name
    return {ci: names.get(ci, f"Cluster {ci + 1}") for ci in range(len(centroids))}


def pca_loadings(pca) -> list[dict]:
    comp = pca.pc.toArray()
    return [
        {"feature": f, "pc1": float(comp[i, 0]), "pc2": float(comp[i, 1])} for i, f in enumerate(C.FOUR_FACTORS)
    ]


_STYLE_NOTES = {
    "Pace & Space": "fast tempo and many efficient threes",
    "Defensive Grinders": "slow tempo, few turnovers and second chances",
    "Rebound Dominant": "offensive rebounds, free throws and a slower game",
    "Balanced / Elite": "efficient shooting, few turnovers, solid rebounding",
}


def style_profiles(factors: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """Cluster, components, raw factors and percentiles of every team-season."""
    scored, _, _ = cluster_teams(factors, k, seed)
    ranks = W.percentile_ranks(factors).select("season", "team_code", *[f"{c}_pctl" for c in C.FOUR_FACTORS])
    note = F.coalesce(F.try_element_at(X.literal_map(_STYLE_NOTES), F.col("cluster_name")), F.lit("a style of its own"))
    return scored.join(ranks, ["season", "team_code"]).withColumn("style_note", note)


# -- player similarity --------------------------------------------------------
def similarity_vectors(pool: DataFrame, keys: list[str]) -> DataFrame:
    """Unit vectors of the standardised features; incomplete players are dropped."""
    full = pool.na.drop(subset=C.SIMILARITY_FEATURES)
    z = standardise(full, C.SIMILARITY_FEATURES, keys)
    raw = F.array(*[F.col(f"{c}_z") for c in C.SIMILARITY_FEATURES])
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return z.select(
        *keys, "player_code", "player_name", "team_code",
        F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vec"),
    )


def _tile_topk(top_n: int, keys: list[str]):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                q = np.array([np.asarray(r["vec"], dtype=float) for r in row.queries])
                c = np.array([np.asarray(r["vec"], dtype=float) for r in row.candidates])
                sims = q @ c.T
                ids = np.array([r["id"] for r in row.candidates])
                for i, r in enumerate(row.queries):
                    own = ids != r["id"]
                    keep = np.lexsort((ids[own], -np.round(sims[i][own], 12)))[:top_n]
                    for j in keep:
                        out.append((*[getattr(row, k) for k in keys], r["id"], ids[own][j], float(sims[i][own][j])))
            yield pd.DataFrame(out, columns=[*keys, "player_code", "similar_code", "similarity"])

    return run


def similar_players(pool: DataFrame, top_n: int = 5, same_position: bool = False, tile: int = 512) -> DataFrame:
    """The ``top_n`` most cosine-similar players of the season for every player, exactly.

    Players of a season are packed into tiles of at most ``tile`` vectors by a
    hash of their id. Tiles, not players, are joined; each tile pair becomes one
    matrix product in a task and returns only ``top_n`` rows per player, so no
    player pair is ever a row and no task holds more than two tiles.
    """
    keys = ["season", "position"] if same_position else ["season"]
    vectors = similarity_vectors(pool, keys).withColumn("id", F.concat_ws("|", "player_code", "team_code"))
    sizes = vectors.groupBy(*keys).agg(F.ceil(F.count("*") * 2 / F.lit(tile)).alias("tiles"))
    packed = (
        vectors.join(sizes, keys)
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
        .groupBy(*keys, "tile")
        .agg(F.collect_list(F.struct("id", "vec")).alias("members"))
    )
    pairs = packed.select(*keys, F.col("members").alias("queries")).join(
        packed.select(*keys, F.col("members").alias("candidates"), "tile"), keys
    ).repartition(*keys, "tile")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*keys).schema)
    found = pairs.select(*keys, "queries", "candidates").mapInPandas(
        _tile_topk(top_n, keys), f"{schema}, player_code string, similar_code string, similarity double"
    )
    order = Window.partitionBy(*keys, "player_code").orderBy(F.desc(F.round("similarity", 12)), "similar_code")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    part = lambda c, i: F.split(c, r"\|")[i]
    return ranked.select(
        *keys, part("player_code", 0).alias("player_code"), part("player_code", 1).alias("team_code"), "rank",
        part("similar_code", 0).alias("similar_code"), part("similar_code", 1).alias("similar_team"), "similarity",
    )


def radar_vectors(pool: DataFrame) -> DataFrame:
    """Raw and min-max scaled features of every player, in long form."""
    full = pool.na.drop(subset=C.SIMILARITY_FEATURES)
    bounds = full.groupBy("season").agg(
        *[F.min(c).alias(f"{c}_lo") for c in C.SIMILARITY_FEATURES], *[F.max(c).alias(f"{c}_hi") for c in C.SIMILARITY_FEATURES]
    )
    cell = lambda c: F.struct(
        F.lit(c).alias("feature"), F.col(c).alias("raw"),
        ((F.col(c) - F.col(f"{c}_lo")) / F.when(F.col(f"{c}_hi") == F.col(f"{c}_lo"), 1.0).otherwise(F.col(f"{c}_hi") - F.col(f"{c}_lo"))).alias("norm"),
    )
    return full.join(bounds, "season").select(
        "season", "player_code", "team_code", F.explode(F.array(*[cell(c) for c in C.SIMILARITY_FEATURES])).alias("x")
    ).select("season", "player_code", "team_code", "x.*")
