"""Fixed values of the league data model and operator defaults."""

# --- Fixed values: codes, tables and constants that results depend on -------
TEAM_ALIASES = {
    "ULK": "FEN", "IST": "EFS", "TEL": "MTA", "BAS": "BKN", "RED": "CZV",
    "MCO": "ASM", "MAD": "RMB", "BAR": "FCB", "PAN": "PAO", "PAM": "VAL",
}

BOX_COLUMNS = {
    "Player": "player_name", "Player_ID": "player_id", "Team": "team_code", "Home": "is_home",
    "Dorsal": "dorsal", "Minutes": "minutes_str", "Points": "points",
    "FieldGoalsMade2": "fgm2", "FieldGoalsAttempted2": "fga2",
    "FieldGoalsMade3": "fgm3", "FieldGoalsAttempted3": "fga3",
    "FreeThrowsMade": "ftm", "FreeThrowsAttempted": "fta",
    "OffensiveRebounds": "off_rebounds", "DefensiveRebounds": "def_rebounds",
    "TotalRebounds": "total_rebounds", "Assistances": "assists", "Steals": "steals",
    "Turnovers": "turnovers", "BlocksFavour": "blocks_favour", "BlocksAgainst": "blocks_against",
    "FoulsCommited": "fouls_committed", "FoulsReceived": "fouls_received", "Plusminus": "plus_minus",
}

COUNT_STATS = [
    "points", "fgm2", "fga2", "fgm3", "fga3", "ftm", "fta", "off_rebounds", "def_rebounds",
    "total_rebounds", "assists", "steals", "turnovers", "blocks_favour", "blocks_against",
    "fouls_committed", "fouls_received", "plus_minus",
]

PLAYTYPES = [
    "2FGM", "2FGA", "3FGM", "3FGA", "FTM", "FTA", "D", "O", "TO", "ST", "AS", "FV", "AG", "IN", "OUT",
    "CM", "CMU", "CMT", "CMF", "CMP", "RV", "JB", "BP", "EG", "EP", "CCH", "TOUT", "TOUT_TV", "OF",
]
SCORE_POINTS = {"2FGM": 2, "3FGM": 3, "FTM": 1}
POSSESSION_PLAYS = ["2FGM", "2FGA", "3FGM", "3FGA", "TO", "D"]
FIELD_GOAL_PLAYS = ["2FGM", "2FGA", "3FGM", "3FGA"]
FREE_THROW_PLAYS = ["FTM", "FTA"]
FOUL_PLAYS = ["CM", "CMU", "CMT"]

HOOP_X, HOOP_Y = 0.0, 72.0
PERIOD_SECONDS = 600
REGULATION_SECONDS = 2400
HOME_COURT_ADVANTAGE = 2.5
LOGISTIC_DIVISOR = 10.0
MAX_REGULAR_SEASON_ROUND = 38

SEASON_MONTH_ORDER = [10, 11, 12, 1, 2, 3, 4, 5]
MONTH_LABELS = {10: "Oct", 11: "Nov", 12: "Dec", 1: "Jan", 2: "Feb", 3: "Mar", 4: "Apr", 5: "May"}

POSITION_LABELS = {
    "guard": "Guard", "Guard": "Guard", "G": "Guard",
    "forward": "Forward", "Forward": "Forward", "F": "Forward",
    "center": "Center", "Center": "Center", "C": "Center",
    "forward-center": "Forward", "center-forward": "Forward",
    "guard-forward": "Guard", "forward-guard": "Guard",
}
POSITIONS = ["Guard", "Forward", "Center"]

# (archetype, position, exclusive lower height bound, inclusive upper height bound, description)
ARCHETYPES = [
    ("Tall Playmaker", "Guard", 195, None, "Guard > 195 cm"),
    ("Standard Guard", "Guard", None, 195, "Guard <= 195 cm"),
    ("Stretch Big", "Center", 200, None, "Center > 200 cm"),
    ("Undersized Big", "Center", None, 200, "Center <= 200 cm"),
    ("Tall Forward", "Forward", 205, None, "Forward > 205 cm"),
    ("Standard Forward", "Forward", None, 205, "Forward <= 205 cm"),
]

LEADER_DEFAULTS = {"min_games": 10, "min_fga2": 40, "min_fga3": 30, "min_fta": 30}

FOUR_FACTORS = ["efg_pct", "tov_pct", "orb_pct", "ft_rate", "pace", "three_pt_rate"]
STYLE_TEMPLATES = {
    "Pace & Space": {"three_pt_rate": 1, "pace": 1, "efg_pct": 0.5},
    "Defensive Grinders": {"tov_pct": -1, "pace": -1, "orb_pct": 0.5},
    "Rebound Dominant": {"orb_pct": 1, "ft_rate": 0.5, "pace": -0.5},
    "Balanced / Elite": {"efg_pct": 1, "tov_pct": -1, "orb_pct": 0.5, "ft_rate": 0.5},
}

SIMILARITY_FEATURES = [
    "ts_pct", "true_usg_pct", "stop_rate", "assist_ratio", "ast_tov_ratio", "orb_pct",
    "drb_pct", "three_pt_rate", "ft_rate", "steals_pg", "blocks_pg",
]
PLAYER_MODEL_FEATURES = [
    "ts_pct", "true_usg_pct", "stop_rate", "off_rating", "assist_ratio",
    "orb_pct", "drb_pct", "three_pt_rate", "ft_rate",
]
LINEUP_FEATURES = [f"mean_{c}" for c in PLAYER_MODEL_FEATURES] + [
    "std_ts_pct", "std_true_usg_pct", "max_stop_rate", "sum_assist_ratio",
]
RADAR_CATEGORIES = {
    "Offense": ["mean_ts_pct", "mean_off_rating", "mean_true_usg_pct"],
    "Defense": ["mean_stop_rate", "max_stop_rate"],
    "Rebounding": ["mean_orb_pct", "mean_drb_pct"],
    "Spacing": ["mean_three_pt_rate", "mean_ft_rate"],
    "Playmaking": ["mean_assist_ratio", "sum_assist_ratio"],
}
GAME_FEATURES = [
    "home_net_rtg", "away_net_rtg", "net_rtg_diff", "home_court_adv",
    "home_form_5", "away_form_5", "home_rest_days", "away_rest_days",
]
FORM_FEATURES = ["month_index", "home_game_ratio", "opp_strength_avg"]
# --- end of fixed values ----------------------------------------------------

GAME_KEYS = ["season", "gamecode"]
PLAY_ORDER = "true_numberofplay"
PLAYS_PER_BLOCK = 4096
