"""Column expressions the cleaning jobs and operators are made of.

Every function takes and returns ``Column`` and stays inside generated code:
no Python runs per row. ANSI mode is on in Spark 4, so anything that may fail
uses the ``try_`` form and missing values are NULL, never NaN.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

from courtlake import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


# -- strings and casts --------------------------------------------------------
def clean_text(c, max_len: int | None = None) -> Column:
    """Trimmed text of at most ``max_len`` characters; blank becomes NULL."""
    text = F.trim(_col(c))
    if max_len is not None:
        text = F.substring(text, 1, max_len)
    return F.nullif(text, F.lit(""))


def safe_int(c) -> Column:
    return _col(c).try_cast("int")


def safe_double(c) -> Column:
    return _col(c).try_cast("double")


def team_alias(c) -> Column:
    code = F.trim(_col(c))
    return F.coalesce(F.try_element_at(literal_map(C.TEAM_ALIASES), code), code)


def alias_codes(team_code: str) -> list[str]:
    """The code itself and the sponsor-era code of the same club."""
    reverse = {v: k for k, v in C.TEAM_ALIASES.items()}
    return [team_code, reverse.get(team_code, C.TEAM_ALIASES.get(team_code, team_code))]


def title_case(c) -> Column:
    """Capitalise every run of letters, so O'NEALE and MARSH-LEE keep both capitals."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))),
        "",
    )


def display_name(c) -> Column:
    """'LESSORT, MATHIAS' -> 'Lessort M.'; a name without comma is only capitalised."""
    raw = _col(c)
    parts = F.split(raw, ",")
    first = F.trim(F.try_element_at(parts, F.lit(2)))
    initial = F.when(F.length(first) > 0, F.concat(F.upper(F.substring(first, 1, 1)), F.lit("."))).otherwise("")
    with_comma = F.trim(F.concat_ws(" ", title_case(F.trim(parts[0])), initial))
    return F.when(raw.isNull(), F.lit("")).when(raw.contains(","), with_comma).otherwise(title_case(F.trim(raw)))


# -- clock and calendar -------------------------------------------------------
def clock_to_seconds(c) -> Column:
    """'MM:SS' -> whole seconds; DNP, blank or malformed text -> 0."""
    text = F.trim(_col(c))
    parts = F.split(text, ":")
    secs = F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.coalesce(F.when(F.size(parts) == 2, secs), F.lit(0))


def clock_to_minutes(c) -> Column:
    return clock_to_seconds(c) / F.lit(60.0)


def game_date(c) -> Column:
    """Date text in the three known formats, then whatever a plain cast accepts."""
    text = F.trim(_col(c))
    known = [F.try_to_date(text, f) for f in ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")]
    return F.coalesce(*known, text.try_cast("date"))


def season_month(day) -> Column:
    """Oct..May -> 1..8, NULL for the summer months."""
    return F.try_element_at(literal_map({m: i + 1 for i, m in enumerate(C.SEASON_MONTH_ORDER)}), F.month(_col(day)))


def month_label(month) -> Column:
    return F.try_element_at(literal_map(C.MONTH_LABELS), _col(month))


def age_on(birthdate, as_of) -> Column:
    return F.floor(F.months_between(as_of, _col(birthdate)) / 12).cast("int")


def age_bracket(age) -> Column:
    a = _col(age)
    return F.when(a < 25, "Under 25").when(a <= 30, "25-30").when(a > 30, "31+ (Veterans)")


def period_length(period, ot_seconds: int = 300) -> Column:
    return F.when(_col(period) <= 4, C.PERIOD_SECONDS).otherwise(ot_seconds)


def period_start(period, ot_seconds: int = 300) -> Column:
    p = _col(period)
    return F.when(p <= 4, (p - 1) * C.PERIOD_SECONDS).otherwise(C.REGULATION_SECONDS + (p - 5) * ot_seconds)


def elapsed_seconds(period, clock_secs, ot_seconds: int = 300) -> Column:
    return period_start(period, ot_seconds) + period_length(period, ot_seconds) - _col(clock_secs)


def remaining_seconds(period, clock_secs, ot_seconds: int = 300) -> Column:
    """Seconds left in regulation, or in the running overtime period."""
    left = F.when(
        _col(period) <= 4, C.REGULATION_SECONDS - elapsed_seconds(period, clock_secs, ot_seconds)
    ).otherwise(_col(clock_secs))
    return F.greatest(left, F.lit(0))


def comment_score(comment, side: int) -> Column:
    """Home (1) or away (2) score written as '(12-10)' in a play comment."""
    return F.nullif(F.regexp_extract(F.coalesce(_col(comment), F.lit("")), r"\((\d+)-(\d+)\)", side), F.lit("")).try_cast("int")


def percent_text(c) -> Column:
    """'54.2%' -> 0.542"""
    return F.regexp_replace(_col(c), "%", "").try_cast("double") / 100.0


# -- rates --------------------------------------------------------------------
def ratio(num, den) -> Column:
    """num / den, NULL when the denominator is not positive."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.when(d > 0, n / d)


def ratio0(num, den) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def possessions100(fga, fta, orb, tov) -> Column:
    """Possession estimate in whole hundredths (the .44 free-throw weight stays an integer)."""
    return _col(fga) * 100 + _col(fta) * 44 - _col(orb) * 100 + _col(tov) * 100


def true_shooting(points, fga, fta) -> Column:
    return ratio(_col(points) * 50, _col(fga) * 100 + _col(fta) * 44)


def involvement100(fga, fta, tov, ast, fouls_drawn=None) -> Column:
    total = _col(fga) * 100 + _col(fta) * 44 + (_col(tov) + _col(ast)) * 100
    return total if fouls_drawn is None else total + _col(fouls_drawn) * 100


def points_of(playtype) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.SCORE_POINTS), _col(playtype)), F.lit(0))


def is_possession(playtype) -> Column:
    return _col(playtype).isin(C.POSSESSION_PLAYS)


def count_of(playtype, *codes: str) -> Column:
    return F.count_if(_col(playtype).isin(*codes))


# -- shots --------------------------------------------------------------------
def hoop_distance(x, y) -> Column:
    dx, dy = _col(x) - C.HOOP_X, _col(y) - C.HOOP_Y
    return F.sqrt(dx * dx + dy * dy)


def baseline_xp(x, y, shot_value) -> Column:
    """Expected points of a shot by distance zone; fixed percentages, .50/.35 without coordinates."""
    d, v = hoop_distance(x, y), _col(shot_value)
    two = F.when(d < 150, 0.65).when(d < 300, 0.42).when(d >= 300, 0.38).otherwise(0.50)
    three = F.when(d < 680, 0.37).when(d >= 680, 0.35).otherwise(0.35)
    return F.when(v == 3, three).when(v == 2, two).otherwise(0.50) * v


# -- labels -------------------------------------------------------------------
def infer_position(orb_pct="orb_pct", drb_pct="drb_pct", blocks="blocks_pg", assist="assist_ratio", threes="three_pt_rate") -> Column:
    z = [F.coalesce(_col(c), F.lit(0.0)) for c in (orb_pct, drb_pct, blocks, assist, threes)]
    big = (z[0] + z[1]) * 50 + z[2] * 10
    guard = z[3] * 50 + z[4] * 50
    return (
        F.when((big > 18) & (big > guard * 1.3), "Center")
        .when((guard > 14) & (guard > big * 1.1), "Guard")
        .otherwise("Forward")
    )


def position_label(c) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.POSITION_LABELS), _col(c)), F.lit("Forward"))


def archetype(position, height) -> Column:
    """Six position-and-height rules as one CASE, so no join is needed."""
    p, h = _col(position), _col(height)
    rules = []
    for name, pos, low, high, _ in C.ARCHETYPES:
        cond = p == pos
        if low is not None:
            cond = cond & (h > low)
        if high is not None:
            cond = cond & (h <= high)
        rules.append((cond, name))
    first = F.when(rules[0][0], rules[0][1])
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], first)


def win_probability(home_net, away_net) -> Column:
    diff = _col(home_net) - _col(away_net) + C.HOME_COURT_ADVANTAGE
    return 1.0 / (1.0 + F.exp(-diff / C.LOGISTIC_DIVISOR))


def live_win_probability(home_score, away_score, remaining) -> Column:
    f = F.greatest(_col(remaining).cast("double") / float(C.REGULATION_SECONDS), F.lit(0.01))
    diff = (_col(home_score) - _col(away_score) + f * 3.0) / F.greatest(F.sqrt(f), F.lit(0.1))
    p = 1.0 / (1.0 + F.exp(diff * -0.15))
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))


def net_rating_tier(net) -> Column:
    n = _col(net)
    return F.when(n > 8, "Elite").when(n > 3, "Strong").when(n > -3, "Average").when(n > -8, "Weak").otherwise("Poor")


def balance_score(offense, defense) -> Column:
    return F.lit(100) - F.abs(_col(offense) - _col(defense))


def display_round(c, digits: int = 1) -> Column:
    """Half-even rounding for presentation; operators themselves never round."""
    return F.bround(_col(c), digits)
