import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtlake.functions import exprs as X


def one(spark, **cols):
    df = spark.range(1).select(*[c.alias(n) for n, c in cols.items()])
    return df.first().asDict()


@pytest.mark.parametrize("text,secs", [("25:30", 1530), ("DNP", 0), ("", 0), (None, 0), ("a:b", 0), (" 09:05 ", 545)])
def test_clock(spark, text, secs):
    assert one(spark, s=X.clock_to_seconds(F.lit(text)))["s"] == secs


@pytest.mark.parametrize("raw,shown", [
    ("LESSORT, MATHIAS", "Lessort M."), ("O'NEALE, royce", "O'Neale R."), ("MARSH-LEE, A", "Marsh-Lee A."), ("de colo", "De Colo"), (None, ""),
])
def test_display_name(spark, raw, shown):
    assert one(spark, n=X.display_name(F.lit(raw).cast("string")))["n"] == shown


@pytest.mark.parametrize("text", ["Oct 3, 2024", "Oct 03, 2024", "October 3, 2024", "2024-10-03"])
def test_dates(spark, text):
    row = one(spark, d=X.game_date(F.lit(text)), m=X.season_month(X.game_date(F.lit(text))))
    assert row == {"d": dt.date(2024, 10, 3), "m": 1}


def test_scores_percent_and_ids(spark):
    row = one(
        spark, a=X.comment_score(F.lit("made (12-10)"), 1), b=X.comment_score(F.lit("made (12-10)"), 2), none=X.comment_score(F.lit("foul"), 1),
        p=X.percent_text(F.lit("54.2%")), bad=X.percent_text(F.lit("-")), t=X.team_alias(F.lit(" PAN ")), same=X.team_alias(F.lit("OLY")),
        cut=X.clean_text(F.lit("  abcdef "), 3), blank=X.clean_text(F.lit("  ")),
    )
    assert (row["a"], row["b"], row["none"]) == (12, 10, None)
    assert row["p"] == pytest.approx(0.542) and row["bad"] is None
    assert (row["t"], row["same"], row["cut"], row["blank"]) == ("PAO", "OLY", "abc", None)
    assert X.alias_codes("PAO") == ["PAO", "PAN"]


@pytest.mark.parametrize("x,y,v,xp", [(0, 72, 2, 1.3), (0, 300, 2, .84), (0, 600, 2, .76), (0, 700, 3, 1.11), (0, 800, 3, 1.05), (None, None, 2, 1.0), (None, None, 3, 1.05)])
def test_baseline_xp(spark, x, y, v, xp):
    c = lambda z: F.lit(z).cast("double")
    assert one(spark, e=X.baseline_xp(c(x), c(y), F.lit(v)))["e"] == pytest.approx(xp)


def test_labels(spark):
    row = one(
        spark, tall=X.archetype(F.lit("Guard"), F.lit(196)), std=X.archetype(F.lit("Guard"), F.lit(195)), none=X.archetype(F.lit("Guard"), F.lit(None).cast("int")),
        young=X.age_bracket(F.lit(24)), mid=X.age_bracket(F.lit(30)), old=X.age_bracket(F.lit(31)), fwd=X.position_label(F.lit("unknown")),
        tier=X.net_rating_tier(F.lit(3.5)), bal=X.balance_score(F.lit(60), F.lit(40)),
    )
    assert row == {"tall": "Tall Playmaker", "std": "Standard Guard", "none": None, "young": "Under 25", "mid": "25-30", "old": "31+ (Veterans)",
                   "fwd": "Forward", "tier": "Strong", "bal": 80}


def test_win_probabilities(spark):
    row = one(spark, even=X.win_probability(F.lit(0.0), F.lit(0.0)), sure=X.live_win_probability(F.lit(90), F.lit(60), F.lit(0)),
              start=X.live_win_probability(F.lit(0), F.lit(0), F.lit(2400)), left=X.remaining_seconds(F.lit(5), F.lit(120)), el=X.elapsed_seconds(F.lit(5), F.lit(120)))
    assert row["even"] == pytest.approx(0.5621765, abs=1e-6) and row["sure"] == 0.999
    assert row["start"] == pytest.approx(0.6106392, abs=1e-6) and (row["left"], row["el"]) == (120, 2580)
