"""Aggregate reports on a hand-written league (expected values worked out by hand)."""

import datetime as dt

import pytest

from scoreline import operators as op

TEAMS = {1: "Alpha", 2: "Beta", 3: "Gamma", 4: "Beta", 5: "Delta"}   # 2 and 4 share a name
LEAGUES = {10: "North", 20: "South"}
ROWS = [
    # id, league, season, stage, date, home, away, home goals, away goals
    (1, 10, "2020", 1, "2020-01-01", 1, 2, 2, 0),
    (2, 10, "2020", 1, "2020-01-02", 2, 1, 1, 1),
    (3, 10, "2020", 2, "2020-02-01", 1, 3, None, None),   # no score
    (4, 10, "2020", 2, "2020-02-02", 3, 5, 0, 3),         # team 5 only ever plays away
    (5, 20, "2020", 1, "2020-01-05", 4, 1, 1, 0),
    (6, 20, "2020", 1, "2020-01-06", 1, 4, 2, 2),
    (7, 10, "2020", 3, "2020-03-01", 4, 3, 1, 0),
]


@pytest.fixture(scope="module")
def t(fx):
    return fx.matches(ROWS), fx.teams(TEAMS), fx.leagues(LEAGUES), fx.countries({0: "Land"})


def test_group_overview(t):
    m, _, lg, ct = t
    north = {r.league: r for r in op.group_overview(m, lg, ct).collect()}["North"]
    assert north.country == "Land"
    assert north.matches == 5
    assert north.teams == 4                    # home teams 1, 2, 3, 4; team 5 never at home
    assert north.total_goals == 2 + 2 + 3 + 1  # the NULL score is ignored by SUM
    assert north.goals_per_match == 2.0        # AVG over the 4 scored matches
    assert north.pct_home_wins == 40.0         # 2 of 5: the unscored match counts in the denominator
    assert north.pct_away_wins == 20.0
    assert north.pct_draws == 20.0
    assert north.first_date == dt.date(2020, 1, 1) and north.last_date == dt.date(2020, 3, 1)


def test_top_winners_groups_by_names_and_null_is_draw(t):
    m, tm, lg, _ = t
    rows = {(r.team, r.league): r for r in op.top_winners(m, tm, lg, min_matches=1, k=100).collect()}
    beta = rows[("Beta", "North")]               # teams 2 and 4 merge under one name
    assert (beta.matches, beta.wins, beta.draws, beta.losses) == (3, 1, 1, 1)
    assert beta.pct_wins == 33.3
    alpha = rows[("Alpha", "North")]
    assert (alpha.matches, alpha.wins, alpha.draws, alpha.losses) == (3, 1, 2, 0)
    # threshold is inclusive
    kept = op.top_winners(m, tm, lg, min_matches=3, k=100).collect()
    assert {(r.team, r.league) for r in kept} == {("Beta", "North"), ("Alpha", "North"),
                                                 ("Gamma", "North")}


def test_home_advantage_fans_out_over_leagues(t):
    m, tm, lg, _ = t
    rows = op.home_advantage(m, tm, lg, min_home=1, k=100).collect()
    alpha = [r for r in rows if r.team == "Alpha"]
    assert len(alpha) == 4                       # 2 home leagues x 2 away leagues
    assert not [r for r in rows if r.team == "Delta"]   # never played at home
    same = op.home_advantage(m, tm, lg, min_home=1, k=100, same_league=True).collect()
    a_north = [r for r in same if r.team == "Alpha" and r.league == "North"][0]
    assert (a_north.home_matches, a_north.home_wins, a_north.pct_home_wins) == (2, 1, 50.0)
    assert (a_north.away_matches, a_north.away_wins, a_north.pct_away_wins) == (1, 0, 0.0)
    assert a_north.home_away_gap == 50.0


def test_biggest_margins(t):
    m, tm, lg, _ = t
    rows = op.biggest_margins(m, tm, lg, min_margin=3, k=15).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.scoreline, r.winner, r.loser, r.margin, r.total_goals) == ("Gamma 0-3 Delta", "Delta",
                                                                         "Gamma", 3, 3)
    assert r.match_date == dt.date(2020, 2, 2) and r.league == "North"


def test_scoring_profile_groups_by_ids(t):
    m, tm, lg, _ = t
    rows = op.scoring_profile(m, tm, lg, min_matches=1, k=100).collect()
    betas = [r for r in rows if r.team == "Beta" and r.league == "North"]
    assert len(betas) == 2                       # ids 2 and 4 stay apart
    gamma = [r for r in rows if r.team == "Gamma"][0]
    assert (gamma.matches, gamma.goals_for_pg, gamma.goals_against_pg, gamma.goal_diff_pg) == \
        (3, 0.0, 2.0, -2.0)
    both = op.scoring_profile_both(m, tm, lg, min_matches=1, k=2).collect()
    assert sorted({r.category for r in both}) == ["Best defences", "Top scorers"]


def test_high_scoring(t):
    m, tm, lg, _ = t
    rows = {(r.team, r.league): r for r in op.high_scoring(m, tm, lg, min_matches=1, k=100).collect()}
    gamma = rows[("Gamma", "North")]             # matches 3 (no score), 4 (0-3), 7 (1-0)
    assert (gamma.matches, gamma.goals_per_match, gamma.over_2_5, gamma.nil_nil) == (3, 2.0, 1, 0)
    assert gamma.pct_over_2_5 == 33.3
