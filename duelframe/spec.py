"""Names and groups of the engine's features, and the constants they rest on."""

from __future__ import annotations

from dataclasses import dataclass

# Window lengths, debut priors, layoff and recency limits.
WINDOWS = (3, 5, 10)
DEBUT = {"win_rate": 0.52, "ko_rate": 0.25, "sub_rate": 0.15, "dec_rate": 0.60, "finish_rate": 0.40}
DEBUT_GAP_DAYS = 365
LAYOFF_DAYS = 180
DAYS_PER_YEAR = 365.25
RELIABLE_CONTESTS = 6
SKILL_MIN_CONTESTS = 3
PHYSICAL_DEFAULTS = {"height": 70.0, "reach": 70.0, "age": 30.0}

# Divisions of the one-hot encoding and of the segment report.
DIVISIONS = (
    "Bantamweight", "Catch Weight", "Featherweight", "Flyweight", "Heavyweight", "Light Heavyweight", "Lightweight",
    "Middleweight", "Open Weight", "Super Heavyweight", "Welterweight", "Women's Bantamweight",
    "Women's Featherweight", "Women's Flyweight", "Women's Strawweight")
SEGMENT_DIVISIONS = (
    "Flyweight", "Bantamweight", "Featherweight", "Lightweight", "Welterweight", "Middleweight",
    "Light Heavyweight", "Heavyweight", "Women's Strawweight", "Women's Flyweight", "Women's Bantamweight",
    "Women's Featherweight")


@dataclass(frozen=True)
class Feature:
    """A per-side feature: its group, and whether matchups carry the difference too."""

    name: str
    group: str
    diff: bool = True


ROLLING = ("win_rate", "finish_rate", "sig_landed", "sig_absorbed", "td_landed", "duration")
SKILLS = ("striking", "grappling", "durability", "quality")
ADJUSTED_ROLLING = ("adj_win_rate", "opp_striking", "opp_grappling", "opp_quality",
                    "adj_sig_landed", "adj_td_landed", "adj_control", "adj_kd")

SIDE_FEATURES = tuple(
    [Feature(n, "career") for n in (
        "n_prior", "wins_prior", "losses_prior", "win_rate", "ko_rate", "sub_rate", "dec_rate", "finish_rate",
        "win_streak", "loss_streak", "days_since_last", "contests_per_year", "division_prior", "contests_last_365d",
        "is_debut", "completeness")]
    + [Feature("detailed", "career", diff=False)]
    + [Feature(f"{m}_last_{n}", "rolling") for n in WINDOWS for m in ROLLING]
    + [Feature("adj_win_rate", "adjusted")] + [Feature(f"avg_opp_{s}", "adjusted") for s in SKILLS]
    + [Feature(f"{m}_last_{n}", "adjusted") for n in WINDOWS for m in ADJUSTED_ROLLING])


def names(*groups: str) -> list[str]:
    return [f.name for f in SIDE_FEATURES if f.group in groups]


# Named model inputs, as lists of matchup columns.
FEATURE_SETS = {
    "base": [f"diff_{n}" for n in (
        "win_rate", "finish_rate", "win_streak", "loss_streak", "days_since_last", "n_prior",
        "win_rate_last_3", "win_rate_last_5", "sig_landed_last_5", "sig_absorbed_last_5", "td_landed_last_5")],
    "ratings": ["diff_elo", "f1_elo_expected", "diff_elo_momentum"],
    "physical": ["diff_height", "diff_reach", "diff_age", "diff_reach_advantage", "stance_mismatch"],
    "debut": ["any_debut", "both_debut", "any_early", "experience_gap"],
    "adjusted": ["diff_adj_win_rate"] + [f"diff_avg_opp_{s}" for s in SKILLS],
}


def select_feature_set(columns: list[str], *sets: str) -> list[str]:
    """Columns of the named sets that the frame really has, in registry order, without repeats."""
    wanted = [c for s in sets for c in FEATURE_SETS[s]]
    present = set(columns)
    return [c for c in dict.fromkeys(wanted) if c in present]
