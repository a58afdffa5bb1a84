"""Score expressions: each takes and returns columns, so they run inside one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import fixed


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) != 0


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def _total(start: float, terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(start))


def rules_score() -> Column:
    """Prior plus weighted signals. A missing KYC flag counts as not verified."""
    deviation = F.coalesce(F.col("amount_deviation_score"), F.lit(0.0))
    steps = F.lit(0.0)
    for above, points in reversed(fixed.RULES_AMOUNT_STEPS):
        steps = F.when(deviation > above, points).otherwise(steps)
    age = F.col("usr_account_age_days")
    age = F.when(age.isNull() | (age == 0), fixed.RULES_UNKNOWN_AGE).otherwise(age)
    young, large, young_points = fixed.RULES_YOUNG_ACCOUNT
    failures, failure_points = fixed.RULES_FAILURES
    score = _total(
        fixed.RULES_PRIOR,
        [
            _points(_flag("new_device_flag"), fixed.RULES_NEW_DEVICE),
            _points(_flag("ip_location_mismatch"), fixed.RULES_IP_MISMATCH),
            _points(~_flag("kyc_verified_flag"), fixed.RULES_NO_KYC),
            _points(_flag("usr_is_high_risk"), fixed.RULES_HIGH_RISK_USER),
            steps,
            _points(_flag("is_night_transaction"), fixed.RULES_NIGHT),
            _points(F.col("failed_attempts_last_24h") > failures, failure_points),
            _points((age < young) & (F.col("amount") > large), young_points),
        ],
    )
    return F.least(F.round(score, 4), F.lit(fixed.RULES_CAP))


def light_lr_score() -> Column:
    """Logistic score of five features with the default weights; missing counts as 0."""
    z = _total(
        fixed.LIGHT_INTERCEPT,
        [F.coalesce(F.col(n), F.lit(0)) * w for n, w in fixed.LIGHT_WEIGHTS.items()],
    )
    return 1 / (1 + F.exp(-z))


def fallback_score() -> Column:
    """The score used when there are no model artefacts."""
    above, points = fixed.FALLBACK_AMOUNT
    score = _total(
        fixed.FALLBACK_PRIOR,
        [
            _points(_flag("new_device_flag"), fixed.FALLBACK_NEW_DEVICE),
            _points(_flag("ip_location_mismatch"), fixed.FALLBACK_IP_MISMATCH),
            _points(_flag("usr_is_high_risk"), fixed.FALLBACK_HIGH_RISK_USER),
            _points(F.col("amount_deviation_score") > above, points),
            _points(_flag("is_night_transaction"), fixed.FALLBACK_NIGHT),
            _points(F.col("kyc_verified_flag") == 0, fixed.FALLBACK_NO_KYC),
        ],
    )
    return F.least(F.round(score, 4), F.lit(fixed.FALLBACK_CAP))


def offline_verdict() -> tuple[Column, Column]:
    """The client's own (is_fraud, score) when the scorer cannot be reached."""
    hit = (
        (F.col("amount") > fixed.OFFLINE_AMOUNT)
        | _flag("new_device_flag")
        | _flag("ip_location_mismatch")
    )
    hit = F.coalesce(hit, F.lit(False))
    return hit, F.when(hit, fixed.OFFLINE_SCORES[0]).otherwise(fixed.OFFLINE_SCORES[1])


def alert_level(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    level = F.lit("none")
    for cut, name in reversed(fixed.ALERT_CUTS):
        level = F.when(score >= cut, name).otherwise(level)
    return level


def alert_action(level: str | Column) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    action = F.lit(fixed.ALERT_ACTIONS["none"])
    for name in ("low", "medium", "high"):
        action = F.when(level == name, fixed.ALERT_ACTIONS[name]).otherwise(action)
    return action


def ensemble_columns(threshold: float = 0.5, scores: dict[str, str] | None = None) -> dict[str, Column]:
    """Weighted mean of the scorers that are present (not null) in a row.

    `scores` maps scorer name to column. Weights are rescaled to sum to one over the
    present scorers and rounded to four places before use.
    """
    scores = scores or {"rules": "rules_score", "tree": "tree_score", "light_lr": "light_lr_score"}
    raw = {
        name: F.when(F.col(col).isNotNull(), fixed.ENSEMBLE_WEIGHTS[name]).otherwise(0.0)
        for name, col in scores.items()
    }
    total = _total(0.0, list(raw.values()))
    weights = {name: F.round(F.try_divide(w, total), 4) for name, w in raw.items()}
    mixed = _total(
        0.0, [F.coalesce(F.col(col), F.lit(0.0)) * weights[name] for name, col in scores.items()]
    )
    score = F.round(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)), 6)
    present = [F.when(F.col(col).isNotNull(), F.lit(name)) for name, col in scores.items()]
    used = [F.when(F.col(col).isNotNull(), weights[name]) for name, col in scores.items()]
    return {
        "ensemble_score": score,
        "active_scorers": F.array_compact(F.array(*present)),
        "weights_used": F.map_from_arrays(
            F.array_compact(F.array(*present)), F.array_compact(F.array(*used))
        ),
        "is_fraud": score >= threshold,
    }
