"""Score columns: prices, confidence, influence, variant and metric deltas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double (decimal ties follow the binary value)."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def estimate_cost(provider: Column, total: Column, inputs: Column | None = None, outputs: Column | None = None) -> Column:
    """Dollars for a request; a missing split is half of the total each, unknown providers NULL."""
    half = F.coalesce(F.floor(total / 2), F.lit(0))

    def part(given: Column | None) -> Column:
        return half if given is None else F.when(F.coalesce(given, F.lit(0)) != 0, given).otherwise(half)

    out = None
    for name, (price_in, price_out) in K.PROVIDER_PRICES.items():
        cost = rounded(part(inputs) / 1_000_000 * price_in + part(outputs) / 1_000_000 * price_out, 6)
        out = F.when(provider == name, cost) if out is None else out.when(provider == name, cost)
    return out


def estimate_model_cost(inputs: Column, outputs: Column, per_1k_in: Column, per_1k_out: Column) -> Column:
    return inputs / 1000 * per_1k_in + outputs / 1000 * per_1k_out


def _ladder(value: Column, steps: list[tuple[float, object]], last: object) -> Column:
    out = None
    for bound, label in steps:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(last)


def confidence_level(c: Column) -> Column:
    return _ladder(c, [(0.2, "very_low"), (0.4, "low"), (0.6, "medium"), (0.8, "high")], "very_high")


def uncertainty_level(u: Column) -> Column:
    return _ladder(
        u, [(0.2, "very confident"), (0.4, "somewhat confident"), (0.6, "neutral"), (0.8, "uncertain")],
        "very uncertain",
    )


def patch_size_score(size: Column) -> Column:
    return _ladder(size, [(10, 1.0), (50, 0.9), (100, 0.7), (200, 0.5)], 0.3)


def age_score(age_hours: Column) -> Column:
    day = 24
    return _ladder(
        age_hours,
        [(1, 1.0), (day, 0.9), (7 * day, 0.7), (30 * day, 0.5), (90 * day, 0.3), (365 * day, 0.2)],
        0.1,
    )


def adaptive_confidence(
    validation: Column, coverage: Column, patch_size: Column, complexity: Column, history: Column
) -> Column:
    score = (
        validation * 0.35 + coverage * 0.25 + patch_size_score(patch_size) * 0.15
        + (1.0 - F.least(complexity, F.lit(1.0))) * 0.15
    )
    blended = F.when(history.isNotNull(), score * 0.9 + history * 0.10).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended))


def year_score(year: Column, as_of_year: int) -> Column:
    return F.when(year > 0, 1.0 / (1.0 + 0.1 * F.abs(F.lit(as_of_year) - year))).otherwise(0.0)


def influence_score(citations: Column, references: Column, year: Column, as_of_year: int) -> Column:
    """``sqrt(citations * references + 1)`` damped by age; 0 for an unlinked paper."""
    weight = F.when(year > 0, 1.0 / (1.0 + 0.1 * (F.lit(as_of_year) - year))).otherwise(1.0)
    return F.when((citations == 0) & (references == 0), 0.0).otherwise(
        F.sqrt(citations * references + 1) * weight
    )


def lookup(name: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out.otherwise(default)


def variant_score(speedup: Column, loss_change: Column, confidence: Column) -> Column:
    return speedup * 40 + F.greatest(F.lit(0.0), 30 - F.abs(loss_change) * 3) + confidence * 30


def speedup_of(new_rate: Column, base_rate: Column) -> Column:
    return F.when(base_rate != 0, rounded(new_rate / F.greatest(base_rate, F.lit(1e-9)), 4))


def loss_change_pct(new_loss: Column, base_loss: Column) -> Column:
    return rounded((new_loss - base_loss) / F.greatest(F.abs(base_loss), F.lit(1e-9)) * 100.0, 4)
