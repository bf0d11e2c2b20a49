"""Bins, losses and normalisation as native columns."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F


def log_bin(x: Column, fine: int = 1) -> Column:
    """log10 in bins, ``fine`` to a power of ten, half up and cut towards zero; null below 0."""
    return F.when(x > 0, (F.log10(x) * fine + 0.5).cast("int"))


def capped(x: Column, most: int = 10) -> Column:
    return F.least(x, F.lit(most))  # W13


def relative_position(k: Column, n: Column) -> Column:
    """(2k - n - 1) / (n - 1) for place k of n, from 1; 0 if there is one place."""
    return F.coalesce(F.try_divide(2 * k - n - 1, n - 1), F.lit(0.0))


def false_link_loss(kind: str, anaphoric: Column, new: Column, correct: Column, false_link: float = 0.1, false_new: float = 3.0, wrong_link: float = 1.0) -> Column:
    """Loss of choosing an antecedent or a new cluster (X33): ``none``, ``precision`` (wrong links), ``recall`` (an antecedent
    that is missed, by a new cluster or a wrong link) or ``custom``."""
    if kind == "none":
        return F.lit(0.0)
    if kind == "precision":
        return F.when(~new & ~correct, 1.0).otherwise(0.0)
    if kind == "recall":
        return F.when(anaphoric & (new | ~correct), 1.0).otherwise(0.0)
    if kind != "custom":
        raise ValueError(f"no loss function {kind!r}")
    return F.when(~anaphoric & ~new, false_link).when(anaphoric & new, false_new).when(anaphoric & ~correct, wrong_link).otherwise(0.0)


def named_loss(name: str, anaphoric: Column, new: Column, correct: Column, cluster_size: Column | None = None) -> Column:
    """A loss by its name: noLoss, precisionLoss, recallLoss, customLoss-<false link>-<false new>-<wrong link>, or
    weightedCustomLoss with a share of each loss that grows with the mention's gold cluster, as a fourth number (X33)."""
    kind, *numbers = name.split("-")
    known = {"noLoss": ("none", 0), "precisionLoss": ("precision", 0), "recallLoss": ("recall", 0), "customLoss": ("custom", 3), "weightedCustomLoss": ("custom", 4)}
    if kind not in known or len(numbers) != known[kind][1]:
        raise ValueError(f"no loss function {name!r}")
    weights = [float(x) for x in numbers]
    loss = false_link_loss(known[kind][0], anaphoric, new, correct, *weights[:3])
    return loss if len(weights) < 4 else loss * (1 - weights[3] + weights[3] * cluster_size)


def shown(x: Column) -> Column:
    """A number as reports show it: three digits, or one digit and a power of ten from 10,000 on and below 0.001."""
    a = F.abs(x)
    down = F.ceil(-F.log10(a))
    up = F.floor(F.log10(a))
    text = F.when(a == 0, "0").when(a < 1e-20, "tiny").when(a < 0.001, F.concat(F.format_string("%.1f", a * F.pow(F.lit(10.0), down)), F.lit("e-"), down.cast("string")))
    text = text.when(a < 10_000, F.format_string("%.3f", a)).otherwise(F.concat(F.format_string("%.1f", a / F.pow(F.lit(10.0), up)), F.lit("e"), up.cast("string")))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def log_sum_exp(x: Column, over: WindowSpec) -> Column:
    """log of the sum of exponentials over a window, shifted by the largest."""
    top = F.max(x).over(over)
    return top + F.log(F.sum(F.exp(x - top)).over(over))


def softmax(x: Column, over: WindowSpec) -> Column:
    top = F.max(x).over(over)
    return F.exp(x - top) / F.sum(F.exp(x - top)).over(over)


def floor_quantile(values: Column, share: float) -> Column:
    """The value at place floor(share * n) of the sorted values, without interpolation."""
    place = F.least(F.floor(F.size(values) * share).cast("int") + 1, F.size(values))
    return F.try_element_at(F.array_sort(values), place)


def smoothed_choice(choice: Column, size: int, confidence: float = 0.75) -> Column:
    """A distribution with most weight on a choice; uniform if it is null."""
    rest = (1 - confidence) / max(1, size - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(choice.isNull(), F.lit(1.0 / size)).when(k == choice, F.lit(confidence)).otherwise(F.lit(rest)))


def agreement_bucket(agree: Column, total: Column) -> Column:
    """``c/n`` up to two mentions, else NONE, AL1, MANY or ALL."""
    return F.when(total <= 2, F.concat(agree.cast("string"), F.lit("/"), total.cast("string"))).when(agree == 0, "NONE").when(agree == total, "ALL").when(2 * agree > total, "MANY").otherwise("AL1")
