"""Scalar and array functions of the scoring and training metrics, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(x: Column, eps: float = 1e-5) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.ln(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))


def prior_bias(p: float) -> float:
    return -math.log((1 - p) / p)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def add_up(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(a: Column) -> Column:
    shifted = lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))
    return let(let(doubles(a), shifted), lambda e: let(add_up(e), lambda total: F.transform(e, lambda v: v / total)))


def expectation(p: Column, weights: Column) -> Column:
    """Sum of probabilities times bin positions."""
    return add_up(F.zip_with(p, weights, lambda a, b: a * b))


def top_values(a: Column, k: int) -> Column:
    return F.slice(F.sort_array(a, asc=False), 1, k)


def mean_of(a: Column) -> Column:
    return add_up(a) / F.size(a)


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def dot(a: Column, b: Column) -> Column:
    return add_up(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def focal_cost(p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Cost of giving a target its class at probability p: positive less negative part."""
    positive = alpha * F.pow(1 - p, F.lit(gamma)) * -F.ln(p + 1e-8)
    negative = (1 - alpha) * F.pow(p, F.lit(gamma)) * -F.ln(1 - p + 1e-8)
    return positive - negative


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """In the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.ln(1 + F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    hit = p * target + (1 - p) * (1 - target)
    side = alpha * target + (1 - alpha) * (1 - target)
    return side * F.pow(1 - hit, F.lit(gamma)) * binary_cross_entropy(logit, target)


def varifocal_loss(logit: Column, is_class: Column, quality: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    goal = quality * is_class
    weight = alpha * F.pow(sigmoid(logit), F.lit(gamma)) * (1 - is_class) + goal
    return weight * binary_cross_entropy(logit, goal)


def matchability_loss(logit: Column, is_class: Column, quality: Column, gamma: float = 1.5) -> Column:
    goal = F.pow(quality * is_class, F.lit(gamma))
    weight = F.pow(sigmoid(logit), F.lit(gamma)) * (1 - is_class) + is_class
    return weight * binary_cross_entropy(logit, goal)


def distribution_loss(probabilities: Column, k: Column, right: Column, left: Column) -> Column:
    """Cross-entropy against the two bins next to the target, by their weights."""
    at = lambda i: -F.ln(F.get(probabilities, i.cast("int")))
    return at(k) * left + at(k + 1) * right


def softened(logits: Column, temperature: float) -> Column:
    """Log-softmax of an array at a temperature."""
    log_sum = lambda z, top: top + F.ln(add_up(F.transform(z, lambda v: F.exp(v - top))))
    below = lambda z: let(let(F.array_max(z), lambda top: log_sum(z, top)), lambda total: F.transform(z, lambda v: v - total))
    return let(F.transform(doubles(logits), lambda v: v / temperature), below)


def distillation_divergence(student: Column, teacher: Column, temperature: float = 5.0) -> Column:
    """Temperature squared x KL(teacher | student) of two arrays of logits."""
    each = F.zip_with(softened(teacher, temperature), softened(student, temperature), lambda t, s: F.exp(t) * (t - s))
    return temperature**2 * add_up(each)


def decoupled_loss(loss: Column, weight: Column, matched: Column) -> Column:
    """An aggregate: weighted losses, averaged apart over matched and other rows, the means weighed by
    the square roots of the counts. Null without rows."""
    own, rest = F.when(matched, weight * loss), F.when(~matched, weight * loss)
    root = lambda c: F.sqrt(F.count(c).cast("double"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)) * root(c)
    return (mean(own) + mean(rest)) / F.nullif(root(own) + root(rest), F.lit(0.0))


def masked_square(f: Column, t: Column) -> Column:
    """Squared difference where either is positive, else 0."""
    return F.when((f > 0) | (t > 0), (f - t) * (f - t)).otherwise(0.0)


def gradient_share(own: Column, total: Column) -> Column:
    """The own part in %, 0 where the total is 0 or either is not finite."""
    share = 100 * own / F.nullif(total, F.lit(0.0))
    return F.when(is_finite(own) & is_finite(total), F.coalesce(share, F.lit(0.0))).otherwise(0.0)


def is_finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


# Fixed value: the largest single-precision number.
FLOAT_MAX = 3.4028234663852886e38


def finite_number(x: Column, nan: float = 0.0) -> Column:
    """NaN becomes ``nan``, an infinity the largest single-precision number of its sign."""
    return F.when(F.isnan(x), F.lit(nan)).when(x == float("inf"), FLOAT_MAX).when(x == float("-inf"), -FLOAT_MAX).otherwise(x)


def gradual_step(i: Column, layers: int) -> Column:
    """Weight of layer i of ``layers``: from 0.5 to 1 in equal steps; 1 for a single layer."""
    return F.lit(0.5) + i * (0.5 / (layers - 1)) if layers > 1 else F.lit(1.0)


def folded_norm(weight: Column, gamma: Column, beta: Column, mean: Column, variance: Column, eps: float = 1e-5) -> tuple[Column, Column]:
    """(weight, bias) of a convolution with its batch norm folded in."""
    scale = gamma / F.sqrt(variance + eps)
    return weight * scale, beta - mean * scale


def divisible(x: Column, divisor: int) -> Column:
    """The least multiple of ``divisor`` not under x."""
    return F.ceil(x / F.lit(float(divisor))) * divisor


def same_padding(kernel: Column) -> Column:
    """Padding that keeps the size under a convolution of stride 1."""
    return F.floor(kernel / F.lit(2)).cast("int")


def ema_decay(n: Column, decay: float, warmups: int) -> Column:
    return F.lit(decay) * (1 - F.exp(-n / F.lit(float(warmups)))) if warmups else F.lit(decay)


def flat_cosine(step: Column, total: int, warmup: int, flat: int, tail: int, start: float, least: float) -> Column:
    """Quadratic warm-up, flat, cosine decay, floor; the branches are tried in that order but the floor before the cosine."""
    wave = 0.5 * (1 + F.cos(F.lit(math.pi) * (step - flat) / F.lit(float(total - flat - tail))))
    return (
        F.when(step <= warmup, start * F.pow(step / F.lit(float(warmup)), F.lit(2.0)))
        .when(step <= flat, F.lit(start))
        .when(step >= total - tail, F.lit(least))
        .otherwise(least + (start - least) * wave)
    )


def linear_warmup(step: Column, duration: int) -> Column:
    return F.least(F.lit(1.0), (step + 1) / F.lit(float(duration)))


#: Shares and weights up to so much count as nothing; a divisor under the second leaves a weight as it is.
NOTHING, NO_DIVISOR = 1e-6, 1e-9


def weight_factor(share: Column, rho: float, delta: float) -> Column:
    """What brings a weight's share (%) of the gradient back into rho +- delta, from a tenth to tenfold; 1 inside and for null."""
    low, high = rho - delta, rho + delta
    goal = F.when(share < low, F.lit(high)).otherwise(F.lit(low)) / 100
    p = share / 100
    change = goal * (1 - p) / F.nullif(p * (1 - goal), F.lit(0.0))
    return F.when(share.isNull() | share.between(low, high) | (F.abs(p * (1 - goal)) < NO_DIVISOR), F.lit(1.0)).otherwise(F.least(F.greatest(change, F.lit(0.1)), F.lit(10.0)))


def adapted_weight(share: Column, weight: Column, rho: float, delta: float, default: float, late: Column) -> Column:
    """Next loss weight from its share (%) of the gradient: back into rho +- delta, at most tenfold."""
    moved = weight * weight_factor(share, rho, delta)
    return F.when((share < NOTHING) | late, F.lit(default)).when(weight <= NOTHING, weight).otherwise(moved)


def rate(seconds: Column, zero) -> Column:
    """1 / seconds, or ``zero`` where no time passed."""
    return F.when(seconds > 0, 1 / F.nullif(seconds, F.lit(0.0))).otherwise(F.lit(zero).cast("double"))
