"""Posteriors, uncertainty, fusion and confidence as Column expressions. A posterior is an array of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.config import KnowledgeConfig


def pair(p: Column) -> Column:
    """[1 - p, p]."""
    return F.array(1 - p, p)


def argmax2(p0: Column, p1: Column) -> Column:
    """0 or 1; equal values give 0."""
    return (p1 > p0).cast("int")


def uncertainty(probs: Column, metric: str = "u_max") -> Column:
    """u_max, u_entropy or u_margin of a posterior."""
    if metric == "u_max":
        return 1 - F.array_max(probs)
    if metric == "u_entropy":
        k = F.size(probs)
        h = F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.log(p + 1e-10))
        return F.when(k > 1, h / F.log(k.cast("double"))).otherwise(0.0)
    if metric == "u_margin":
        top = F.sort_array(probs, asc=False)
        return F.when(F.size(probs) < 2, 0.0).otherwise(1 - (top[0] - top[1]))
    raise ValueError(f"unknown metric {metric}")


def edges(n: int) -> list[float]:
    """Interior edges of n equal buckets of [0, 1], as multiples of 1/n in floating point (3 * 0.1 lies above 0.3)."""
    return [i * (1 / n) for i in range(1, n)]


def bucket(x: Column, n: int = 10) -> Column:
    """Number of interior edges up to x."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges(n)]), lambda e: e <= x))


def knowledge(counts: dict[str, Column], regex_hits: Column, words: Column, config: KnowledgeConfig) -> tuple[Column, Column, Column]:
    """(probability, total matches, match score) from match counts by category."""
    weights = {"porn": config.porn_weight, "politics": config.politics_weight, "abuse": config.abuse_weight}
    total, score = regex_hits, regex_hits * (sum(weights.values()) / 3)
    for k, w in weights.items():
        total, score = total + counts[k], score + counts[k] * w
    score = score / words
    p = F.lit(config.base_prob) + (config.max_prob - config.base_prob) * (F.tanh(score * 5) + 1) / 2
    hit = total >= config.min_matches
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(hit, p).otherwise(F.lit(config.base_prob)))), total, F.when(hit, score).otherwise(0.0)


def fuse(p0: Column, p1: Column, q0: Column, q1: Column, alpha: Column) -> tuple[Column, Column]:
    """alpha * p + (1 - alpha) * q of posteriors that are normalised first; the result is clipped and normalised again."""

    def norm(a: Column, b: Column) -> tuple[Column, Column]:
        s = a + b
        return F.when(s > 0, a / s).otherwise(a), F.when(s > 0, b / s).otherwise(b)

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    (p0, p1), (q0, q1) = norm(p0, p1), norm(q0, q1)
    f0, f1 = norm(alpha * p0 + (1 - alpha) * q0, alpha * p1 + (1 - alpha) * q1)
    return norm(clip(f0), clip(f1))


def lut_alpha(u: Column, lut: list[tuple[float, float]]) -> Column:
    """Linear interpolation in a table of (u, alpha) in order of u; ends beyond it."""
    out = F.lit(float(lut[-1][1]))
    for (u0, a0), (u1, a1) in reversed(list(zip(lut, lut[1:], strict=False))):
        inside = a0 if u1 == u0 else F.lit(a0) + (a1 - a0) * (u - u0) / (u1 - u0)
        out = F.when(u < u1, inside).otherwise(out)
    return F.when(u <= lut[0][0], float(lut[0][1])).otherwise(out)


def gate_threshold(alpha: Column, q0: Column, q1: Column, threshold: float) -> Column:
    """Knowledge that is less sure than the threshold isn't used."""
    return F.when(F.greatest(q0, q1) < threshold, 1.0).otherwise(alpha)


def gate_consistency(alpha: Column, p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
    """Knowledge that contradicts the model isn't used."""
    return F.when(argmax2(p0, p1) != argmax2(q0, q1), 1.0).otherwise(alpha)


def confidence(p: Column, method: str = "tanh") -> Column:
    """raw, tanh or piecewise mapping of a probability; unknown methods are raw."""

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    if method == "tanh":
        return clip(0.3 + 0.6 * F.tanh((p - 0.5) * 4))
    if method == "piecewise":
        return clip(F.when(p < 0.6, 0.4 + (p - 0.5) * 2).otherwise(0.6 + (p - 0.6) * 0.75))
    return p


def credible(counts: dict[str, Column], conf: Column, method: str = "improved_weighted", q: Column | None = None, base: float = 0.1, most: float = 0.75) -> Column:
    """Probability from match counts and their credibility: original, improved_weighted, offset or q0_based (needs q)."""
    total = counts["porn"] + counts["politics"] + counts["abuse"]
    score = (1.0 * counts["porn"] + 0.6 * counts["politics"] + 0.5 * counts["abuse"]) / F.greatest(total, F.lit(1))
    s = (F.tanh(score * 5) + 1) / 2
    if method == "original":
        x = s * conf
    elif method == "offset":
        x = s * (1.0 + (conf - 0.5) * 0.5)
    else:
        x = s * 0.7 + conf * 0.3
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(total == 0, base).otherwise(base + (most - base) * x)))
    if method == "q0_based" and q is not None:
        adjusted = F.greatest(F.lit(0.5), F.least(F.lit(1.3), 0.5 + (conf - 0.5) * (1.3 - 0.5) / (0.9 - 0.5)))
        return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(0.9), q * (0.7 + (1 - 0.7) * adjusted))), p)
    return p


def features(counts: dict[str, Column], words: Column, length: Column, labels: Column) -> dict[str, Column]:
    """The 21 credibility features by name. Anything but a list of subtypes counts as none."""
    n = {k: c.cast("double") for k, c in counts.items()}
    total = n["porn"] + n["politics"] + n["abuse"]
    hit = {k: c > 0 for k, c in counts.items()}
    one = {k: v.cast("double") for k, v in hit.items()}
    labels = F.array_distinct(F.coalesce(labels, F.array().cast("array<string>")))
    matched = F.array_compact(F.array(*[F.when(hit[k], k) for k in counts]))
    both = F.size(F.array_intersect(matched, labels)) / F.size(F.array_union(matched, labels))
    agree = (
        F.when((F.size(labels) == 0) & (F.size(matched) == 0), 1.0).when((F.size(labels) == 0) | (F.size(matched) == 0), 0.0).otherwise(both)
    )
    first = (n["porn"] >= n["politics"]) & (n["porn"] >= n["abuse"])
    second = ~first & (n["politics"] >= n["abuse"])
    per_char = F.when(length > 0, total / length).otherwise(0.0)
    out = {f"lexicon_match_{k}": n[k] for k in counts}
    out |= {"total_matches": total, "match_ratio": total / words} | {f"has_{k}_match": one[k] for k in counts}
    out |= {f"subtype_match_{k}": (F.array_contains(labels, k) & hit[k]).cast("double") for k in counts} | {"subtype_match_score": agree}
    out |= {"match_density": per_char, "match_span_ratio": F.when(length > 0, total * 3.0 / length).otherwise(0.0)}
    out |= {"max_match_category_porn": first.cast("double"), "max_match_category_politics": second.cast("double"), "max_match_category_abuse": (~first & ~second).cast("double")}
    sure = {"porn": 1.0, "politics": 0.8, "abuse": 0.6}
    out |= {f"source_confidence_{k}": F.lit(v) for k, v in sure.items()}
    weighted = (n["porn"] * 1.0 + n["politics"] * 0.8 + n["abuse"] * 0.6) / F.when(total > 0, total)
    return out | {"weighted_source_confidence": F.coalesce(weighted, F.lit(0.0))}
