"""Set and vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overlap_score(left: Column | str, right: Column | str) -> Column:
    """Share of ``left`` found in ``right``; 0 when ``left`` is empty."""
    left, right = _col(left), _col(right)
    return F.when(F.size(left) == 0, 0.0).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(left))


def jaccard_sizes(left: Column | str, right: Column | str, common: Column | str) -> Column:
    """Intersection over union from set sizes; both empty 1, one empty 0."""
    left, right, common = _col(left), _col(right), _col(common)
    return (F.when((left == 0) & (right == 0), 1.0).when((left == 0) | (right == 0), 0.0)
            .otherwise(common / (left + right - common)))


def jaccard(left: Column | str, right: Column | str) -> Column:
    left, right = _col(left), _col(right)
    return jaccard_sizes(F.size(left), F.size(right), F.size(F.array_intersect(left, right)))


def alignment(claim_terms: Column | str, evidence_terms: Column | str) -> Column:
    """Share of claim terms also in the evidence; 1 when the claim has none,
    0 when only the evidence has none."""
    claim_terms, evidence_terms = _col(claim_terms), _col(evidence_terms)
    return (F.when(F.size(claim_terms) == 0, 1.0)
            .when(F.size(evidence_terms) == 0, 0.0)
            .otherwise(F.size(F.array_intersect(claim_terms, evidence_terms))
                       / F.size(claim_terms)))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_normalise(v: Column | str) -> Column:
    """L2-normalised vector (double precision); a zero vector stays zero."""
    doubles = _col(v).cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(doubles, lambda x: F.when(norm > 0, x / norm).otherwise(x))
