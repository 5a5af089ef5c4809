"""Band arithmetic and per-observation predicates (F-01 to F-12, F-43, F-44, P-03, P-04, P-07 to P-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

# Thresholds of the published rules.
THICK_SMOKE, CLEAR_LIMIT, MIN_VALID = 0.20, 0.10, 0.6
RED_FLOOR = 0.005
CLOUD_CLASSES = (3, 8, 9, 10, 11)


def normalized_difference(a: Column, b: Column) -> Column:
    """F-01: (a - b) / (a + b); NULL if either is missing or not finite, or the sum is 0."""
    a, b = finite(a), finite(b)
    return F.try_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def nbr(narrow_nir: Column, swir2: Column) -> Column:
    return normalized_difference(narrow_nir, swir2)


def nbr_b08(nir: Column, swir2: Column) -> Column:
    """F-02: the wide-NIR variant, for non-negative bands only."""
    return F.when((nir >= 0) & (swir2 >= 0), normalized_difference(nir, swir2))


def nbr2(swir1: Column, swir2: Column) -> Column:
    """F-03."""
    return normalized_difference(swir1, swir2)


def _bais2(b4: Column, b6: Column, b7: Column, b8a: Column, b12: Column) -> Column:
    return (1 - F.sqrt(b6 * b7 * b8a / b4)) * ((b12 - b8a) / F.sqrt(b12 + b8a) + 1)


def bais2_strict(b4: Column, b6: Column, b7: Column, b8a: Column, b12: Column) -> Column:
    """F-04: NULL where red is 0, a radicand is negative or the root sum is not positive."""
    b4, b6, b7, b8a, b12 = map(finite, (b4, b6, b7, b8a, b12))
    # the guards stand inside the arithmetic too, since branches may be computed before they are chosen
    red, radicand, total = F.when(b4 != 0, b4), b6 * b7 * b8a, b12 + b8a
    inner, root = F.try_divide(radicand, red), F.when(total > 0, total)
    return (1 - F.sqrt(F.when(inner >= 0, inner))) * (F.try_divide(b12 - b8a, F.sqrt(root)) + 1)


def bais2_floored(b4: Column, b6: Column, b7: Column, b8a: Column, b12: Column, floor: float = RED_FLOOR) -> Column:
    """F-05: NULL where red lies under its physical floor."""
    b4, b6, b7, b8a, b12 = map(finite, (b4, b6, b7, b8a, b12))
    inner = F.greatest(F.try_divide(b6 * b7 * b8a, F.greatest(b4, F.lit(floor))), F.lit(0.0))
    value = (1 - F.sqrt(inner)) * ((b12 - b8a) / F.sqrt(F.greatest(b12 + b8a, F.lit(1e-8))) + 1)
    return F.when((b4 >= floor) & b6.isNotNull() & b7.isNotNull() & b8a.isNotNull() & b12.isNotNull(), value)


def bais2_of_means(b4: Column, b6: Column, b7: Column, b8a: Column, b12: Column) -> Column:
    """F-06: from band means, radicand clipped at 0 and denominator at 1e-8; NULL for non-positive red."""
    b4, b6, b7, b8a, b12 = map(finite, (b4, b6, b7, b8a, b12))
    inner = F.greatest(F.try_divide(b6 * b7 * b8a, F.when(b4 > 0, b4)), F.lit(0.0))
    value = (1 - F.sqrt(inner)) * ((b12 - b8a) / F.sqrt(F.greatest(b12 + b8a, F.lit(1e-8))) + 1)
    return F.when((b4 > 0) & (b6 * b7 * b8a).isNotNull() & b12.isNotNull(), value)


def bais2_stability(mean_of_index: Column, index_of_means: Column, gap: float = 0.25) -> Column:
    """F-06: UNVERIFIED without both values, UNSTABLE if they lie more than gap apart, else OK."""
    return F.when(mean_of_index.isNull() | index_of_means.isNull(), "UNVERIFIED").when(F.abs(mean_of_index - index_of_means) > gap, "UNSTABLE").otherwise("OK")


def valid_fraction(n_valid: Column, n_cloud: Column) -> Column:
    """F-43."""
    return n_valid / F.greatest(n_valid + n_cloud, F.lit(1))


def pixel_area_ha(n_px: Column) -> Column:
    """F-44: pixels of 20 m."""
    return n_px * 0.04


def haze_class(blue: Column, narrow_nir: Column, swir2: Column, valid: Column) -> Column:
    """P-03: the first of no data, cloud, thick smoke and haze that holds, else clear."""
    return (
        F.when(blue.isNull() | narrow_nir.isNull() | swir2.isNull(), "NO_DATA_EXCLUDED")
        .when(valid < MIN_VALID, "CLOUD_EXCLUDED")
        .when(blue >= THICK_SMOKE, "THICK_SMOKE_EXCLUDED")
        .when(blue >= CLEAR_LIMIT, "HAZE_DOWNGRADED")
        .otherwise("CLEAR")
    )


def usable(haze: Column, index: Column) -> Column:
    """P-04."""
    return haze.isin("CLEAR", "HAZE_DOWNGRADED") & index.isNotNull()


def clear(haze: Column, index: Column) -> Column:
    """P-04."""
    return (haze == "CLEAR") & index.isNotNull()


def char_pixel(nir: Column, swir2: Column, index: Column) -> Column:
    """F-10: dark pixel with a low burn ratio."""
    return F.coalesce((nir < 0.12) & (swir2 < 0.14) & (index < 0.0), F.lit(False))


def green_pixel(index: Column) -> Column:
    """F-10."""
    return F.coalesce(index >= 0.5, F.lit(False))


def reflectance(dn: Column, baseline: Column) -> Column:
    """F-11: digital numbers of processing baseline 4.00 and later carry an offset of 1000."""
    return (dn - F.when(baseline >= 4.0, 1000).otherwise(0)) / 10000


def masked_reflectance(dn: Column, scene_class: Column, classes: tuple[int, ...] = CLOUD_CLASSES) -> Column:
    """S-15: scaled reflectance outside the cloud classes."""
    return F.when(~scene_class.isin(*classes), dn * 1e-4)


def to_linear(db: Column) -> Column:
    """F-12."""
    return F.pow(F.lit(10.0), db / 10)


def to_db(linear: Column) -> Column:
    """F-12: NULL for non-positive power."""
    return 10 * F.log10(F.when(linear > 0, linear))


def gap_category(days: Column) -> Column:
    """P-12: NORMAL up to 14 days, MODERATE up to 30, LARGE beyond."""
    return F.when(days.isNull(), None).when(days <= 14, "NORMAL").when(days <= 30, "MODERATE").otherwise("LARGE")


def eligible(quality: Column, n_valid: Column) -> Column:
    """P-02: not POOR, and pixels to show for it."""
    return F.coalesce(quality != "POOR", F.lit(True)) & (F.coalesce(n_valid, F.lit(0)) > 0)


def product_quality(n_valid: Column, fraction: Column, physical: Column) -> Column:
    """P-08: GOOD from 10 pixels and half coverage, LIMITED from 5 and a quarter, else (or if unphysical) POOR."""
    return F.when(~F.coalesce(physical, F.lit(False)), "POOR").when((n_valid >= 10) & (fraction >= 0.5), "GOOD").when((n_valid >= 5) & (fraction >= 0.25), "LIMITED").otherwise("POOR")


def physical(red: Column, *indices: Column) -> Column:
    """P-09: positive red and indices within [-1, 1]; missing indices do not count against it."""
    out = F.coalesce(red > 0, F.lit(False))
    for i in indices:
        out = out & F.coalesce(i.between(-1, 1), F.lit(True))
    return out


def event_quality(haze: Column, next_date: Column, valid: Column) -> Column:
    """P-10."""
    return F.when(haze == "HAZE_DOWNGRADED", "HAZE_DOWNGRADED").when(next_date.isNull(), "NO_POST_IMAGE").when(valid >= 0.9, "GOOD").otherwise("FAIR")


def scene_status(excluded: Column, hazy: Column) -> Column:
    """P-11: roll-up of the shares of excluded and hazy fields of a scene."""
    return F.when(excluded >= 0.5, "EXCLUDED").when(hazy >= 0.5, "HAZE_DOWNGRADED").otherwise("USABLE")


# F-08 and F-09. Comparisons with a missing value do not hold.
def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def loose_burn(post: Column, nir: Column, swir2: Column, index: Column, nir_drop: Column, swir_drop: Column, index_drop: Column, char: Column) -> Column:
    """F-08, loose tier: after harvest, and either dark with a drop in all three or a quarter of charred pixels."""
    dark = _holds(nir < 0.15) & _holds(swir2 < 0.17) & _holds(index < 0.03)
    drop = _holds(nir_drop > 0.06) & _holds(swir_drop > 0.03) & _holds(index_drop > 0.08)
    return _holds(post) & (dark & drop | _holds(char >= 0.25))


def strict_burn(loose: Column, nir: Column, swir2: Column, index: Column, nir_drop: Column, swir_drop: Column, index_drop: Column, char: Column, prev_haze: Column, prev_index: Column, next_index: Column) -> Column:
    """F-08, strict tier: darker still, seen from a clear image, and lasting to the next one."""
    drop = _holds(nir_drop > 0.06) & _holds(swir_drop > 0.03) & _holds(index_drop > 0.08)
    dark = _holds(nir < 0.12) & _holds(swir2 < 0.14) & _holds(index < 0.0)
    spectral = dark & drop & _holds(index_drop >= 0.10) | _holds(char >= 0.40) & _holds(index_drop >= 0.10) & _holds(nir_drop > 0.06)
    return loose & spectral & _holds(prev_haze == "CLEAR") & _holds(next_index <= prev_index - 0.05)


def blocked_by_haze(loose: Column, strict: Column, index_drop: Column, prev_haze: Column) -> Column:
    """F-09."""
    return loose & ~strict & _holds(index_drop >= 0.10) & ~_holds(prev_haze == "CLEAR")


def blocked_by_consistency(loose: Column, strict: Column, index_drop: Column, prev_haze: Column, prev_index: Column, next_index: Column) -> Column:
    """F-09."""
    return loose & ~strict & _holds(index_drop >= 0.10) & _holds(prev_haze == "CLEAR") & ~_holds(next_index <= prev_index - 0.05)
