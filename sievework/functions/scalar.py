"""Column functions: names of features, colours, angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FAMILIES

D = float


def feature_family(name: Column) -> Column:
    """The family of a feature by its prefix; any other name is an error."""
    out = F.raise_error(F.concat(F.lit("no family for feature "), name)).cast("string")
    for prefix, family in reversed(FAMILIES.items()):
        out = F.when(F.startswith(name, F.lit(prefix)), F.lit(family)).otherwise(out)
    return out


def family_of(name: str) -> str:
    for prefix, family in FAMILIES.items():
        if name.startswith(prefix):
            return family
    raise ValueError(f"no family for feature {name}")


def quarter_turns(transform: Column) -> Column:
    """Degrees at the end of a transform's name; without them none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(transform, r"rot(\d+)$", 1), F.lit("")), F.lit("999")).cast("int"), F.lit(0))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.rint(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct h (0-180), s, v (0-255), not rounded, of 8-bit channels."""
    high, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = high - low
    turn = F.when(span == 0, F.lit(0.0)).when(high == r, 60.0 * (g - b) / span).when(high == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    return F.struct((F.when(turn < 0, turn + 360.0).otherwise(turn) / 2.0).alias("h"), F.when(high == 0, F.lit(0.0)).otherwise(span * 255.0 / F.nullif(high, F.lit(0.0))).alias("s"), high.alias("v"))


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct l, a, b in 8-bit units (L * 255 / 100, a and b + 128), not rounded; D65 white."""
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in (x / 255.0 for x in (r, g, b))]
    # sRGB to XYZ over the white point.
    rows = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
    x, y, z = ((p * linear[0] + q * linear[1] + s * linear[2]) / w for p, q, s, w in rows)
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)
    light = F.when(y > 0.008856, 116.0 * F.pow(y, F.lit(1.0 / 3.0)) - 16.0).otherwise(903.3 * y)
    return F.struct((light * 255.0 / 100.0).alias("l"), (500.0 * (f(x) - f(y)) + 128.0).alias("a"), (200.0 * (f(y) - f(z)) + 128.0).alias("b"))


def circular_hue(sine: Column, cosine: Column) -> Column:
    """struct mean, sd in hue units (0-180) from the means of the sine and cosine of the hues."""
    unit = 90.0 / 3.141592653589793
    length = F.least(F.hypot(sine, cosine), F.lit(1.0))
    turn = F.pmod(F.atan2(sine, cosine), F.lit(2 * 3.141592653589793))
    spread = F.when(length > 1.0 - 1e-12, F.lit(0.0)).otherwise(F.sqrt(-2.0 * F.log(F.greatest(length, F.lit(1e-12)))))
    return F.struct((turn * unit).alias("mean"), (spread * unit).alias("sd"))


def upload_error(length: Column, head: Column, limit: int = 25 << 20) -> Column:
    """Why a file cannot be graded, by its size and first bytes; null if it may be an image."""
    # Signatures of JPEG and PNG files.
    known = F.startswith(head, F.unhex(F.lit("FFD8FF"))) | F.startswith(head, F.unhex(F.lit("89504E470D0A1A0A")))
    return F.when(length == 0, F.lit("The file is empty.")).when(length > limit, F.concat(F.lit("The file is larger than "), F.lit(str(limit >> 20)), F.lit(" MB."))).when(~known, F.lit("The file is neither a JPEG nor a PNG image."))
