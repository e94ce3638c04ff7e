"""Pixel operators on square images held as an array of grays in a row: all of an image's work stays
in its row or its group, and no two images meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TRANSFORMS

#: Steps (dy, dx) of distance d by angle, in a frame whose rows go down.
STEPS = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}
#: Multiple of 1 + k * k for k from 0 to 7: homogeneity of eight levels in whole numbers.
COMMON = 408850


def pixel_rows(df: DataFrame, keys: list[str], pixels: str, side: int) -> DataFrame:
    """keys, y, x, g: a row for each pixel."""
    return df.select(*keys, F.posexplode(pixels).alias("p", "g")).select(*keys, F.expr(f"p div {side}").cast("int").alias("y"), (F.col("p") % side).alias("x"), "g")


def pair_counts(df: DataFrame, keys: list[str], pixels: str, side: int, distances: tuple[int, ...], angles: tuple[int, ...], foreground: bool = False) -> DataFrame:
    """keys, d, a, i, j, n: symmetric co-occurrence counts. Pairs are formed inside the row, not by a
    join; with foreground, pairs that touch gray 0 do not count."""
    found = []
    for d in distances:
        for a in angles:
            dy, dx = (s * d for s in STEPS[a])
            inner = f"transform(filter(sequence(0, {side * side - 1}), p -> p div {side} + {dy} between 0 and {side - 1} and p % {side} + {dx} between 0 and {side - 1}), p -> named_struct('d', {d}, 'a', {a}, 'i', v[p], 'j', v[p + {dy * side + dx}]))"
            found.append(_bound(pixels, inner))
    pairs = df.select(*keys, F.explode(F.concat(*found)).alias("q")).select(*keys, "q.*")
    if foreground:
        pairs = pairs.filter("i > 0 and j > 0")
    return pairs.select(*keys, "d", "a", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("s")).groupBy(*keys, "d", "a", F.col("s.i").alias("i"), F.col("s.j").alias("j")).agg(F.count("*").alias("n"))


def glcm(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d, a, contrast, homogeneity, energy, entropy from co-occurrence counts of up to eight
    levels; sums are of whole numbers and divided once, so no order of summing shows."""
    n, step = F.col("n"), F.col("i") - F.col("j")
    total = F.sum("n")
    return counts.groupBy(*keys, "d", "a").agg(
        (F.sum(n * step * step).cast("double") / total).alias("contrast"),
        (F.sum(n * F.expr(f"{COMMON} div (1 + (i - j) * (i - j))")).cast("double") / (total * COMMON)).alias("homogeneity"),
        (F.sum(n * n).cast("double") / (total * total)).alias("energy"),
        F.round(F.log2(total) - F.sum(n * F.log2("n")) / total, 6).alias("entropy"))


def otsu_threshold(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the gray up to which the between-class variance is largest, the lowest on ties.

    From exact sums over the histogram, of up to 256 rows an image."""
    from pyspark.sql import Window as W

    histogram = pixels.groupBy(*keys, "g").agg(F.count("*").alias("n"))
    upto, every = W.partitionBy(*keys).orderBy("g"), W.partitionBy(*keys)
    low = histogram.select(*keys, "g", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("g")).over(upto).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("g")).over(every).alias("s"))
    # w0 * w1 * (mean0 - mean1)**2 is (s0 * w - s * w0)**2 / (w0 * w1), up to a factor
    between = F.pow((F.col("s0") * F.col("w") - F.col("s") * F.col("w0")).cast("double"), F.lit(2.0)) / F.nullif(F.col("w0") * (F.col("w") - F.col("w0")), F.lit(0)).cast("double")
    return low.withColumn("v", F.coalesce(between, F.lit(-1.0))).groupBy(*keys).agg(F.max_by("g", F.struct("v", -F.col("g"))).alias("threshold"))


def otsu_mask(df: DataFrame, keys: list[str], pixels: str, side: int) -> DataFrame:
    """keys, mask: the side of the threshold that holds the image's centre."""
    threshold = otsu_threshold(pixel_rows(df, keys, pixels, side), keys)
    joined = df.select(*keys, pixels).join(threshold, keys)
    center = (side // 2) * side + side // 2
    return joined.select(*keys, _bound(pixels, f"transform(v, g -> cast((g > threshold) = (v[{center}] > threshold) as int))").alias("mask"))


def _bound(column: str, body: str) -> Column:
    """body over v, which stands for the column: computed once, where a name inside a lambda would be
    replaced by its whole expression and computed for every element."""
    return F.expr(f"element_at(transform(array({column}), v -> {body}), 1)")


def _window(best: str, side: int, reach: int) -> str:
    near = f"filter(sequence(0, {side * side - 1}), q -> abs(q div {side} - p div {side}) <= {reach} and abs(q % {side} - p % {side}) <= {reach})"
    return f"transform(sequence(0, {side * side - 1}), p -> {best}(transform({near}, q -> v[q])))"


def eroded(mask: str, side: int, reach: int = 1) -> Column:
    """A pixel stays where all pixels within reach, of those the image has, are set."""
    return _bound(mask, _window("array_min", side, reach))


def transformed(pixels: str, side: int, name: str) -> Column:
    """One of the eight symmetries: a flip first, then quarter turns against the clock."""
    if name not in TRANSFORMS:
        raise ValueError(f"no transform {name}")
    turns = int(name.rpartition("rot")[2] or 0) // 90 if "rot" in name else 0
    last = side - 1
    source = {0: ("y", "x"), 1: ("x", f"({last} - y)"), 2: (f"({last} - y)", f"({last} - x)"), 3: (f"({last} - x)", "y")}[turns]
    fill = lambda s: s.replace("y", "#").replace("x", f"(p % {side})").replace("#", f"(p div {side})")
    y, x = map(fill, source)
    if name.startswith("flip"):
        x = f"({last} - {x})"
    return _bound(pixels, f"transform(sequence(0, {side * side - 1}), p -> v[cast({y} * {side} + {x} as int)])")


def resized(pixels: str, side: int, to: int) -> Column:
    """Nearest neighbour: the source of a place is the floor of its scaled place."""
    return _bound(pixels, f"transform(sequence(0, {to * to - 1}), p -> v[cast((p div {to}) * {side} div {to} * {side} + (p % {to}) * {side} div {to} as int)])")


def cropped(pixels: DataFrame, keys: list[str], object_: Column) -> DataFrame:
    """keys, y, x, g of the object's bounding box, from its corner; the object at least 1, the rest 0."""
    box = pixels.filter(object_).groupBy(*keys).agg(*[f(c).alias(f"{c}{k}") for c in "yx" for k, f in enumerate((F.min, F.max))])
    inside = pixels.join(box, keys).filter("y between y0 and y1 and x between x0 and x1")
    return inside.select(*keys, (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.when(object_, F.greatest("g", F.lit(1))).otherwise(0).alias("g"))


def in_band(side: int, band: int) -> Column:
    return (F.col("y") < band) | (F.col("y") >= side - band) | (F.col("x") < band) | (F.col("x") >= side - band)


def surface_sums(pixels: DataFrame, keys: list[str], side: int, band: int, value: str = "g") -> DataFrame:
    """Normal equations of the quadratic surface through the border band: m, 21 sums of products of
    1, x, y, xx, xy, yy, and v, 6 of them with the value; x and y in pixels, so all are whole."""
    terms = [F.lit(1), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"), F.col("y") * F.col("y")]
    m = [F.sum(terms[i] * terms[j]).cast("long") for i in range(6) for j in range(i, 6)]
    v = [F.sum(t * F.col(value)).cast("long") for t in terms]
    return pixels.filter(in_band(side, band)).groupBy(*keys).agg(F.array(*m).alias("m"), F.array(*v).alias("v"))


def dilated(mask: str, side: int, reach: int = 1) -> Column:
    """A pixel is set where any pixel within reach is."""
    return _bound(mask, _window("array_max", side, reach))


def blur_sums(pixels: str, side: int) -> Column:
    """256 times a Gaussian blur of five by five pixels, mirrored at the frame."""
    last = side - 1
    fold = lambda at: f"({last} - abs({last} - abs({at})))"
    terms = " + ".join(f"{a * b} * v[cast({fold(f'p div {side} + {dy}')} * {side} + {fold(f'p % {side} + {dx}')} as int)]" for dy, a in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True) for dx, b in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True))
    return _bound(pixels, f"transform(sequence(0, {side * side - 1}), p -> {terms})")
