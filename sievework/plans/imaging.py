"""Queries on pixels, over vectors read as 8 by 8 images, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import pixels
from ..schema import TRANSFORMS

SIDE, BAND = 8, 2
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def images(spark: SparkSession, d: str, levels: int = 256) -> DataFrame:
    """img and px: 64 grays of so many levels."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    level = lambda x: F.least(F.greatest(F.floor((x.cast("double") + F.lit(0.6)) / F.lit(1.2) * levels), F.lit(0)), F.lit(levels - 1)).cast("int")
    return v.select(F.col("vec_id").alias("img"), F.transform("embedding", level).alias("px"))


def _px(levels: int = 256) -> str:
    return f"px AS (SELECT vec_id AS img, i // 8 AS y, i % 8 AS x, least(greatest(floor((embedding[i + 1]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * {levels}), 0), {levels - 1})::INT AS g FROM embeddings, range(64) t(i))"


OFFSETS = " UNION ALL ".join(f"SELECT {d} AS d, {a} AS a, {d * dy} AS dy, {d * dx} AS dx" for d in (1, 2, 3) for a, (dy, dx) in pixels.STEPS.items())


def _glcm_sql(levels: int, where: str = "true") -> str:
    return f"""
WITH {_px(levels)}, o AS ({OFFSETS}),
q AS (SELECT p.img, d, a, p.g AS i, r.g AS j FROM px p, o, px r WHERE r.img = p.img AND r.y = p.y + dy AND r.x = p.x + dx),
b AS (SELECT img, d, a, i, j FROM q WHERE {where} UNION ALL SELECT img, d, a, j, i FROM q WHERE {where}),
n AS (SELECT img, d, a, i, j, count(*) AS n FROM b GROUP BY ALL)
SELECT img, d::INT AS d, a::INT AS a, sum(n * (i - j) * (i - j))::DOUBLE / sum(n) AS contrast, sum(n * ({pixels.COMMON} // (1 + (i - j) * (i - j))))::DOUBLE / (sum(n) * {pixels.COMMON}) AS homogeneity,
  sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS energy, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS entropy
FROM n GROUP BY ALL"""


@query("glcm_features", _glcm_sql(8))
def glcm_features(spark, d):
    return pixels.glcm(pixels.pair_counts(images(spark, d, 8), ["img"], "px", SIDE, (1, 2, 3), tuple(pixels.STEPS)), ["img"])


@query("glcm_foreground", _glcm_sql(8, "i > 2 AND j > 2"))
def glcm_foreground(spark, d):
    """Pixels of gray 2 and below are background: lifted to 0, so their pairs do not count."""
    lifted = images(spark, d, 8).withColumn("px", F.transform("px", lambda g: F.when(g > 2, g).otherwise(0)))
    return pixels.glcm(pixels.pair_counts(lifted, ["img"], "px", SIDE, (1, 2, 3), tuple(pixels.STEPS), foreground=True), ["img"])


OTSU = f"""
WITH {_px()}, h AS (SELECT img, g, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT img, g, sum(n) OVER u AS w0, sum(n * g) OVER u AS s0, sum(n) OVER e AS w, sum(n * g) OVER e AS s FROM h WINDOW u AS (PARTITION BY img ORDER BY g), e AS (PARTITION BY img)),
v AS (SELECT img, g, coalesce(pow((s0 * w - s * w0)::DOUBLE, 2) / nullif(w0 * (w - w0), 0)::DOUBLE, -1) AS v FROM c),
t AS (SELECT img, g AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY img ORDER BY v DESC, g) = 1)
"""


@query("otsu_threshold", OTSU + "SELECT img, threshold FROM t")
def otsu_threshold(spark, d):
    return pixels.otsu_threshold(pixels.pixel_rows(images(spark, d), ["img"], "px", SIDE), ["img"])


MASK = OTSU + ", m AS (SELECT img, y, x, g, ((g > threshold) = max(CASE WHEN y = 4 AND x = 4 THEN (g > threshold)::INT END) OVER (PARTITION BY img)::BOOLEAN)::INT AS mask FROM px JOIN t USING (img))"


@query("otsu_mask_center", MASK + " SELECT img, string_agg(mask::VARCHAR, '' ORDER BY y, x) AS mask FROM m GROUP BY 1")
def otsu_mask_center(spark, d):
    return pixels.otsu_mask(images(spark, d), ["img"], "px", SIDE).select("img", F.array_join("mask", "").alias("mask"))


@query("erode_mask", MASK + " , e AS (SELECT a.img, a.y, a.x, min(b.mask) AS mask FROM m a JOIN m b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT img, string_agg(mask::VARCHAR, '' ORDER BY y, x) AS mask FROM e GROUP BY 1")
def erode_mask(spark, d):
    return pixels.otsu_mask(images(spark, d), ["img"], "px", SIDE).select("img", F.array_join(pixels.eroded("mask", SIDE), "").alias("mask"))


@query("bbox_crop", f"WITH {_px()}, b AS (SELECT img, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px WHERE g > 190 GROUP BY 1) SELECT img, (y - y0)::INT AS y, (x - x0)::INT AS x, CASE WHEN g > 190 THEN greatest(g, 1) ELSE 0 END::INT AS g FROM px JOIN b USING (img) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")
def bbox_crop(spark, d):
    p = pixels.pixel_rows(images(spark, d), ["img"], "px", SIDE)
    return pixels.cropped(p, ["img"], F.col("g") > 190).select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("g").cast("int").alias("g"))


@query("resize_nearest", f"WITH {_px()} SELECT img, string_agg(g::VARCHAR, ',' ORDER BY yy, xx) AS px FROM px, range(12) a(yy), range(12) b(xx) WHERE y = yy * 8 // 12 AND x = xx * 8 // 12 GROUP BY 1")
def resize_nearest(spark, d):
    return images(spark, d).select("img", F.array_join(pixels.resized("px", SIDE, 12), ",").alias("px"))


def _turned(name: str) -> str:
    turns = int(name.rpartition("rot")[2] or 0) // 90 if "rot" in name else 0
    x = "(7 - x)" if name.startswith("flip") else "x"
    y, x = {0: ("y", x), 1: (f"(7 - {x})", "y"), 2: ("(7 - y)", f"(7 - {x})"), 3: (x, "(7 - y)")}[turns]
    return f"SELECT img, '{name}' AS augment, {y} AS y, {x} AS x, g FROM px"


@query("geom_transforms", f"WITH {_px()}, a AS ({' UNION ALL '.join(map(_turned, TRANSFORMS))}) SELECT img, augment, string_agg(g::VARCHAR, ',' ORDER BY y, x) AS px FROM a GROUP BY ALL")
def geom_transforms(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("augment"), F.array_join(pixels.transformed("px", SIDE, t), ",").alias("px")) for t in TRANSFORMS]))
    return images(spark, d).select("img", each.alias("t")).select("img", "t.*")


@query("rotation_swap_check", _glcm_sql(8).replace("FROM n GROUP BY ALL", "FROM n WHERE d = 1 AND a IN (0, 90) GROUP BY ALL").replace("a::INT AS a", "(90 - a)::INT AS a"))
def rotation_swap_check(spark, d):
    """A quarter turn swaps what is measured along rows and columns."""
    turned = images(spark, d, 8).withColumn("px", pixels.transformed("px", SIDE, "rot90"))
    return pixels.glcm(pixels.pair_counts(turned, ["img"], "px", SIDE, (1,), (0, 90)), ["img"])


def colors(spark, d) -> DataFrame:
    """img, i, r, g, b: 21 pixels from consecutive grays."""
    return images(spark, d).select("img", F.posexplode(F.expr("transform(sequence(0, 20), k -> named_struct('r', px[3 * k], 'g', px[3 * k + 1], 'b', px[3 * k + 2]))")).alias("i", "c")).select("img", "i", "c.*")


RGB = f"WITH {_px()}, c AS (SELECT img, ((y * 8 + x) // 3)::INT AS i, max(CASE WHEN (y * 8 + x) % 3 = 0 THEN g END) AS r, max(CASE WHEN (y * 8 + x) % 3 = 1 THEN g END) AS g, max(CASE WHEN (y * 8 + x) % 3 = 2 THEN g END) AS b FROM px WHERE y * 8 + x < 63 GROUP BY ALL)"
HSV = RGB + """, s AS (SELECT *, greatest(r, g, b)::DOUBLE AS hi, greatest(r, g, b)::DOUBLE - least(r, g, b)::DOUBLE AS span FROM c),
t AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN hi = r THEN 60.0::DOUBLE * (g - b) / span WHEN hi = g THEN 120 + 60.0::DOUBLE * (b - r) / span ELSE 240 + 60.0::DOUBLE * (r - g) / span END AS turn FROM s),
h AS (SELECT img, i, CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2.0::DOUBLE AS h, CASE WHEN hi = 0 THEN 0 ELSE span * 255.0::DOUBLE / nullif(hi, 0) END AS s, hi AS v FROM t)"""


@query("gray_convert", RGB + " SELECT img, i, round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0)::INT AS gray FROM c")
def gray_convert(spark, d):
    return colors(spark, d).select("img", "i", scalar.gray(*map(F.col, "rgb")).alias("gray"))


@query("hsv_stats", HSV + " SELECT img, round(avg(s), 6) AS s_mean, round(stddev_pop(s), 6) AS s_std, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std FROM h GROUP BY 1")
def hsv_stats(spark, d):
    c = colors(spark, d).select("img", scalar.hsv(*map(F.col, "rgb")).alias("c"))
    return c.groupBy("img").agg(*[F.round(f(f"c.{x}"), 6).alias(f"{x}_{n}") for x in "sv" for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


@query("hue_circular", HSV + """, a AS (SELECT img, avg(sin(h * (pi() / 90))) AS sn, avg(cos(h * (pi() / 90))) AS cs FROM h GROUP BY 1),
l AS (SELECT img, atan2(sn, cs) AS t, least(sqrt(sn * sn + cs * cs), 1) AS r FROM a)
SELECT img, round((CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END) * 90 / pi(), 6) AS h_mean, round(CASE WHEN r > 1 - 1e-12 THEN 0 ELSE sqrt(-2 * ln(greatest(r, 1e-12))) END * 90 / pi(), 6) AS h_std FROM l""")
def hue_circular(spark, d):
    turn = F.col("c.h") * F.lit(3.141592653589793 / 90)
    c = colors(spark, d).select("img", scalar.hsv(*map(F.col, "rgb")).alias("c")).groupBy("img").agg(F.avg(F.sin(turn)).alias("sn"), F.avg(F.cos(turn)).alias("cs"))
    hue = scalar.circular_hue(F.col("sn"), F.col("cs"))
    return c.select("img", F.round(hue["mean"], 6).alias("h_mean"), F.round(hue["sd"], 6).alias("h_std"))


LAB = RGB + """, n AS (SELECT img, i, """ + ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END AS {c}" for c in "rgb") + """ FROM c),
w AS (SELECT img, i, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456::DOUBLE AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754::DOUBLE AS z FROM n),
f AS (SELECT img, y, """ + ", ".join(f"CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0::DOUBLE / 3) ELSE 7.787::DOUBLE * {c} + 16.0::DOUBLE / 116 END AS f{c}" for c in "xyz") + """ FROM w),
o AS (SELECT img, CASE WHEN y > 0.008856 THEN 116.0::DOUBLE * fy - 16 ELSE 903.3::DOUBLE * y END * 255.0::DOUBLE / 100 AS l, 500.0::DOUBLE * (fx - fy) + 128 AS a, 200.0::DOUBLE * (fy - fz) + 128 AS b FROM f)"""


@query("lab_stats", LAB + " SELECT img, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in "lab" for f, n in (("avg", "mean"), ("stddev_pop", "std"))) + " FROM o GROUP BY 1")
def lab_stats(spark, d):
    c = colors(spark, d).select("img", scalar.lab(*map(F.col, "rgb")).alias("c"))
    return c.groupBy("img").agg(*[F.round(f(f"c.{x}"), 6).alias(f"{x}_{n}") for x in "lab" for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


BORDER = "y < 2 OR y >= 6 OR x < 2 OR x >= 6"


@query("border_band_stats", f"WITH {_px()} SELECT img, count(*) AS n, sum(g)::DOUBLE / count(*) AS mean, round(stddev_pop(g), 6) AS sd FROM px WHERE {BORDER} GROUP BY 1")
def border_band_stats(spark, d):
    p = pixels.pixel_rows(images(spark, d), ["img"], "px", SIDE).filter(pixels.in_band(SIDE, BAND))
    return p.groupBy("img").agg(F.count("*").alias("n"), (F.sum("g").cast("double") / F.count("*")).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("sd"))


@query("lighting_gains", f"WITH {_px()}, b AS (SELECT img, sum(g)::DOUBLE / count(*) AS m FROM px WHERE {BORDER} GROUP BY 1) SELECT img, string_agg(least(greatest(round_even(g * (110.0::DOUBLE / greatest(m, 1)), 0), 0), 255)::INT::VARCHAR, ',' ORDER BY y, x) AS px FROM px JOIN b USING (img) GROUP BY 1")
def lighting_gains(spark, d):
    """Grays times the reference over the band's mean. An image's band is in its row: no shuffle."""
    band = F.expr(f"filter(px, (g, p) -> p div {SIDE} < {BAND} or p div {SIDE} >= {SIDE - BAND} or p % {SIDE} < {BAND} or p % {SIDE} >= {SIDE - BAND})")
    mean = F.aggregate(band, F.lit(0), lambda a, g: a + g).cast("double") / F.size(band)
    with_gain = images(spark, d).withColumn("gain", F.lit(110.0) / F.greatest(mean, F.lit(1.0)))
    return with_gain.select("img", F.array_join(F.transform("px", lambda g: F.least(F.greatest(F.rint(g * F.col("gain")), F.lit(0.0)), F.lit(255.0)).cast("int")), ",").alias("px"))


_TERMS = ("1", "x", "y", "x * x", "x * y", "y * y")


@query("border_surface_fit", f"WITH {_px()} SELECT img, concat_ws(',', " + ", ".join(f"sum(({_TERMS[i]}) * ({_TERMS[j]}))::BIGINT" for i in range(6) for j in range(i, 6)) + ") AS m, concat_ws(',', " + ", ".join(f"sum(({t}) * g)::BIGINT" for t in _TERMS) + f") AS v FROM px WHERE {BORDER} GROUP BY 1")
def border_surface_fit(spark, d):
    sums = pixels.surface_sums(pixels.pixel_rows(images(spark, d), ["img"], "px", SIDE), ["img"], SIDE, BAND)
    return sums.select("img", F.array_join("m", ",").alias("m"), F.array_join("v", ",").alias("v"))


def _swept(f: str) -> str:
    return f"SELECT a.img, a.y, a.x, {f}(b.mask) AS mask FROM m a JOIN m b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL"


@query("dilate_mask", MASK + f", e AS ({_swept('max')}) SELECT img, string_agg(mask::VARCHAR, '' ORDER BY y, x) AS mask FROM e GROUP BY 1")
def dilate_mask(spark, d):
    return pixels.otsu_mask(images(spark, d), ["img"], "px", SIDE).select("img", F.array_join(pixels.dilated("mask", SIDE), "").alias("mask"))


@query("mask_opening", MASK + f", e AS ({_swept('min')}), o AS ({_swept('max').replace('FROM m a JOIN m b', 'FROM e a JOIN e b')}) SELECT img, string_agg(mask::VARCHAR, '' ORDER BY y, x) AS mask FROM o GROUP BY 1")
def mask_opening(spark, d):
    """Erosion, then dilation: what a piece smaller than the window does not survive."""
    less = pixels.otsu_mask(images(spark, d), ["img"], "px", SIDE).select("img", pixels.eroded("mask", SIDE).alias("mask"))
    return less.select("img", F.array_join(pixels.dilated("mask", SIDE), "").alias("mask"))


@query("area_downscale", f"WITH {_px()}, s AS (SELECT img, y // 2 AS yy, x // 2 AS xx, sum(g)::BIGINT AS s FROM px GROUP BY ALL) SELECT img, string_agg(s::VARCHAR, ',' ORDER BY yy, xx) AS sums FROM s GROUP BY 1")
def area_downscale(spark, d):
    """Sums over two by two pixels: four times the area average, in whole numbers."""
    at = lambda k: f"px[(q div 4) * 16 + (q % 4) * 2 + {k}]"
    return images(spark, d).select("img", F.expr(f"array_join(transform(sequence(0, 15), q -> {' + '.join(map(at, (0, 1, 8, 9)))}), ',')").alias("sums"))


BLUR = "SELECT p.img, p.y, p.x, sum(r.g * wy.w * wx.w)::BIGINT AS s FROM px p, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) wy(o, w), (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) wx(o, w), px r WHERE r.img = p.img AND r.y = 7 - abs(7 - abs(p.y + wy.o)) AND r.x = 7 - abs(7 - abs(p.x + wx.o)) GROUP BY ALL"


@query("gaussian_blur", f"WITH {_px()}, b AS ({BLUR}) SELECT img, string_agg(s::VARCHAR, ',' ORDER BY y, x) AS sums FROM b GROUP BY 1")
def gaussian_blur(spark, d):
    """256 times the five by five blur, mirrored at the frame, in whole numbers."""
    return images(spark, d).select("img", F.array_join(pixels.blur_sums("px", SIDE), ",").alias("sums"))


LARGEST = MASK.replace("WITH", "WITH RECURSIVE", 1) + """, r(img, p, label) AS (
  SELECT img, y * 8 + x, y * 8 + x FROM m WHERE mask = 1 UNION
  SELECT b.img, b.y * 8 + b.x, r.label FROM r JOIN m b ON b.img = r.img AND b.mask = 1 AND abs(b.y - r.p // 8) <= 1 AND abs(b.x - r.p % 8) <= 1),
l AS (SELECT img, p, min(label) AS label FROM r GROUP BY ALL)
SELECT img, label::INT AS first_pixel, n::INT AS size FROM (SELECT img, label, count(*) AS n FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, label) = 1"""


@query("largest_component", LARGEST)
def largest_component(spark, d):
    """The mask's largest piece, by the kernel that photos go through."""
    import numpy as np
    import pandas as pd

    from ..kernels.morphology import largest

    def work(batches):
        for batch in batches:
            rows = []
            for img, mask in zip(batch["img"], batch["mask"], strict=True):
                found = np.flatnonzero(largest(np.asarray(mask).reshape(SIDE, SIDE) > 0))
                if len(found):
                    rows.append((img, int(found[0]), len(found)))
            yield pd.DataFrame(rows, columns=["img", "first_pixel", "size"])

    return pixels.otsu_mask(images(spark, d), ["img"], "px", SIDE).mapInPandas(work, "img long, first_pixel int, size int")


@query("glcm_kernel", f"SELECT img, d, a, round(contrast, 9) AS contrast, round(homogeneity, 9) AS homogeneity, round(energy, 9) AS energy, entropy FROM ({_glcm_sql(8)})")
def glcm_kernel(spark, d):
    """Texture by the kernel that photos go through, of the same pixels as the relational form."""
    import numpy as np
    import pandas as pd

    from ..kernels.texture import glcm_features

    def work(batches):
        for batch in batches:
            rows = []
            for img, px in zip(batch["img"], batch["px"], strict=True):
                f = glcm_features(np.asarray(px, np.uint8).reshape(SIDE, SIDE), levels=8)
                rows += [(img, k, a, *(round(f[f"glcm_d{k}_a{a}_{s}"], 6 if s == "entropy" else 9) for s in ("contrast", "homogeneity", "energy", "entropy"))) for k in (1, 2, 3) for a in pixels.STEPS]
            yield pd.DataFrame(rows, columns=["img", "d", "a", "contrast", "homogeneity", "energy", "entropy"])

    return images(spark, d).mapInPandas(work, "img long, d int, a int, contrast double, homogeneity double, energy double, entropy double")


EDGES = """, n AS (
  SELECT a.img, a.y, a.x, coalesce(sum(CASE WHEN c.dx <> 0 THEN c.dx * (2 - abs(c.dy)) * b.g END), 0)::INT AS gx, coalesce(sum(CASE WHEN c.dy <> 0 THEN c.dy * (2 - abs(c.dx)) * b.g END), 0)::INT AS gy
  FROM px a, (SELECT dy, dx FROM (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx)) c, px b
  WHERE b.img = a.img AND b.y = least(greatest(a.y + c.dy, 0), 7) AND b.x = least(greatest(a.x + c.dx, 0), 7) GROUP BY ALL),
m AS (SELECT *, abs(gx) + abs(gy) AS s, abs(gy) < 0.4142135623730951::DOUBLE * abs(gx) AS flat, abs(gy) > 2.414213562373095::DOUBLE * abs(gx) AS steep, (gx < 0) = (gy < 0) AS same FROM n),
k AS (
  SELECT m.img, m.y, m.x, m.s FROM m
  LEFT JOIN m u ON u.img = m.img AND u.y = m.y + CASE WHEN m.flat THEN 0 ELSE -1 END AND u.x = m.x + CASE WHEN m.flat THEN -1 WHEN m.steep THEN 0 WHEN m.same THEN -1 ELSE 1 END
  LEFT JOIN m v ON v.img = m.img AND v.y = m.y + CASE WHEN m.flat THEN 0 ELSE 1 END AND v.x = m.x + CASE WHEN m.flat THEN 1 WHEN m.steep THEN 0 WHEN m.same THEN 1 ELSE -1 END
  WHERE m.s > %d AND m.s > coalesce(u.s, 0) AND (m.s > coalesce(v.s, 0) OR (m.flat OR m.steep) AND m.s = coalesce(v.s, 0))),
e(img, y, x) AS (
  SELECT img, y, x FROM k WHERE s > %d UNION
  SELECT k.img, k.y, k.x FROM e JOIN k ON k.img = e.img AND abs(k.y - e.y) <= 1 AND abs(k.x - e.x) <= 1),
a AS (SELECT img, count(*) FILTER (g <> 0) AS area FROM px GROUP BY 1),
c AS (SELECT img, count(*) AS n, string_agg((y * 8 + x)::VARCHAR, ',' ORDER BY y, x) AS places FROM (SELECT DISTINCT * FROM e) GROUP BY 1)
SELECT img, coalesce(places, '') AS pixels, coalesce(n, 0)::DOUBLE / area AS density FROM a LEFT JOIN c USING (img) WHERE area > 0"""
EDGE_LOW, EDGE_HIGH = 200, 400


@query("edge_density_kernel", f"WITH RECURSIVE {_px()}{EDGES % (EDGE_LOW, EDGE_HIGH)}")
def edge_density_kernel(spark, d):
    """Edges by the kernel that photos go through, and their share of the object's pixels."""
    import numpy as np
    import pandas as pd

    from ..kernels.texture import canny, edge_features

    def work(batches):
        for batch in batches:
            rows = []
            for img, px in zip(batch["img"], batch["px"], strict=True):
                gray = np.asarray(px, np.uint8).reshape(SIDE, SIDE)
                if gray.any():
                    at = np.flatnonzero(canny(gray, EDGE_LOW, EDGE_HIGH))
                    rows.append((img, ",".join(map(str, at)), edge_features(gray, EDGE_LOW, EDGE_HIGH)["edge_density"]))
            yield pd.DataFrame(rows, columns=["img", "pixels", "density"])

    return images(spark, d).mapInPandas(work, "img long, pixels string, density double")
