"""Queries of the code that photos go through, on 8 by 8 images and on a fixed tree, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import masking, morphology
from ..operators import explain, pixels
from .imaging import BAND, MASK, SIDE, _px, images

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def per_image(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray | None], tuple], columns: str) -> DataFrame:
    """img and what a kernel makes of each image's grays and, if there is a mask, of that."""
    names = [c.split(" ")[0] for c in columns.split(", ")]
    masked = "mask" in df.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = lambda x, kind: np.asarray(x, kind).reshape(SIDE, SIDE)
        for batch in batches:
            rows = [(img, *kernel(square(px, np.uint8), square(mask, np.int8) > 0 if masked else None)) for img, px, mask in zip(batch["img"], batch["px"], batch["mask"] if masked else batch["px"], strict=True)]
            yield pd.DataFrame(rows, columns=["img", *names])

    return df.select("img", "px", *["mask"] * masked).mapInPandas(work, f"img long, {columns}")


def masked_images(spark: SparkSession, d: str) -> DataFrame:
    grays = images(spark, d)
    return pixels.otsu_mask(grays, ["img"], "px", SIDE).select("img", "mask").join(grays, "img")


def _text(values: np.ndarray, joint: str = "") -> str:
    return joint.join(map(str, np.asarray(values).astype(int).ravel().tolist()))


OUTSIDE = MASK.replace("WITH", "WITH RECURSIVE", 1) + """, o(img, y, x) AS (
  SELECT img, y, x FROM m WHERE mask = 0 AND (y IN (0, 7) OR x IN (0, 7)) UNION
  SELECT b.img, b.y, b.x FROM o JOIN m b ON b.img = o.img AND b.mask = 0 AND abs(b.y - o.y) + abs(b.x - o.x) = 1)
"""


@query("filled_mask", OUTSIDE + "SELECT m.img, string_agg(CASE WHEN o.img IS NULL THEN '1' ELSE '0' END, '' ORDER BY m.y, m.x) AS mask FROM m LEFT JOIN o ON o.img = m.img AND o.y = m.y AND o.x = m.x GROUP BY m.img")
def filled_mask(spark, d):
    """Background that does not reach the frame joins the object."""
    return per_image(masked_images(spark, d), lambda px, mask: (_text(morphology.filled(mask)),), "mask string")


@query("mask_outline", MASK + ", e AS (SELECT a.img, a.y, a.x, max(b.mask) - min(b.mask) AS edge FROM m a JOIN m b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT img, string_agg(edge::VARCHAR, '' ORDER BY y, x) AS outline FROM e GROUP BY 1")
def mask_outline(spark, d):
    """What an overlay draws in red: the object's border, one pixel to either side."""
    from ..sources.images import outlined

    def drawn(px, mask):
        return (_text((outlined(np.zeros((*px.shape, 3), np.uint8), mask) == (255, 0, 0)).all(axis=-1)),)

    return per_image(masked_images(spark, d), drawn, "outline string")


@query("otsu_crop", MASK + f""", b AS (SELECT img, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM m WHERE mask = 1 GROUP BY 1)
SELECT img, (y1 - y0 + 1)::INT AS height, (x1 - x0 + 1)::INT AS width, string_agg(CASE WHEN mask = 1 THEN greatest(g, 1) ELSE 0 END::VARCHAR, ',' ORDER BY y, x) AS px FROM m JOIN b USING (img) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY ALL""")
def otsu_crop(spark, d):
    """The object's bounding box, its pixels at least 1 and all others 0."""
    def cropped(px, mask):
        out = masking.cut_out(px, mask)
        return (*out.shape, _text(out, ","))

    return per_image(masked_images(spark, d), cropped, "height int, width int, px string")


def _solution() -> str:
    """VALUES of the least squares of the border band, which are the same for every image of a size: how
    much each of its pixels counts in each coefficient."""
    y, x = np.nonzero(masking.border((SIDE, SIDE), BAND))
    basis = np.stack([(x / SIDE) ** i * (y / SIDE) ** j for i, j in masking.Surface.POWERS], axis=-1)
    return ", ".join(f"({k}, {b}, {a}, {v!r}::DOUBLE)" for k, row in enumerate(np.linalg.pinv(basis).tolist()) for a, b, v in zip(x.tolist(), y.tolist(), row, strict=True))


@query("border_surface_solve", f"WITH {_px()}, s(k, y, x, v) AS (VALUES {_solution()}) SELECT img, " + ", ".join(f"round(sum(CASE WHEN k = {k} THEN v * g END), 5) + 0.0 AS c{k}" for k in range(6)) + " FROM px JOIN s USING (y, x) GROUP BY 1")
def border_surface_solve(spark, d):
    """Coefficients of the quadratic surface through the border band, before outliers are left out."""
    def solved(px, _):
        ys, xs = np.nonzero(masking.border(px.shape, BAND))
        surface = object.__new__(masking.Surface)
        surface.shape = px.shape
        values = px[ys, xs].astype(np.float64)[:, None]
        return tuple((np.round(surface._solved(surface._basis(ys, xs), values, np.ones(values.shape, bool))[:, 0], 5) + 0.0).tolist())

    return per_image(images(spark, d), solved, ", ".join(f"c{k} double" for k in range(6)))


#: A tree of two features: where it divides, and the cover and the value of each leaf.
CUT0, CUT1 = 0.0, 0.1
LEAVES = ((30.0, 1.0), (20.0, -2.0), (50.0, 4.0))


def fixed_tree() -> explain.Tree:
    """x0 <= CUT0 leads to x1 <= CUT1 and the first two leaves, else the third."""
    (a, u), (b, v), (c, w) = LEAVES
    tree = object.__new__(explain.Tree)
    tree.feature, tree.threshold = [0, 1, -1, -1, -1], [CUT0, CUT1, 0.0, 0.0, 0.0]
    tree.left, tree.right = [1, 2, -1, -1, -1], [4, 3, -1, -1, -1]
    tree.cover, tree.value = [a + b + c, a + b, a, b, c], np.array([[0.0], [0.0], [u], [v], [w]])
    return tree


(_A, _U), (_B, _V), (_C, _W) = LEAVES
SHAPLEY = f"""
WITH x AS (SELECT vec_id, embedding[1]::DOUBLE <= {CUT0} AS p, embedding[2]::DOUBLE <= {CUT1} AS q FROM embeddings),
v AS (SELECT *, CASE WHEN q THEN {_U} ELSE {_V} END::DOUBLE AS inner_known, {(_A * _U + _B * _V) / (_A + _B)}::DOUBLE AS inner_mean, {_A + _B}::DOUBLE AS near, {_C}::DOUBLE AS far, {_W}::DOUBLE AS w FROM x),
s AS (SELECT vec_id, (near * inner_mean + far * w) / (near + far) AS v_, CASE WHEN p THEN inner_mean ELSE w END AS v_x, (near * inner_known + far * w) / (near + far) AS v_y, CASE WHEN p THEN inner_known ELSE w END AS v_xy FROM v),
f AS (SELECT vec_id, 'glcm_0' AS feature, ((v_x - v_) + (v_xy - v_y)) / 2 AS value FROM s UNION ALL SELECT vec_id, 'hsv_1', ((v_y - v_) + (v_xy - v_x)) / 2 FROM s)
"""


def tree_values(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, feature, value: Shapley values of the fixed tree."""
    tree = fixed_tree()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = tree.shapley(batch[["x0", "x1"]].to_numpy(float))[:, :, 0]
            yield pd.DataFrame({"vec_id": np.repeat(batch["vec_id"].to_numpy(), 2), "feature": ["glcm_0", "hsv_1"] * len(batch), "value": value.reshape(-1)})

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in (0, 1)])
    return rows.mapInPandas(work, "vec_id long, feature string, value double")


@query("tree_shapley", SHAPLEY + "SELECT vec_id, feature, round(value, 9) + 0.0 AS value FROM f")
def tree_shapley(spark, d):
    return tree_values(spark, d).withColumn("value", F.round("value", 9) + F.lit(0.0))


@query("tree_importance", SHAPLEY + "SELECT CASE feature WHEN 'glcm_0' THEN 'texture' ELSE 'color' END AS family, round(avg(abs(value)), 9) AS value FROM f GROUP BY ALL")
def tree_importance(spark, d):
    """Mean absolute values by family."""
    return explain.importance_by_family(tree_values(spark, d)).select("family", F.round("value", 9).alias("value"))
