"""Photos from Spark's image reader, uploads as bytes, and image sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import upload_error
from ..operators.checks import and_more, told

#: Photos are megabytes each: few of them go to Python at a time.
PHOTOS_A_BATCH = 16


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, image: rows that cannot be decoded stay, with height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select(F.col("image.origin").alias("origin"), "image")


def with_images(manifest: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """The manifest's rows with the image that their path, below root, names; null if there is none."""
    full = F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    return manifest.withColumn("_at", plain(full)).join(images.select(plain(F.col("origin")).alias("_at"), "image"), "_at", "left").drop("_at")


def require_images(photos: DataFrame, key: str = "path") -> DataFrame:
    """photos themselves, or an error that tells how many have no file and lists the first. Files that
    are there but cannot be decoded are not missing."""
    n, missing = told(photos.filter(F.col("image").isNull()).select(key), key)
    if n:
        raise FileNotFoundError(f"{n} photos have no file: {and_more(n, [str(r[0]) for r in missing])}")
    return photos


def parts(image: str = "image") -> list:
    """An image struct's fields as columns: what kernels take."""
    return [F.col(f"{image}.{c}").alias(f"image_{c}") for c in ("height", "width", "nChannels", "data")]


def pixels(record: dict) -> np.ndarray | None:
    """An (H, W, 3) RGB array from a record with parts() (BGR bytes); None if it could not be decoded."""
    if record["image_data"] is None or not record["image_height"] > 0:
        return None
    n = int(record["image_nChannels"])
    flat = np.frombuffer(record["image_data"], np.uint8).reshape(int(record["image_height"]), int(record["image_width"]), n)
    return np.repeat(flat, 3, axis=2) if n == 1 else np.ascontiguousarray(flat[..., 2::-1])


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, error, and the decoded image where there is no error before or in decoding.

    Readers pass over files without bytes, so names come from the listing, which the driver has."""
    raw = spark.read.format("binaryFile").load(path)
    first = upload_error(F.coalesce("length", F.lit(0)), F.substring("content", 1, 8))
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    listed = spark.createDataFrame([(p,) for p in raw.inputFiles()], "listed string").select(plain(F.col("listed")).alias("path"))
    judged = listed.join(raw.withColumn("path", plain(F.col("path"))), "path", "left").select("path", first.alias("error"))
    decoded = read_images(spark, path).select(plain(F.col("origin")).alias("path"), "image")
    both = judged.join(decoded, "path", "left")
    broken = F.when(F.col("image").isNull() | (F.col("image.height") < 0), F.lit("The image is corrupted and could not be read."))
    both = both.withColumn("error", F.coalesce("error", broken))
    return both.select("path", "error", F.when(F.col("error").isNull(), F.col("image")).alias("image"))


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray or RGB PNG."""
    rows = image if image.ndim == 3 else image[..., None]
    h, w, n = rows.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rows.astype(np.uint8).reshape(h, w * n)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def outlined(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The photo with the mask's edge in red."""
    from ..kernels.morphology import dilate, erode

    out = image.copy()
    out[dilate(mask, 3) & ~erode(mask, 3)] = (255, 0, 0)
    return out


def mask_pictures(photos: DataFrame, settings) -> DataFrame:
    """id, mask_fraction, and PNGs of the masked crop and of the photo with its outline; nulls where a
    photo could not be decoded. Executors write no files: rows go wherever Spark writes."""
    from ..kernels.masking import cut_out, mask

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                image = pixels(record)
                if image is None:
                    rows.append((record["id"], None, None, None))
                    continue
                found = mask(image, settings)
                rows.append((record["id"], float(found.mean()), png(cut_out(image, found)), png(outlined(image, found))))
            yield pd.DataFrame(rows, columns=["id", "mask_fraction", "crop", "outline"])

    return photos.select("id", *parts()).mapInPandas(work, "id string, mask_fraction double, crop binary, outline binary")


def put(spark: SparkSession, path: str, body: bytes) -> None:
    """A file in any of Hadoop's file systems, from the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def sheet(pictures: list[np.ndarray], across: int = 6, size: tuple[int, int] = (160, 120)) -> np.ndarray:
    """Pictures side by side in rows, each made as small as said; what is left over is white."""
    from ..kernels.morphology import nearest

    down = max(1, -(-len(pictures) // across))
    out = np.full((down * size[1], across * size[0], 3), 255, np.uint8)
    for k, picture in enumerate(pictures):
        y, x = k // across * size[1], k % across * size[0]
        out[y : y + size[1], x : x + size[0]] = nearest(picture, *size)
    return out


def write_masks(photos: DataFrame, out: str, settings, preview: int = 0) -> DataFrame:
    """Writes mask_pictures as a table at out, and with a preview the outlines of so many photos, the first
    by id, as one sheet beside it. id, mask_fraction of each photo."""
    spark = photos.sparkSession
    mask_pictures(photos, settings).write.mode("overwrite").parquet(out)
    held = spark.read.parquet(out)
    if preview:
        first = held.filter("outline is not null").orderBy("id").limit(preview).select("id", "outline")  # as many as asked for
        put(spark, f"{out.rstrip('/')}_preview.png", png(sheet([unpng(r.outline) for r in first.collect()])))
    return held.select("id", "mask_fraction")


def unpng(body: bytes) -> np.ndarray:
    """An image that png() made."""
    width, height, _, kind = struct.unpack(">IIBB", body[16:26])
    size, n = struct.unpack(">I", body[33:37])[0], 3 if kind == 2 else 1
    lines = np.frombuffer(zlib.decompress(body[41 : 41 + size]), np.uint8).reshape(height, 1 + width * n)
    flat = lines[:, 1:].reshape(height, width, n)
    return flat if n == 3 else flat[..., 0]
