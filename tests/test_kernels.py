"""Image kernels: closed forms and relations on generated images."""

import numpy as np
import pytest

from sievework.kernels import color, masking, morphology, texture
from sievework.schema import TRANSFORMS, EmptyRegionError, Settings


def test_constant_texture():
    f = texture.glcm_features(np.full((16, 16), 128, np.uint8))
    assert f["glcm_d1_a0_contrast"] == 0 and f["glcm_d1_a0_energy"] == 1 and f["glcm_d1_a0_entropy"] == 0 and len(f) == 48


def test_checkerboard_has_more_contrast():
    board = (np.indices((16, 16)).sum(axis=0) % 2 * 255).astype(np.uint8)
    assert texture.glcm_features(board)["glcm_d1_a0_contrast"] == 255**2


def test_stripes_inside_foreground():
    gray = np.zeros((32, 32), np.uint8)
    gray[8:24, 8:24] = np.where(np.arange(16) % 2, 200, 100)
    f = texture.glcm_features(gray, (1,), (0, 90), gray > 0)
    assert f["glcm_d1_a0_contrast"] == 100**2 and f["glcm_d1_a90_contrast"] == 0


def test_diagonal_steps():
    y, x = np.indices((20, 20))
    g = ((x + y) % 4 // 2 * 100 + 50).astype(np.uint8)
    f = texture.glcm_features(g, (1, 2), (45,))
    assert f["glcm_d1_a45_contrast"] == 0 or f["glcm_d2_a45_contrast"] == 0


def test_texture_arguments():
    g = np.zeros((4, 4), np.uint8)
    for bad in (dict(distances=()), dict(distances=(0,)), dict(angles=(30,)), dict(levels=1)):
        with pytest.raises(ValueError):
            texture.glcm_features(g, **bad)
    with pytest.raises(EmptyRegionError):
        texture.glcm_features(g, foreground=g > 0)
    with pytest.raises(EmptyRegionError):
        texture.glcm_features(g, distances=(9,))


def test_quarter_turn_swaps_rows_and_columns():
    g = np.random.default_rng(1).integers(0, 256, (20, 20)).astype(np.uint8)
    a, b = texture.glcm_features(g, (1,), (0, 90)), texture.glcm_features(np.rot90(g).copy(), (1,), (0, 90))
    assert a["glcm_d1_a0_contrast"] == pytest.approx(b["glcm_d1_a90_contrast"])


def test_uniform_color_has_no_deviation():
    image = np.zeros((20, 20, 3), np.uint8)
    image[4:16, 4:16] = (200, 100, 50)
    f = color.color_features(image)
    assert all(f[f"{s}_{c}_std"] == 0 for s, cs in (("hsv", "hsv"), ("lab", "lab")) for c in cs)
    assert f["hsv_h_mean"] == pytest.approx(10) and f["hsv_v_mean"] == 200 and len(f) == 12


def test_known_lab_and_hue_wrap():
    assert color.to_lab(np.array([[[255, 255, 255], [0, 0, 0]]], np.uint8)).tolist() == [[[255, 128, 128], [0, 128, 128]]]
    mean, sd = color.hue_stats(np.array([178.0] * 10 + [2.0] * 10))
    assert min(mean, 180 - mean) < 1 and sd < 5


def test_flat_block_outline():
    image = np.zeros((40, 40), np.uint8)
    image[10:30, 10:30] = 180
    assert texture.edge_features(image)["edge_density"] > 0
    assert texture.edge_features(image, foreground=image > 0)["edge_density"] == 0
    image[20, 14:26] = 40
    assert texture.edge_features(image, foreground=image > 0)["edge_density"] > 0


def test_contours_of_known_shapes():
    line = np.zeros((9, 9), bool)
    line[4, 2:7] = True
    assert texture.contour_lengths(line) == [pytest.approx(4.0)]
    square = np.zeros((9, 9), bool)
    square[2:7, 2:7] = True
    assert texture.contour_lengths(square) == [pytest.approx(12.0)]
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert len(texture.contour_lengths(ring)) == 2
    assert texture.contour_lengths(np.eye(1, dtype=bool)) == [0.0]
    assert texture.contour_lengths(np.zeros((3, 3), bool)) == []


def test_symmetries_are_distinct_and_exact():
    image = np.arange(12).reshape(3, 4)
    made = {t: texture.transformed(image, t) for t in TRANSFORMS}
    assert len({(m.shape, m.tobytes()) for m in made.values()}) == 8
    assert (made["flip_rot90"] == np.rot90(np.fliplr(image))).all()
    with pytest.raises(ValueError):
        texture.transformed(image, "rot45")


def two_tone(h=300, w=400, noise=2.0, seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w))
    image = np.repeat((110 + 55 * x / w)[..., None], 3, axis=-1)
    inside = (abs(y - h / 2) < h / 5) & (abs(x - w / 2) < w / 5)
    image[inside & (y < h / 2)] = (70, 40, 25)
    image[inside & (y >= h / 2)] = (235, 228, 210)
    return np.clip(image + rng.normal(0, noise, image.shape), 0, 255).astype(np.uint8), inside


def iou(a, b):
    return (a & b).sum() / (a | b).sum()


def test_background_mask_finds_two_tone_object():
    image, inside = two_tone()
    assert iou(masking.background_mask(image), inside) > 0.9
    assert iou(masking.background_mask(image, rounds=0), inside) > 0.85
    assert iou(masking.otsu_mask(image), inside) < 0.7
    assert (masking.background_mask(image) == masking.background_mask(image)).all()


def test_empty_photo_has_an_empty_mask():
    flat = np.full((120, 160, 3), 140, np.uint8)
    assert not masking.background_mask(flat).any()
    assert not masking.cut_out(flat, np.zeros((120, 160), bool)).any()
    with pytest.raises(ValueError):
        masking.background_mask(flat[..., 0])


def test_otsu_finds_a_large_disk():
    y, x = np.indices((60, 60))
    disk = (y - 30) ** 2 + (x - 30) ** 2 < 28**2
    assert (masking.otsu_mask(np.where(disk, 200, 20).astype(np.uint8)) == disk).all()


def test_gains_bring_paper_to_the_reference():
    image, _ = two_tone(240, 320, 1.0)
    after = masking.normalized(image, Settings())
    assert np.abs(masking.paper_color(after) - 110).max() < 2
    assert masking.normalized(image, Settings(normalize=False)) is image


def test_crop_lifts_black_object_pixels():
    image = np.zeros((6, 6, 3), np.uint8)
    m = np.zeros((6, 6), bool)
    m[2:4, 1:5] = True
    out = masking.cut_out(image, m)
    assert out.shape == (2, 4, 3) and (out == 1).all()


def test_morphology_against_brute_force():
    rng = np.random.default_rng(5)
    image = rng.random((17, 23)) < 0.7
    padded = np.pad(image, 1, constant_values=True)
    slow = np.array([[padded[y : y + 3, x : x + 3].all() for x in range(23)] for y in range(17)])
    assert (morphology.erode(image, 3) == slow).all() and (morphology.erode(image, np.ones((3, 3), bool)) == slow).all()
    assert (morphology.dilate(~image, np.ones((3, 3), bool)) == ~morphology.erode(image, 3)).all()


def test_components_and_holes():
    image = np.zeros((8, 8), bool)
    image[0:2, 0:2] = image[3:8, 3:8] = True
    image[2, 2] = True
    assert morphology.labelled(image).max() == 1 and morphology.labelled(image, eight=False).max() == 3
    image[5, 5] = False
    assert morphology.filled(image)[5, 5] and not morphology.filled(image)[0, 7]
    assert morphology.largest(np.zeros((3, 3), bool)).sum() == 0


def test_scaling():
    image = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert morphology.area(image, 2, 2).tolist() == [[2, 4], [10, 12]]
    assert morphology.nearest(image, 2, 2).tolist() == [[0, 2], [8, 10]]


def test_all_features_in_order():
    image, inside = two_tone(120, 160)
    crop, mask = masking.masked_crop(image, Settings())
    names = list(texture.all_features(morphology.nearest(crop, 64, 64), Settings()))
    assert len(names) == 65 and [n.split("_")[0] for n in names] == ["glcm"] * 48 + ["hsv"] * 6 + ["lab"] * 6 + ["edge"] * 5
    assert 0.05 < mask.mean() < 0.5


def test_paper_features_ignore_the_object():
    image, _ = two_tone()
    f = masking.paper_features(image, 110)
    assert set(f) == {f"paper_{c}_{n}" for c in "lab" for n in ("mean", "std")} and abs(f["paper_a_mean"] - 128) < 2
