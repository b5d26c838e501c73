"""Cuts of small boxes: each box of two cells and more is looked at once, cells alone never."""

import numpy as np

from rasterlake.functions import wu


def test_cuts_of_few_cells(monkeypatch):
    r, calls = np.random.default_rng(4), []
    plain = wu._best_cut_of_few
    monkeypatch.setattr(wu, "_best_cut_of_few", lambda *a: calls.append(1) or plain(*a))
    flat = r.choice(32768, 20, replace=False)
    cells = np.stack([flat >> 10, flat >> 5 & 31, flat & 31], -1)
    n = r.integers(2, 9, 20)
    colours = cells * 8 + 4
    moments = np.c_[n, colours * n[:, None], (colours**2).sum(1) * n + 3 * n]  # cells with a spread of their own
    palette, index = wu.split(cells, moments, 256)
    assert len(palette) == 20 and (palette[index] == colours).all() and len(calls) == 19


def test_few_cells_of_a_large_image_as_alone():
    """Boxes of an image of more than LISTED cells, whose small boxes fill in their cells, give the palette that lists give."""
    r = np.random.default_rng(6)
    rgb = r.integers(0, 256, (4000, 3)).astype(np.uint8)
    palette, index = wu.quantize(rgb, 256)
    listed, wu.LISTED = wu.LISTED, 1 << 15
    try:
        same = wu.quantize(rgb, 256)
    finally:
        wu.LISTED = listed
    assert (palette == same[0]).all() and (index == same[1]).all()
