import numpy as np
import pytest

from packetflow.operators import raster as R
from packetflow.plans.images import drawn

TEXT = "\n".join("the clerk of the third desk reads every word of a long letter aloud"[: 50 + 7 * (i % 3)] for i in range(30))


@pytest.mark.parametrize("angle", [-6.0, -1.5, 2.0, 7.5])
def test_skew_is_found_and_undone(angle):
    page = R.rotate(drawn(TEXT), -angle)
    assert abs(R.skew_angle(page) - angle) <= 0.3 and abs(R.skew_angle(R.deskew(page))) <= 0.3


def test_no_skew():
    blank = np.full((300, 200), 255, np.uint8)
    assert R.skew_angle(blank) == 0.0 and R.skew_angle(drawn(TEXT)) == 0.0 and R.deskew(blank) is blank and R.rotate(blank, 0.2) is blank


def test_orientation():
    page = drawn(TEXT)
    assert not R.needs_quarter_turn(page) and R.needs_quarter_turn(np.rot90(page)) and np.array_equal(R.upright(page), page)
    assert R.upright(np.rot90(page)).shape == page.shape and not R.needs_quarter_turn(R.repaired(np.rot90(page)))


def brute_borders(g):
    n = max(2, int(min(g.shape) * 0.025))
    h, w = g.shape
    inside = [lambda y, x: y < n, lambda y, x: y >= h - n, lambda y, x: x < n, lambda y, x: x >= w - n]
    out = []
    for f in inside:
        spots = [g[y, x] < 200 for y in range(h) for x in range(w) if f(y, x)]
        out.append(sum(spots) / len(spots))
    return out


def test_borders_against_brute_force():
    g = np.random.default_rng(3).integers(0, 256, (57, 43)).astype(np.uint8)
    assert np.allclose(R.border_ratios(g), brute_borders(g)) and R.border_edges(np.full((50, 50), 255, np.uint8)) == 0.0


def test_corners_and_warps():
    p = [(90, 12), (10, 10), (88, 60), (12, 62)]
    assert R.ordered_corners(p).tolist() == [[10, 10], [90, 12], [88, 60], [12, 62]] and R.parallel_difference([(0, 0), (10, 0), (10, 5), (0, 5)]) == 0 and R.aspect_ratio([(0, 0), (10, 0), (10, 5), (0, 5)]) == 2.0
    page = np.full((100, 120), 255, np.uint8)
    page[20:60, 30:80] = 50
    assert (R.warp(page, [(30, 20), (79, 20), (79, 59), (30, 59)])[1:-1, 1:-1] == 50).all() and R.bounding_area([(0, 0), (4, 1), (4, 5), (0, 6)]) == 24.0
    assert R.warp(page, [(0, 0), (1, 1), (2, 2), (3, 3)]).size > 0


def test_sheet_on_a_bed_and_margins():
    scan = np.full((400, 300), 60, np.uint8)
    scan[30:350, 20:280] = 255
    assert R.paper_box(scan) == (30, 350, 20, 280) and R.paper_box(np.full((50, 50), 255, np.uint8)) is None
    assert R.trim_margins(scan).shape == (320, 260) and R.trim_margins(np.zeros((9, 9), np.uint8)).shape == (9, 9)


def test_harms():
    page = drawn(TEXT)
    assert R.harms(page, page) == [] and "sideways" in R.harms(page, np.rot90(page)) and "card_fragment" in R.harms(page, page[:8, :200], "embedded_card")
    cut = page[33:120, 33:200]
    assert "overcut" in R.harms(page, cut, "embedded_card") and R.accepted(page, cut, "embedded_card") is page


def test_odd_images(spark):
    rows = [(1, 1, "default", 8, 8, bytes(64)), (1, 2, None, 2, 2, b"abcd"), (2, 1, "default", 3, 3, b"x"), (2, 2, "default", None, 3, None), (3, 1, "full_page_form", *drawn(TEXT).shape, drawn(TEXT).tobytes())]
    df = spark.createDataFrame(rows, "packet_id bigint, page_no int, mode string, height int, width int, data binary")
    assert [r.dark_share for r in R.page_borders(df).orderBy("packet_id", "page_no").collect()][:4] == [1.0, 1.0, None, None]
    fixed = R.page_repairs(df).orderBy("packet_id", "page_no").collect()
    assert len(fixed) == 5 and all(r.data is None or r.skew is None or r.height * r.width == len(r.data) for r in fixed)
    assert R.page_scores(df.limit(0)).count() == 0


def test_pages_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    """Drawn pages of a batch of texts do not stand in memory at once; no page is lost at a seam."""
    from packetflow.plans import images

    seen = []
    monkeypatch.setattr(images, "table", lambda *_: Texts([(i, "a word " * (i * 40)) for i in range(60)], seen))
    images.document_pages(spark, "")
    sizes = [int((b.height * b.width).sum()) for b in seen]
    assert [i for b in seen for i in b.packet_id] == list(range(60)) and all((b.height * b.width == b.data.map(len)).all() for b in seen)
    assert len(sizes) > 2 and max(sizes) < 2 * images.PART


class Texts:
    """A table whose mapInPandas runs at once, on one batch."""

    def __init__(self, rows, seen):
        self.rows, self.seen = rows, seen

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        import pandas as pd

        self.seen.extend(run(iter([pd.DataFrame(self.rows, columns=["doc_id", "text"])])))


def test_smoothing_and_windows_in_whole_numbers():
    g = np.random.default_rng(5).integers(0, 256, (61, 47)).astype(np.uint8)
    weights, padded = np.array([1, 4, 6, 4, 1], float) / 16, np.pad(g.astype(float), 2, mode="reflect")
    rows = sum(w * padded[i : i + 61] for i, w in enumerate(weights))
    right = np.rint(sum(w * rows[:, i : i + 47] for i, w in enumerate(weights))).astype(np.uint8)
    assert np.array_equal(R.smooth(g), right) and (R.smooth(np.full((9, 9), 255, np.uint8)) == 255).all()
    dark, at = g < 100, np.pad(g < 100, 1)
    assert np.array_equal(R._windows(dark, np.logical_or, False), np.array([[at[y : y + 3, x : x + 3].any() for x in range(47)] for y in range(61)]))
