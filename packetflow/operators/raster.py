"""Page images in numpy over Arrow batches: content, borders, skew, orientation, crops, warps, and whether a repair holds.

An image is one page of gray bytes, so a batch is as large as its pages and no group is formed: every function works on one
page. A repair is kept only where the checks find no harm in it; else the page stays as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Ink share from which a page has content; share of dark pixels below which a scan is blank.
CONTENT_SHARE, DARK_SHARE, DARK_BELOW = 0.008, 0.001, 200


def _reflected(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, n, mode="reflect")


def smooth(gray: np.ndarray) -> np.ndarray:
    """5 x 5 Gaussian, rounded."""
    h, w = gray.shape
    five = lambda a, b, c, d, e: a + e + ((b + d) << 2) + c * np.uint16(6)
    padded = _reflected(gray.astype(np.uint16), 2)
    rows = five(*[padded[i : i + h] for i in range(5)])
    total = five(*[rows[:, i : i + w] for i in range(5)])  # 256 times the mean, 65280 at most
    return ((total + np.uint16(127) + ((total >> 8) & 1)) >> 8).astype(np.uint8)  # halves to even, as rint


def otsu(gray: np.ndarray) -> int:
    """The level that parts dark from light with most variance between them."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    between[~np.isfinite(between)] = 0
    return int(between.argmax())


def _windows(binary: np.ndarray, fold, edge: bool) -> np.ndarray:
    padded = np.pad(binary, 1, constant_values=edge)
    h, w = binary.shape
    rows = fold(fold(padded[:h], padded[1 : 1 + h]), padded[2:])
    return fold(fold(rows[:, :w], rows[:, 1 : 1 + w]), rows[:, 2:])


def ink(gray: np.ndarray) -> np.ndarray:
    """Dark strokes of a page: smoothed, thresholded, specks of less than 3 x 3 pixels removed."""
    if min(gray.shape) < 3 or gray.min() == gray.max():
        return np.zeros(gray.shape, bool)
    soft = smooth(gray)
    dark = soft <= otsu(soft)
    return _windows(_windows(dark, np.logical_and, True), np.logical_or, False)


def content_score(gray: np.ndarray) -> float:
    found = ink(gray)
    return float(found.mean()) if found.size else 0.0


def is_blank_scan(gray: np.ndarray, score: float | None = None) -> bool:
    """score: the page's content score, where it is known."""
    score = content_score(gray) if score is None else score
    return score < CONTENT_SHARE and float((gray < DARK_BELOW).mean()) < DARK_SHARE


def content_box(gray: np.ndarray, padding: float = 0.03, least: int = 24, keep: float = 0.85) -> tuple[int, int, int, int]:
    """top, bottom, left, right around the ink, padded; the whole page when that would keep less than keep of it."""
    h, w = gray.shape
    rows, cols = np.flatnonzero(ink(gray).any(axis=1)), np.flatnonzero(ink(gray).any(axis=0))
    if not len(rows):
        return 0, h, 0, w
    py, px = max(least, int(h * padding)), max(least, int(w * padding))
    box = max(0, rows[0] - py), min(h, rows[-1] + 1 + py), max(0, cols[0] - px), min(w, cols[-1] + 1 + px)
    return box if (box[1] - box[0]) * (box[3] - box[2]) >= keep * h * w else (0, h, 0, w)


def _strips(a: np.ndarray, band_ratio: float) -> tuple[np.ndarray, ...]:
    n = max(2, int(min(a.shape) * band_ratio))
    return a[:n], a[-n:], a[:, :n], a[:, -n:]


def border_ratios(gray: np.ndarray, band_ratio: float = 0.025) -> tuple[float, float, float, float]:
    """Share of dark pixels in the strips along the top, bottom, left and right."""
    return tuple(float((x < DARK_BELOW).mean()) for x in _strips(gray, band_ratio))


def border_ink(gray: np.ndarray, band_ratio: float = 0.025) -> float:
    return float(np.mean(border_ratios(gray, band_ratio)))


def edges(gray: np.ndarray, least: float = 100.0) -> np.ndarray:
    """Pixels on a step between light and dark: gradient of the smoothed page."""
    if min(gray.shape) < 3:
        return np.zeros(gray.shape, bool)
    down, right = np.gradient(smooth(gray).astype(float))
    return 4 * np.hypot(down, right) >= least


def border_edges(gray: np.ndarray, band_ratio: float = 0.025) -> float:
    """Mean edge level (0 to 255) of the four strips."""
    return float(np.mean([255.0 * x.mean() for x in _strips(edges(gray), band_ratio)]))


def _runs(lines: np.ndarray, least: int, gap: int) -> float:
    """Total length of the runs of True along the rows that are at least so long, gaps of up to gap pixels bridged."""
    total = 0.0
    for row in lines:
        at = np.flatnonzero(row)
        if len(at) < 2:
            continue
        cut = np.flatnonzero(np.diff(at) > gap + 1)
        first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
        length = last - first + 1
        total += float(length[length >= least].sum())
    return total


def axis_lengths(gray: np.ndarray, share: int = 10, gap: int = 4) -> tuple[float, float]:
    """Length of what is drawn along rows and along columns: rules, and the upper and lower sides of words."""
    if min(gray.shape) < 3:
        return 0.0, 0.0
    down, right = np.gradient(smooth(gray).astype(float))
    steep, least = 4 * np.hypot(down, right) >= 100.0, max(min(gray.shape) // share, 40) // 2
    return _runs(steep & (abs(down) > abs(right)), least, gap), _runs((steep & (abs(right) > abs(down))).T, least, gap)


def needs_quarter_turn(gray: np.ndarray, least: float = 1000.0, ratio: float = 1.5) -> bool:
    """Whether the lines of a page run down instead of across."""
    across, down = axis_lengths(gray)
    return across + down >= least and down > ratio * across


def _evenness(y: np.ndarray, x: np.ndarray, angle: float) -> float:
    """How unevenly the ink falls into rows when the page is turned by angle: text lines in level make high, narrow peaks."""
    t = np.deg2rad(angle)
    rows = np.rint(y * np.cos(t) + x * np.sin(t)).astype(np.int64)
    counts = np.bincount(rows - rows.min())
    return float((counts.astype(float) ** 2).sum())


def skew_angle(gray: np.ndarray, most: float = 15.0, least_ink: int = 100, most_ink: float = 0.35) -> float:
    """Degrees by which a page must be turned to level its lines; 0 for blank and dark pages, and below a quarter degree."""
    y, x = np.nonzero(ink(gray))
    if len(y) < least_ink or len(y) > most_ink * gray.size:
        return 0.0
    best = 0.0
    for step, width in ((1.0, most), (0.25, 1.0), (0.05, 0.25)):
        tried = np.arange(-width, width + step / 2, step) + best
        tried = tried[np.abs(tried) <= most]
        scores = [_evenness(y, x, a) for a in tried]
        best = float(tried[max(range(len(tried)), key=lambda i: (scores[i], -abs(tried[i])))])
    return best if abs(best) >= 0.25 else 0.0


def sample(gray: np.ndarray, y: np.ndarray, x: np.ndarray, outside: int = 255) -> np.ndarray:
    """Values between pixels, bilinear; white outside the page."""
    padded = np.pad(gray.astype(float), 1, constant_values=outside)
    y, x = np.clip(y + 1, 0, gray.shape[0] + 0.999), np.clip(x + 1, 0, gray.shape[1] + 0.999)
    i, j = y.astype(np.int64), x.astype(np.int64)
    v, u = y - i, x - j
    i2, j2 = np.minimum(i + 1, padded.shape[0] - 1), np.minimum(j + 1, padded.shape[1] - 1)
    out = padded[i, j] * (1 - v) * (1 - u) + padded[i2, j] * v * (1 - u) + padded[i, j2] * (1 - v) * u + padded[i2, j2] * v * u
    return np.rint(out).astype(np.uint8)


def rotate(gray: np.ndarray, angle: float, most: float = 15.0) -> np.ndarray:
    """The page turned about its middle so that lines found at skew_angle lie level; below 0.3 degrees unchanged."""
    angle = max(-most, min(most, angle))
    if abs(angle) < 0.3:
        return gray
    t, (h, w) = np.deg2rad(angle), gray.shape
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    return sample(gray, y * np.cos(t) - x * np.sin(t) + (h - 1) / 2, y * np.sin(t) + x * np.cos(t) + (w - 1) / 2)


def deskew(gray: np.ndarray, passes: int = 2) -> np.ndarray:
    for n in range(passes):
        angle = skew_angle(gray)
        if abs(angle) < (0.25 if n == 0 else 0.3):
            break
        gray = rotate(gray, angle)
    return gray


def upright_score(gray: np.ndarray) -> float:
    """Higher for a page that stands: lines across, left edge straighter than the right, more ink above than below."""
    found = ink(gray)
    if not found.any():
        return 0.0
    across, down = axis_lengths(gray)
    rows, columns = found.any(axis=1), found[found.any(axis=1)]
    first, last = columns.argmax(axis=1), columns[:, ::-1].argmax(axis=1)
    ragged = (np.std(last) - np.std(first)) / gray.shape[1]
    middle = np.flatnonzero(rows).mean() / gray.shape[0]
    return 5.0 * across / max(across + down, 1.0) + 4.0 * float(ragged) + 2.0 * float(0.5 - middle)


def upright(gray: np.ndarray, margin: float = 0.75) -> np.ndarray:
    """Sideways pages turned to the better side; upside-down ones only where standing is clearly better."""
    if needs_quarter_turn(gray):
        return max((np.rot90(gray, 1), np.rot90(gray, 3)), key=upright_score)
    turned = np.rot90(gray, 2)
    return turned if upright_score(turned) > upright_score(gray) + margin else gray


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left (x, y)."""
    p = np.asarray(points, float).reshape(4, 2)
    total, difference = p.sum(axis=1), p[:, 1] - p[:, 0]
    return p[[total.argmin(), difference.argmin(), total.argmax(), difference.argmax()]]


def _sides(points: np.ndarray) -> np.ndarray:
    """Lengths of top, right, bottom and left."""
    p = ordered_corners(points)
    return np.hypot(*(np.roll(p, -1, axis=0) - p).T)


def parallel_difference(points: np.ndarray) -> float:
    """Largest relative difference of opposite sides."""
    top, right, bottom, left = _sides(points)
    return float(max(abs(top - bottom) / max(top, bottom, 1.0), abs(left - right) / max(left, right, 1.0)))


def aspect_ratio(points: np.ndarray) -> float:
    """Longer over shorter mean side."""
    top, right, bottom, left = _sides(points)
    across, down = (top + bottom) / 2, (left + right) / 2
    return float(max(across, down) / max(min(across, down), 1.0))


def bounding_area(points: np.ndarray) -> float:
    p = np.asarray(points, float).reshape(4, 2)
    return float(np.prod(p.max(axis=0) - p.min(axis=0)))


def warp(gray: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The quadrilateral drawn out to a rectangle of its own size."""
    p = ordered_corners(points)
    top, right, bottom, left = _sides(p)
    w, h = max(1, int(round(max(top, bottom)))), max(1, int(round(max(left, right))))
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows = [r for (u, v), (x, y) in zip(target, p) for r in ([u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y])]
    try:
        m = np.append(np.linalg.solve(np.array(rows), p.ravel()), 1.0).reshape(3, 3)
    except np.linalg.LinAlgError:  # three points on a line
        return gray
    v, u = np.mgrid[:h, :w].astype(float)
    x, y, z = np.einsum("ij,jhw->ihw", m, np.stack([u, v, np.ones_like(u)]))
    return sample(gray, y / z, x / z)


def paper_box(gray: np.ndarray, light: int = 180, share: float = 0.5) -> tuple[int, int, int, int] | None:
    """top, bottom, left, right of the sheet on a darker bed; none where the sheet is all there is, or its ink would be cut."""
    bright = gray >= light
    rows, columns = np.flatnonzero(bright.mean(axis=1) >= share), np.flatnonzero(bright.mean(axis=0) >= share)
    if not len(rows) or not len(columns):
        return None
    box = int(rows[0]), int(rows[-1]) + 1, int(columns[0]), int(columns[-1]) + 1
    area = (box[1] - box[0]) * (box[3] - box[2]) / gray.size
    return box if 0.25 <= area <= 0.98 else None


def trim_margins(gray: np.ndarray, spread: float = 2.0) -> np.ndarray:
    """Without border rows and columns of one even shade."""
    rows, columns = np.flatnonzero(gray.std(axis=1) > spread), np.flatnonzero(gray.std(axis=0) > spread)
    if not len(rows) or not len(columns):
        return gray
    return gray[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def straightness(gray: np.ndarray) -> float:
    return sum(axis_lengths(gray, 10, 16))


def harms(original: np.ndarray, corrected: np.ndarray, mode: str = "default") -> list[str]:
    """What a correction broke: sideways, overcut, card_fragment, warp_damage; none for an unchanged page."""
    if original.shape == corrected.shape and np.array_equal(original, corrected):
        return []
    found = []
    across, down = axis_lengths(corrected, 12)
    if across + down >= 800.0 and down > 1.5 * across:
        found.append("sideways")
    ratios, edge = border_ratios(corrected), border_edges(corrected)
    hot, mean = sum(r >= 0.18 for r in ratios), float(np.mean(ratios))
    overcut = {
        "embedded_card": hot >= 2 or max(ratios) >= 0.22 or mean >= 0.14 or edge >= 20.0,
        "full_page_form": mean >= 0.18 or edge >= 35.0 or hot >= 3,
    }.get(mode, mean >= 0.14 or edge >= 28.0 or hot >= 2)
    if overcut:
        found.append("overcut")
    if mode == "embedded_card" and (corrected.size < 0.025 * original.size or not 1.05 <= max(corrected.shape) / max(min(corrected.shape), 1) <= 3.2):
        found.append("card_fragment")
    if mode == "full_page_form" and 0 < straightness(original) and straightness(corrected) < 0.55 * straightness(original) and border_ink(corrected) >= 0.12:
        found.append("warp_damage")
    return found


def accepted(original: np.ndarray, corrected: np.ndarray, mode: str) -> np.ndarray:
    """The correction where it keeps most of the page and stands, or where nothing is broken; else the original."""
    broken = harms(original, corrected, mode)
    if corrected.size >= 0.85 * original.size:
        broken = [x for x in broken if x == "sideways"]
    return original if broken else corrected


def repaired(gray: np.ndarray, mode: str = "default") -> np.ndarray:
    """Cropped to the sheet, stood up, levelled, cropped to the content; every step only where it holds."""
    if min(gray.shape) < 8 or gray.min() == gray.max():
        return gray
    if box := paper_box(gray):
        gray = accepted(gray, gray[box[0] : box[1], box[2] : box[3]], mode)
    gray = accepted(gray, upright(gray), mode)
    gray = accepted(gray, deskew(gray), mode)
    top, bottom, left, right = content_box(gray)
    return accepted(gray, gray[top:bottom, left:right], mode)


def _pages(b: pd.DataFrame) -> Iterator[np.ndarray | None]:
    """The pages of a batch; none where the data do not fit the size."""
    for h, w, data in zip(b.height, b.width, b.data):
        fits = data is not None and h == h and w == w and h * w == len(data) and h * w > 0
        yield np.frombuffer(data, np.uint8).reshape(int(h), int(w)) if fits else None


def page_borders(images: DataFrame) -> DataFrame:
    """packet_id, page_no, dark_share and the dark shares of the four border strips; null for images that do not fit their size."""
    names = ["dark_share", "top", "bottom", "left", "right"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(None,) * 5 if g is None else (float((g < DARK_BELOW).mean()), *border_ratios(g)) for g in _pages(b)]
            yield pd.concat([b[["packet_id", "page_no"]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=float)], axis=1)

    return images.select("packet_id", "page_no", "height", "width", "data").mapInPandas(run, "packet_id bigint, page_no int, " + ", ".join(f"`{n}` double" for n in names))


def page_repairs(images: DataFrame) -> DataFrame:
    """packet_id, page_no, skew, quarter_turn, height, width, data of the repaired page; images (with mode) that do not fit their size pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for packet, page, mode, h, w, data, g in zip(b.packet_id, b.page_no, b["mode"], b.height, b.width, b.data, _pages(b)):
                if g is None:
                    out.append((packet, page, None, None, h, w, data))
                else:
                    fixed = np.ascontiguousarray(repaired(g, mode or "default"))
                    out.append((packet, page, skew_angle(g), needs_quarter_turn(g), *fixed.shape, fixed.tobytes()))
            yield pd.DataFrame(out, columns=["packet_id", "page_no", "skew", "quarter_turn", "height", "width", "data"])

    return images.select("packet_id", "page_no", "mode", "height", "width", "data").mapInPandas(run, "packet_id bigint, page_no int, skew double, quarter_turn boolean, height int, width int, data binary")


def page_scores(images: DataFrame) -> DataFrame:
    """packet_id, page_no, score, is_blank of images (packet_id, page_no, height, width, data: one byte a pixel); images
    whose data do not fit their size have a null score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score, blank = [], []
            for g in _pages(b):
                score.append(None if g is None else content_score(g))
                blank.append(None if g is None else is_blank_scan(g, score[-1]))
            yield pd.DataFrame({"packet_id": b.packet_id, "page_no": b.page_no, "score": score, "is_blank": blank})

    return images.select("packet_id", "page_no", "height", "width", "data").mapInPandas(run, "packet_id bigint, page_no int, score double, is_blank boolean")
