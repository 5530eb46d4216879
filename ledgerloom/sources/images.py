"""Page images before recognition: skew, margins, binarisation and table regions, with numpy on grey images.

Images are files in a DataFrame (path, content); a task works on one at a time. PNG (8 bit, not interlaced) and PGM are
read here; other formats need a decoder, given as a function from bytes to a grey array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PNG = b"\x89PNG\r\n\x1a\n"


def grey(content: bytes) -> np.ndarray:
    """A PNG or PGM file as a grey array."""
    if content.startswith(b"P5"):
        _, width, height, _ = content.split(None, 4)[:4]
        return np.frombuffer(content[-int(width) * int(height) :], np.uint8).reshape(int(height), int(width))
    if not content.startswith(_PNG):
        raise ValueError("no PNG or PGM file")
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    if depth != 8 or interlaced:
        raise ValueError("only PNG files of 8 bits that aren't interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * channels + 1)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        out[y] = _unfiltered(raw[y, 0], raw[y, 1:], out[y - 1] if y else np.zeros(width * channels, np.uint8), channels)
    pixels = out.reshape(height, width, channels)
    if color == 3:
        pixels = palette[pixels[:, :, 0]]
    return pixels[:, :, 0] if pixels.shape[2] < 3 else (pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG after its filter is undone: none, left, above, their mean, or the nearest of three."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step).astype(np.int64), 0).astype(np.uint8).ravel()
    out = line.astype(np.int64)
    up = above.astype(np.int64)
    for x in range(len(out)):
        left, corner = (int(out[x - step]), int(up[x - step])) if x >= step else (0, 0)
        guess = (left + int(up[x])) // 2
        if kind == 4:
            p = left + int(up[x]) - corner
            guess = min((left, int(up[x]), corner), key=lambda v: abs(p - v))
        out[x] = (out[x] + guess) & 255
    return out.astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A grey array as a PNG file."""
    height, width = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate((np.zeros((height, 1), np.uint8), image.astype(np.uint8)), 1).tobytes()
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def threshold(image: np.ndarray) -> int:
    """The level that parts dark from light with the largest variance between them (Otsu); what is at most that level is dark."""
    count = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, level = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(all="ignore"):
        between = below * above * (level / below - (level[-1] - level) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def rotated(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """The image turned counter-clockwise about its centre, in a frame that holds it whole."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    sin, cos = np.sin(a), np.cos(a)
    height, width = int(h * abs(cos) + w * abs(sin)), int(h * abs(sin) + w * abs(cos))
    y, x = np.mgrid[0:height, 0:width]
    y, x = y - height / 2 + 0.5, x - width / 2 + 0.5
    from_x, from_y = np.rint(x * cos - y * sin + w / 2 - 0.5).astype(int), np.rint(x * sin + y * cos + h / 2 - 0.5).astype(int)
    inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
    return np.where(inside, image[np.clip(from_y, 0, h - 1), np.clip(from_x, 0, w - 1)], fill).astype(np.uint8)


def skew(image: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """By how many degrees the lines of a page rise to the right: the turn, of those tried, after which dark pixels fill rows most unevenly."""
    dark = np.argwhere(image <= threshold(image))
    if not len(dark) or image.min() == image.max():
        return 0.0
    if len(dark) > 200_000:
        dark = dark[:: len(dark) // 200_000 + 1]
    y, x = dark[:, 0].astype(np.float64), dark[:, 1].astype(np.float64)
    best, found = -1.0, 0.0
    for degrees in sorted(np.arange(-most, most + step / 2, step), key=abs):
        rows = np.rint(y + x * np.tan(np.deg2rad(degrees))).astype(int)
        score = float((np.bincount(rows - rows.min()).astype(np.float64) ** 2).sum())
        if score > best:
            best, found = score, float(degrees)
    return found


def deskewed(image: np.ndarray, least: float = 0.3) -> np.ndarray:
    angle = skew(image)
    return rotated(image, -angle) if abs(angle) > least else image


def cropped(image: np.ndarray, pad: int = 16) -> np.ndarray:
    """The image without its margins, but for `pad` pixels."""
    if image.min() == image.max():
        return image
    y, x = np.nonzero(image <= threshold(image))
    return image[max(0, y.min() - pad) : y.max() + 1 + pad, max(0, x.min() - pad) : x.max() + 1 + pad]


def _means(image: np.ndarray, size: int) -> np.ndarray:
    """The mean of the square of `size` pixels around each."""
    half = size // 2
    padded = np.pad(image.astype(np.float64), half, mode="edge")
    sums = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2


def binarised(image: np.ndarray, size: int = 31, below: int = 15) -> np.ndarray:
    """Black where a pixel, after a median of nine, is darker than its surroundings by more than `below`."""
    padded = np.pad(image, 1, mode="edge")
    h, w = image.shape
    median = np.median(np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)
    return np.where(median > _means(median, size) - below, 255, 0).astype(np.uint8)


def borderless(image: np.ndarray) -> np.ndarray:
    """For tables without rules: straightened, its contrast stretched, and parted at one level."""
    straight = deskewed(image, 0.2)
    low, high = np.percentile(straight, (1, 99))
    stretched = np.clip((straight.astype(np.float64) - low) * 255 / max(1.0, high - low), 0, 255).astype(np.uint8)
    return np.where(stretched > threshold(stretched), 255, 0).astype(np.uint8)


def _runs(dark: np.ndarray, least: int) -> np.ndarray:
    """Dark pixels that stand in a row of at least `least`."""
    h, w = dark.shape
    sums = np.pad(np.cumsum(dark, 1), ((0, 0), (1, 0)))
    if w < least:
        return np.zeros_like(dark)
    full = sums[:, least:] - sums[:, :-least] == least
    marks = np.zeros((h, w + 1), np.int64)
    marks[:, : w - least + 1] += full
    marks[:, least:] -= full
    return np.cumsum(marks, 1)[:, :w] > 0


def table_boxes(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, width, height of each region of connected rules, the largest first."""
    h, w = image.shape
    dark = image <= threshold(image) if image.min() < image.max() else np.zeros(image.shape, bool)
    rules = _runs(dark, max(10, w // 60)) | _runs(dark.T, max(10, h // 60)).T
    near = rules.copy()
    for axis in (0, 1):
        for shift in (-2, -1, 1, 2):
            near |= np.roll(rules, shift, axis)
    label, boxes = np.zeros(near.shape, bool), []
    for y, x in np.argwhere(near):
        if label[y, x]:
            continue
        stack, ys, xs = [(int(y), int(x))], [int(y)] * 2, [int(x)] * 2
        label[y, x] = True
        while stack:
            i, j = stack.pop()
            ys, xs = [min(ys[0], i), max(ys[1], i)], [min(xs[0], j), max(xs[1], j)]
            for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= a < h and 0 <= b < w and near[a, b] and not label[a, b]:
                    label[a, b] = True
                    stack.append((a, b))
        boxes.append((xs[0], ys[0], xs[1] - xs[0] + 1, ys[1] - ys[0] + 1))
    return sorted(boxes, key=lambda b: -b[2] * b[3])


def table_box(image: np.ndarray, area: float = 0.1, width: float = 0.4, height: float = 0.25) -> tuple[int, int, int, int] | None:
    """The largest region of rules that takes these shares of the page; None without one."""
    h, w = image.shape
    return next((b for b in table_boxes(image) if b[2] * b[3] > area * h * w and b[2] > width * w and b[3] > height * h), None)


def table_region(image: np.ndarray, pad: int = 6) -> np.ndarray:
    """The part of the image with the largest region of rules; the whole of it without any."""
    boxes = table_boxes(image)
    if not boxes:
        return image
    x, y, w, h = boxes[0]
    return image[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad]


STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"orig": lambda i: cropped(deskewed(i)), "bin": lambda i: binarised(cropped(deskewed(i))), "borderless": borderless, "table": table_region}


def prepared(found: DataFrame, steps: tuple[str, ...] = ("orig", "bin"), decode: Callable[[bytes], np.ndarray] = grey) -> DataFrame:
    """path, step, content, width, height, error: each image after each of the steps, as PNG; an image that can't be read gives its error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    image = decode(bytes(content))
                    for step in steps:
                        done = STEPS[step](image)
                        rows.append((path, step, png(done), done.shape[1], done.shape[0], None))
                except Exception as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                frame = pd.DataFrame(rows, columns=["path", "step", "content", "width", "height", "error"])
                yield frame.astype({"width": "Int32", "height": "Int32"})

    return found.select("path", "content").mapInPandas(work, "path string, step string, content binary, width int, height int, error string")


def page_files(images: DataFrame, base: str, page: str) -> DataFrame:
    """name and content of prepared images, for write_files: <base>_pageNN_<step>.png."""
    return images.where("error is null").select(F.concat(base, F.lit("_page"), F.lpad(F.col(page).cast("string"), 2, "0"), F.lit("_"), "step", F.lit(".png")).alias("name"), "content")
