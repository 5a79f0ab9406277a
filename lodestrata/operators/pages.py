"""Reading order of printed pages, from the places of their glyphs.

glyphs: one row a glyph or word, (keys, x0, x1, top, size, text, width, images): its box in points, its font size, the
width of the page and how many images the page has. A page's glyphs are few: Spark brings them together as one row a
page, and a task works on the numbers of many pages at once. Null texts count as empty. A page without glyphs has no
row, and so no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of the body size below which a glyph is small, how far it may stand from its line (in body
# sizes), tolerances of lines and words, and the four gates of a page of two columns.
SMALL, ABOVE, BELOW = 0.85, -0.1, 0.75
LINE, SPACE = 3.0, 3.0
SPLITS = (30, 70)
GAP, MIN_SIDE_ROWS, MIN_SIDE_BY_SIDE, MAX_CROSSING = 12.0, 3, 2, 0.10
#: Glyphs that a task works on at a time; a page that has more is taken by itself.
GLYPHS = 1 << 18


def glyph(x0: Column, x1: Column, top: Column, size: Column, text: Column, width: Column, images: Column) -> Column:
    """A glyph as an element of its page's array."""
    numbers = {"x0": x0, "x1": x1, "top": top, "line": F.round(top, 1), "size": size, "width": width, "images": images}
    return F.struct(*[c.cast("double").alias(n) for n, c in numbers.items()], F.coalesce(text, F.lit("")).alias("text"))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _reattached(page: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    """Tops, with those of subscripts and superscripts set to that of the nearest line of body glyphs."""
    size, top = g["size"], g["top"].copy()
    base = np.full(page[-1] + 1, np.nan)
    sized = np.flatnonzero(~np.isnan(size))
    if len(sized):
        sized = sized[np.lexsort((size[sized], page[sized]))]
        first = _heads(page[sized])
        n = np.diff(np.append(first, len(sized)))
        low, high = size[sized][first + (n - 1) // 2], size[sized][first + n // 2]
        base[page[sized][first]] = low + (high - low) * np.where(n % 2, 0.0, 0.5)
    body = size >= SMALL * base[page]
    small = ~body & (base[page] > 0)
    for p in np.unique(page[small]):  # few pages have small glyphs
        a, b = np.searchsorted(page, [p, p + 1])
        lines = np.unique(g["line"][a:b][body[a:b] & ~np.isnan(g["line"][a:b])])
        at = a + np.flatnonzero(small[a:b])
        if len(lines):
            away = top[at, None] - lines[None, :]
            away = np.where((away >= ABOVE * base[p]) & (away <= BELOW * base[p]), np.abs(away), np.inf)
            best = away.argmin(axis=1)
            top[at] = np.where(np.isfinite(away.min(axis=1)), lines[best], top[at])
    return top


def _crossed(x: np.ndarray, x0: np.ndarray, x1: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """How rows of glyphs, of which first are the first ones, lie to vertical lines x: (cross, left, right, both). A row
    with both sides has neither left nor right alone."""
    cross = np.logical_or.reduceat((x0 < x) & (x < x1), first)
    left = np.maximum.reduceat(np.where(x1 <= x, x1, -np.inf), first)
    right = np.minimum.reduceat(np.where(x0 >= x, x0, np.inf), first)
    two = (left > -np.inf) & (right < np.inf)
    both = ~cross & two & (right - left >= GAP)
    cross |= two & ~both
    left = ~cross & ~both & (left > -np.inf)
    return cross, left, ~(cross | both | left), both


def _splits(page: np.ndarray, row: np.ndarray, x0: np.ndarray, x1: np.ndarray, seen: np.ndarray, plain: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Each page's split, the one that crosses the fewest rows (the middle one of equals); nan for a page of one column.
    Glyphs come by page and row; blank ones are not seen, but their rows count."""
    n_pages, out = len(width), np.full(len(width), np.nan)
    n_rows = np.bincount(page[_heads(page, row)], minlength=n_pages)
    at = np.flatnonzero(seen & ~plain[page])
    if not len(at):
        return out
    own, x0, x1 = page[at], x0[at], x1[at]
    first = _heads(own, row[at])
    of = own[first]
    count = lambda mark: np.bincount(of[mark], minlength=n_pages)
    crossing = []
    for pct in range(SPLITS[0], SPLITS[1] + 1):
        cross, left, right, both = _crossed((width * pct / 100)[own], x0, x1, first)
        b, c = count(both), count(cross)
        fit = (count(left) + b >= MIN_SIDE_ROWS) & (count(right) + b >= MIN_SIDE_ROWS) & (b >= MIN_SIDE_BY_SIDE)
        crossing.append(np.where(fit, c, np.iinfo(np.int64).max))
    crossing = np.stack(crossing)
    least = crossing.min(axis=0)
    equal = crossing == least
    middle = (np.cumsum(equal, axis=0) > equal.sum(axis=0) // 2).argmax(axis=0) + SPLITS[0]
    found = least / np.maximum(n_rows, 1) <= MAX_CROSSING
    out[found] = (width * middle / 100)[found]
    return out


def _joined(texts: pa.Array, first: np.ndarray) -> pa.Array:
    """Runs of texts as one text each; first are the first ones. They lie side by side already."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at[np.append(first, len(texts))]), texts.buffers()[2] or pa.py_buffer(b""))


def _before(mark: np.ndarray, separator: str, texts: pa.Array) -> pa.Array:
    """texts with a separator before the marked ones."""
    kinds = pa.array(["", separator], pa.large_string())
    return pc.binary_join_element_wise(kinds.take(pa.array(mark.astype(np.int8))), texts, pa.scalar("", pa.large_string()))


def _read(page: np.ndarray, g: dict[str, np.ndarray], text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(pages, their texts) of glyphs that come by page; pages without a line are left out."""
    n_pages = page[-1] + 1
    head = _heads(page)
    plain = np.zeros(n_pages, bool)
    symbol = pc.match_substring_regex(text, "^[\\x{F000}-\\x{F0FF}]").to_numpy(zero_copy_only=False)
    plain[page[symbol | (g["images"] > 0)]] = True
    width = np.full(n_pages, np.nan)
    width[page[head]] = g["width"][head]
    low = lambda v: np.where(np.isnan(v), -np.inf, v)  # noqa: E731  a missing place comes first

    top = low(_reattached(page, g))
    order = np.lexsort((top, page))
    new = np.zeros(len(page), np.int64)
    with np.errstate(invalid="ignore"):
        new[1:] = (np.diff(top[order]) > LINE) & np.isfinite(top[order][:-1])
    new[_heads(page[order])] = 1
    row = np.empty(len(page), np.int64)
    row[order] = np.cumsum(new)

    by_place = [low(g["x1"]), low(g["x0"]), row]
    order = np.lexsort(by_place)
    if len(_heads(*[k[order] for k in by_place])) < len(order):  # glyphs on one place: by their texts
        order = np.lexsort((pc.rank(text, tiebreaker="min").to_numpy(), *by_place))
    page, row, text = page[order], row[order], text.take(pa.array(order))
    x0, x1 = g["x0"][order], g["x1"][order]
    seen = pc.not_equal(pc.utf8_trim(text, " "), "").to_numpy(zero_copy_only=False)
    x = _splits(page, row, x0, x1, seen, plain, width)[page]

    first = _heads(row)
    crosses = np.zeros(len(first), bool)
    at = np.flatnonzero(seen & ~np.isnan(x))
    if len(at):
        inner = _heads(row[at])
        crosses[np.searchsorted(row[first], row[at][inner])] = _crossed(x[at], x0[at], x1[at], inner)[0]
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    whole = np.isnan(x) | crosses[of]
    section = np.cumsum(crosses)[of]
    middle = (x0 + x1) / 2
    part = np.where(whole, 0, np.where(middle < x, 1, 2))
    order = np.lexsort((row, part, section, page))
    order = order[(whole | ~np.isnan(middle))[order]]
    page, row, part, x0, x1, text = page[order], row[order], part[order], x0[order], x1[order], text.take(pa.array(order))
    if not len(order):
        return page, text

    first = _heads(row, part)
    apart = np.zeros(len(order), bool)
    apart[1:] = x0[1:] - x1[:-1] > SPACE
    apart[first] = False
    lines = pc.utf8_trim(_joined(_before(apart, " ", text), first), " ")
    some = pc.not_equal(lines, "")
    of, lines = page[first][some.to_numpy(zero_copy_only=False)], lines.filter(some)
    if not len(of):
        return of, lines
    first = _heads(of)
    later = np.ones(len(of), bool)
    later[first] = False
    return of[first], _joined(_before(later, "\n", lines), first)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, glyphs) to (keys, text)."""
    for batch in batches:
        *keys, glyphs = batch.columns
        ends = np.cumsum(pc.fill_null(pc.list_value_length(glyphs), 0).to_numpy())
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GLYPHS, "right")))
            part = glyphs.slice(a, b - a)
            inner = part.flatten()
            if len(inner):
                page = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
                fields = dict(zip([f.name for f in inner.type], inner.flatten()))
                text = fields.pop("text").cast(pa.large_string())
                numbers = {n: pc.fill_null(v, np.nan).to_numpy() for n, v in fields.items()}
                found, texts = _read(page, numbers, text)
                at = pa.array(found + a)
                yield pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], texts.cast(pa.string())], [*batch.schema.names[:-1], "text"])
            a = b


def texts_of(pages: DataFrame) -> DataFrame:
    """(keys, text) of rows (keys, glyphs), a row a page with the array of its glyphs: lines in reading order. On a page
    of two columns the left one comes before the right one, and rows across both end a section. A page is read straight
    through unless it passes the gates: no images, no glyphs of a symbol font, a split, and few rows that cross it."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(_texts, f"{kinds}, text string")


def page_texts(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of glyphs, a row each."""
    one = glyph(*[F.col(c) for c in ("x0", "x1", "top", "size", "text", "width", "images")])
    return texts_of(glyphs.groupBy(*keys).agg(F.collect_list(one).alias("glyphs")))
