"""Index sampling over frame sequences, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def _ints(x: Column) -> Column:
    return x.cast("array<int>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once rather than wherever the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def uniform_indices(n: Column | str | int, k: Column | str | int) -> Column:
    """k indices spread evenly over 0..n-1 (ties to even), distinct, filled up from 0, sorted."""
    n, k = _c(n), _c(k)

    def spread(m: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: F.when(m > 1, F.bround(i * (n - 1) / (m - 1))).otherwise(F.lit(0.0)).cast("int"))
        # bounded: of 0..n-1 no more than m are needed beside the spread ones
        spare = lambda own: F.array_except(_ints(F.sequence(F.lit(0), F.greatest(F.least(n, m * 2) - 1, F.lit(0)))), own)
        return _let(F.array_distinct(at), lambda own: F.array_sort(F.concat(own, F.slice(spare(own), 1, F.greatest(m - F.size(own), F.lit(0))))))

    return F.when((n > 0) & (k > 0), _let(F.least(n, k), spread)).otherwise(_ints(F.array()))


def downsample(indices: Column | str, limit: Column | str | int) -> Column:
    """A sorted distinct list thinned evenly to ``limit`` entries."""
    limit = _c(limit)

    def thin(own: Column) -> Column:
        picked = F.transform(uniform_indices(F.size(own), limit), lambda i: F.element_at(own, i + 1))
        return F.when((limit <= 0) | (F.size(own) == 0), _ints(F.array())).when(F.size(own) <= limit, own).otherwise(picked)

    return _let(F.array_sort(F.array_distinct(_c(indices))), thin)


def keyframes(n: Column | str | int, k: int, scenes: Column | str) -> Column:
    """Half the frames (rounded up) spread evenly, thinned scene changes for the rest, filled up with evenly spread ones."""
    n = _c(n)
    if k <= 1:
        return F.when(n > 0, _ints(F.array(F.lit(0)))).otherwise(_ints(F.array()))
    full = uniform_indices(n, k)

    def choose(even: Column, scenes: Column) -> Column:
        extra = downsample(F.array_except(scenes, even), F.lit(k) - F.size(even))
        return _let(F.array_sort(F.array_union(even, extra)), lambda m: downsample(F.when(F.size(m) < k, F.concat(m, full)).otherwise(m), k))

    chosen = _let(F.array_sort(F.array_distinct(_ints(_c(scenes)))), lambda s: F.when(F.size(s) == 0, full).otherwise(_let(uniform_indices(n, (k + 1) // 2), lambda even: choose(even, s))))
    return F.when(n <= 0, _ints(F.array())).otherwise(chosen)


def multi_frame(n: Column | str | int) -> Column:
    """All frames of up to 3, else the first, the middle and the last."""
    n = _c(n)
    return F.when(n <= 0, _ints(F.array())).when(n <= 3, _ints(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))).otherwise(F.array_distinct(_ints(F.array(F.lit(0), F.floor(n / 2), n - 1))))


def keep_frame(index: Column | str, width: Column | str, height: Column | str, video_fps: float, target_fps: float, min_side: int = 128) -> Column:
    step = max(1, round(video_fps / target_fps)) if target_fps > 0 else 1
    return (_c(index) % step == 0) & (F.least(_c(width), _c(height)) >= min_side)


def frame_time(index: Column | str, fps: float) -> Column:
    """The time of a frame in seconds, to the millisecond; 0 where the rate isn't known."""
    return F.bround(_c(index) / F.lit(float(fps)), 3) if fps > 0 else F.lit(0.0)


def fit_within(width: Column | str, height: Column | str, longest: int, cut: bool = False) -> Column:
    """struct(width, height) scaled so that the longer side is at most ``longest``, at least 1; rounded, or cut off."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    whole = F.floor if cut else F.bround
    side = lambda x: F.greatest(F.lit(1), whole(x * scale).cast("int"))
    return F.struct(side(w).alias("width"), side(h).alias("height"))
