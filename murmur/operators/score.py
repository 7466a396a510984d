"""Robust outlier scores of posts against their author's earlier posts.

A post's level is the median log engagement of the author's last LEVEL_POSTS mature posts of the preceding LEVEL_DAYS days,
its spread the scaled median absolute deviation of the detrended posts of the preceding SPREAD_DAYS days.
Everything a post needs lies in the SPREAD_DAYS before it (and the LEVEL_POSTS posts before those), so an author's posts are
cut into time slices of SLICE_DAYS and each slice is scored with the history it needs: no task holds a whole author.
Sliding medians over medians have no built-in form; they run over Arrow batches in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.grouped_arrow import by_group
from murmur.sources import settings as S
from murmur.sources.tables import clustered

#: Days of a slice: with as many days of history before it a post is copied once at most.
SLICE_DAYS = S.SPREAD_DAYS
#: Places of a rectangle of spans.
AT_ONCE = 1 << 18


def weighted(likes: str = "likes", comments: str = "comments", shares: str = "shares") -> Column:
    """Engagement with comments and shares weighted up."""
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0)) * w
    return part(likes, S.WEIGHT_LIKES) + part(comments, S.WEIGHT_COMMENTS) + part(shares, S.WEIGHT_SHARES)


def _medians(lg: np.ndarray, window: int) -> np.ndarray:
    """The median of the ``window`` values before each place; NaN where there are fewer."""
    out = np.full(len(lg), np.nan)
    if len(lg) > window:
        out[window:] = np.median(np.lib.stride_tricks.sliding_window_view(lg[:-1], window), axis=1)
    return out


def _middle(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of the first ``n`` of each row's sorted values; the rest is infinite."""
    rows.sort(axis=1)
    at = np.arange(len(rows))
    return (rows[at, (n - 1) // 2] + rows[at, n // 2]) / 2


def _spans(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places, inside): spans of about one length as a rectangle of places, of AT_ONCE places or one span."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    a = 0
    while a < len(order):
        widest = max(1, int(size[order[a]]))
        rows = order[a : a + max(1, AT_ONCE // widest)]
        places = start[rows][:, None] + np.arange(widest)
        yield rows, places, places < end[rows][:, None]
        a += len(rows)


def _level_and_spread(values: np.ndarray, start: np.ndarray, end: np.ndarray, deviation: bool) -> np.ndarray:
    """The median of each span of ``values``, or the median distance from it."""
    out = np.empty(len(start))
    for rows, places, inside in _spans(start, end):
        x = np.where(inside, values[np.minimum(places, len(values) - 1)], np.inf)
        n = (end - start)[rows]
        middle = _middle(x, n)
        if deviation:
            with np.errstate(invalid="ignore"):
                middle = _middle(np.abs(x - middle[:, None]), n)
        out[rows] = middle
    return out


def _score(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Scores of one slice, whose rows come in order of posted, then id."""
    number = lambda c: t.column(c).to_numpy()
    mine = np.flatnonzero(number("own"))
    if not len(mine):
        return  # history only
    ws, posted = number("ws"), number("posted")
    age = (number("measured") - posted) / S.DAY_MS
    lg = np.log1p(ws.astype(float))
    mature = age >= S.MATURE_DAYS
    at, history = posted[mature], lg[mature]
    end = np.searchsorted(at, posted[mine], "left")
    start_level = np.searchsorted(at, posted[mine] - S.LEVEL_DAYS * S.DAY_MS, "right")
    start_spread = np.searchsorted(at, posted[mine] - S.SPREAD_DAYS * S.DAY_MS, "right")
    enough = (age[mine] >= S.PROVISIONAL_DAYS) & (end - start_level >= S.LEVEL_LEAST) & (end - start_spread >= S.SPREAD_LEAST) & (end - start_spread - S.LEVEL_POSTS >= S.RESIDUALS_LEAST)
    level, spread, score, factor = (np.full(len(mine), np.nan) for _ in range(4))
    k = np.flatnonzero(enough)
    if len(k):
        # posts of one instant share their history
        spans, of = np.unique(np.stack([start_level[k], start_spread[k], end[k]], 1), axis=0, return_inverse=True)
        of = of.ravel()
        residual = history - _medians(history, S.LEVEL_POSTS)
        middle = _level_and_spread(history, np.maximum(spans[:, 0], spans[:, 2] - S.LEVEL_POSTS), spans[:, 2], False)[of]
        wide = np.maximum(S.MAD_SCALE * _level_and_spread(residual, spans[:, 1] + S.LEVEL_POSTS, spans[:, 2], True)[of], S.SPREAD_FLOOR)
        level[k], spread[k], score[k] = np.expm1(middle), wide, (lg[mine[k]] - middle) / wide
        with np.errstate(divide="ignore", invalid="ignore"):
            factor[k] = np.where(level[k] > 0, ws[mine[k]] / level[k], np.nan)
    column = lambda x: pa.array(x, mask=np.isnan(x))
    provisional = (age[mine] < S.MATURE_DAYS).astype(np.int64)
    yield pa.RecordBatch.from_arrays([t.column("id").take(pa.array(mine)).combine_chunks(), pa.array(ws[mine].astype(np.int64)), column(level), column(spread), column(factor), column(score), pa.array(provisional)], names=["id", "weighted_score", "creator_baseline", "creator_spread", "x_factor", "x_score", "x_provisional"])


def scores(posts: DataFrame) -> DataFrame:
    """(id, weighted_score, creator_baseline, creator_spread, x_factor, x_score, x_provisional) of every post of an author.

    ``posts``: id, author_id, ws, posted (ms), measured (ms). Only mature posts strictly before a post and strictly within the
    windows count. A post younger than a day, or with too little history, has null scores; without a date it has only its
    weighted score and is not provisional. Posts of null or empty authors are not scored. Authors compare by id only, whatever the
    platform. A baseline that is not positive gives no factor.
    """
    named = posts.where("author_id <> '' AND id IS NOT NULL").select("id", "author_id", "ws", "posted", "measured")
    dated = named.where("posted IS NOT NULL AND measured IS NOT NULL")
    width = SLICE_DAYS * S.DAY_MS
    # a post is history for the slices whose posts look back to it: SPREAD_DAYS ahead. Residuals need LEVEL_POSTS posts
    # before, and only residuals of posts that have as many in the window are used, so no more history is needed
    slice_ = F.floor(F.col("posted") / width)
    ahead = F.floor((F.col("posted") + S.SPREAD_DAYS * S.DAY_MS) / width)
    spread = dated.withColumn("home", slice_).withColumn("slice", F.explode(F.sequence(slice_, ahead)))
    spread = spread.withColumn("own", F.col("slice") == F.col("home"))
    work = clustered(spread, "author_id", "slice").sortWithinPartitions("author_id", "slice", "posted", "id")
    made = work.select("author_id", "slice", "id", "ws", "posted", "measured", "own").mapInArrow(
        by_group(["author_id", "slice"], _score), "id string, weighted_score long, creator_baseline double, creator_spread double, x_factor double, x_score double, x_provisional long"
    )
    # every dated post is its own slice's once, so nothing is joined
    nothing = [F.lit(None).cast("double").alias(c) for c in ("creator_baseline", "creator_spread", "x_factor", "x_score")]
    undated = named.where("posted IS NULL OR measured IS NULL").select("id", F.col("ws").cast("long").alias("weighted_score"), *nothing, F.lit(None).cast("long").alias("x_provisional"))
    out = made.unionByName(undated)
    return out.withColumn("x_provisional", F.coalesce("x_provisional", F.lit(0)).cast("long"))
