"""Running values over ordered groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole group into one task. So every group of more than
``piece_rows`` rows is cut along its integer order column into pieces of at most so many rows: running
values are computed inside a piece, one total per piece is carried forward over the (far
fewer) pieces, and both are combined. The result equals the undivided window. There is one
way for all sizes; a short group is a single piece.

Cuts are quantiles of the order values, from a sketch that merges before the shuffle, so pieces hold
about equally many rows however sparse or uneven the values are (time stamps, for example). A piece
that is still too large is cut again by its own quantiles. The cuts are written before they are used:
every step that reads them sees the same.

Rows with null keys form a group of their own, as in any window, and rows without an order
value come first in it, in no particular order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.session import materialize

#: Rows one task can order comfortably; a group holding 10^11 rows makes 10^5 pieces.
PIECE_ROWS = 1 << 20
#: Parts that a piece is cut into at once, and accuracy of the sketch: an error of one in so many rows.
PARTS, ACCURACY = 64, 10_000
#: Times that a piece is cut again at most: far beyond any size; equal values cannot be cut.
LEVELS = 8
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
_JOIN = {"max": F.greatest, "min": F.least}


@dataclass(frozen=True)
class Running:
    """``sum``, ``max`` or ``min`` of ``value`` over the rows so far.

    ``max`` also finds the latest row of some kind: give it a struct that starts with
    the order column and is null elsewhere.
    """

    kind: str
    value: Column
    include_current: bool = True

    def over(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if self.include_current else -1)
        value = _FOLD[self.kind](self.value).over(frame)
        return F.coalesce(value, F.lit(0)) if self.kind == "sum" else value


def with_piece(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """Add the group as one value that is never null, so that joins keep null keys, and the piece.

    Pieces of a group are numbered in the order of their values. Only groups and pieces of more than
    ``size`` rows are looked at again, of which there are no more than rows divided by ``size``.
    """
    value = F.col(order)
    rows = df.withColumns({"_group": F.struct(*keys), "_piece": F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(0)})
    quantiles = [part / PARTS for part in range(1, PARTS)]
    where = ["_group", "_piece"]
    for _ in range(LEVELS):
        counted = rows.filter(value.isNotNull()).groupBy(*where).agg(F.count(F.lit(1)).alias("_rows"))
        crowded = materialize(counted.filter(F.col("_rows") > size).select(*where), "crowded-pieces")
        if crowded.isEmpty():
            break
        sketch = rows.join(crowded, where, "left_semi").groupBy(*where).agg(F.percentile_approx(order, quantiles, ACCURACY).alias("_cuts"))
        cuts = materialize(sketch.select(*where, F.array_distinct("_cuts").alias("_cuts")), "cuts")
        passed = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < value)), F.lit(0))
        rows = rows.join(cuts, where, "left").withColumn("_piece", F.col("_piece") * PARTS + passed).drop("_cuts")
    return rows


def running(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Running], size: int = PIECE_ROWS
) -> DataFrame:
    """Add one column per entry of ``values``; ``order`` is an integer, unique in its group."""
    pieces = with_piece(df, keys, order, size)
    totals = pieces.groupBy("_group", "_piece").agg(
        *[_FOLD[v.kind](v.value).alias(f"_carry_{name}") for name, v in values.items()]
    )
    earlier = Window.partitionBy("_group").orderBy("_piece")
    carried = totals.select(
        "_group", "_piece",
        *[Running(v.kind, F.col(f"_carry_{name}"), False).over(earlier).alias(f"_carry_{name}") for name, v in values.items()],
    )
    local = Window.partitionBy("_group", "_piece").orderBy(order)
    rows = pieces.select("*", *[v.over(local).alias(f"_local_{name}") for name, v in values.items()])
    # Same keys as the local windows: the large side is not shuffled again.
    joined = rows.join(carried, ["_group", "_piece"])
    combined = []
    for name, v in values.items():
        here, before = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        both = here + before if v.kind == "sum" else _JOIN[v.kind](here, before)
        combined.append(both.alias(name))
    return joined.select(*df.columns, *combined)


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, name: str, size: int = PIECE_ROWS) -> DataFrame:
    """1-based position of each row in its group."""
    return running(df, keys, order, {name: Running("sum", F.lit(1).cast("long"))}, size)


@dataclass(frozen=True)
class Folded:
    """An aggregate that can be taken in two steps: over rows, then over partial results."""

    kind: str
    value: Column


def fold_runs(
    df: DataFrame, keys: Sequence[str], order: str, starts: Column, run: str, folded: Mapping[str, Folded],
    size: int = PIECE_ROWS,
) -> DataFrame:
    """Aggregate runs of consecutive rows; a row where ``starts`` is true opens a run.

    The first row of a group must open one. Runs are numbered from 1 in ``run``. A run
    may be of any length and may cross pieces.
    """
    merge = {"sum": F.sum, "max": F.max, "min": F.min, "any": F.bool_or}
    opened = Running("sum", F.col("_starts"))
    flagged = df.withColumn("_starts", starts.cast("long"))
    pieces = with_piece(flagged, keys, order, size)
    local = Window.partitionBy("_group", "_piece").orderBy(order)
    # Number 0 continues the last run of the pieces before.
    partial = pieces.withColumn("_run", opened.over(local)).groupBy("_group", "_piece", "_run").agg(
        F.sum("_starts").alias("_starts"), *[merge[f.kind](f.value).alias(n) for n, f in folded.items()]
    )
    # Runs are few compared with rows; both uses below read the written table.
    partial = materialize(partial, "partial-runs")
    earlier = Window.partitionBy("_group").orderBy("_piece")
    opened_before = partial.groupBy("_group", "_piece").agg(F.sum("_starts").alias("_starts")).select(
        "_group", "_piece", Running("sum", F.col("_starts"), False).over(earlier).alias("_before")
    )
    numbered = partial.join(opened_before, ["_group", "_piece"]).withColumn(run, F.col("_before") + F.col("_run"))
    runs = numbered.groupBy("_group", run).agg(*[merge[f.kind](n).alias(n) for n, f in folded.items()])
    return runs.select(*[F.col("_group")[k].alias(k) for k in keys], run, *folded)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], split: Column, count: int, rank: str
) -> DataFrame:
    """The first ``count`` rows per group with their rank.

    Each piece (``split`` value) of a group keeps its own best rows first, so that the
    final ranking sees at most ``count`` rows per piece.
    """
    best_of_piece = Window.partitionBy(*keys, "_split").orderBy(*order)
    survivors = (
        df.withColumn("_split", split)
        .withColumn("_rank", F.row_number().over(best_of_piece))
        .filter(F.col("_rank") <= count)
        .drop("_rank", "_split")
    )
    overall = Window.partitionBy(*keys).orderBy(*order)
    return survivors.withColumn(rank, F.row_number().over(overall)).filter(F.col(rank) <= count)
