"""Greedy selections along an ordered group, split over tasks.

"Take the first row, then the first row at or after the bound it sets, and so
on" depends on order, so it has no window form, and one group may be too large
for one task. It does split: inside a segment of positions the outcome depends
only on where the chain enters. Pass one turns every segment into a small step
function (entry row -> bound and last pick at its end). Step functions of
neighbouring segments compose, so they are first joined into blocks, then the
blocks of a group are folded in order, then the segments of each block; the
last pass marks the rows of every segment from its entry. The largest thing a
task holds is a segment, or the summaries of one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_PICK = -(1 << 62)

# Segments per block.
BLOCK = 1_024


def _hops(pos: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Index of the row picked after each row; its own index at the end."""
    nxt = np.searchsorted(pos, bound, side="left")
    return np.where(nxt < len(pos), np.maximum(nxt, np.arange(len(pos)) + 1), len(pos))


def _last_pick(nxt: np.ndarray) -> np.ndarray:
    """Where the chain through each row ends, by repeated doubling."""
    n = len(nxt)
    reach = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return reach
        reach = further


def _steps(upto: np.ndarray, bound: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """A step function without steps that lead to the same place."""
    differs = (bound[1:] != bound[:-1]) | (last[1:] != last[:-1])
    edge = np.append(np.flatnonzero(differs), len(bound) - 1)
    return upto[edge], bound[edge], last[edge]


def greedy_chain(
    rows: DataFrame,
    group: list[str],
    pos: str,
    bound_of: Callable[[pd.DataFrame], np.ndarray],
    segment: int,
    reach: int,
    lookahead: int = 0,
) -> DataFrame:
    """Every row with ``start``: the position of the pick it falls under (its
    own position if it is a pick).

    ``pos`` is a long, unique within the group. ``bound_of`` gets a segment's
    rows in order, followed by ``lookahead`` positions of the next segment, and
    returns for each row the position from which the next pick may come.
    ``reach`` limits how far a bound lies beyond its row.
    """
    if reach > segment or lookahead > segment:
        raise ValueError("a segment must cover the reach of one pick")
    types = {f.name: f.dataType for f in rows.schema.fields}
    keys = [T.StructField(g, types[g]) for g in group]

    # A fixed number of tasks: groups are work for Python, however few bytes
    # they have, so partitions must not be merged by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = BLOCK
    home = F.floor(F.col(pos) / F.lit(segment))
    ahead = F.pmod(F.col(pos), F.lit(segment)) < F.lit(lookahead)
    spread = (
        rows.withColumn("_home", home)
        .withColumn("_seg", F.explode(F.when(ahead, F.array("_home", F.col("_home") - 1)).otherwise(F.array("_home"))))
        .withColumn("_own", F.col("_seg") == F.col("_home"))
        .drop("_home")
        .repartition(tasks, *group, "_seg")
    )

    def prepared(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        own = pdf["_own"].to_numpy(bool)
        bound = np.asarray(bound_of(pdf), dtype=np.int64)[own]
        at = pdf.loc[own, pos].to_numpy(np.int64)
        return pdf[own], at, bound, _hops(at, bound)

    def step_function(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, at, bound, nxt = prepared(pdf)
        if not len(at):
            return pd.DataFrame(columns=[*group, "_seg", "_block", "upto", "bound", "last"])
        first = int(mine["_seg"].iloc[0]) * segment
        entries = np.arange(min(len(at), int(np.searchsorted(at, first + reach)) + 1))
        ends = _last_pick(nxt)[entries]
        head = mine.iloc[[0]][[*group, "_seg"]].reset_index(drop=True)
        upto, exits, lasts = _steps(at[entries], bound[ends], at[ends])
        return head.assign(_block=head["_seg"] // block, upto=[upto], bound=[exits], last=[lasts])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One step function for all segments of a block, from the last back."""
        pdf = pdf.sort_values("_seg", ascending=False).reset_index(drop=True)
        upto = exits = lasts = np.empty(0, np.int64)
        for seg, u, b, e in zip(pdf["_seg"], pdf["upto"], pdf["bound"], pdf["last"]):
            then = np.searchsorted(upto, b, side="left")
            goes_on = then < len(upto)
            b, e = b.copy(), e.copy()
            b[goes_on], e[goes_on] = exits[then[goes_on]], lasts[then[goes_on]]
            later = upto > u[-1]  # entries past every row of this segment
            upto, exits, lasts = (np.concatenate(p) for p in ((u, upto[later]), (b, exits[later]), (e, lasts[later])))
            near = int(np.searchsorted(upto, int(seg) * segment + reach)) + 1
            upto, exits, lasts = _steps(upto[:near], exits[:near], lasts[:near])
        head = pdf.iloc[[0]][[*group, "_block"]].reset_index(drop=True)
        return head.assign(upto=[upto], bound=[exits], last=[lasts])

    def fold(part: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """Entry bound and pick in force at each part, in order; starts from
        the ``entry`` and ``carried`` of the whole, if it has them."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(part).reset_index(drop=True)
            entry, carried = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            bound = int(pdf["entry"].iloc[0]) if "entry" in pdf else NO_PICK
            last = int(pdf["carried"].iloc[0]) if "carried" in pdf else NO_PICK
            for i, (upto, bounds, lasts) in enumerate(zip(pdf["upto"], pdf["bound"], pdf["last"])):
                entry[i], carried[i] = bound, last
                step = int(np.searchsorted(upto, bound, side="left"))
                if step < len(upto):
                    bound, last = int(bounds[step]), int(lasts[step])
            return pdf[[*group, part]].assign(entry=entry, carried=carried)

        return run

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, at, _, nxt = prepared(pdf)
        picks, i = [], int(np.searchsorted(at, pdf["entry"].iloc[0]))
        while i < len(at):
            picks.append(i)
            i = int(nxt[i])
        under = np.searchsorted(picks, np.arange(len(at)), side="right") - 1
        start = np.full(len(at), pdf["carried"].iloc[0], np.int64)
        if picks:
            start = np.where(under >= 0, at[np.asarray(picks)[np.maximum(under, 0)]], start)
        return mine[[*group, pos]].assign(start=start)

    def long(*names: str) -> list[T.StructField]:
        return [T.StructField(n, T.LongType()) for n in names]

    functions = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("upto", "bound", "last")]
    steps = spread.groupBy(*group, "_seg").applyInPandas(
        step_function, T.StructType([*keys, *long("_seg", "_block"), *functions])
    )
    of_block = [*group, "_block"]
    blocks = steps.groupBy(*of_block).applyInPandas(compose, T.StructType([*keys, *long("_block"), *functions]))
    heads = blocks.groupBy(*group).applyInPandas(
        fold("_block"), T.StructType([*keys, *long("_block", "entry", "carried")])
    )
    entries = (
        steps.join(heads, of_block)
        .groupBy(*of_block)
        .applyInPandas(fold("_seg"), T.StructType([*keys, *long("_seg", "entry", "carried")]))
    )
    return (
        spread.join(entries, [*group, "_seg"])
        .groupBy(*group, "_seg")
        .applyInPandas(mark, T.StructType([*keys, *long(pos, "start")]))
    )
