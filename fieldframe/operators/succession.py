"""Successors of administrative codes by pointer doubling.

A jump table holds, for every code, the codes it reaches in a number of steps, in the order in
which a depth-first walk would meet them. Joining the table with itself doubles the steps, so rounds
are the logarithm of the longest chain. Ways are compared by rank instead of by listing their steps:
the rank of a way is that of its first half, then that of its second half.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.operators.picks import pick_one
from fieldframe.session import materialize


def _ranked(ways: DataFrame) -> DataFrame:
    """One way of lowest order to every code reached, numbered from 0 within a code."""
    best = ways.groupBy("code", "at", "open").agg(F.min("way").alias("way"))
    place = Window.partitionBy("code").orderBy("way", "open")
    return best.select("code", "at", (F.row_number().over(place) - 1).alias("rank"), "open")


def _doubled(jumps: DataFrame) -> DataFrame:
    """Jumps (code, at, rank, open) of twice the steps; what is not open stays where it is."""
    ahead = jumps.where("open").alias("l").join(jumps.alias("r"), F.col("l.at") == F.col("r.code")).select(
        "l.code", "r.at", "r.open", F.struct(F.col("l.rank").alias("a"), F.col("r.rank").alias("b")).alias("way"))
    settled = jumps.where("not open").select("code", "at", "open", F.struct(F.col("rank").alias("a"), F.lit(0).alias("b")).alias("way"))
    return _ranked(ahead.unionByName(settled))


def follow(jumps: DataFrame, most: int) -> DataFrame:
    """Double until nothing is open, or until open ways are longer than ``most`` steps and so meet a code twice."""
    jumps, steps = materialize(jumps, "jumps"), 1
    while steps <= most and not jumps.where("open").isEmpty():
        jumps, steps = materialize(_doubled(jumps), "jumps"), 2 * steps
    return jumps


def _within(links: DataFrame) -> DataFrame:
    """(knot, code) of the codes on cycles of links (code, at); a knot's codes all reach each other.

    The links are closed by doubling, with every pair kept once; the smallest code names a knot.
    """
    pairs = materialize(links.select("code", "at").distinct(), "knots")
    size = pairs.count()
    while True:
        longer = pairs.alias("l").join(pairs.alias("r"), F.col("l.at") == F.col("r.code")).select("l.code", "r.at")
        pairs = materialize(pairs.union(longer).distinct(), "knots")
        grown = pairs.count()
        if grown == size:
            break
        size = grown
    back = pairs.select(F.col("at").alias("code"), F.col("code").alias("at"))
    return pairs.intersect(back).groupBy("code").agg(F.least(F.min("at"), F.col("code")).alias("knot"))


def _walks(group: pd.DataFrame) -> pd.DataFrame:
    """What a depth-first walk from each code of a knot meets: exits, and codes met twice on their own way.

    Rows (knot, code, at, rank) list the successors of the knot's codes. Codes outside the knot are
    not entered, as no way leads back from them.
    """
    after: dict[object, list[object]] = {}
    for code, at in group.sort_values(["code", "rank"])[["code", "at"]].itertuples(index=False):
        after.setdefault(code, []).append(at)
    rows = []
    for first in after:
        met: dict[tuple[object, bool], int] = {}
        way, stack = {first}, [(first, iter(after[first]))]
        while stack:
            code, ahead = stack[-1]
            for at in ahead:
                if at in after and at not in way:
                    way.add(at)
                    stack.append((at, iter(after[at])))
                    break
                # a code of the knot that is on the way already stands for itself
                met.setdefault((at, at not in after), len(met))
            else:
                stack.pop()
                way.discard(code)
        rows += [(first, at, rank, outside) for (at, outside), rank in met.items()]
    return pd.DataFrame(rows, columns=["code", "at", "rank", "outside"])


def _untied(jumps: DataFrame, stuck: DataFrame, movable: DataFrame) -> DataFrame:
    """First jumps with the successors of codes on cycles replaced by what a walk inside their cycles meets.

    A code on a cycle has open ways of any length and is at the end of such ways, so only codes
    that are both are looked at; a chain that leads to a cycle or away from one is not.
    """
    both = stuck.select("code").distinct().intersect(stuck.select(F.col("at").alias("code")).distinct())
    core = materialize(both, "core")
    links = jumps.join(core, "code", "left_semi").join(core.withColumnRenamed("code", "at"), "at", "left_semi")
    knots = materialize(_within(links), "knots")
    kind = jumps.schema["code"].dataType.simpleString()
    listed = jumps.join(knots, "code").select("knot", "code", "at", "rank").groupBy("knot").applyInPandas(_walks, f"code {kind}, at {kind}, rank int, outside boolean")
    opened = listed.join(movable.select(F.col("code").alias("at"), F.lit(True).alias("_moves")), "at", "left")
    replaced = opened.select("code", "at", "rank", (F.col("outside") & F.coalesce("_moves", F.lit(False))).alias("open"))
    return jumps.join(knots, "code", "left_anti").unionByName(replaced)


def resolve(records: DataFrame, active: Column) -> DataFrame:
    """Follow successors to active codes: ``(code, standard_code, _order)``, in the order of a depth-first walk.

    ``records`` has ``code, start_year, end_year, new_codes array``; ``active`` tells a record in
    force. A code with an active record, without successors or without a record stands for itself,
    and so does one that a walk meets twice on its own way. Of several records of a code the latest
    with successors counts. Null successors lead nowhere.
    """
    latest = pick_one(
        records.where(F.size("new_codes") > 0), ["code"], [F.col("start_year").desc_nulls_last(), F.col("end_year").desc_nulls_first()]
    ).select("code", "new_codes")
    state = records.groupBy("code").agg(F.max(active).alias("_active")).join(latest, "code", "left")
    moving = ~F.coalesce(F.col("_active"), F.lit(False)) & F.coalesce(F.exists("new_codes", lambda x: x.isNotNull()), F.lit(False))
    state = materialize(state.withColumn("_moves", moving), "succession-state")
    movable = state.where("_moves").select("code")
    steps = state.where("_moves").select("code", F.posexplode("new_codes").alias("_i", "at")).where("at is not null")
    steps = steps.groupBy("code", "at").agg(F.min("_i").alias("rank"))
    jumps = materialize(steps.join(movable.select(F.col("code").alias("at"), F.lit(True).alias("_on")), "at", "left").select(
        "code", "at", "rank", F.coalesce("_on", F.lit(False)).alias("open")), "jumps")
    most = movable.count()
    found = follow(jumps, most)
    stuck = found.where("open")
    if not stuck.isEmpty():
        found = follow(_untied(jumps, stuck, movable), most)
    still = state.where("not _moves").select("code", F.col("code").alias("standard_code"), F.lit(0).alias("_order"))
    return found.groupBy("code", F.col("at").alias("standard_code")).agg(F.min("rank").alias("_order")).unionByName(still)


def joined_codes(resolved: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Per code its distinct standard codes in order, as array and joined text."""
    ordered = F.array_sort(F.collect_list(F.struct("_order", "standard_code")))
    codes = F.transform(ordered, lambda x: x["standard_code"])
    return resolved.groupBy(*keys).agg(codes.alias("standard_codes")).withColumn("admin_code_standard", F.array_join("standard_codes", ";"))
