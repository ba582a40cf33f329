"""Most similar name in a scope, by an index of letters that is probed once.

Names are filed once per scope and dealt into chunks; a target meets the chunks of its scope by
equality. In a chunk, lists of names by letter count the letters that a name shares with the target,
which bounds their similarity together with both lengths. Names are compared in the order of that
bound, so the first comparison gives the score to beat and the search ends at the first bound below
the best score: no name that could win is left out, and few others are compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.session import materialize

#: Names and targets that meet in one task's group at most, on average.
CHUNK = 4096


class LetterIndex:
    """Names by letter, every further occurrence of a letter in a name counting as a letter of its own."""

    def __init__(self, names: list[str], codes: list):
        self.names, self.codes = names, codes
        self.lengths = np.array([len(n) for n in names], np.int64)
        filed: dict[tuple[str, int], list[int]] = defaultdict(list)
        for place, name in enumerate(names):
            for mark in self.marks(name):
                filed[mark].append(place)
        self.filed = {mark: np.array(places) for mark, places in filed.items()}

    @staticmethod
    def marks(text: str) -> list[tuple[str, int]]:
        return [(letter, k) for letter, many in Counter(text).items() for k in range(many)]

    def bounds(self, target: str) -> np.ndarray:
        """For every name twice the shared letters over the sum of lengths; no similarity is above it."""
        lists = [self.filed[m] for m in self.marks(target) if m in self.filed]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.names)) if lists else np.zeros(len(self.names), np.int64)
        return 2.0 * shared / np.maximum(self.lengths + len(target), 1)

    def closest(self, target: str) -> tuple[float, object, int]:
        """(best score, lowest code that has it, names compared); score 0 and no code if no letter is shared."""
        bounds = self.bounds(target)
        best, code, compared = 0.0, None, 0
        for place in np.argsort(-bounds, kind="stable"):
            if not bounds[place] or bounds[place] < best - 1e-12:
                break
            compared += 1
            score = SequenceMatcher(None, target, self.names[place]).ratio()
            if score > best or score and score == best and self.codes[place] < code:
                best, code = score, self.codes[place]
        return best, code, compared


def _searched(key: tuple, names: pa.Table, targets: pa.Table) -> pa.Table:
    index = LetterIndex(names.column("_name").to_pylist(), names.column("_code").to_pylist())
    asked = targets.column("_target").to_pylist()
    found = [index.closest(t) for t in asked]
    scopes = targets.column("_scope")
    return pa.table({
        "_scope": scopes, "_target": targets.column("_target"), "_score": pa.array([f[0] for f in found], pa.float64()),
        "_code": pa.array([f[1] for f in found], names.schema.field("_code").type), "_compared": pa.array([f[2] for f in found], pa.int64())})


def closest_names(targets: DataFrame, names: DataFrame, scope: dict[str, str], target: str = "_target", name: str = "_name", code: str = "_code") -> DataFrame:
    """Targets with _score, _code and _compared of the most similar name in their scope; the lowest code on ties.

    ``scope`` maps the scope columns of the targets to those of the names; nulls are equal. Scores are
    matching-blocks ratios. Targets that share no letter with any name are left out, and so are names without a code. _compared
    counts the names that were compared in full.

    Only scopes with targets are filed. A scope with many names or targets is a grid of groups of
    bounded size; each group is searched on its own, and a target keeps the best of its groups.
    """
    key = lambda columns: F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns])
    asked = targets.where(F.col(target).isNotNull()).withColumn("_scope", key(list(scope)))
    stored = names.select(key(list(scope.values())).alias("_scope"), F.col(name).alias("_name"), F.col(code).alias("_code")).where("_name is not null and _code is not null")
    stored = materialize(stored.join(asked.select("_scope").distinct(), "_scope", "left_semi"), "name-index")
    groups = lambda df, out: df.groupBy("_scope").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(out))
    wanted = asked.select("_scope", F.col(target).alias("_target")).distinct()
    dealt = groups(stored, "_chunks").join(groups(wanted, "_parts"), "_scope")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    one = lambda text, many: F.pmod(F.xxhash64(text), F.col(many)).cast("int")
    left = stored.join(dealt, "_scope").withColumn("_chunk", one("_name", "_chunks")).withColumn("_part", every("_parts"))
    right = wanted.join(dealt, "_scope").withColumn("_part", one("_target", "_parts")).withColumn("_chunk", every("_chunks"))
    cell = ["_scope", "_chunk", "_part"]
    kind = stored.schema["_code"].dataType.simpleString()
    met = left.select(*cell, "_name", "_code").groupBy(*cell).cogroup(right.select(*cell, "_target").groupBy(*cell))
    found = met.applyInArrow(_searched, f"_scope string, _target string, _score double, _code {kind}, _compared long")
    # the best score, the lowest code on ties, in one aggregate
    first = F.min(F.when(F.col("_score") > 0, F.struct((-F.col("_score")).alias("less"), F.col("_code").alias("code"))))
    best = found.groupBy("_scope", "_target").agg(first.alias("_best"), F.sum("_compared").alias("_compared")).where("_best is not null")
    best = best.select(F.col("_scope").alias("_where"), F.col("_target").alias("_asked"), (-F.col("_best.less")).alias("_score"), F.col("_best.code").alias("_code"), "_compared")
    return asked.join(best, (F.col("_scope") == F.col("_where")) & (F.col(target) == F.col("_asked"))).drop("_scope", "_where", "_asked")
