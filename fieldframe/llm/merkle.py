"""Merkle manifest of a dataset whose parents retain SHA-256 states, and folding that resumes them.

A digest as hex text is 64 bytes, one block of SHA-256, so the state a parent's hash has before each
of its child slots is eight words that a table can hold. A manifest stores subtrees of at most
3**levels leaves as rows: all their digests and, per parent, the states before its second and third
slot (before the first it is the start state). Folding a replaced leaf takes the state of its slot,
hashes the replacement and the siblings to the right, and goes up; what lies to the left is never
read again.

Trees grow in rounds of so many levels; each round shuffles one digest per subtree of the round before.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.session import checkpoint_root, materialize

FANOUT, LEVELS = 3, 6
#: Rows that are hashed together inside a task.
SLAB = 1 << 13
#: Bytes of one level of a path: slot, number of children, state before the slot, two siblings.
STEP = 2 + 32 + 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _primes(n: int) -> list[int]:
    found: list[int] = []
    c = 2
    while len(found) < n:
        if all(c % p for p in found):
            found.append(c)
        c += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


#: The hash's constants by their rule: fractions of square and cube roots of the first primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
#: Four hex digits as one big-endian word, for every half of a digest's word.
HEX = np.array([int.from_bytes(f"{h:04x}".encode(), "big") for h in range(1 << 16)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def as_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as blocks (16, n) of their hex text."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2] = HEX[digests >> np.uint32(16)]
    out[1::2] = HEX[digests & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[14] = (blocks.astype(np.uint64) * np.uint64(512) >> np.uint64(32)).astype(np.uint32)
    last[15] = (blocks * 512).astype(np.uint32)
    return compress(state, last)


def resume(state: np.ndarray, digests: np.ndarray, where: np.ndarray) -> np.ndarray:
    """States after the digests' hex text in the columns ``where``; other columns stay."""
    if where.all():
        return compress(state, as_block(digests))
    at = np.flatnonzero(where)
    if not len(at):
        return state
    out = state.copy()
    out[:, at] = compress(state[:, at], as_block(digests[:, at]))
    return out


def words(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32))


def raw(digests: np.ndarray) -> bytes:
    return digests.T.astype(">u4").tobytes()


def hexes(digests: np.ndarray) -> pa.Array:
    text = raw(digests).hex()
    return pa.array([text[k:k + 64] for k in range(0, len(text), 64)], pa.string())


def depth(sizes: np.ndarray) -> np.ndarray:
    """Levels above the leaves of trees of so many leaves."""
    out, reach = np.zeros(len(sizes), np.int64), 1
    while (more := sizes > reach).any():
        out += more
        reach *= FANOUT
    return out


class Levels:
    """Node numbers of a slab of subtrees: counts and offsets by level and subtree."""

    def __init__(self, leaves: np.ndarray, sizes: np.ndarray, most: int):
        self.todo = np.minimum(depth(sizes), most)
        self.counts = [leaves]
        for level in range(int(self.todo.max(initial=0))):
            self.counts.append(np.where(self.todo > level, -(-self.counts[-1] // FANOUT), 0))
        self.offsets = [np.cumsum(c) - c for c in self.counts]

    def parents(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first child, number of children) of every parent over ``level``."""
        above = self.counts[level + 1]
        group = np.repeat(np.arange(len(above)), above)
        local = np.arange(int(above.sum())) - self.offsets[level + 1][group]
        first = self.offsets[level][group] + FANOUT * local
        return first, np.minimum(FANOUT, self.counts[level][group] - FANOUT * local)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole subtrees, place of each one's first row) of rows sorted by tree and chunk."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        tree, chunk = table.column("tree"), table.column("chunk").to_numpy()
        changed = (chunk[1:] != chunk[:-1]) | pc.not_equal(tree[1:], tree[:-1]).to_numpy()
        return np.concatenate(([0], np.flatnonzero(changed) + 1))

    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            held.append(batch.slice(at, SLAB))
            if sum(b.num_rows for b in held) >= SLAB:
                table = pa.Table.from_batches(held).combine_chunks()
                firsts = bounds(table)
                if len(firsts) > 1:
                    yield table.slice(0, int(firsts[-1])), firsts[:-1]
                    held = table.slice(int(firsts[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)


def _binary(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _subtrees(carried: bool, most: int):
    """Rows of a round (tree, chunk, idx, size, digest) to one row per subtree."""
    def built(batches):
        for table, firsts in _slabs(batches):
            leaves = np.diff(firsts, append=table.num_rows)
            sizes = table.column("size").to_numpy()[firsts]
            levels, digests, states = Levels(leaves, sizes, most), [words(_binary(table.column("digest")))], []
            for level in range(len(levels.counts) - 1):
                first, kids = levels.parents(level)
                below = digests[-1]
                after = [start(len(first))]
                for k in range(FANOUT):
                    after.append(resume(after[-1], below[:, np.minimum(first + k, below.shape[1] - 1)], kids > k))
                digests.append(finish(after[FANOUT], kids))
                states.append(np.concatenate(after[1:FANOUT]).T.astype(">u4").tobytes())
            raws = [raw(d) for d in digests]
            ids = table.column("doc_id").combine_chunks() if carried else None
            changed = _binary(table.column("replaced")) if carried else b""
            out: dict[str, list] = {c: [] for c in ("digests", "states", "top")}
            for g in range(len(firsts)):
                spans = [(int(levels.offsets[k][g]), int(levels.offsets[k][g] + levels.counts[k][g])) for k in range(int(levels.todo[g]) + 1)]
                out["digests"].append(b"".join(r[32 * a:32 * b] for r, (a, b) in zip(raws, spans)))
                out["states"].append(b"".join(s[64 * a:64 * b] for s, (a, b) in zip(states, spans[1:])))
                out["top"].append(out["digests"][-1][-32:])
            keep = pa.array(firsts)
            columns = [table.column("tree").combine_chunks().take(keep), table.column("chunk").combine_chunks().take(keep), pa.array(sizes, pa.int64()), pa.array(leaves, pa.int32()),
                       *(pa.array(out[c], pa.binary()) for c in ("digests", "states", "top"))]
            names = ["tree", "chunk", "size", "leaves", "digests", "states", "top"]
            if carried:
                columns += [pa.array([ids[a:a + n].to_pylist() for a, n in zip(firsts.tolist(), leaves.tolist())], pa.list_(pa.int64())),
                            pa.array([changed[32 * a:32 * (a + n)] for a, n in zip(firsts.tolist(), leaves.tolist())], pa.binary())]
                names += ["doc_ids", "replaced"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return built


@dataclass
class Opened:
    """A slab of stored subtrees, unpacked: digests and states by level over all of them."""

    levels: Levels
    digests: list[np.ndarray]
    states: list[np.ndarray]
    group: np.ndarray
    local: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, most: int) -> Opened:
        leaves = table.column("leaves").to_numpy().astype(np.int64)
        levels = Levels(leaves, table.column("size").to_numpy(), most)
        digests, states = table.column("digests").to_pylist(), table.column("states").to_pylist()
        ends = np.cumsum(np.stack(levels.counts), axis=0)
        nodes = [words(b"".join(d[32 * (e - n):32 * e] for d, e, n in zip(digests, ends[k].tolist(), c.tolist()))) for k, c in enumerate(levels.counts)]
        kept = []
        for k in range(1, len(levels.counts)):
            last = (ends[k] - ends[0]).tolist()
            joined = b"".join(s[64 * (e - n):64 * e] for s, e, n in zip(states, last, levels.counts[k].tolist()))
            kept.append(np.ascontiguousarray(np.frombuffer(joined, ">u4").reshape(-1, 16).T.astype(np.uint32)))
        group = np.repeat(np.arange(len(leaves)), leaves)
        return cls(levels, nodes, kept, group, np.arange(int(leaves.sum())) - levels.offsets[0][group])

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """By level: (leaves that have it, slots, numbers of children, states before the slot, the two siblings)."""
        local = self.local
        for level in range(len(self.states)):
            live = np.flatnonzero(self.levels.todo[self.group] > level)
            group, at = self.group[live], local[live]
            slot = at % FANOUT
            place = self.levels.offsets[level][group] + at
            kids = np.minimum(FANOUT, self.levels.counts[level][group] - (at - slot))
            parent = self.levels.offsets[level + 1][group] + at // FANOUT
            state = start(len(live))
            for k in range(1, FANOUT):
                there = np.flatnonzero(slot == k)
                state[:, there] = self.states[level][8 * k - 8:8 * k, parent[there]]
            below, siblings = self.digests[level], []
            for k in range(FANOUT - 1):
                other = place - slot + k + (slot <= k)
                siblings.append(below[:, np.minimum(other, below.shape[1] - 1)])
            yield live, slot, kids, state, siblings
            local = local // FANOUT


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stored subtrees in slabs of about SLAB leaves."""
    for batch in batches:
        at, ends = 0, np.cumsum(batch.column("leaves").to_numpy())
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right")))
            yield pa.Table.from_batches([batch.slice(at, end - at)])
            at = end


def _paths(most: int):
    """(tree, idx, path, subroot) of every node that a subtree of an upper round stands on."""
    def listed(batches):
        for table in _few(batches):
            opened = Opened.of(table, most)
            parts: list[list[bytes]] = [[] for _ in opened.group]
            for live, slot, kids, state, siblings in opened.steps():
                shown = np.zeros((len(live), STEP), np.uint8)
                shown[:, 0], shown[:, 1] = slot, kids
                for k, x in enumerate((state, *siblings)):
                    shown[:, 2 + 32 * k:34 + 32 * k] = np.frombuffer(raw(x), np.uint8).reshape(-1, 32)
                for leaf, step in zip(live.tolist(), shown):
                    parts[leaf].append(step.tobytes())
            above, group = table.column("path").to_pylist(), opened.group.tolist()
            rows = pa.array(opened.group)
            first = table.column("chunk").to_numpy()[opened.group] * FANOUT ** most
            yield pa.RecordBatch.from_arrays([
                table.column("tree").combine_chunks().take(rows), pa.array(first + opened.local),
                pa.array([b"".join(p) + above[g] for p, g in zip(parts, group)], pa.binary()), table.column("subroot").combine_chunks().take(rows),
            ], ["tree", "idx", "path", "subroot"])
    return listed


def _folded(root: bytes, most: int):
    """Result rows of the leaves of stored subtrees, given each subtree's path to the root."""
    def folded(batches):
        for table in _few(batches):
            opened = Opened.of(table, most)
            n = len(opened.group)
            value, proof, siblings_seen = words(_binary(table.column("replaced"))), start(n), np.zeros(n, np.int64)

            def climb(at, slot, kids, state, siblings):
                """One level up for the rows ``at``: resume with the value and right siblings only; the proof takes all."""
                state = resume(state, value[:, at], np.ones(len(at), bool))
                hashed = proof[:, at]
                for k, sibling in enumerate(siblings):
                    there = kids > k + 1
                    state = resume(state, sibling, there & (slot <= k))
                    hashed = resume(hashed, sibling, there)
                    siblings_seen[at] += there
                value[:, at], proof[:, at] = finish(state, kids), hashed

            for step in opened.steps():
                climb(*step)
            paths = table.column("path").to_pylist()
            for level in range(max(map(len, paths), default=0) // STEP):
                have = np.array([len(p) > STEP * level for p in paths])
                at = np.flatnonzero(have[opened.group])
                shown = np.frombuffer(b"".join(p[STEP * level:STEP * level + STEP].ljust(STEP, b"\0") for p in paths), np.uint8).reshape(-1, STEP)[opened.group[at]]
                state, *siblings = (words(shown[:, 2 + 32 * k:34 + 32 * k].tobytes()) for k in range(FANOUT))
                climb(at, shown[:, 0].astype(np.int64), shown[:, 1].astype(np.int64), state, siblings)
            subroots, final = [s.hex() for s in table.column("subroot").to_pylist()], words(root)
            yield pa.RecordBatch.from_arrays([
                table.column("doc_ids").combine_chunks().flatten(), hexes(opened.digests[0]), pa.array(subroots, pa.string()).take(pa.array(opened.group)),
                pa.array([root.hex()] * n, pa.string()), hexes(finish(proof, siblings_seen)), hexes(value), pa.array((value == final).all(axis=0)),
            ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return folded


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of fields as ``-`` for null, else byte count, colon and value, one after another."""
    shown = []
    for field in fields:
        text = field.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*shown), 256))


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (tree, …) with idx, their number inside the tree from 0 by ``order``, and size, the tree's rows.

    Rows are dealt into sorted ranges by tree and order, whatever a tree's share; a range's first
    number follows from the counts of the ranges before, one row per range and tree.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "merkle-ranges").withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    starts = counts.select("tree", "_part", (F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(whole).alias("size"))
    return ranged.join(starts, ["tree", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _grow(rows: DataFrame, folder: str, most: int, carried: bool = False) -> list[DataFrame]:
    """Stored subtrees of all trees of rows (tree, idx, size, digest), one table per round."""
    form = "tree string, chunk long, size long, leaves int, digests binary, states binary, top binary"
    rounds: list[DataFrame] = []
    subtree = FANOUT ** most
    while True:
        dealt = rows.withColumn("chunk", F.expr(f"idx div {subtree}"))
        dealt = dealt.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")
        first = carried and not rounds
        path = f"{folder}/round-{len(rounds)}"
        shape = form + (", doc_ids array<long>, replaced binary" if first else "")
        dealt.select("tree", "chunk", "size", "digest", *(("doc_id", "replaced") if first else ())).mapInArrow(_subtrees(first, most), shape).write.parquet(path)
        rounds.append(rows.sparkSession.read.schema(shape).parquet(path))
        rows = rounds[-1].where(F.col("size") > subtree).select("tree", F.col("chunk").alias("idx"), F.expr(f"(size + {subtree - 1}) div {subtree} AS size"), F.col("top").alias("digest"))
        if rows.isEmpty():
            return rounds


def _done(rounds: list[DataFrame], most: int) -> DataFrame:
    """(tree, subroot) of all trees."""
    out = None
    for stored in rounds:
        found = stored.where(F.col("size") <= FANOUT ** most).select("tree", F.col("top").alias("subroot"))
        out = found if out is None else out.unionByName(found)
    return out


def _above(rounds: list[DataFrame], beyond: DataFrame, most: int) -> DataFrame:
    """(tree, chunk, path, subroot) of the subtrees of the first round; ``beyond`` holds (tree, path, subroot)."""
    upper = None
    for number in range(len(rounds) - 1, -1, -1):
        stored = rounds[number]
        here = stored.where(F.col("size") <= FANOUT ** most).select("tree", "chunk").join(beyond, "tree")
        if upper is not None:
            here = here.unionByName(upper)
        if not number:
            return here
        nodes = stored.select("tree", "chunk", "size", "leaves", "digests", "states").join(here, ["tree", "chunk"])
        upper = nodes.mapInArrow(_paths(most), "tree string, idx long, path binary, subroot binary").withColumnRenamed("idx", "chunk")
    return upper


@dataclass
class Manifest:
    """Stored subtrees of the sources' trees and of the tree over the sources; root is None without rows."""

    trees: list[DataFrame]
    sources: list[DataFrame]
    places: DataFrame
    root: bytes | None
    levels: int = LEVELS


def write_manifest(docs: DataFrame, path: str, replaced: Column | None = None, source: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, text: str = "text",
                   levels: int = LEVELS) -> Manifest:
    """Write the manifest of docs under ``path``: one tree per source over its rows by ``order``, and one over the sources.

    ``replaced`` is the text to fold instead of the stored one (null where it is null). Rows are
    ordered by ``order``, null first, then by leaf, so repeated rows stay apart and rows that are
    equal throughout are interchangeable. A null source is a tree of its own and comes first. Only
    the named columns are read. Without rows there are no trees and no root.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    columns = [F.col(f) for f in fields]
    changed = [(F.col(f) if replaced is None or f != text else replaced) for f in fields]
    leaves = docs.select(key.alias("tree"), F.col(order).cast("long").alias("doc_id"), leaf_digest(columns).alias("digest"), leaf_digest(changed).alias("replaced"))
    trees = _grow(_placed(materialize(leaves, "merkle-leaves"), ["doc_id", "digest", "replaced"]), f"{path}/trees", levels, carried=True)
    places = materialize(_placed(_done(trees, levels).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("digest")), ["source"]), "merkle-sources")
    sources = _grow(places.select("tree", "idx", "size", "digest"), f"{path}/sources", levels)
    top = _done(sources, levels).first()
    return Manifest(trees, sources, places, bytes(top["subroot"]) if top else None, levels)


def fold(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of the manifest.

    Inside a subtree and along its path upwards, a row's replacement resumes the state kept before
    its slot. Without rows the result is empty.
    """
    shape = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return manifest.places.sparkSession.createDataFrame([], shape)
    beyond = _above(manifest.sources, manifest.sources[0].select("tree", F.lit(b"").alias("path"), F.lit(manifest.root).alias("subroot")).distinct(), manifest.levels)
    stored = manifest.sources[0].join(beyond, ["tree", "chunk"])
    steps = stored.mapInArrow(_paths(manifest.levels), "tree string, idx long, path binary, subroot binary").select("idx", "path")
    by_source = manifest.places.join(steps, "idx").select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"))
    leaves = manifest.trees[0].join(_above(manifest.trees, by_source, manifest.levels), ["tree", "chunk"])
    return leaves.select("size", "leaves", "digests", "states", "doc_ids", "replaced", "path", "subroot").mapInArrow(_folded(manifest.root, manifest.levels), shape)


def tampered_fold(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of docs, folded with texts whose newlines are gone wherever 2 divides crc32 of the decimal doc_id.

    Rows without a doc_id are not tampered with.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    replaced = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    folder = f"{checkpoint_root(docs.sparkSession)}/fieldframe/manifest-{uuid.uuid4().hex}"
    return fold(write_manifest(docs, folder, replaced, levels=levels))


_LEAF = "sha256(concat({}))"
_SHOWN = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_NODE = _LEAF.format(", ".join(_SHOWN.format(f) for f in FIELDS))
_TAMPERED = _LEAF.format(", ".join(_SHOWN.format(f if f != "text" else "(CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END)") for f in FIELDS))
ORACLE = f"""
WITH RECURSIVE
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS row_id,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 2 = 0, false) AS hit
  FROM documents),
leaves AS (
  SELECT row_id, doc_id, source, {_NODE} AS h, {_TAMPERED} AS t,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, row_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM numbered),
nodes AS (
  SELECT source, 0 AS level, i, h, n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
roots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, i, h, n FROM roots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY level, i // 3, n),
walk AS (
  SELECT row_id, source, 0 AS level, i, n, t AS value, '' AS proof FROM leaves
  UNION ALL
  SELECT w.row_id, w.source, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN s.i = w.i THEN w.value ELSE s.h END, '' ORDER BY s.i)),
    w.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i <> w.i), '')
  FROM walk w JOIN nodes s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.i // 3 = w.i // 3
  WHERE w.n > 1 GROUP BY w.row_id, w.source, w.level, w.i, w.n, w.value, w.proof),
upper_walk AS (
  SELECT w.row_id, 0 AS level, r.i, r.n, w.value, w.proof FROM walk w JOIN roots r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT w.row_id, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN s.i = w.i THEN w.value ELSE s.h END, '' ORDER BY s.i)),
    w.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i <> w.i), '')
  FROM upper_walk w JOIN upper_nodes s ON s.level = w.level AND s.i // 3 = w.i // 3
  WHERE w.n > 1 GROUP BY w.row_id, w.level, w.i, w.n, w.value, w.proof)
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, u.h AS root, sha256(w.proof) AS proof_sha256, w.value AS folded_root, w.value = u.h AS verified
FROM leaves l JOIN roots r ON r.source IS NOT DISTINCT FROM l.source JOIN upper_nodes u ON u.n = 1 JOIN upper_walk w ON w.row_id = l.row_id AND w.n = 1
"""
