"""Similarity join of word-shingle sets with signature trees.

Stages: (1) every text becomes its set of distinct shingles; equal sets are one class. (2) Blocks:
the hash space is cut into one segment more than a pair at the threshold can have differing
shingles, so a linked pair agrees on a whole segment, and with some spare segments on several. Pairs
of classes that share as many segment hashes as a linked pair must, and whose sizes and parity
sketches do not rule a link out, fall into one block. In a hot hash, one of more than ``PAIRED``
classes, pairs are not counted: a pair needs as many hashes less as its classes have hot ones, and
only classes with so many hot ones that a pair may share no other meet by those, the rarest of them,
and are linked there if sizes and sketches allow it. (3) A block's classes form signature trees,
whose nodes hold OR-combined token bitmaps and size ranges; a dual traversal drops node pairs whose largest possible overlap is too small, and
the sets of the surviving leaves are compared exactly. A block over the size limit is dealt out in
chunks: neighbouring chunks first, then only what is not yet in the block's main component is
compared with the rest, so links that only repeat a known connection are not computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.batches import longs, runs
from fieldframe.llm.graph import Forest, components, spanning
from fieldframe.llm.words import STEPS, mix, shingle_sets
from fieldframe.session import materialize

BITS = 4096
FAN = 8
CHUNK_SETS, CHUNK_TOKENS = 1024, 1 << 20
FILTER_BITS = 1 << 23
SPARE_PERCENT = 6
PAIRED = 32  # most classes of one segment hash whose pairs are counted
HOT_CHUNK = 8192  # classes of one hot hash that meet in one task
MET = 1 << 18  # pairs of classes whose sketches are compared at once
SKETCH_WORDS = 8  # 64-bit words of a set's parity sketch
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least common size of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def size_classes(largest: int, percent: int) -> list[tuple[int, int]]:
    """Ranges of sizes; linked sets lie in the same range or in neighbouring ones."""
    ranges, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        ranges.append((low, high))
        low = high + 1
    return ranges


class Segments:
    """Segment hashes of a set, for the size ranges in which it may meet a partner."""

    def __init__(self, percent: int):
        self.percent, self.ranges, self.edges = percent, [], {}

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.filed(tokens)[0]

    def filed(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and beside each how many hashes a linked partner shares at least (at most 127); the smaller of both sets' holds for a pair."""
        n = len(tokens)
        if not self.ranges or self.ranges[-1][1] < n:
            self.ranges = size_classes(2 * n, self.percent)
        k = next(k for k, (_, high) in enumerate(self.ranges) if n <= high) if n < 64 else int(np.searchsorted([r[1] for r in self.ranges], n))
        sums = None
        out, least = [], []
        for c in (k, k - 1):
            if c < 0:
                continue
            high = self.ranges[c][1]
            most = high * 100 // self.percent
            parts = (high + most) * (100 - self.percent) // (100 + self.percent) + 1
            if parts < 2 or n > most:
                continue
            # with some segments more, a linked pair agrees on more of them than a usual set has empty
            # ones, so only sets with more empty segments than that are filed under empty ones
            spare = parts * SPARE_PERCENT // 100 + 3
            parts += spare
            if sums is None:
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens))))
            if parts not in self.edges:
                self.edges[parts] = np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)
            cut = np.concatenate(([0], np.searchsorted(tokens, self.edges[parts]), [n]))
            codes = mix((sums[cut[1:]] - sums[cut[:-1]]) * STEPS[2] + np.uint64(c << 32) + np.arange(parts, dtype=np.uint64))
            filled = cut[1:] > cut[:-1]
            empty = parts - int(filled.sum())
            out.append(codes[filled] if empty <= spare else codes)
            # a linked pair agrees on spare + 1 segments; empty ones are filed by neither, or by both, or by one of them
            least.append(np.full(len(out[-1]), min(127, 1 + spare - empty) if empty <= spare else 1, np.int8))
        return (np.concatenate(out), np.concatenate(least)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int8))


def set_hash(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens ^ STEPS[1]).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """64-bit words whose bits flip with every token; two sets differ in at least as many tokens as their sketches in bits."""
    flips = np.bincount(((tokens >> np.uint64(20)) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((flips & 1).astype(bool)).view(np.uint64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[(tokens >> np.uint64(17)).astype(np.int64) % BITS] = True
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    """Levels of nodes over sets sorted by size: bitmap, least and largest size, most bit collisions."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        self.order = np.argsort(sizes, kind="stable")
        self.sets = [sets[i] for i in self.order]
        maps = np.array([bitmap(s) for s in self.sets])
        low = high = sizes[self.order]
        extra = high - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, low, high, extra)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, extra = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def pairs(self, percent: int, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of leaf pairs (a < b) that no node pair above them rules out."""
        frontier = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while frontier:
            level, a, b = frontier.pop()
            if len(a) > 1 << 14:
                half = len(a) // 2
                frontier += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            maps, low, high, extra = self.levels[level]
            if not level:
                known = forest.settle()
                new = known[a] != known[b]
                a, b = a[new], b[new]
            fits = (percent * high[b] <= 100 * high[a]) if not level else (percent * low[b] <= 100 * high[a]) & (percent * low[a] <= 100 * high[b])
            a, b = a[fits], b[fits]
            most = np.bitwise_count(maps[a] & maps[b]).sum(axis=1) + np.minimum(extra[a], extra[b])
            able = np.minimum(most, np.minimum(high[a], high[b])) >= overlap_needed(low[a], low[b], percent)
            a, b = a[able], b[able]
            if not level:
                if len(a):
                    yield a, b
                continue
            below = len(self.levels[level - 1][0])
            x = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), int)
            y = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), int)
            keep = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
            x, y = x[keep], y[keep]
            if len(x):
                frontier.append((level - 1, x, y))


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (positions) that connect the same positions as all links of the sets do."""
    tree, forest, found = SignatureTree(sets), Forest(len(sets)), []
    for a, b in tree.pairs(percent, forest):
        while len(a):
            for x, y in zip(a[:256].tolist(), b[:256].tolist()):
                if forest.root(x) == forest.root(y):
                    continue
                s, t = tree.sets[x], tree.sets[y]
                at = np.searchsorted(t, s)
                at[at == len(t)] = len(t) - 1
                both = int((t[at] == s).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    forest.union(x, y)
                    found.append((int(tree.order[x]), int(tree.order[y])))
            a, b = a[256:], b[256:]
            known = forest.settle()
            new = known[a] != known[b]
            a, b = a[new], b[new]
    return found


def _classes(words: int):
    def of(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int32)
            marks = np.zeros(batch.num_rows, np.int64)
            sketches = np.zeros((batch.num_rows, SKETCH_WORDS), np.uint64)
            for row, tokens in shingle_sets(batch.column("text"), words):
                if len(tokens):
                    sizes[row], marks[row], sketches[row] = len(tokens), set_hash(tokens), parity_sketch(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(marks), *(longs(x) for x in sketches.T)], ["id", "n", "cls", *SKETCH])
    return of


def _segments(words: int, percent: int):
    def of(batches):
        cut = Segments(percent)
        for batch in batches:
            seen, found, marks = set(), [], []
            for _, tokens in shingle_sets(batch.column("text"), words):
                if not len(tokens) or (mark := set_hash(tokens)) in seen:
                    continue
                seen.add(mark)
                found.append(cut.filed(tokens))
                marks.append(mark)
            if found:
                codes, least = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([
                    longs(codes), pa.array(np.repeat(np.array(marks, np.int64), [len(x) for x, _ in found])), pa.array(least)], ["seg", "cls", "least"])
    return of


def _near(limit: int, by_hash: bool = False):
    """Pairs (u, v, least) of the classes of each segment hash; over ``limit`` classes, each with the first and least 0.

    Rows come by hash and class, without a hash's first class, which stands in every row as v. With
    ``by_hash`` each class of a hash over the limit, the first too, comes with the hash and -1 - least;
    rows may repeat.
    """
    def pairs(seg, cls, least, v, of_v, large):
        """Pairs of whole hashes, and stars of those with more rows or in ``large``."""
        at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        sizes = np.diff(at, append=len(seg))
        many = (sizes >= limit) | np.isin(seg[at], large)
        star = np.repeat(many, sizes)
        if by_hash:
            first = at[many]
            found = [(cls[star], seg[star], -1 - least[star]), (v[first], seg[first], -1 - of_v[first])]
        else:
            found = [(cls[star], v[star], np.zeros(int(star.sum()), np.int8))]
        for size in np.unique(sizes[~many]):
            first = at[~many & (sizes == size)]
            rows = first[:, None] + np.arange(size)
            group = np.concatenate((v[first][:, None], cls[rows]), axis=1)
            needed = np.concatenate((of_v[first][:, None], least[rows]), axis=1)
            a, b = np.triu_indices(size + 1, 1)
            found.append((group[:, b].ravel(), group[:, a].ravel(), np.minimum(needed[:, a], needed[:, b]).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v", "least"])

    def of(batches):
        held, large = None, []  # rows of a hash that may go on, or that hash once its pairs are not counted
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("seg", "cls", "least", "v", "of_v")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            seg, cls = rows[:2]
            once = np.concatenate(([True], (seg[1:] != seg[:-1]) | (cls[1:] != cls[:-1])))
            rows = [x[once] for x in rows]
            seg = rows[0]
            last = len(seg) - int((seg == seg[-1]).sum())
            if len(seg) - last >= limit or seg[-1] in large:
                yield pairs(*rows, [*large, seg[-1]])
                held, large = None, [seg[-1]]
                continue
            if last:
                yield pairs(*(x[:last] for x in rows), large)
            held, large = [x[last:] for x in rows], []
        if held is not None:
            yield pairs(*held, large)
    return of


def _chosen_sets(words: int, chosen):
    def of(batches):
        bits = np.unpackbits(np.frombuffer(chosen.value, np.uint8), bitorder="little")
        for batch in batches:
            seen, marks, sets = set(), [], []
            for _, tokens in shingle_sets(batch.column("text"), words):
                if not len(tokens):
                    continue
                mark = set_hash(tokens)
                if mark in seen or not bits[mark % FILTER_BITS]:
                    continue
                seen.add(mark)
                marks.append(mark)
                sets.append(tokens.tobytes())
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sets, pa.binary())], ["cls", "tokens"])
    return of


def _links(percent: int):
    def of(batches):
        for part in runs(batches, "task"):
            marks = part.column("cls").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("tokens")]
            if len(marks) > 1 and (found := linked(sets, percent)):
                u, v = marks[np.array(found).T]
                if part.column("whole")[0].as_py():  # all of a block: its links are complete
                    u, v = spanning(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array([part.column("whole")[0].as_py()] * len(u))], ["u", "v", "whole"])
    return of


def _bit_filter(nodes: DataFrame) -> bytes:
    """A bitmap of fixed size with every node's bit set; it only spares work, a wrong hit is dropped by the join."""
    bit = F.pmod("node", F.lit(FILTER_BITS))
    words = nodes.groupBy(F.floor(bit / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(node, 32)))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, "<u4")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.tobytes()


def _written(table: DataFrame, label: str) -> DataFrame:
    """materialize(); then Spark may drop the shuffle files behind it, which it only does when the driver collects garbage."""
    out = materialize(table, label)
    del table
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def _able(u, v, percent: int):
    """Whether sizes and sketches of two classes allow a link; ``u`` and ``v`` give the columns of either by name."""
    near = percent * F.greatest(u("n"), v("n")) <= 100 * F.least(u("n"), v("n"))
    differ = sum(F.bit_count(u(c).bitwiseXOR(v(c))).cast("long") for c in SKETCH)
    return near & ((100 + percent) * differ <= (100 - percent) * (u("n") + v("n")))


def _met(percent: int):
    """Links (u, v) that connect what sizes and sketches let the ``rest`` of a task's classes link with all of them."""
    def of(batches):
        for part in runs(batches, "task"):
            cls, n = part.column("cls").to_numpy(), part.column("n").to_numpy()
            sketch = np.stack([part.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1)
            u = v = np.zeros(0, np.int64)
            rest = np.flatnonzero(part.column("rest").to_numpy())
            for rows in np.array_split(rest, -(-len(rest) * len(cls) // MET)):
                a, b = np.nonzero(percent * np.maximum.outer(n[rows], n) <= 100 * np.minimum.outer(n[rows], n))
                a = rows[a]
                differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
                able = ((100 + percent) * differ <= (100 - percent) * (n[a] + n[b])) & (a != b)
                if able.any():
                    u, v = spanning(np.concatenate((u, cls[a[able]])), np.concatenate((v, cls[b[able]])))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    return of


def _hot_links(kept: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect the classes of each hash whose sizes and sketches allow a link; of (seg, cls, n, sketch).

    The first class of a hash takes all that it may link with; only what it leaves meets all others.
    """
    kept = materialize(kept, "kept")
    first = kept.groupBy("seg").agg(F.min(F.struct("cls", "n", *SKETCH)).alias("v"), F.count(F.lit(1)).alias("many")).where("many > 1")
    near = kept.join(first, "seg").withColumn("rest", ~_able(F.col, lambda c: F.col(f"v.{c}"), percent))
    left = near.where("rest").groupBy("seg").agg(F.ceil(F.count(F.lit(1)) / HOT_CHUNK).alias("parts"))
    to = F.xxhash64("cls")
    chunks = F.ceil(F.col("many") / HOT_CHUNK)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_all = F.transform(numbers(F.col("parts")), lambda p: F.struct(p.alias("part"), F.pmod(to, chunks).alias("chunk")))
    as_rest = F.transform(numbers(chunks), lambda c: F.struct(F.pmod(to, F.col("parts")).alias("part"), c.alias("chunk")))
    tasks = F.when(F.col("rest"), F.array_union(as_rest, as_all)).otherwise(as_all)
    dealt = near.join(left, "seg").withColumn("at", F.explode(tasks)).select(F.xxhash64("seg", "at.part", "at.chunk").alias("task"), "cls", "n", "rest", *SKETCH)
    more = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_met(percent), "u long, v long")
    return near.where("not rest").select(F.col("cls").alias("u"), F.col("v.cls").alias("v")).union(more).where("u <> v")


def _candidates(counted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect every linked pair of ``counted`` (u, v, shared, least; least below 0: v is a hot hash of u)."""
    hot = counted.where("least < 0").select(F.col("u").alias("cls"), F.col("v").alias("seg"), (-1 - F.col("least")).alias("needed"))
    of = hot.groupBy("cls").agg(F.count(F.lit(1)).alias("hot"), F.min("needed").alias("needed"))
    sides = classes.where("n > 0").dropDuplicates(["cls"]).withColumn("n", F.col("n").cast("long")).drop("id").join(of.drop("needed"), "cls", "left").fillna(0, ["hot"])
    pairs = counted.where("least >= 0")
    for side in "uv":
        pairs = pairs.join(sides.select(F.col("cls").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "hot", *SKETCH))), side)
    # of the hashes that a linked pair shares at most as many are hot as the one with fewer has
    enough = F.col("shared") >= F.col("least") - F.least("u_hot", "v_hot")
    able = _able(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"), percent)
    # pairs that may share hot hashes only: both have as many as they need, and of those in one order (the hashes
    # with fewest classes first) they share one that is not among the last needed - 1 of either
    order = Window.partitionBy("cls").orderBy("size", "seg")
    sizes = hot.groupBy("seg").agg(F.count(F.lit(1)).alias("size"))
    heavy = hot.select("cls", "seg").join(of.where("hot >= needed"), "cls").join(sizes, "seg").withColumn("at", F.row_number().over(order))
    kept = heavy.where("at <= hot - needed + 1").select("cls", "seg").join(sides.select("cls", "n", *SKETCH), "cls")
    return pairs.where(enough & able).select("u", "v").union(_hot_links(kept, percent).distinct())


def similar_classes(texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes (id, n, cls) of a table (id, text), and (node, root) of the classes that links connect."""
    spark = texts.sparkSession
    classes = materialize(texts.mapInArrow(_classes(words), "id long, n int, cls long, " + ", ".join(f"{c} long" for c in SKETCH)), "classes")
    shared = texts.select("text").mapInArrow(_segments(words, percent), "seg long, cls long, least byte")
    # the running frame needs no group in memory; rows stay in the order of hash and class
    running = Window.partitionBy("seg").orderBy("cls").rowsBetween(Window.unboundedPreceding, 0)
    ordered = shared.withColumns({"v": F.first("cls").over(running), "of_v": F.first("least").over(running)}).where("cls <> v")
    counted = _written(ordered.mapInArrow(_near(PAIRED, by_hash=True), "u long, v long, least byte").groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("shared"), F.min("least").alias("least")), "counted")
    near = _candidates(counted, classes, percent)
    classes = classes.select("id", "n", "cls")
    blocks = _written(components(near), "blocks")
    sizes = classes.select(F.col("cls").alias("node"), "n").distinct()
    measured = blocks.join(sizes, "node").groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    chunks = F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("tokens") / CHUNK_TOKENS))
    member = materialize(blocks.join(measured.select("root", chunks.alias("chunks")), "root").select(
        F.col("node").alias("cls"), "root", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk")), "members")

    def sets(nodes: DataFrame) -> DataFrame:
        """Sets (cls, tokens) of a table (node), read from the texts again: less than what writing them and dealing them twice takes."""
        filter_ = spark.sparkContext.broadcast(_bit_filter(nodes))
        found = texts.select("text").mapInArrow(_chosen_sets(words, filter_), "cls long, tokens binary")
        return found.join(nodes.select(F.col("node").alias("cls")), "cls", "left_semi").groupBy("cls").agg(F.any_value("tokens").alias("tokens"))

    def compare(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
        rows = dealt.join(sets(nodes), "cls").repartition("task").sortWithinPartitions("task")
        return rows.select("task", "whole", "cls", "tokens").mapInArrow(_links(percent), "u long, v long, whole boolean")

    # neighbouring chunks meet in one task; with one or two chunks that is all pairs
    ring = F.when(F.col("chunks") < 3, F.array(F.lit(0).cast("long"))).otherwise(
        F.array(F.col("chunk"), F.pmod(F.col("chunk") + F.col("chunks") - 1, F.col("chunks"))))
    first = member.select("cls", "root", "chunks", F.explode(ring).alias("at")).select(
        "cls", F.xxhash64("root", "at").alias("task"), (F.col("chunks") < 3).alias("whole"))
    found = _written(compare(first, blocks.select("node")), "found")
    done = found.where("whole").select(F.col("u").alias("node"), F.col("v").alias("root"))
    large = member.where("chunks > 2")
    if large.isEmpty():
        return classes, done
    links = found.where("not whole").select("u", "v")
    known = components(links).withColumnRenamed("node", "cls").withColumnRenamed("root", "label")
    large = materialize(large.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "large")
    main = large.groupBy("root", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("label", "k").alias("main"))
    marked = large.join(main, "root").withColumn("rest", F.col("label") != F.col("main"))
    left = marked.where("rest").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).alias("parts"))
    whole = marked.join(left, "root").select("cls", "root", "chunks", "chunk", "rest", "parts")
    as_rest = whole.where("rest").select("cls", "root", F.pmod(F.xxhash64("cls"), "parts").alias("part"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    as_all = whole.select("cls", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "chunk")
    second = as_rest.select("cls", "root", "part", "chunk").union(as_all.select("cls", "root", "part", "chunk")).distinct()
    more = compare(second.select("cls", F.xxhash64("root", "part", "chunk").alias("task"), F.lit(False).alias("whole")), whole.select(F.col("cls").alias("node")))
    return classes, done.union(components(links.union(more.select("u", "v"))))


def ngram_join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    A null, empty or blank text has an empty set: n_shingles 0, linked with nothing, its own
    component. Rows that repeat a doc_id stay apart as rows and share the id. The component of a
    row without doc_id is the smallest id that it reaches, null if none. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    classes, labels = similar_classes(texts, words, percent)
    full = classes.where("n > 0")
    roots = full.select("cls").distinct().join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", F.coalesce("root", "cls").alias("root"))
    rooted = materialize(full.join(roots, "cls").select("id", "n", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    linked_rows = rooted.join(least, "root").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = classes.where("n = 0").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked_rows.union(alone)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when every group of near or exact copies keeps its smallest doc_id.

    Of rows that repeat doc_id and text one stays; an id whose rows differ in text goes only if each
    of its texts has a smaller id in its group. Rows without doc_id or without words stay.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    classes, labels = similar_classes(texts, words, percent)
    roots = labels.withColumnRenamed("node", "cls")
    rooted = classes.where("n > 0 and id is not null").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    gone = rooted.join(least, "root").groupBy("id").agg(F.min(F.col("id") - F.col("least")).alias("above")).where("above > 0")
    again = classes.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = materialize(gone.select(F.col("id").alias("doc_id")), "gone")
    twice = materialize(again.select(F.col("id").alias("doc_id")), "twice")
    once = docs.join(out.union(twice), "doc_id", "left_anti")
    if twice.isEmpty():
        return once.select(*docs.columns)
    one = docs.join(twice, "doc_id", "left_semi").join(out, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).union(one.select(*docs.columns))
