"""Language-model scores from a weighted backoff automaton.

States are the root, words and word pairs; arcs are smoothed n-grams, and where a state has no arc for
a word, a failure arc with its weight leads to the state of the shorter history. All words are states,
and every pair and triple seen twice or more in the training texts is an arc, so the automaton grows
with the corpus. It lies in tables dealt out by ranges of hashed keys, one row of packed columns for each
range, and all that meets in a range (counts, questions, answers) comes in such rows too. A path's log
probability is a sum over the text's words, pairs and triples: each n-gram carries the log of its arc,
less that of the path it replaces, and the failure weight of the state it leads to. So a text needs only
the values of its n-grams. The most frequent values are broadcast, a bit filter keeps back n-grams the
tables do not hold, and the ranges answer for all others with sums for each text. What is broadcast
changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.batches import longs, trim
from fieldframe.llm.words import BASE, STEPS, mix, text_slices, unmix, word_hashes
from fieldframe.session import discard, materialize

# a table that is broadcast lies on the disks of the driver and of every executor, so it is kept small
WORD_SHARE = 2e-6  # of all tokens: words that are broadcast, at most 500,000; the others are joined
HOT_ARCS = 1 << 19  # most pairs and triples that are broadcast; the others are joined
ARC_SHARE = 0.0  # of all tokens that an arc must have; 0: two occurrences at any size of the corpus
FILTER_WORDS = 1 << 21  # 64-bit words of a bit filter
DISCOUNT = 0.75
END = mix(np.array([0xE0D], np.uint64))[0]
# what a Python worker holds at once; it stands beside an executor's JVM
BUFFER = 1 << 20  # n-grams that a task holds before it packs them
TEXT_BYTES = 1 << 20  # of a batch's texts that are cut into words at a time
RANGE_TOKENS = 1 << 22  # tokens for each range of keys, about, at most


def held_out(doc_id: Column) -> Column:
    """Rows that are scored but not learned; rows without doc_id are learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class Lookup:
    """Positions of 64-bit keys in a table, -1 for others, by the keys' leading mixed bits."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys.astype(np.uint64))
        self.order = np.argsort(mixed).astype(np.int32)
        self.sorted = mixed[self.order]
        self.shift = np.uint64(64 - max(4, len(keys).bit_length()))
        slots = (self.sorted >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        mixed = mix(keys.astype(np.uint64))
        slot = (mixed >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            hit = self.sorted[at] == mixed[open_]
            out[open_[hit]] = self.order[at[hit]]
            at = at + 1
            go = ~hit & (at < end[open_])
            open_, at = open_[go], at[go]
        return out


def token_runs(column: pa.Array):
    """(first row, end row, token hashes with every text's end, first token of every row and the total)."""
    for first, end, data, bounds in text_slices(column, TEXT_BYTES):
        words, at = word_hashes(data, bounds)
        starts = at + np.arange(len(at))
        tokens = np.full(starts[-1], END, np.uint64)
        keep = np.ones(len(tokens), bool)
        keep[starts[1:] - 1] = False
        tokens[keep] = words
        yield first, end, tokens, starts


def pair_ids(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit key of each pair of words (x, y)."""
    return mix(x * BASE + y)


def triple_ids(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit key of each triple by the keys of its first and its last pair."""
    return mix(x * STEPS[0] + y)


def first_of(ids: np.ndarray, y: np.ndarray, step: np.uint64) -> np.ndarray:
    """x of the pairs (step BASE) or triples (step STEPS[0]) with these keys and y."""
    return (unmix(ids) - y) * np.uint64(pow(int(step), -1, 1 << 64))


def pairs_of(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word) of every token; before a text's first word stands END."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = END
    return before, tokens


def triples_of(pairs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pair, last pair, token) of every triple by its pairs' keys; a text's first token ends none."""
    inner = np.ones(len(pairs), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    return pairs[at - 1], pairs[at], at


class KeyFilter:
    """Bits of a set of keys, two for each: tells keys that are not in it, and few others are let through."""

    def __init__(self, table: DataFrame, least: dict[int, float] | None = None):
        """table: ranges; least: by kind, keys with that count are left out."""
        shift, size = 64 - (FILTER_WORDS.bit_length() - 1), FILTER_WORDS

        def bits(batches):
            # a range's keys have neighbouring words of the filter
            for row in _rows(batches):
                keys = row.keys()
                if least:
                    keys = keys[row.ints("b") < least[row.kind]]
                if len(keys):
                    at, low = (keys >> np.uint64(shift)).astype(np.int64), np.uint64(63)
                    own = (np.uint64(1) << (keys & low)) | (np.uint64(1) << ((keys >> np.uint64(6)) & low))
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    words = np.zeros(at[-1] - at[0] + 1, np.uint64)
                    words[at[first] - at[0]] = np.bitwise_or.reduceat(own, first)
                    yield pa.RecordBatch.from_pydict({"at": pa.array([at[0]], pa.int64()), "bits": pa.array([words.tobytes()], pa.binary())})

        self.shift, self.bits = np.uint64(shift), np.zeros(size, np.uint64)
        for at, words in zip(*(c.to_pylist() for c in table.mapInArrow(bits, "at long, bits binary").toArrow().columns)):
            self.bits[at:at + len(words) // 8] |= np.frombuffer(words, np.uint64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        low = np.uint64(63)
        bits = self.bits[(keys >> self.shift).astype(np.int64)]
        return ((bits >> (keys & low)) & (bits >> ((keys >> np.uint64(6)) & low)) & np.uint64(1)).astype(bool)


def _written(table: DataFrame, label: str) -> DataFrame:
    """materialize(); then Spark may drop the shuffle files behind it, which it only does when the driver collects garbage."""
    out = materialize(table, label)
    del table
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def _planes(values: np.ndarray) -> bytes:
    """The byte planes of 64-bit values that are in use."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    top = int(values.view(np.uint64).max(initial=0)).bit_length()
    return planes[:, :(top + 7) // 8].T.tobytes()


def _of_planes(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    if n:
        planes[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return planes.reshape(-1).view(np.uint64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the byte planes of their differences."""
    return keys[:1].tobytes() + _planes(np.diff(keys))


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    first = np.frombuffer(data[:8], np.uint64)
    return np.cumsum(np.concatenate((first, _of_planes(data[8:], max(n - 1, 0)))), dtype=np.uint64)


def _packed(keys: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys, and places beside them."""
    return _packed_keys(keys), _planes(places.astype(np.int64))


def _unpacked(keys: bytes, places: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked_keys(keys, n), _of_planes(places, n).view(np.int64)


# one row for a range of keys (part) or for what part src sends to it: n sorted keys a, integers b, 64-bit values c, d and e beside them
RANGE = "part int, kind int, src int, n long, total long, a binary, b binary, c binary, d binary, e binary"
RANGE_SCHEMA = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in RANGE.split(", ")])
WORD, PAIR, TRIPLE, QUESTION, ANSWER, SUMS, REPLY = range(7)


class _Row:
    """A row of RANGE with its columns unpacked when they are asked for."""

    def __init__(self, row: dict):
        self.row, self.part, self.kind, self.src, self.n = row, row["part"], row["kind"], row.get("src"), row["n"]

    def keys(self) -> np.ndarray:
        return _unpacked_keys(self.row["a"], self.n)

    def ints(self, column: str) -> np.ndarray:
        return _of_planes(self.row[column], self.n).view(np.int64)

    def values(self, column: str, kind=np.float64) -> np.ndarray:
        return np.frombuffer(self.row[column], kind)


def _rows(batches) -> Iterator[_Row]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Row({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})


def _range(part: int, kind: int, n: int, src: int = 0, total: int = 0, **columns) -> dict:
    return {"part": part, "kind": kind, "src": src, "n": n, "total": total, **columns}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, RANGE_SCHEMA)


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, its slice) of sorted keys."""
    cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
    for part in np.flatnonzero(np.diff(cuts)):
        yield int(part), slice(int(cuts[part]), int(cuts[part + 1]))


def _summed(keys: np.ndarray, counts: np.ndarray | None, last: np.ndarray | None) -> tuple:
    """(sorted distinct keys, their counts, last of each)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(keys)) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts
    return keys[first], n, None if last is None else last[order[first]]


def _buffered(batches, bits: int, part) -> Iterator[pa.RecordBatch]:
    """Counts of what ``part`` gives for token runs, [(kind, keys, last or None)], in buffers of bounded size, by ranges."""
    held: list[list] = []
    size = 0

    def counted():
        for kind, column in enumerate(zip(*held)):
            kind = column[0][0]
            keys, n, last = _summed(np.concatenate([c[1] for c in column]), None, None if column[0][2] is None else np.concatenate([c[2] for c in column]))
            for some in batched(_slices(keys, bits), 16):
                yield from _table([_range(p, kind, s.stop - s.start, a=_packed_keys(keys[s]), b=_planes(n[s]), c=None if last is None else last[s].tobytes()) for p, s in some]).to_batches()

    for batch in batches:
        for _, _, tokens, starts in token_runs(batch.column("text")):
            held.append(part(tokens, starts))
            size += len(tokens)
            if size >= BUFFER:
                yield from counted()
                held, size = [], 0
    if size:
        yield from counted()
    held = []
    trim()


def _totals(least: int):
    """Of a range: each kind's counts summed; pairs and triples seen that often stay."""
    def summed(table: pa.Table) -> pa.Table:
        rows, out = list(_rows(table.to_batches())), []
        for kind in sorted({r.kind for r in rows}):
            own = [r for r in rows if r.kind == kind]
            part = own[0].part
            keys, n, last = _summed(np.concatenate([r.keys() for r in own]), np.concatenate([r.ints("b") for r in own]), None if kind == WORD else np.concatenate([r.values("c", np.uint64) for r in own]))
            if kind != WORD:
                keep = n >= least
                keys, n, last = keys[keep], n[keep], last[keep]
            if len(keys):
                out.append(_range(part, kind, len(keys), total=int(n.sum()), a=_packed_keys(keys), b=_planes(n), c=None if last is None else last.tobytes()))
        return _table(out)
    return summed


def _met(one: DataFrame, other: DataFrame, function) -> DataFrame:
    """What function makes of the rows of each range."""
    return one.unionByName(other).groupBy("part").applyInArrow(function, RANGE)


def _of_kind(table: pa.Table) -> dict[int, list[_Row]]:
    out: dict[int, list[_Row]] = {}
    for row in sorted(_rows(table.to_batches()), key=lambda r: (r.kind, r.src)):
        out.setdefault(row.kind, []).append(row)
    return out


def _weighted(arcs: DataFrame, lower: DataFrame, kind: int, step: np.uint64, size: float, bits: int, least: float, labels: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    """(arcs with their probability d and value e, lower with its value d, failure weight included).

    ``arcs`` are pairs over words or triples over pairs, with the key c of the word or pair they end in; the
    state they leave is the first. Each range asks once for every such key that its arcs have, and sends one
    sum for every state, so frequent words weigh no more than others.
    """
    def own(row: _Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, last = row.keys(), row.ints("b"), row.values("c", np.uint64)
        keep = n >= least
        return (keys, n, last) if keep.all() else (keys[keep], n[keep], last[keep])

    def ask(batches):
        for row in _rows(batches):
            want = np.unique(own(row)[2])
            for part, s in _slices(want, bits):
                yield from _table([_range(part, QUESTION, s.stop - s.start, row.part, a=_packed_keys(want[s]))]).to_batches()

    def shares(row: _Row) -> np.ndarray:
        return (row.ints("b") + 1) / size if row.kind == WORD else row.values("d")

    def answer(table: pa.Table) -> pa.Table:
        rows = _of_kind(table)
        if QUESTION not in rows:
            return _table([])
        (held,) = rows[kind - 1]
        keys, p = held.keys(), shares(held)
        return _table([_range(r.src, ANSWER, r.n, held.part, d=p[np.searchsorted(keys, r.keys())].tobytes()) for r in rows[QUESTION]])

    def gather(table: pa.Table) -> pa.Table:
        rows = _of_kind(table)
        if ANSWER not in rows:
            return _table([])
        (row,) = rows[kind]
        keys, n, last = own(row)
        below = np.concatenate([r.values("d") for r in rows[ANSWER]])[np.unique(last, return_inverse=True)[1]]
        states, at = np.unique(first_of(keys, last, step), return_inverse=True)
        mass, left = np.bincount(at, n - DISCOUNT), np.bincount(at, below)
        out = [_range(row.part, kind, len(keys), a=_packed_keys(keys), b=_planes(n), c=last.tobytes(), d=below.tobytes())]
        return _table(out + [_range(p, SUMS, s.stop - s.start, row.part, a=_packed_keys(states[s]), d=mass[s].tobytes(), e=left[s].tobytes()) for p, s in _slices(states, bits)])

    def fail(table: pa.Table) -> pa.Table:
        rows = _of_kind(table)
        (held,) = rows[kind - 1]
        keys, n = held.keys(), held.ints("b")
        mass, left = np.zeros((2, len(keys)))
        where = [np.searchsorted(keys, r.keys()) for r in rows.get(SUMS, [])]
        for at, r in zip(where, rows.get(SUMS, [])):
            mass[at] += r.values("d")
            left[at] += r.values("e")
        # log10 weight that gives a state's missing words what its arcs leave
        weight = np.log10(np.maximum(1 - mass / n, 1e-12) / np.maximum(1 - left, 1e-12))
        value = (np.log10(shares(held)) if held.kind == WORD else held.values("e")) + weight
        out = [_range(held.part, held.kind, held.n, a=held.row["a"], b=held.row["b"], d=value.tobytes())]
        return _table(out + [_range(r.src, REPLY, r.n, held.part, b=_planes(n[at]), d=weight[at].tobytes()) for at, r in zip(where, rows.get(SUMS, []))])

    def value(table: pa.Table) -> pa.Table:
        rows = _of_kind(table)
        (row,) = rows[kind]
        keys, n, last, below = row.keys(), row.ints("b"), row.values("c", np.uint64), row.values("d")
        at = np.unique(first_of(keys, last, step), return_inverse=True)[1]
        of, weight = np.concatenate([r.ints("b") for r in rows[REPLY]])[at], np.concatenate([r.values("d") for r in rows[REPLY]])[at]
        p = (n - DISCOUNT) / of
        # an arc takes the place of the failure arc and the lower arc
        gain = np.log10(p) - np.log10(below) - weight
        if kind == TRIPLE:
            return _table([_range(row.part, kind, row.n, a=row.row["a"], b=row.row["b"], d=gain.tobytes())])
        return _table([_range(row.part, kind, row.n, a=row.row["a"], b=row.row["b"], d=p.tobytes(), e=gain.tobytes())])

    answers = _met(arcs.mapInArrow(ask, RANGE), lower, answer)
    sums = _written(_met(arcs, answers, gather), labels[0])
    discard(arcs)
    weights = _written(_met(sums.where(F.col("kind") == SUMS), lower, fail), labels[1])
    discard(lower)
    values = _written(_met(sums.where(F.col("kind") == kind), weights.where(F.col("kind") == REPLY), value), labels[2])
    discard(sums)
    held = _written(weights.where(F.col("kind") == kind - 1), "words" if kind == PAIR else "pair_values")
    discard(weights)
    return values, held


@dataclass
class Automaton:
    """Sizes of the training texts; the ranges of words, pairs and triples: keys a, counts b, values d."""

    tokens: int
    kinds: int
    bits: int
    words: DataFrame
    arcs: DataFrame


def fit(texts: DataFrame) -> Automaton:
    """The automaton of a table (text)."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, (size // 5 // RANGE_TOKENS).bit_length())

    def total(function, label: str) -> DataFrame:
        return _written(texts.select("text").mapInArrow(function, RANGE).groupBy("part").applyInArrow(_totals(2), RANGE), label)

    def short(batches):
        def part(tokens, starts):
            return [(WORD, tokens, None), (PAIR, pair_ids(*pairs_of(tokens, starts)), tokens)]
        return _buffered(batches, bits, part)

    counts = total(short, "counts")
    words = counts.where(F.col("kind") == WORD)
    tokens, kinds = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = _written(words, "word_counts")
    pairs = _written(counts.where(F.col("kind") == PAIR), "pair_counts")
    discard(counts)
    known_pairs = spark.sparkContext.broadcast(KeyFilter(pairs))

    def long(batches):
        # a triple is seen at most as often as its pairs, so one with a pair that is no arc is none either
        def part(tokens, starts):
            ids = pair_ids(*pairs_of(tokens, starts))
            held = known_pairs.value.may_hold(ids)
            first, last, at = triples_of(ids, starts)
            both = held[at - 1] & held[at]
            first, last = first[both], last[both]
            return [(TRIPLE, triple_ids(first, last), last)]
        return _buffered(batches, bits, part)

    triples = total(long, "triple_counts")
    known_pairs.destroy()

    # smoothing: one added to word counts; pairs and triples discounted
    least, among = max(2.0, ARC_SHARE * tokens), float(tokens + kinds + 1)
    pairs, words = _weighted(pairs, words, PAIR, BASE, among, bits, least, ("pair_sums", "word_weights", "pair_gains"))
    triples, pairs = _weighted(triples, pairs, TRIPLE, STEPS[0], among, bits, least, ("triple_sums", "pair_weights", "triple_values"))
    return Automaton(tokens, kinds, bits, words, pairs.unionByName(triples))


def _hot_count(model: Automaton) -> float:
    """Least count of the arcs that are broadcast, of which there are HOT_ARCS at most."""
    top = 10_000
    bound = 2 * model.tokens / HOT_ARCS  # pairs and triples with that count are at most HOT_ARCS

    def sizes(batches):
        for row in _rows(batches):
            count, n = np.unique(np.minimum(row.ints("b"), top), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(n.astype(np.int64))], ["count", "n"])

    many, least = 0, bound
    for r in model.arcs.mapInArrow(sizes, "count long, n long").groupBy("count").agg(F.sum("n").alias("n")).orderBy(F.desc("count")).collect():
        many += r["n"]
        if many > HOT_ARCS:
            break
        least = float(r["count"])
    return min(bound, least) if many else bound


ASKED = "part int, base_row long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double, keys binary, places binary"
ANSWERED = f"{ASKED}, bases binary, sums binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double"


def _fields(form: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in form.split(", ")])


def _answers(floor: float, among: float):
    def answered(asked: pa.Table, held: pa.Table) -> pa.Table:
        """Heads of texts as they are, and for each block the sums of what the range holds of its texts' n-grams."""
        form = _fields(ANSWERED)
        heads = asked.filter(asked.column("keys").is_null())
        for field in list(form)[len(heads.schema):]:
            heads = heads.append_column(field, pa.nulls(len(heads), field.type))
        out = []
        rows = list(_rows(held.to_batches()))
        if rows:
            keys = np.concatenate([r.keys() for r in rows])
            order = np.argsort(keys)
            keys = keys[order]
            # what a known word has above the floor, which every token gets
            known = np.concatenate([np.full(r.n, r.kind == WORD, np.int64) for r in rows])[order]
            base = np.concatenate([np.log10((r.ints("b") + 1) / among) - floor if r.kind == WORD else np.zeros(r.n) for r in rows])[order]
            value = np.concatenate([r.values("d") - floor if r.kind == WORD else r.values("d") for r in rows])[order]
            blocks = asked.filter(asked.column("keys").is_valid())
            for part, first, n, k, places in zip(*(blocks.column(c).to_pylist() for c in ("part", "base_row", "n_tokens", "keys", "places"))):
                want, place = _unpacked(k, places, n)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                at, place = at[hit], place[hit]
                if len(at):
                    some = np.flatnonzero(np.bincount(place))
                    words, bases, sums = (np.bincount(place, x[at])[some] for x in (known, base, value))
                    keys_of, counts = _packed(some.astype(np.uint64), words)
                    out.append({"part": part, "base_row": first, "n_tokens": len(some), "keys": keys_of, "places": counts, "bases": bases[words > 0].tobytes(), "sums": sums.tobytes()})
        return pa.concat_tables([heads.cast(form), pa.Table.from_pylist(out, form)])
    return answered


def _collected(table: pa.Table) -> pa.Table:
    """The texts of one block with all sums of the ranges."""
    heads = table.filter(table.column("keys").is_null()).sort_by("row")
    blocks = table.filter(table.column("keys").is_valid()).sort_by("part")
    known, base, value = (heads.column(c).to_numpy().copy() for c in ("n_known", "base", "value"))
    for n, keys, places, bases, sums in zip(*(blocks.column(c).to_pylist() for c in ("n_tokens", "keys", "places", "bases", "sums"))):
        at, more = _unpacked(keys, places, n)
        at = at.astype(np.int64)
        known[at] += more
        base[at[more > 0]] += np.frombuffer(bases)
        value[at] += np.frombuffer(sums)
    return pa.Table.from_arrays([*(heads.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array(known), pa.array(base), pa.array(value)], _fields(SCORED).names)


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Tokens are a text's words and its end; a null or empty text is its end alone. Without training
    texts every probability is one. Rows that repeat a doc_id are scored one by one; other columns
    are ignored.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    bits, among = model.bits, float(model.tokens + model.kinds + 1)
    floor = float(np.log10(1.0 / among))
    often, hot = max(1.0, WORD_SHARE * model.tokens), _hot_count(model)
    least = {WORD: often, PAIR: hot, TRIPLE: hot}

    def frequent(batches):
        for row in _rows(batches):
            n = row.ints("b")
            some = n >= least[row.kind]
            base = np.log10((n[some] + 1) / among) - floor if row.kind == WORD else np.zeros(int(some.sum()))
            yield pa.RecordBatch.from_arrays([longs(row.keys()[some]), pa.array(base), pa.array(row.values("d")[some] - floor * (row.kind == WORD))], ["key", "base", "value"])

    def table(found: DataFrame, *columns: str) -> tuple:
        """Bounded by HOT_ARCS or one over WORD_SHARE; position -1 is the last, without a value."""
        got = found.mapInArrow(frequent, "key long, base double, value double").select("key", *columns).toArrow()
        return (Lookup(got.column("key").to_numpy().view(np.uint64)), *(np.append(got.column(c).to_numpy(), 0.0) for c in columns))

    held = model.words.unionByName(model.arcs)
    shared = rows.sparkSession.sparkContext.broadcast((table(model.words, "base", "value"), table(model.arcs, "value"), KeyFilter(held, least)))
    form = _fields(ASKED)

    def traversed(batches):
        (known, bases, values), (arc, arc_values), rest = shared.value
        number = base = TaskContext.get().partitionId() << 33
        waiting, size = [], 0

        def blocks():
            """One block for each range of keys that the texts from ``base`` on ask for."""
            asked, whose = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(asked)
            asked, whose = asked[order], whose[order] - base
            for part, some in _slices(asked, bits):
                block = {"part": part, "base_row": base, "n_tokens": some.stop - some.start} | dict(zip(("keys", "places"), _packed(asked[some], whose[some])))
                yield from pa.Table.from_pylist([block], form).to_batches()

        for batch in batches:
            for first, end, tokens, starts in token_runs(batch.column("text")):
                many, owner = end - first, np.repeat(np.arange(end - first), np.diff(starts))
                pairs = pair_ids(*pairs_of(tokens, starts))
                a, b, at = triples_of(pairs, starts)
                keys, owners = np.concatenate((pairs, triple_ids(a, b))), np.concatenate((owner, owner[at]))
                ids, arcs_at = known.find(tokens), arc.find(keys)
                score = np.bincount(owner, values[ids], many) + np.bincount(owners, arc_values[arcs_at], many)
                asked, whose = np.concatenate((tokens[ids < 0], keys[arcs_at < 0])), np.concatenate((owner[ids < 0], owners[arcs_at < 0]))
                some = rest.may_hold(asked)
                heads = np.arange(number, number + many)
                yield pa.RecordBatch.from_arrays([
                    pa.array((heads % (1 << bits)).astype(np.int32)), pa.array(np.full(many, base)), pa.array(heads), batch.column("doc_id").slice(first, many), batch.column("held_out").slice(first, many),
                    pa.array(np.diff(starts).astype(np.int64)), pa.array(np.bincount(owner[ids >= 0], minlength=many).astype(np.int64)),
                    pa.array(np.bincount(owner, bases[ids], many).astype(float)), pa.array(score.astype(float)), pa.nulls(many, pa.binary()), pa.nulls(many, pa.binary()),
                ], form.names)
                waiting.append((asked[some], number + whose[some]))
                size += int(some.sum())
                number += many
                if size >= BUFFER:
                    yield from blocks()
                    waiting, size, base = [], 0, number
        if size:
            yield from blocks()
        waiting = []
        trim()

    # heads of texts, and blocks of the n-grams that texts ask for; each range of keys answers, and the answers meet by the texts' block
    asked = rows.mapInArrow(traversed, ASKED)
    values = held.select("part", "kind", "n", "a", F.when(F.col("kind") == WORD, F.col("b")).alias("b"), "d")
    answers = asked.groupBy("part").cogroup(values.groupBy("part")).applyInArrow(_answers(floor, among), ANSWERED)
    plain = F.col("n_tokens") * F.lit(floor)
    return answers.groupBy("base_row").applyInArrow(_collected, SCORED).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + plain).alias("base_score"), (F.col("value") + plain).alias("score"))
