"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words and word beginnings of the examples; no level keeps a term out. Each weighs by its
idf times the log likelihood ratio of toxic and other examples, so what tells nothing weighs next to
nothing in any language and with few examples too. A bounded hash sample of labelled rows gives
examples, so index and broadcast are bounded. The search is exact: sums over rare terms come from
postings, common terms are multiplied for blocks of examples whose upper bound can still enter the k
best. Votes weigh by nearness and shrink to the rate of examples without any term, which is also the
score of texts without any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.llm import tokens
from fieldframe.llm.words import STEPS, mix, powers
from fieldframe.session import materialize

EXAMPLES = 8192  # most labelled rows used, by hash of doc_id
BEGINNINGS = (4, 5, 6)  # lengths of word beginnings, in bytes
BLOCK = 32
TEXTS = 256  # searched at once
PIECE = 1 << 18  # bytes whose words are hashed at once
LEADING = 20  # bits of a hash by which terms are found
RUN = 16  # blocks whose common terms are multiplied at once
LEFT = 0.005  # most that rare terms, and common ones, add to a cosine which are left to the exact comparison
COMMON = 16  # a term is common if it stands in one of so many examples
NEIGHBOURS = 15
SOFT = 0.05  # distance added before a vote's weight is its inverse
SHRINK = 1.0  # weight of the rate of examples without terms
TOXIC_FROM = 0.3
PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never read; a null doc_id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _plain(text: str | None) -> bytes:
    """A text in lower case with a space for whatever is neither an ASCII letter nor part of another character."""
    return (text or "").lower().encode("utf-8", "replace").translate(PLAIN)


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(row, bytes) in groups of about PIECE bytes; long texts are cut at spaces."""
    group: list[tuple[int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        raw, at = _plain(text), 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE)
            end = len(raw) if end < 0 else end
            group.append((row, raw[at:end]))
            size, at = size + end - at, end
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _group_terms(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, term hashes, words) of a group: every distinct word of a piece and its beginnings, with how often the word stands there."""
    data = np.frombuffer(b" ".join(raw for _, raw in group) + b" ", np.uint8)
    solid = data != 32
    edges = np.flatnonzero(np.diff(solid, prepend=False))
    first, length = edges[::2], edges[1::2] - edges[::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.array([len(raw) + 1 for _, raw in group])
    piece = np.searchsorted(np.cumsum(sizes), first, side="right")
    places = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    values = (data[solid].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[places]
    word = mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))
    # equal words of a piece once, with their number
    key = mix(word + piece.astype(np.uint64) * STEPS[2])
    order = np.argsort(key)
    new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    one, many = order[new], np.diff(new, append=len(order))
    rows = np.array([row for row, _ in group])[piece[one]]
    found = [(rows, word[one], many)]
    for n in BEGINNINGS:
        longer = length[one] > n
        letters = data[first[one][longer][:, None] + np.arange(n)].astype(np.uint64) + np.uint64(1)
        found.append((rows[longer], mix(mix((letters * powers(n)[:n]).sum(axis=1, dtype=np.uint64)) + np.uint64(n)), many[longer]))
    return tuple(np.concatenate(x) for x in zip(*found))


def text_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of a term, number of words that bear it) of all texts; a pair of row and term may come in parts.

    Terms are words, runs of ASCII letters and bytes of other characters in lower case, and their
    beginnings. A term is its 64-bit hash: equal hashes are taken as equal terms.
    """
    found = [_group_terms(group) for group in _pieces(texts)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _ratio(a: Column, b: Column, toxic: int, other: int) -> Column:
    """Log likelihood ratio of a term in a of the toxic and b of the other examples."""
    n = float(toxic + other)

    def part(seen: Column, row: Column, column: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    inside, outside = a + b, F.lit(n) - a - b
    return part(a, inside, toxic) + part(b, inside, other) + part(toxic - a, outside, toxic) + part(other - b, outside, other)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first..end, one after another."""
    sizes = end - first
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - stops + sizes, sizes)


class BlockMaxIndex:
    """Unit vectors in blocks of examples: postings of rare terms, columns of common ones with their largest weight per block.

    A vector is a dict of terms and weights over 0, or an array of each. With ``scale``, vectors are one triple of arrays
    (starts, terms, counts) instead, and a weight is 1 + log(count) times the term's scale, before a vector gets length
    one; counts are kept as numbers of their few levels, a quarter or less of the memory of weights. The array of terms
    becomes the index's own.
    """

    def __init__(self, vectors, ids: list[int], toxic: list[int], terms: int, scale: np.ndarray | None = None):
        self.scale = scale
        self.starts, self.of, self.amounts = _joined(vectors) if scale is None else vectors
        spans = list(zip(self.starts[:-1].tolist(), self.starts[1:].tolist()))
        if scale is not None:
            values, counts = np.unique(self.amounts), self.amounts
            self.levels, self.amounts = 1 + np.log(values, dtype=np.float64), np.zeros(len(counts), np.min_scalar_type(len(values)))
            for a, b in spans:
                self.amounts[a:b] = np.searchsorted(values, counts[a:b])
            del counts
        self.norms, leading, sizes, most = np.ones(len(ids)), [], np.zeros(terms, np.int64), np.zeros(terms, np.float32)
        for i, (a, b) in enumerate(spans):
            raw = self._raw(slice(a, b))
            self.norms[i] = 1.0 if scale is None else np.sqrt((raw * raw).sum())
            leading.append(self.of[a:b][np.argsort(-raw, kind="stable")[:3]].tolist())
            sizes[self.of[a:b]] += 1
            most[self.of[a:b]] = np.maximum(most[self.of[a:b]], raw / self.norms[i])
        # inside the index common terms are numbered first, by largest weight, and the others from the most frequent: what is looked up often lies together
        common = sizes * COMMON > len(ids)
        frequent = np.lexsort((np.where(common, -most, -sizes), ~common))
        self.common, self.most, self.number = int(common.sum()), most[frequent], np.zeros(terms, np.int32)
        self.number[frequent] = np.arange(terms)
        # examples with the same leading terms share blocks, which keeps the bounds tight
        order = sorted(range(len(ids)), key=lambda i: (leading[i], ids[i]))
        self.order = np.array(order, np.int64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.float64)
        self.blocks, self.terms = -(-len(order) // BLOCK), terms
        for a, b in spans:
            self.of[a:b] = self.number[self.of[a:b]]
        sizes = sizes[frequent]
        if scale is not None:
            self.scale = scale[frequent]
        self.dense = np.zeros((self.common, self.blocks * BLOCK), np.float32)
        sizes[:self.common] = 0
        self.lists = np.concatenate(([0], np.cumsum(sizes)))
        self.posted = np.zeros(self.lists[-1], np.min_scalar_type(max(0, len(order) - 1)))
        self.posted_weights = np.zeros(self.lists[-1], np.float32)
        # example by example, so that nothing else of the size of the index is held
        free = self.lists[:-1].copy()
        for place, i in enumerate(order):
            a, b = spans[i]
            of, weights = self.of[a:b], (self._raw(slice(a, b)) / self.norms[i]).astype(np.float32)
            common = of < self.common
            self.dense[of[common], place] = weights[common]
            of, weights = of[~common], weights[~common]
            self.posted[free[of]], self.posted_weights[free[of]] = place, weights
            free[of] += 1
        self.largest = self.dense.reshape(self.common, self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((self.common, 0), np.float32)

    def _raw(self, which) -> np.ndarray:
        """Weights of the chosen entries before a vector gets length one."""
        return self.amounts[which] if self.scale is None else self.levels.take(self.amounts[which]) * self.scale.take(self.of[which])

    def nearest(self, vector, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, places) of the k examples with the largest cosine over 0, ties to the smaller id."""
        return self.nearest_of([vector], k)[0]

    def _rare_sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of every example the sum over these rare terms."""
        width = self.blocks * BLOCK
        if not len(terms):
            return np.zeros(width)
        first, end = self.lists[terms], self.lists[terms + 1]
        found = _ranges(first, end)
        weights = np.repeat(weights.astype(np.float32), end - first)
        weights *= self.posted_weights.take(found)  # for single numbers take is twice as fast as brackets
        return np.bincount(self.posted.take(found), weights, width)

    def nearest_of(self, vectors: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each vector, searched together."""
        vectors = [(self.number[terms], weights) for terms, weights in map(_arrays, vectors)]
        width = self.blocks * BLOCK
        sums, common = np.zeros((len(vectors), width), np.float32), np.zeros((len(vectors), len(self.dense)), np.float32)
        left = []  # rare terms that together cannot add more than LEFT to a cosine, and so for common ones
        # sums over the rare terms are below the cosines, and with what is left out and the largest weights of the common ones above them
        slack = np.full(len(vectors), 1e-4, np.float32)  # over the error of single precision
        for i, (terms, weights) in enumerate(vectors):
            rare = terms >= self.common
            common[i, terms[~rare]] = weights[~rare]
            terms, weights = terms[rare], weights[rare]
            most = weights * self.most[terms]
            order = np.argsort(most)
            total = np.cumsum(most[order])
            few = int(np.searchsorted(total, LEFT))
            slack[i] += total[few - 1] if few else 0
            left.append((terms[order[:few]], weights[order[:few]]))
            sums[i] = self._rare_sums(terms[order[few:]], weights[order[few:]])
        rest = np.cumsum((common * self.most[:self.common])[:, ::-1], axis=1)[:, ::-1]
        many = int((rest > LEFT).sum(axis=1).max(initial=0))
        if many < self.common:
            slack += rest[:, many]
        if width:
            # the k-th largest of the blocks' maxima is at most the k-th largest of all
            best, last = sums.reshape(len(vectors), self.blocks, BLOCK).max(axis=2), max(0, self.blocks - k)
            kth = np.partition(best, last, axis=1)[:, last] if k <= self.blocks else np.zeros(len(vectors), np.float32)
            open_ = best + common[:, :many] @ self.largest[:many] + slack[:, None] >= kth[:, None]
        for first in range(0, self.blocks, RUN):
            # neighbouring blocks are multiplied together, for the texts to which one of them is open
            need, part = np.flatnonzero(open_[:, first:first + RUN].any(axis=1)), slice(first * BLOCK, (first + RUN) * BLOCK)
            if 2 * len(need) > len(vectors):
                sums[:, part] += common[:, :many] @ self.dense[:many, part]
            elif len(need):
                sums[need, part] += common[need, :many] @ self.dense[:many, part]
        out, query, last = [], np.zeros(self.terms), max(0, width - k)
        for i, (terms, weights) in enumerate(vectors):
            least = np.partition(sums[i], last)[last] if width else 0
            if least <= 2 * slack[i]:
                # so little is known of the k best that what was left out could tell
                sums[i] += self._rare_sums(*left[i]) + common[i, many:] @ self.dense[many:]
                slack[i] = 1e-4
                least = np.partition(sums[i], last)[last] if width else 0
            places = np.flatnonzero((sums[i] > 0) & (sums[i] + slack[i] >= least))
            # exact cosines of what may be among the k best
            query[terms] = weights if self.scale is None else weights * self.scale[terms]
            cosines = np.concatenate([np.zeros(0), *(self._cosines(places[at:at + TEXTS], query) for at in range(0, len(places), TEXTS))])
            query[terms] = 0
            top = np.lexsort((self.ids[places], -cosines))[:k]
            top = top[cosines[top] > 0]
            out.append((cosines[top], places[top]))
        return out

    def _cosines(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Cosines of the examples at ``places``, none of them empty, with a unit vector given by all its components times their scale."""
        which = self.order[places]
        first, end = self.starts[which], self.starts[which + 1]
        sizes = end - first
        spans = [slice(a, b) for a, b in zip(first.tolist(), end.tolist())]
        of, amounts = (np.concatenate([array[span] for span in spans]) for array in (self.of, self.amounts))
        weights = amounts if self.scale is None else self.levels.take(amounts)
        return np.add.reduceat(query.take(of) * weights, np.cumsum(sizes) - sizes) / self.norms[which]


def _arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, dict):
        terms = sorted(vector)
        return np.array(terms, np.int64), np.array([vector[t] for t in terms])
    return vector


def _joined(vectors: Iterable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, terms, weights) of vectors."""
    vectors = [_arrays(v) for v in vectors]
    starts = np.cumsum([0, *(len(terms) for terms, _ in vectors)])
    return starts, *(np.concatenate([np.zeros(0, form), *(v[x] for v in vectors)]).astype(form) for x, form in enumerate((np.int32, np.float64)))


class Model:
    """Terms as sorted hashes, their weights, and the examples' term counts.

    It travels compressed and without its index, which is built where it is first used.
    """

    def __init__(self, terms: np.ndarray, weights: np.ndarray, plain_rate: float):
        self.terms, self.weights, self.plain_rate = terms.astype(np.uint64), weights, plain_rate
        # where the terms that share their leading bits start
        self.starts = np.searchsorted(self.terms, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(terms)))
        self.examples: tuple[np.ndarray, ...] | None = None  # starts, terms, counts, ids, toxic
        self.index: BlockMaxIndex | None = None

    def __getstate__(self):
        packed = self.terms, zlib.compress(self.weights.tobytes(), 1)
        if self.examples is None:
            return packed, self.plain_rate, None
        starts, terms, counts, ids, toxic = self.examples
        return packed, self.plain_rate, (starts, zlib.compress(np.diff(terms, prepend=np.int32(0)).tobytes(), 1), (zlib.compress(counts.tobytes(), 1), counts.dtype), ids, toxic)

    def __setstate__(self, state):
        (terms, weights), plain_rate, examples = state
        self.__init__(terms, np.frombuffer(zlib.decompress(weights)), plain_rate)
        if examples is not None:
            starts, terms, (counts, form), ids, toxic = examples
            terms = np.cumsum(np.frombuffer(zlib.decompress(terms), np.int32), dtype=np.int32)
            self.examples = starts, terms, np.frombuffer(zlib.decompress(counts), form), ids, toxic

    def search(self) -> BlockMaxIndex | None:
        if self.index is None and self.examples is not None and len(self.examples[3]):
            starts, terms, counts, ids, toxic = self.examples
            self.examples = None  # the index holds what they say
            tells = self.weights[terms] > 0
            if not tells.all():
                starts = np.concatenate(([0], np.cumsum(tells)))[starts]
                terms, counts = terms[tells], counts[tells]
            del tells
            self.index = BlockMaxIndex((starts, terms, counts), ids.tolist(), toxic.tolist(), len(self.terms), self.weights)
        return self.index

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for what is none."""
        leading = (hashes >> np.uint64(64 - LEADING)).astype(np.int64)
        at, end = self.starts[leading], self.starts[leading + 1]
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            hit = self.terms[at] == hashes[open_]
            out[open_[hit]] = at[hit]
            more = ~hit & (at + 1 < end[open_])
            open_, at = open_[more], at[more] + 1
        return out

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text its terms in order, and the number of its words that bear each."""
        rows, hashes, many = text_terms(texts)
        terms = self.lookup(hashes)
        kept = terms >= 0
        key = rows[kept] * len(self.terms) + terms[kept]
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(many[kept][order], new) if len(new) else np.zeros(0, np.int64)
        row, term = np.divmod(key[new], max(1, len(self.terms)))
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        return [(term[a:b], total[a:b]) for a, b in zip(cuts, cuts[1:])]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(counts)) * self.weights[terms]
        terms, raw = terms[raw > 0], raw[raw > 0]
        return terms, raw / np.sqrt((raw * raw).sum())

    def vote(self, cosines: np.ndarray, toxic: np.ndarray) -> float:
        weights = 1 / (np.maximum(1 - cosines, 0) + SOFT)
        return float((weights @ toxic + SHRINK * self.plain_rate) / (weights.sum() + SHRINK))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """(score, doc_ids of the voting examples) of each text."""
        out: list[tuple[float, list[int]]] = []
        index = self.search()
        for at in range(0, len(texts), TEXTS):
            some = texts[at:at + TEXTS]
            distinct = list(dict.fromkeys(some))
            known = {text: self.vector(*found) for text, found in zip(distinct, self.counts(distinct))}
            known = {text: v for text, v in known.items() if len(v[0]) and index is not None}
            found = dict(zip(known, index.nearest_of(list(known.values()), NEIGHBOURS))) if known else {}
            voted = {text: (self.vote(c, index.toxic[p]), index.ids[p].tolist()) for text, (c, p) in found.items() if len(p)}
            out += [voted.get(text, (self.plain_rate, [])) for text in some]
        return out


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of TEXTS rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _terms(batches):
    for part in _parts(batches):
        rows, hashes, _ = text_terms(part.column("text").to_pylist())
        terms = [np.unique(hashes[rows == row]).view(np.int64) for row in range(part.num_rows)]
        yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(terms, pa.list_(pa.int64()))], ["toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Fit on at most ``examples`` labelled rows outside the held-out part, chosen by hash of doc_id.

    A doc_id with several labels is toxic if one says so; null labels and ids count as none.
    Without labelled rows the model scores everything 0.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    here = docs.select("doc_id").distinct().join(marks, "doc_id")
    chosen = materialize(here.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples), "examples")
    # a bounded table: at most ``examples`` pairs of an id and a label
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic + other:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    seen = rows.select("toxic", "text").mapInArrow(_terms, "toxic int, terms array<long>").select("toxic", F.explode("terms").alias("term"))
    counted = seen.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    # a bounded table: the terms of at most ``examples`` texts
    a, b = F.col("a"), F.col("b")
    weight = (F.log(F.lit(1.0 + toxic + other) / (1 + a + b)) + 1) * F.greatest(_ratio(a, b, toxic, other), F.lit(0.0))
    got = counted.select("term", weight.alias("weight")).toArrow()
    hashes = got.column("term").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], got.column("weight").to_numpy()[order], 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def bags(batches):
        for part in _parts(batches):
            found = shared.value.counts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([t for t, _ in found], pa.list_(pa.int32())),
                                              pa.array([n for _, n in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    # at most ``examples`` rows
    found = rows.select("doc_id", "toxic", "text").mapInArrow(bags, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    shared.destroy()
    sizes = pc.list_value_length(found.column("terms")).to_numpy()
    ids, marks = found.column("doc_id").to_numpy(), found.column("toxic").to_numpy()
    used = sizes > 0
    model.plain_rate = float(marks[~used].mean()) if not used.all() else 0.0
    terms, counts = (pc.list_flatten(found.column(c)).to_numpy().astype(np.int32) for c in ("terms", "counts"))
    model.examples = np.cumsum([0, *sizes[used]]), terms, counts.astype(np.min_scalar_type(counts.max(initial=0))), ids[used], marks[used]
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of docs (doc_id, text).

    A text without terms (null, empty, or only words that no example has) scores the toxic rate of
    such examples, with no evidence. evidence holds the doc_ids of the voting examples, nearest
    first. Equal texts score alike; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def scored(batches):
        tokens.forget()
        own = model.value
        for batch in _parts(batches):
            found = own.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()),
                                              pa.array([int(s >= TOXIC_FROM) for s, _ in found], pa.int32()),
                                              pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score TOXIC_FROM or more; columns and other rows stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def clean(batches):
        tokens.forget()  # a worker that encoded texts before holds its words
        own = model.value
        for batch in _parts(batches):
            yield batch.filter(pa.array([s < TOXIC_FROM for s, _ in own.scores(batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
