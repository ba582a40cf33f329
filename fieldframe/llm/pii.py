"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field is trained by gradient ascent on a small labelled table: windows around words with digits
or @ from a bounded hash sample of documents, labelled by the base patterns, each also with the
values rewritten as people write them past those patterns (a phone without its plus, a card with dots,
an address in brackets). Words without digit or @ can only be outside a span, so the best path
falls apart into runs of the other words, which are decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
SAMPLE = 400  # documents from which the labelled table is made, by hash of doc_id
WINDOW = 4  # words kept on each side of a labelled word
ROUNDS = 120

LOCAL = "A-Za-z0-9._%+-"
EMAIL = re.compile(rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_FROM = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
IP_FROM = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HOT_WORD = re.compile(r"(?<![^\x20\x09-\x0D])(?=[^0-9@\x20\x09-\x0D]*+[0-9@])[^\x20\x09-\x0D]++")
WORD = re.compile(r"[^\x20\x09-\x0D]++")
EDGE = ".,;:!?|\"'"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _found(text: str, whole: re.Pattern, first: re.Pattern):
    """Leftmost matches one after another; a match starts where its run starts or the last match ended."""
    at = 0
    while (hit := (whole.match(text, at) if at else None) or first.search(text, at)) is not None:
        yield hit
        at = hit.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; matches that fail their check are dropped."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _found(text, EMAIL, EMAIL_FROM)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _found(text, IP, IP_FROM) if all(len(q := p.lstrip("0")) < 4 and int(q or "0") < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() > 13 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape(word: str) -> str:
    """Letters and digits as classes, runs of letters shortened, runs of digits by length; card check digit told apart."""
    out = []
    core = word.strip(EDGE)
    for run in re.findall(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7f]+|.", core[:64]):
        c = run[0]
        out.append("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else f"9{min(len(run), 20)}" if "0" <= c <= "9" else "u" if c > "\x7f" else c)
    digits = _digits(core) if len(core) < 64 else ""
    return "".join(out[:24]) + ("|ok" if 14 <= len(digits) <= 19 and luhn(digits) else "") + ("|long" if len(core) > 64 else "")


def features(before: str, here: str, after: str) -> list[str]:
    """Names of a word's features from its own shape and its neighbours'."""
    own = re.sub(r"9\d+", "9", here)
    return ["1", f"s={here}", f"c={own}", f"p={before[:8]}", f"n={after[:8]}", f"ps={re.sub(r'[0-9]+', '9', before)}/{own}", f"ns={own}/{re.sub(r'[0-9]+', '9', after)}",
            f"at={'@' in here}", f"d={sum(map(int, re.findall(r'9([0-9]+)', here)))}", f"ok={'|ok' in here}", f"dots={here.count('.')}"]


def _rewritten(value: str, kind: int) -> str:
    """A base value as it is also written, so that its pattern does not match."""
    if kind == 0:
        return value.replace("@", "[@]")
    if kind == 1:
        return value.replace(".", "[.]")
    if kind == 2:
        digits = _digits(value)
        return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return re.sub(r"^\+[0-9]+[ -]*", "", value)


def labelled_windows(text: str) -> list[tuple[list[str], list[int]]]:
    """(shapes, labels) of windows around a text's words with digits or @, and of rewritten ones."""
    out = []
    spans = base_spans(text)
    for rewrite in (False, True) if spans else (False,):
        parts, marks, at = [], [], 0
        for a, k, b in spans:
            if a < at:
                continue
            value = _rewritten(text[a:b], k) if rewrite else text[a:b]
            words = WORD.findall(text[at:a])
            glued = bool(words) and a > 0 and not text[a - 1].isspace()
            parts += words[:-1] if glued else words
            marks += [0] * (len(words) - glued)
            inside = ((words[-1] if glued else "") + value).split()
            parts += inside
            marks += [1 + 2 * k, *[2 + 2 * k] * (len(inside) - 1)][:len(inside)]
            at = b
        rest = WORD.findall(text[at:])
        parts, marks = parts + rest, marks + [0] * len(rest)
        hot = [i for i, w in enumerate(parts) if any(c in "0123456789@" for c in w)]
        last = -1
        for i in hot:
            if i <= last:
                continue
            first, last = max(0, i - WINDOW), min(len(parts), i + WINDOW + 1)
            out.append(([shape(w) for w in parts[first:last]], marks[first:last]))
    return out


class Field:
    """Weights of a linear-chain conditional random field; ``names`` maps features to rows of ``emit``."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step
        self.known: dict[tuple[str, str, str], np.ndarray] = {}

    def scores(self, before: str, here: str, after: str) -> np.ndarray:
        key = (before[:8], here, after[:8])
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            rows = [self.names[f] for f in features(*key) if f in self.names]
            got = self.known[key] = self.emit[rows].sum(axis=0)
        return got

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of chains of one length (chains, words, labels), each between words outside."""
        many, length, _ = scores.shape
        best = scores[:, 0] + self.step[0]
        back = np.zeros((many, length, len(LABELS)), np.int8)
        for t in range(1, length):
            paths = best[:, :, None] + self.step[None]
            back[:, t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[:, t]
        out = np.zeros((many, length), np.int8)
        out[:, -1] = (best + self.step[:, 0]).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(many), t, out[:, t]]
        return out


def _forbidden() -> np.ndarray:
    """Steps that no labelling has: I- of a kind only follows B- or I- of it."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = -1e4
        bad[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return bad


def train(windows: list[tuple[list[str], list[int]]], rounds: int = ROUNDS, rate: float = 0.4, ridge: float = 0.02) -> Field:
    """Weights of largest penalised likelihood, by Adagrad on all windows at once. No windows: all outside."""
    names: dict[str, int] = {}
    wide = 2 * WINDOW + 1
    many = len(windows)
    width = len(features("", "", ""))
    rows = np.zeros((many, wide, width), np.int64)
    gold = np.zeros((many, wide), np.int64)
    real = np.zeros((many, wide), bool)
    for i, (shapes, labels) in enumerate(windows):
        for t, here in enumerate(shapes):
            found = features((shapes[t - 1] if t else "")[:8], here, (shapes[t + 1] if t + 1 < len(shapes) else "")[:8])
            rows[i, t] = [names.setdefault(f, len(names)) for f in found]
        gold[i, :len(labels)] = labels
        real[i, :len(labels)] = True
    size = len(LABELS)
    emit, step, bad = np.zeros((max(1, len(names)), size)), np.zeros((size, size)), _forbidden()
    grown_emit, grown_step = np.full_like(emit, 1e-6), np.full_like(step, 1e-6)
    flat_rows = rows[real].ravel()
    gold_one = np.eye(size)[gold]
    pairs = real[:, 1:] & real[:, :-1]
    for _ in range(rounds if many else 0):
        scores = emit[rows].sum(axis=2)
        scores[~real] = 0
        scores[~real, 1:] = -1e4
        moves = step + bad
        forward = np.zeros((many, wide, size))
        backward = np.zeros((many, wide, size))
        forward[:, 0] = scores[:, 0] + moves[0]
        for t in range(1, wide):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
        for t in range(wide - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        given = np.exp(forward + backward - whole[:, None, None])
        differ = (gold_one - given)[real]
        slope = np.zeros_like(emit)
        np.add.at(slope, flat_rows, np.repeat(differ, width, axis=0))
        both = np.exp(forward[:, :-1, :, None] + moves + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        turn = (gold_one[:, :-1, :, None] * gold_one[:, 1:, None, :] - both)[pairs].sum(axis=0)
        slope, turn = slope - ridge * emit, turn - ridge * step
        grown_emit += slope ** 2
        grown_step += turn ** 2
        emit += rate * slope / np.sqrt(grown_emit)
        step += rate * turn / np.sqrt(grown_step)
    if not many:
        emit[:, 0] = 1.0
    return Field(names, emit, step + bad)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on windows of at most ``sample`` documents with a digit or @, chosen by hash of doc_id and text.

    Hashes alone are ranked; texts are read again for those up to the last chosen one.
    """
    mark = F.xxhash64("doc_id", "text")
    able = docs.where(F.col("text").rlike("[0-9@]")).select("text", mark.alias("mark"))
    last = able.select("mark").orderBy("mark").limit(sample).agg(F.max("mark")).first()[0]
    some = able.where(F.col("mark") <= F.lit(last)).orderBy("mark").limit(sample)

    def windows(batches):
        for batch in batches:
            found = [w for text in batch.column("text").to_pylist() for w in labelled_windows(text[:100_000])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.list_(pa.string())), pa.array([m for _, m in found], pa.list_(pa.int32()))], ["shapes", "labels"])

    rows = some.select("text").mapInArrow(windows, "shapes array<string>, labels array<int>").collect()
    return train(sorted((r["shapes"], r["labels"]) for r in rows))


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; added spans never touch a base span."""
    base = [base_spans(t) if t else [] for t in texts]
    chains = defaultdict(list)
    for i, text in enumerate(texts):
        run: list[tuple[int, int]] = []
        for hit in HOT_WORD.finditer(text):
            if run and not text[run[-1][1]:hit.start()].isspace():
                chains[len(run)].append((i, run))
                run = []
            run.append(hit.span())
        if run:
            chains[len(run)].append((i, run))
    added = defaultdict(list)
    for length, found in chains.items():
        for part in range(0, len(found), 4096):
            some = found[part:part + 4096]
            scores = np.empty((len(some), length, len(LABELS)))
            for c, (i, run) in enumerate(some):
                text = texts[i]
                shapes = [shape(text[a:b]) for a, b in run]
                left = text[max(0, run[0][0] - 48):run[0][0]].split()
                right = text[run[-1][1]:run[-1][1] + 48].split()
                around = [shape(left[-1]) if left else "", *shapes, shape(right[0]) if right else ""]
                for t in range(length):
                    scores[c, t] = field.scores(around[t], around[t + 1], around[t + 2])
            for (i, run), labels in zip(some, field.decode(scores)):
                t = 0
                while t < length:
                    end = t + 1
                    if labels[t] % 2:
                        while end < length and labels[end] == labels[t] + 1:
                            end += 1
                        a, b = run[t][0], run[end - 1][1]
                        while a < b and texts[i][a] in EDGE:
                            a += 1
                        while a < b and texts[i][b - 1] in EDGE:
                            b -= 1
                        if a < b:
                            added[i].append((a, int(labels[t]) // 2, b))
                    t = end
    out = []
    for i, spans in enumerate(base):
        more = [s for s in added[i] if not any(s[0] < b and a < s[2] for a, _, b in spans)]
        out.append((spans, sorted([*spans, *more])))
    return out


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text).

    A null text is empty: no spans, and the digest of an empty list. Rows that repeat a doc_id are
    judged one by one; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample))

    def found(batches):
        for batch in batches:
            spans = all_spans([t or "" for t in batch.column("text").to_pylist()], field.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in spans], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in spans], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([listed(every) for _, every in spans], pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with personal data masked in text, and n_chars (if there) counted again; null texts stay null."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample))

    def clean(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = all_spans([t or "" for t in texts], field.value)
            new = pa.array([None if t is None else masked(t, every) for t, (_, every) in zip(texts, spans)], batch.schema.field("text").type)
            columns = dict(zip(batch.schema.names, batch.columns)) | {"text": new}
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
