"""Subject area of each document (problem 9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retromill.functions.dna import scramble
from retromill.functions.groups import begins, numbers
from retromill.shared import materialize

#: hash buckets for terms; the model has at most so many rows, however large the collection
BITS = 18
BUCKETS = 1 << BITS
#: dimensions of the embedding
DIMS = 48
#: labelled documents from which the first centroids are made, at most
MOST_LABELLED = 50_000
#: least cosine to the centroid of a subject, and least weight of its terms in the document
NEAR, MASS = 0.3, 2.0
#: least cosine for the result: a subject with about a sixth of a document's weighted terms
LEAST = 0.2
SEED_DOUBT = 0.5
FEATURES = "doc_id long, terms array<int>, times array<int>"


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, times) for texts in UTF-8, end to end: the words of identifiers and prose,
    cut at case changes, in lower case, of two letters or more; bytes beyond ASCII are letters."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none, none
    upper = (raw >= 65) & (raw <= 90)
    lower = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    letter = upper | lower
    first = letter.copy()
    first[1:] &= ~letter[:-1] | (upper[1:] & lower[:-1])
    first[1:-1] |= upper[1:-1] & upper[:-2] & lower[2:]
    at = offsets[(offsets > 0) & (offsets < len(raw))]
    first[at] |= letter[at]
    start = np.flatnonzero(first)
    if not len(start):
        return none, none, none
    where = np.flatnonzero(letter)
    begin = np.searchsorted(where, start)
    length = np.diff(np.append(begin, len(where)))
    inside = np.arange(len(where)) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), 0x100000001B3, np.uint64))
        low = raw[where].astype(np.uint64) | np.where(upper[where], np.uint64(32), np.uint64(0))
        word = np.add.reduceat(low * powers[inside], begin)
    keep = length >= 2
    bucket = (scramble(word[keep]) >> np.uint64(64 - BITS)).astype(np.int64)
    doc = np.searchsorted(offsets, start[keep], "right") - 1
    pair, times = np.unique(doc << BITS | bucket, return_counts=True)
    return pair >> BITS, pair & (BUCKETS - 1), times


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            text = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
            doc, bucket, times = term_counts(raw, offsets - offsets[0])
            ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))], ["doc_id", "terms", "times"]
            )


class Model:
    """Term weights, the truncated decomposition and the centroids of the subjects."""

    def __init__(self, weights: np.ndarray, dims: int):
        self.used = np.flatnonzero(weights > 0)
        self.row = np.full(BUCKETS, -1, np.int32)
        self.row[self.used] = np.arange(len(self.used), dtype=np.int32)
        self.weight = weights[self.used]
        rng = np.random.default_rng(7)
        self.basis = np.linalg.qr(rng.normal(size=(len(self.used), min(dims, len(self.used)))))[0] if len(self.used) else np.zeros((0, 0))
        self.centroids = np.zeros((0, self.basis.shape[1]))
        self.near = NEAR

    def rows(self, t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of each document that have a weight: (document, row, weighted times)."""
        doc, term, times = flat(t)
        if "about" in t.schema.names:  # a table that holds these already
            return doc, term, times.astype(np.float64)
        row = self.row[term]
        keep = row >= 0
        return doc[keep], row[keep], times[keep] * self.weight[row[keep]]

    def unit(self, t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with each document of length 1, and the mass each had."""
        doc, row, value = self.rows(t)
        mass = np.bincount(doc, value, t.num_rows)
        size = np.sqrt(np.bincount(doc, value * value, t.num_rows))
        return doc, row, value / np.maximum(size, 1e-9)[doc], mass

    def embed(self, t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        doc, row, value, mass = self.unit(t)
        place = np.zeros((t.num_rows, self.basis.shape[1]))
        if len(doc):
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            place[doc[begin]] = np.add.reduceat(self.basis[row] * value[:, None], begin)
        return place / np.maximum(np.linalg.norm(place, axis=1), 1e-9)[:, None], mass

    def about(self, place: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Which subjects each document is about: those near enough, the two nearest at most."""
        cos = place @ self.centroids.T
        near = (cos >= self.near) & (mass >= MASS)[:, None]
        if cos.shape[1] > 2:
            near &= cos >= np.partition(cos, -2, axis=1)[:, -2:-1]
        return near

    def assign(self, t: pa.RecordBatch) -> np.ndarray:
        return self.about(*self.embed(t))


def flat(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms, times = t.column("terms"), t.column("times")
    doc = np.repeat(np.arange(t.num_rows), np.diff(terms.offsets.to_numpy()))
    return doc, terms.flatten().to_numpy(), times.flatten().to_numpy()


#: tasks for each core that sum arrays; their partial arrays grow with the cores, not with the rows
TASKS = 4


def _sums(rows: DataFrame, height: int, width: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> DataFrame:
    """``row``, ``v0``...: the sum of what ``add`` adds for each batch into a (height, width) array: each task has one,
    of which the rows that are not 0 are summed by Spark. Tasks are as many as the cores can use, since each sends such
    an array, and its size does not depend on the number of rows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for b in batches:
            if b.num_rows:
                add(b, total)
        some = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(some), 4096):
            own = some[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(total[own, j]) for j in range(width))], ["row", *(f"v{j}" for j in range(width))])

    few = rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(over, "row int, " + ", ".join(f"v{j} double" for j in range(width)))
    return parts.groupBy("row").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(width)))


def _united(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    begin = begins(rows[order])
    return rows[order][begin], np.add.reduceat(values[order], begin)


def _sum(rows: DataFrame, height: int, width: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sums as an array on the driver, for what is a part of the model. Rows of the partial arrays travel as one
    value each, since as columns they cost a plan of ``width`` sums in every pass."""

    def batch(some: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        flat = np.ascontiguousarray(values)
        ends = np.arange(len(some) + 1, dtype=np.int32) * (flat.itemsize * width)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(flat)])], ["row", "v"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for b in batches:
            if b.num_rows:
                add(b, total)
        some = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(some), 4096):
            yield batch(some[i : i + 4096], total[some[i : i + 4096]])

    def read(b, kind) -> np.ndarray:
        return np.frombuffer(b"".join(b.column("v").to_pylist()), kind).reshape(-1, width)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((numbers(b, "row"), read(b, np.float64)))
            if len(held) > 1 and sum(len(r) for r, _ in held[1:]) > max(20_000, len(held[0][0])):
                held = [_united(*map(np.concatenate, zip(*held)))]
        if held and sum(len(r) for r, _ in held):
            some, values = _united(*map(np.concatenate, zip(*held)))
            for i in range(0, len(some), 4096):
                yield batch(some[i : i + 4096], values[i : i + 4096].astype(np.float32))

    few = rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    out = np.zeros((height, width))
    t = few.mapInArrow(over, "row int, v binary").repartition("row").mapInArrow(unite, "row int, v binary").toArrow()
    if t.num_rows:
        out[t.column("row").to_numpy()] = read(t, np.float32)
    return out


def _weights(rows: DataFrame, n: int, marks: Callable[[pa.RecordBatch], np.ndarray], least: int, doubt: float) -> np.ndarray:
    """Term weights: how far a term is kept to one of ``n`` subjects, from 0 (in less than 45 % of its documents, of
    which there are ``doubt`` more in other subjects) to 1; terms of fewer than ``least`` documents
    have none. Counts stay in Spark, and only terms with a weight come to the driver."""
    counts = _sums(rows, BUCKETS, n + 1, lambda t, total: _count_terms(t, marks(t), total))
    most = F.greatest(F.lit(0.0), *(F.col(f"v{s}") for s in range(n))) / F.greatest(F.col(f"v{n}") + doubt, F.lit(1.0))
    weight = F.least(F.lit(1.0), (most - 0.45) / 0.45)
    found = counts.where(F.col(f"v{n}") >= least).select("row", weight.alias("weight")).where("weight > 0").toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("row").to_numpy()] = found.column("weight").to_numpy()
    return out


def _count_terms(t: pa.RecordBatch, subjects: np.ndarray, total: np.ndarray) -> None:
    doc, term, _ = flat(t)
    n = subjects.shape[1]
    for s in range(n):
        total[:, s] += np.bincount(term[subjects[doc, s]], minlength=BUCKETS)
    total[:, n] += np.bincount(term, minlength=BUCKETS)


def _weighted(rows: DataFrame, model: Model, old: Model | None) -> DataFrame:
    """A table of the weighted terms of each document, and in ``about`` the subject that the model of the round
    before found, if it found one only; what follows reads this smaller table."""
    held = rows.sparkSession.sparkContext.broadcast((model, old))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, was = held.value
        for t in batches:
            doc, row, value = new.rows(t)
            ends = pa.array(np.searchsorted(doc, np.arange(t.num_rows + 1)).astype(np.int32))
            which = _alone(was.assign(t)) if was else np.zeros((t.num_rows, 1), bool)
            d, about = np.nonzero(which)
            cut = pa.array(np.searchsorted(d, np.arange(t.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(row.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32))), pa.ListArray.from_arrays(cut, pa.array(about.astype(np.int32)))], ["terms", "times", "about"]
            )

    return materialize(rows.mapInArrow(over, "terms array<int>, times array<float>, about array<int>"))[0]


def _marks(t: pa.RecordBatch, column: str, n: int) -> np.ndarray:
    """A column of subject numbers as marks."""
    out = np.zeros((t.num_rows, n), bool)
    s = t.column(column)
    out[np.repeat(np.arange(t.num_rows), np.diff(s.offsets.to_numpy())), s.flatten().to_numpy()] = True
    return out


def _decompose(small: DataFrame, model: Model, passes: int) -> None:
    """Truncated singular value decomposition of the weighted terms of all documents by subspace
    iteration: each pass over the documents adds up X'XQ, which is then made orthonormal."""
    for _ in range(passes if len(model.used) else 0):
        held = small.sparkSession.sparkContext.broadcast(model)

        def add(t: pa.RecordBatch, total: np.ndarray, held=held) -> None:
            m = held.value
            doc, row, value, _ = m.unit(t)
            if not len(doc):
                return
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            y = np.repeat(np.add.reduceat(m.basis[row] * value[:, None], begin), np.diff(np.append(begin, len(doc))), axis=0) * value[:, None]
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(row, y[:, j], len(m.used))

        model.basis = np.linalg.qr(_sum(small, len(model.used), model.basis.shape[1], add))[0]


def _centroids(rows: DataFrame, model: Model, n: int, subjects: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, Model], np.ndarray], before: np.ndarray | None) -> np.ndarray:
    """Mean direction of the documents of each subject; one without documents keeps its centroid."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def add(t: pa.RecordBatch, total: np.ndarray) -> None:
        place, mass = held.value.embed(t)
        which = subjects(t, place, mass, held.value)
        total += (which & (mass > 0)[:, None]).T.astype(float) @ place

    c = _sum(rows, n, model.basis.shape[1], add) if model.basis.shape[1] else np.zeros((n, 0))
    size = np.linalg.norm(c, axis=1)
    if before is not None:
        c = np.where((size > 0)[:, None], c, before)
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]


def _alone(near: np.ndarray) -> np.ndarray:
    return near & (near.sum(axis=1) == 1)[:, None]


def subject_name(c):
    """One spelling: lower case, no blanks around."""
    return F.lower(F.trim(c))


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame, rounds: int = 3, passes: int = 4, refinements: int = 3, least: float = LEAST) -> DataFrame:
    """``doc_id``, ``subject``: none, one or two rows for each document.

    Each document becomes the counts of its terms, hashed to 2^18 buckets. The terms are weighted by
    how far they keep to one subject, the weighted documents are embedded by a truncated singular
    value decomposition over all documents, and a document is about the subjects whose centroids are
    near in cosine. The first centroids and weights are seeds, from at most ``MOST_LABELLED``
    labelled documents, chosen by hash, and the subjects' descriptions. They are refined: documents
    that are near one centroid only make the next centroids, and in each further round the weights and
    the decomposition are made from all documents as assigned by the last. What goes to the driver
    and to all tasks is the model, whose size is bounded by buckets and dimensions.

    Null and empty texts, and texts without weighted terms, have no row. Labels without a subject,
    of no known subject, or of no document are ignored; repeated ones count once. A subject without
    seeds is never assigned. Null ``doc_id`` rows are left out. No documents give no rows.
    """
    spark = documents.sparkSession
    spelled = {r.subject.strip().lower(): r.subject for r in subjects.where("subject is not null").select("subject").distinct().sort(F.desc("subject")).collect()}
    names = [spelled[s] for s in sorted(spelled)]
    number = {s: i for i, s in enumerate(sorted(spelled))}
    n = len(names)
    if not n:
        return documents.select("doc_id", F.lit("").alias("subject")).where("false")
    rows, _ = materialize(documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_features, FEATURES))
    index = spark.createDataFrame(list(number.items()), "subject string, i int")
    known = labels.where("doc_id is not null").select("doc_id", subject_name(F.col("subject")).alias("subject")).join(F.broadcast(index), "subject")
    some = known.groupBy("doc_id").agg(F.collect_set("i").alias("seeds")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    told = subjects.where("subject is not null").select(subject_name(F.col("subject")).alias("subject"), F.concat_ws(" ", "subject", "descr").alias("text")).join(F.broadcast(index), "subject")
    told = told.select((-1 - F.col("i")).cast("long").alias("doc_id"), "text", F.array("i").alias("seeds"))
    described = told.select("doc_id", "text").mapInArrow(_features, FEATURES).join(told.select("doc_id", "seeds"), "doc_id")
    seeds, _ = materialize(rows.join(some, "doc_id").unionByName(described))

    def seeded(t: pa.RecordBatch, *_) -> np.ndarray:
        return _marks(t, "seeds", n)

    model = None
    for k in range(rounds):
        if k:
            old = spark.sparkContext.broadcast(model)
            weights = _weights(rows, n, lambda t: old.value.assign(t), 2, 1.0)
        else:
            weights = _weights(seeds, n, seeded, 1, SEED_DOUBT)
        before, model = model, Model(weights, DIMS)
        small = _weighted(rows, model, before)
        _decompose(small, model, passes)
        model.centroids = _centroids(small, model, n, lambda t, *_: _marks(t, "about", n), None) if k else _centroids(seeds, model, n, seeded, None)
        for _ in range(refinements):
            model.centroids = _centroids(small, model, n, lambda t, place, mass, m: _alone(m.about(place, mass)), model.centroids)
    model.near = least
    held = spark.sparkContext.broadcast(model)

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            doc, s = np.nonzero(held.value.assign(t))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").take(pa.array(doc)), pa.array([names[i] for i in s], pa.string())], ["doc_id", "subject"])

    return rows.mapInArrow(say, "doc_id long, subject string")
