"""Subjects of documents by latent Dirichlet allocation.

Every document is counted once, as the words of it that the vocabulary holds. The vocabulary is what enough
documents hold, less the words that labelled documents of all subjects hold alike. Topics start from anchor words
(words whose neighbours no mix of other words' neighbours can make up) and are fitted in passes over all documents:
each pass is one narrow step that shares every document's words out over the topics, and one tree of sums of the
topics by words. Each topic as a whole is mapped to a subject by its top terms, which labelled documents tell of.
A document deals with the subjects whose topics hold enough of it by its topic proportions; a comparison or passing
remark is a word or two of many and stays below that share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import stored, widen


@dataclass(frozen=True)
class Plan:
    """How topics are fitted and read. All of it means the same at any number of documents."""

    topics: int = 96
    #: documents that must hold a word, as a share of all, for the vocabulary and for an anchor; at least `least_docs`.
    #: A vocabulary is so bounded by the distinct words of a mean document over this share.
    least_share: float = 0.0002
    anchor_share: float = 0.002
    least_docs: int = 3
    #: a word is no subject's own if so many labelled documents hold it and none of the subjects so much oftener than all,
    #: by that many standard deviations
    judged_docs: int = 6
    even_lift: float = 2.5
    even_sigmas: float = 3.0
    #: buckets of neighbouring words by which anchors are told apart, and neighbours counted at a time in a long text
    contexts: int = 1024
    window: int = 256
    passes: int = 4
    #: rounds over a document's proportions, in a pass and in the final reading
    rounds: int = 4
    final_rounds: int = 8
    alpha: float = 0.05
    eta: float = 0.02
    #: terms inspected of a topic, labelled documents that must hold a term, and what the subject must have of their weight
    top_terms: int = 25
    least_told: int = 1
    purity: float = 0.4
    #: label rows that are read at most, by hash: a bounded sample of labelled rows, which only inspects and never fits topics
    most_labelled: int = 50_000
    #: what a subject's topics must hold of a document: words' worth, and share of all its words
    words_worth: float = 0.8
    least_of_words: float = 0.03


_COUNTED = "doc_id bigint, size bigint, words array<string>, counts array<int>"
_BREAKS = str.maketrans(dict.fromkeys("'’`´-–—", " "))
_MARKS = ".,;:!?¡¿()[]{}<>\"“”„«»*#|…~=+"


def words(text: str | None) -> list[str]:
    """The lower-case words of a text: three letters and more; what holds a digit, slash or underscore is no word."""
    spaced = (text or "").lower().translate(_BREAKS).split()
    return [w for x in spaced if len(w := x.strip(_MARKS)) > 2 and w.isalpha()]


def document_words(documents: DataFrame) -> DataFrame:
    """doc_id, number of words, distinct words and how often each occurs; one row per row of `documents` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Counter(words(t)) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0), pa.array([c.total() for c in held], pa.int64()),
                pa.array([list(c) for c in held], pa.list_(pa.string())), pa.array([list(c.values()) for c in held], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "words", "counts"])

    return stored(widen(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(count, _COUNTED), "words")


def told_counts(docs: DataFrame, labels: DataFrame, plan: Plan) -> tuple[dict[str, dict[str, int]], dict[str, int], dict[str, int], int]:
    """By term and subject the labelled documents that hold it; labelled documents by subject, by term, and in all.

    At most `most_labelled` label rows are read, those of least hash, and only terms that enough documents hold come back.
    """
    some = labels.select(F.col("doc_id").cast("bigint"), "subject").where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).distinct()
    some = some.orderBy(F.xxhash64("doc_id", "subject"), "doc_id", "subject").limit(plan.most_labelled)
    told = stored(docs.select("doc_id", "words").join(F.broadcast(some.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))), "doc_id"), "told")
    sizes = {r["s"]: r["n"] for r in told.select(F.explode("subjects").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    terms = told.select(F.explode("words").alias("term"), "subjects")
    often = terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= plan.least_told)
    held = {r["term"]: r["n"] for r in often.collect()}
    seen: dict[str, dict[str, int]] = {}
    for r in terms.join(often.select("term"), "term").select("term", F.explode("subjects").alias("s")).groupBy("term", "s").agg(F.count("*").alias("n")).collect():
        seen.setdefault(r["term"], {})[r["s"]] = r["n"]
    return seen, sizes, held, told.count()


@dataclass
class Told:
    """What the labels say of the vocabulary: by term and subject the labelled documents, and the subjects' sizes."""

    subjects: list[str]
    seen: np.ndarray
    sizes: np.ndarray


def choose_vocabulary(docs: DataFrame, labels: DataFrame, plan: Plan, background: str) -> tuple[list[str], np.ndarray, Told]:
    """The words that enough documents hold and that labels don't show to be spread evenly; the documents of each; what labels say.

    Nothing is cut for being common: a subject of a third of the documents keeps its words.
    """
    seen, sizes, held, labelled = told_counts(docs, labels, plan)
    low = max(plan.least_docs, int(plan.least_share * docs.count()))
    often = docs.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= low)
    names = [*sorted(sizes.keys() - {background}), background]
    kept, rows = [], []
    for r in sorted(often.collect(), key=lambda r: (-r["n"], r["term"])):
        by = seen.get(r["term"], {})
        n = held.get(r["term"], 0)
        expected = {s: n * sizes[s] / labelled for s in names[:-1]} if n else {}
        own = any(by.get(s, 0) + 1 >= plan.even_lift * (e + 1) and by.get(s, 0) - e >= plan.even_sigmas * e**0.5 for s, e in expected.items())
        if n < plan.judged_docs or own or not expected:
            kept.append((r["term"], r["n"]))
            rows.append([by.get(s, 0) for s in names])
    table = np.array(rows, dtype=float).reshape(len(kept), len(names))
    return [t for t, _ in kept], np.array([n for _, n in kept]), Told(names, table, np.array([sizes.get(s, 0) for s in names], dtype=float))


def count_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, number of words, and the vocabulary's terms in it with their counts; every document has its row."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: pa.Array | None = None
        for batch in batches:
            lists, counts = batch.column(2), batch.column(3).flatten()
            held = lists.flatten()
            of = pa.array(known.value, held.type) if of is None else of
            term = pc.index_in(held, value_set=of)
            keep = term.is_valid()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sizes = np.bincount(row[keep.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            begins = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            columns = [batch.column(0), batch.column(1), *[pa.ListArray.from_arrays(begins, x.filter(keep)) for x in (term, counts)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "terms", "counts"])

    return stored(docs.mapInArrow(look_up, "doc_id bigint, size bigint, terms array<int>, counts array<int>"), "counts")


def _blocks(batch: pa.RecordBatch, terms: int, counts: int, cells: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch that fit a processor's cache: rows that hold terms, where each begins, the terms and counts."""
    lists = batch.column(terms)
    ends = lists.offsets.to_numpy()
    t, c = lists.values.to_numpy(zero_copy_only=False), batch.column(counts).values.to_numpy(zero_copy_only=False).astype(np.float32)
    cuts = [0]
    while cuts[-1] < len(ends) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + cells, side="right")) - 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        full = np.flatnonzero(np.diff(ends[a : b + 1]))
        if len(full):
            yield a + full, ends[a:b][full] - ends[a], t[ends[a] : ends[b]], c[ends[a] : ends[b]]


def _summed(counted: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all batches of what `add` puts into an array of this shape: one array per task, added up as a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = counted.mapInArrow(partial, "part binary").rdd.map(lambda r: np.frombuffer(r[0], np.float32).astype(np.float64))
    return parts.treeReduce(np.add).reshape(shape) if parts.getNumPartitions() else np.zeros(shape)


def anchor_topics(counted: DataFrame, often: np.ndarray, docs: int, plan: Plan) -> np.ndarray:
    """Topics to start from, by topic and term: the neighbours of anchor words.

    Words of at least `anchor_share` of the documents are candidates. Their neighbours, in `contexts` buckets, are
    counted over all documents, every document weighing the same; of the candidates each anchor is the one that
    lies farthest from what the anchors before it span.
    """
    v = len(often)
    able = np.flatnonzero(often >= max(plan.least_docs, plan.anchor_share * docs))
    if len(able) < 1:
        return np.zeros((0, v))
    place = np.full(v, -1)
    place[able] = np.arange(len(able))
    width, window = min(plan.contexts, v), plan.window

    def pairs(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, begin, t, _ in _blocks(batch, 2, 3):
            ends = np.r_[begin[1:], len(t)]
            for b, e in ((x, min(x + window, e)) for b, e in zip(begin, ends, strict=True) for x in range(b, e, window)):
                own = t[b:e]
                if (m := len(own)) > 1:
                    left = place[own]
                    which = np.flatnonzero(left >= 0)
                    near = own % width
                    np.add.at(total, (np.repeat(left[which], m), np.tile(near, len(which))), 1.0 / (m * (m - 1)))
                    total[left[which], near[which]] -= 1.0 / (m * (m - 1))

    q = np.maximum(_summed(counted, (len(able), width), pairs), 0)
    rows = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-12)
    far = np.sqrt(rows)
    chosen = [int((far**2).sum(axis=1).argmax())]
    far = far - far[chosen[0]]
    while len(chosen) < min(plan.topics, len(able)):
        norm = (far**2).sum(axis=1)
        j = int(norm.argmax())
        if norm[j] < 1e-9:
            break
        chosen.append(j)
        u = far[j] / np.sqrt(norm[j])
        far = far - np.outer(far @ u, u)
    overall = np.maximum(q.sum(axis=0) / max(q.sum(), 1e-12), 1e-12)
    near = rows[chosen]
    near = np.where(near > overall, near, 0.1 * near)[:, np.arange(v) % width]
    near[np.arange(len(chosen)), able[chosen]] = near.max(axis=1)
    near += 1e-5
    return near / near.sum(axis=1, keepdims=True)


def shares(phi: np.ndarray, begin: np.ndarray, t: np.ndarray, c: np.ndarray, rounds: int, alpha: float) -> np.ndarray:
    """By place in `t` and topic: how many of the term's occurrences in its document each topic has, by the document's proportions."""
    p = phi[t]
    who = np.zeros(len(t), np.int64)
    who[begin[1:]] = 1
    who = np.cumsum(who)
    theta = np.full((len(begin), phi.shape[1]), 1.0 / phi.shape[1], np.float32)
    for _ in range(rounds):
        x = c / np.maximum(np.einsum("ij,ij->i", p, theta[who]), 1e-30)
        theta *= np.add.reduceat(p * x[:, None], begin, axis=0)
        theta += np.float32(alpha)
        theta /= theta.sum(axis=1, keepdims=True)
    r = p * theta[who]
    r *= (c / np.maximum(r.sum(axis=1), 1e-30))[:, None]
    return r


def fit_topics(counted: DataFrame, start: np.ndarray, plan: Plan) -> np.ndarray:
    """Topics by term and topic after `passes` passes, each of which reads every document once."""
    phi = start.T.astype(np.float32)
    for _ in range(plan.passes):
        now = counted.sparkSession.sparkContext.broadcast(phi)

        def weigh(total: np.ndarray, batch: pa.RecordBatch, now=now) -> None:
            for _, begin, t, c in _blocks(batch, 2, 3):
                r = shares(now.value, begin, t, c, plan.rounds, plan.alpha)
                o = np.argsort(t, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(t[o]) > 0])
                total[t[o][first]] += np.add.reduceat(r[o], first, axis=0)

        held = _summed(counted, phi.shape, weigh) + plan.eta
        phi = (held / held.sum(axis=0)).astype(np.float32)
        now.unpersist()
    return phi


def map_topics(phi: np.ndarray, told: Told, plan: Plan) -> np.ndarray:
    """The number of each topic's subject: that which most of its top terms' weight is about, if it has enough of it.

    A term is about the subjects whose labelled documents hold it, by their rates.
    """
    rate = told.seen / np.maximum(told.sizes, 1)
    about = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
    about[told.seen.sum(axis=1) < plan.least_told] = 0.0
    none = len(told.subjects) - 1
    out = np.full(phi.shape[1], none)
    for k in range(phi.shape[1]):
        top = np.argsort(-phi[:, k], kind="stable")[: plan.top_terms]
        w = phi[top, k] * (about[top].sum(axis=1) > 0)
        score = w @ about[top] / max(w.sum(), 1e-12)
        if score.max() >= plan.purity:
            out[k] = score.argmax()
    return out


@dataclass
class SubjectModel:
    """Topics by term and topic, the subject of each topic, and the vocabulary. The last of `subjects` is the background."""

    phi: np.ndarray
    of: np.ndarray
    subjects: list[str]
    vocabulary: list[str]
    plan: Plan


def fit(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), background: str = "software") -> tuple[SubjectModel, DataFrame]:
    """A model fitted on all of `docs` (from document_words) and mapped by `labels` (doc_id, subject); and their count vectors."""
    vocabulary, often, told = choose_vocabulary(docs, labels, plan, background)
    counted = count_vectors(docs, vocabulary)
    phi = fit_topics(counted, anchor_topics(counted, often, docs.count(), plan), plan)
    return SubjectModel(phi, map_topics(phi, told, plan), told.subjects, vocabulary, plan), counted


def assign(model: SubjectModel, counted: DataFrame) -> DataFrame:
    """doc_id and subject, one row per subject of each document of `counted`; the background if there is none.

    Each word is shared out over the topics by the document's topic proportions; a subject is dealt with whose topics
    get at least `words_worth` words and `least_of_words` of all words of the document. A document whose words are
    all outside the vocabulary, or whose text is null or empty, has the background. Repeated ids give each row's subjects.
    """
    spark, plan, names, none = counted.sparkSession, model.plan, model.subjects, len(model.subjects) - 1
    phi, into = spark.sparkContext.broadcast(model.phi), np.zeros((len(model.of), none), np.float32)
    told = model.of < none
    into[np.flatnonzero(told), model.of[told]] = 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy()
            worth = np.zeros((batch.num_rows, none), np.float32)
            if len(into) and none:
                for row, begin, t, c in _blocks(batch, 2, 3):
                    worth[row] = np.add.reduceat(shares(phi.value, begin, t, c, plan.final_rounds, plan.alpha) @ into, begin, axis=0)
            row, subject = np.nonzero((worth >= plan.words_worth) & (worth >= plan.least_of_words * size[:, None]))
            bare = np.setdiff1d(np.arange(batch.num_rows), row)
            ids = batch.column(0).take(pa.array(np.r_[row, bare]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([names[s] for s in subject] + [names[none]] * len(bare), pa.string())], names=["doc_id", "subject"])

    return counted.mapInArrow(deal, "doc_id bigint, subject string")
