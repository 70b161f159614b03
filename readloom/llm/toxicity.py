"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are distinct labelled texts that are not held out, drawn by a hash of the text,
about `per_label` of each label (the bound of the fit); what a label was thinned by is
its weight in votes. Terms are lower-cased words whose chi-square with the label, over
the examples, is at least `chi_square` and that one label has in at least `lift` times
the share of its examples; the `most_terms` of highest chi-square are kept. Document
frequencies of the terms, and the number of documents, are counted over all documents.

Index. Examples are numbered so that those with the same heaviest term lie together, in
blocks of BLOCK. Each term has its postings in order of number, cut at the block
borders, with the largest weight of each cut. A query adds up these maxima into one
bound per block, reads the blocks from the highest bound down, scores all their examples
exactly, and ends when the next bound is below the k-th best cosine. Blocks that share
no term are never touched. Ties go to the smaller number.

Votes. Neighbours vote with their cosine times their weight, against a fixed mass of
`prior` that votes as all examples do; a text near nothing gets about the share of toxic
documents. The vote is calibrated by isotonic regression on the examples' own votes,
each taken without the example itself. The evidence of a score is its neighbours.

A score depends on the text and the index only. The index is broadcast: at most
2 * `per_label` examples, and no more of them than have `most_postings` postings together.

Defined results: null, empty and wordless texts get the score of no neighbour; a null
label is none, a text with several labels has their mean, rounded half up; repeated rows
give equal results each; a null id is held out; without examples every score is 0; other
columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import pieces, stash, unstash
from readloom.llm.langid import held_out

WORD = re.compile(r"\w+")
BLOCK = 32  # examples
STEP = 8  # blocks that are scored at first, then twice as many each time


def counted(text: str | None) -> Counter:
    """The words of a text and how often each comes."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the spans one after the other, and the span of each."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[which], which


class Index:
    """Block-max inverted index over unit vectors of examples."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[dict[int, int]], ids: list, label: np.ndarray, weight: np.ndarray):
        """examples: per example the counts of its terms."""
        self.terms = {t: k for k, t in enumerate(terms)}
        self.idf = idf
        vectors = [self._vector(e) for e in examples]
        heavy = [int(t[np.argmax(w)]) if len(t) else len(terms) for t, w in vectors]
        order = np.lexsort((np.arange(len(vectors)), heavy))
        self.ids, self.label, self.weight = [ids[k] for k in order.tolist()], label[order], weight[order]
        self.place = np.argsort(order)  # of each example as given
        self.base = float((self.label * self.weight).sum() / max(1e-12, self.weight.sum()))
        vectors = [vectors[k] for k in order.tolist()]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        value = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        by_term = np.lexsort((example, term))
        term, self.example, self.value = term[by_term], example[by_term], value[by_term]
        block = self.example // BLOCK
        head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
        self.cut = np.append(head, len(term))  # where the postings of a term in a block begin
        self.cut_block = block[head]
        self.cut_max = np.maximum.reduceat(self.value, head) if len(head) else np.zeros(0)
        self.of_term = np.searchsorted(term[head], np.arange(len(terms) + 1))
        self.blocks = -(-len(vectors) // BLOCK)

    def _vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        term = np.array(sorted(counts), np.int64)
        weight = np.array([1 + math.log(counts[t]) for t in term.tolist()]) * self.idf[term]
        size = math.sqrt(float((weight * weight).sum()))
        return (term, weight / size) if size else (term[:0], weight[:0])

    def query(self, words: Counter) -> dict[int, int]:
        return {self.terms[w]: words[w] for w in self.terms.keys() & words.keys()}

    def nearest(self, counts: dict[int, int], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers, cosines, blocks read) of the k nearest examples with a cosine above 0."""
        term, weight = self._vector(counts)
        at, which = _spans(self.of_term[term], self.of_term[term + 1])
        best, cosine, read = np.zeros(0, np.int64), np.zeros(0), 0
        if not len(at):
            return best, cosine, read
        bound = np.bincount(self.cut_block[at], weight[which] * self.cut_max[at], self.blocks)
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        reach = bound[order] * (1 + 1e-9) + 1e-12  # sums are rounded in another order
        slot = np.full(self.blocks, -1)
        while read < len(order) and (len(best) < k or reach[read] >= cosine[-1]):
            now = order[read : read + max(STEP, read)]
            read += len(now)
            slot[now] = np.arange(len(now))
            own = slot[self.cut_block[at]] >= 0
            place, cut = _spans(self.cut[at[own]], self.cut[at[own] + 1])
            number = self.example[place]
            score = np.bincount(slot[number // BLOCK] * BLOCK + number % BLOCK, weight[which[own]][cut] * self.value[place], len(now) * BLOCK)
            slot[now] = -1
            hit = np.flatnonzero(score > 0)
            number = now[hit // BLOCK] * BLOCK + hit % BLOCK
            hit, number = hit[number != without], number[number != without]
            best, cosine = np.concatenate([best, number]), np.concatenate([cosine, score[hit]])
            top = np.lexsort((best, -cosine))[:k]
            best, cosine = best[top], cosine[top]
        return best, cosine, read


class Votes:
    """Distance-weighted votes of the k nearest examples, calibrated."""

    def __init__(self, index: Index, k: int, prior: float):
        self.index, self.k, self.prior = index, k, prior
        self.knots, self.levels = np.zeros(0), np.zeros(0)

    def vote(self, counts: dict[int, int], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        number, cosine, _ = self.index.nearest(counts, self.k, without)
        mass = cosine * self.index.weight[number]
        vote = (float((mass * self.index.label[number]).sum()) + self.prior * self.index.base) / (float(mass.sum()) + self.prior)
        return vote, number, cosine

    def calibrate(self, votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Isotonic regression: neighbouring votes are pooled until the share of label 1 never falls."""
        pools: list[list[float]] = []  # weight, weight of label 1, weighted sum of votes
        order = np.argsort(votes, kind="stable")
        for v, y, w in zip(votes[order].tolist(), label[order].tolist(), weight[order].tolist()):
            pools.append([w, w * y, w * v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.knots = np.array([v / w for w, _, v in pools])
        self.levels = np.array([y / w for w, y, _ in pools])

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        vote, number, cosine = self.vote(self.index.query(counted(text)))
        return float(np.interp(vote, self.knots, self.levels)) if len(self.knots) else vote, number, cosine


def examples(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """id, text, label, weight of the distinct labelled texts that are learned from.

    docs: id, text; labels: id, label. Texts are drawn by their hash before any text is
    shuffled on its own account, so a text with thousands of copies meets as one row.
    """
    known = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.avg("label").alias("label"))
    rows = docs.where(~held_out("id") & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    hashes = rows.select("id", "h").join(known, "id").groupBy("h").agg(F.floor(F.avg("label") + 0.5).cast("int").alias("label"), F.min("id").alias("id"))
    hashes = stash(hashes, "labelled")
    sizes = {r.label: r.n for r in hashes.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    drawn = hashes.withColumn("share", share).where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    texts = rows.select("id", "h", "text").join(F.broadcast(drawn), ["id", "h"])  # about 2 * per_label rows of numbers
    return texts.dropDuplicates(["id", "h"]).select("id", "text", F.col("label").cast("double").alias("label"), (1 / F.col("share")).alias("weight"))


def _terms(rows: DataFrame, to: str, of_part) -> DataFrame:
    """rows (id, text, ...) through of_part(record batch) -> record batch, in parts of bounded size."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                yield of_part(part)

    return rows.mapInArrow(run, to)


def learn(docs: DataFrame, labels: DataFrame, *, per_label: int = 4096, most_terms: int = 20000, most_postings: int = 1_000_000, least_examples: int = 5, chi_square: float = 20.0, lift: float = 2.0, k: int = 30, prior: float = 1.0) -> Votes | None:
    """The votes of the labelled examples; docs: id, text; labels: id, label."""
    spark = docs.sparkSession
    own = stash(examples(docs, labels, per_label), "examples")
    n = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    toxic, clean = n.get(1.0, 0), n.get(0.0, 0)

    def words_of(part):
        found = [counted(t) for t in part.column("text").to_pylist()]
        size = [len(c) for c in found]
        repeat = np.repeat(np.arange(len(found)), size)
        keep = [part.column(c).take(pa.array(repeat)) for c in ("id", "label", "weight")]
        return pa.record_batch([*keep, pa.array([w for c in found for w in c], pa.string()), pa.array([x for c in found for x in c.values()], pa.int64())], names=["id", "label", "weight", "term", "tf"])

    words = stash(_terms(own, "id long, label double, weight double, term string, tf long", words_of), "words")
    a, b = F.col("a"), F.col("b")
    observed = F.pow(a * (clean - b) - b * (toxic - a), 2) * (toxic + clean)
    expected = (a + b) * (toxic + clean - a - b) * float(max(1, toxic)) * float(max(1, clean))
    chi = observed / F.greatest(F.lit(1.0), expected)
    table = words.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).withColumn("chi", chi)
    share = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
    terms = [r.term for r in table.where((a + b >= least_examples) & (F.col("chi") >= chi_square) & ((share >= lift) | (share <= 1 / lift))).orderBy(F.desc("chi"), "term").limit(most_terms).select("term").collect()]
    terms.sort()
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def frequencies(batches):
        """One row a term that the task has seen, and its number of documents."""
        number, seen, total = shared.value, np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                total += part.num_rows
                for t in part.column("text").to_pylist():
                    if t:
                        seen[[number[w] for w in number.keys() & set(WORD.findall(t.lower()))]] += 1
        seen[-1] = total
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    df = np.zeros(len(terms) + 1)
    for r in docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1]))

    # Postings of the examples, the bound on the index: whole examples in the order of a hash.
    held = words.join(F.broadcast(spark.createDataFrame([(t, i) for t, i in shared.value.items()], "term string, number int")), "term", "left")
    held = held.groupBy("id", "label", "weight").agg(F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "tf")))).alias("terms"))
    held = held.withColumn("before", F.sum(F.size("terms")).over(Window.orderBy(F.xxhash64("id"), "id")))
    got = held.where(F.col("before") <= most_postings).orderBy("id").select("id", "label", "weight", "terms.number", "terms.tf").toArrow()
    counts = [dict(zip(t.tolist(), c.tolist())) for t, c in zip(_lists(got.column("number")), _lists(got.column("tf")))]
    index = Index(terms, idf, counts, got.column("id").to_pylist(), got.column("label").to_numpy(), got.column("weight").to_numpy())
    votes = Votes(index, k, prior)
    calibrate(spark, votes, counts)
    unstash(words)
    unstash(own)
    return votes


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for c in column.chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(c).to_numpy())[:-1])]


def calibrate(spark, votes: Votes, counts: list[dict[int, int]]) -> None:
    """Votes of all examples, each without itself, found by the workers."""
    shared = spark.sparkContext.broadcast((votes, counts))

    def run(batches):
        own, counts = shared.value
        for batch in batches:
            given = batch.column("id").to_pylist()
            found = [own.vote(counts[k], int(own.index.place[k]))[0] for k in given]
            yield pa.record_batch([pa.array(own.index.place[given], pa.int64()), pa.array(found, pa.float64())], names=["place", "vote"])

    done = {r.place: r.vote for r in spark.range(len(counts)).mapInArrow(run, "place long, vote double").collect()}
    votes.calibrate(np.array([done[k] for k in range(len(done))]), votes.index.label, votes.index.weight)


def score(docs: DataFrame, votes: Votes | None, *, threshold: float = 0.3, shown: int = 3) -> DataFrame:
    """docs (id, text) as id, score, predicted, and the ids, cosines and labels of the `shown` nearest examples."""
    schema = "id long, score double, predicted int, near_ids array<long>, near_cosines array<double>, near_labels array<int>"
    shared = docs.sparkSession.sparkContext.broadcast(votes)

    def run(part):
        out = []
        for text in part.column("text").to_pylist():
            value, number, cosine = shared.value.score(text) if shared.value else (0.0, np.zeros(0, int), np.zeros(0))
            near = number[:shown].tolist()
            out.append((value, [shared.value.index.ids[k] for k in near], cosine[:shown].tolist(), [int(shared.value.index.label[k]) for k in near]))
        value, ids, cosines, own = zip(*out) if out else ((),) * 4
        value = pa.array(value, pa.float64())
        return pa.record_batch([part.column("id"), value, pa.compute.greater_equal(value, threshold).cast(pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())), pa.array(own, pa.list_(pa.int32()))], names=["id", "score", "predicted", "near_ids", "near_cosines", "near_labels"])

    return _terms(docs, schema, run)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest examples of every row of docs; labels names ids and their label."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    done = score(rows, learn(rows, known, **options), threshold=threshold)
    return done.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted", "near_ids", "near_cosines", "near_labels")
