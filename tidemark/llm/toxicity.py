"""Toxicity scores by weak supervision: many voters, a generative model of their votes, a linear classifier on its labels.

Voters. Terms of a text are its distinct lower-cased words, and the beginnings of three to seven letters that one, two or three of them share.
Terms that are clearly more common in labelled toxic than in labelled clean texts (lower confidence limit of the log ratio of
document shares) are dealt by rank into ``LISTS`` lexicons, short ones first; a lexicon votes toxic on a text with one of its
terms. Pattern voters look at shouting, masked words, letters repeated four times, exclamation marks, forms of address, a short list of insults, notices,
tables, and at how many terms are in any lexicon. A voter votes toxic (2), clean (1) or not at all (0).

Label model. Given the class, votes follow a tree: each voter's vote depends on one other's, so voters that see the same thing are
not counted twice. Class shares, the voters' vote rates (their accuracies) and the tree of their strongest correlations (largest conditional
mutual information) are estimated by expectation maximisation. Rows whose label may be learned from hold it fixed, all others take
part with their posterior. A step sums weighted pair counts over distinct vote patterns: tables of fixed size that merge by addition.

Classifier. A logistic regression with a lasso penalty (``pyspark.ml``) over the terms and patterns is fitted to the posteriors given votes
alone, and gives the scores. Bounds of the fit: the lexicons are learned from about ``fit_rows`` labelled rows of each class, the
regression from about ``fit_rows`` rows of each posterior class and from its ``features`` clearest terms; rows are taken by hash and
the classes weighted back to their share. Copies and near copies (equal smallest hashes of neighbouring words) count as one text in learning terms. Votes,
label model and scores cover all rows. Texts are read by four scans and only the bounded samples are moved.

Null text counts as empty and scores as the classifier's intercept. Whole texts are used, of any length. Rows are scored one by one, repeated ones
alike. A doc_id with several labels takes the majority, toxic on a tie; other values than 0 and 1 and null doc_ids are ignored. Without
labels the fixed voters alone teach the model; where posteriors show no second class, every score is the share of toxic posteriors.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base

LISTS = 16
#: Words that open a vote without any label, in the four languages of the corpus.
INSULTS = {"asshole", "bastard", "bitch", "idiot", "moron", "scum", "stupid", "trash", "arschloch", "dummkopf", "idiota", "imbécile", "cabrón", "estúpido", "connard", "salaud"}
ADDRESS = {"you", "your", "du", "dich", "dein", "tu", "toi", "vous", "te", "usted"}
PATTERNS = ["shouting", "exclaiming", "masked", "stretched", "address", "insults", "notice", "table", "dense", "quiet"]
VOTERS = [*[f"lexicon_{i}" for i in range(LISTS)], *PATTERNS]

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*#@$]{2,}[^\W\d_]")
_STEMS = range(3, 8)
_HELD = 400_000


def words_of(text: str | None) -> set[str]:
    """Distinct runs of letters, lower-cased."""
    tokens = set((text or "").lower().split())
    words = {t for t in tokens if t.isalpha()}
    words.update(_WORD.findall(" ".join(tokens - words)))
    return words


def terms_of(words: set[str]) -> set[str]:
    """Distinct words and beginnings: ``ab*`` of one longer word, also ``ab**`` and ``ab***`` if two and three share it."""
    shared: Counter[str] = Counter()
    for n in _STEMS:
        shared.update([w[:n] for w in words if len(w) > n])
    return words.union(*[[s + "*" * k for s, c in shared.items() if c >= k] for k in (1, 2, 3)])


class Vocabulary:
    """Finds the terms of a text that are among ``terms``; most words are told apart by their first letters."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = set(terms)
        self.words = {t for t in self.terms if not t.endswith("*")}
        self.stems = {t.rstrip("*") for t in self.terms - self.words}
        self.openings = {s[: _STEMS[0]] for s in self.stems}

    def within(self, words: set[str]) -> set[str]:
        near = [w for w in words if w[: _STEMS[0]] in self.openings]
        shared = Counter([s for n in _STEMS for w in near if len(w) > n and (s := w[:n]) in self.stems])
        found = {t for s, c in shared.items() for k in (1, 2, 3) if c >= k and (t := s + "*" * k) in self.terms}
        return found | (words & self.words)


def _patterns(text: str, words: set[str], n_hits: int) -> list[str]:
    """Votes of ``PATTERNS``."""
    plain = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    capitals = int(np.count_nonzero((plain >= 65) & (plain <= 90)))
    letters = np.where(((plain | 32) >= 97) & ((plain | 32) <= 122), plain | 32, 0)
    runs = (letters[3:] == letters[:-3]) & (letters[2:-1] == letters[:-3]) & (letters[1:-2] == letters[:-3]) & (letters[:-3] > 0)
    low = text.lower()
    toxic = [
        capitals >= 20 and capitals * 3 > len(text), text.count("!") >= 3, any(c in text for c in "*#@$") and bool(_MASKED.search(text)), bool(runs.any()),
        not words.isdisjoint(ADDRESS), not words.isdisjoint(INSULTS),
    ]
    clean = [any(w in low for w in ("license", "licence", "copyright")), text.count("|") * 20 > len(text)]
    votes = ["2" if v else "0" for v in toxic] + ["1" if v else "0" for v in clean]
    return [*votes, "2" if n_hits >= 2 and n_hits * 50 > len(words) else "0", "1" if n_hits == 0 and len(words) >= 50 else "0"]


def votes_of(text: str | None, lists: dict[str, int], vocabulary: Vocabulary) -> str:
    """One digit for each of ``VOTERS``."""
    words = words_of(text)
    hits = vocabulary.within(words)
    mine = {lists[t] for t in hits}
    return "".join(["2" if i in mine else "0" for i in range(LISTS)] + _patterns(text or "", words, len(hits)))


def features_of(text: str | None, vocabulary: Vocabulary) -> set[str]:
    """Terms within a vocabulary, and ``@`` with the name of each pattern that votes without the lexicons."""
    words = words_of(text)
    votes = zip(PATTERNS[:-2], _patterns(text or "", words, 0), strict=False)
    return vocabulary.within(words) | {f"@{name}" for name, vote in votes if vote != "0"}


def signature(text: str | None) -> str:
    """The same for most near copies and for few other texts: the two smallest hashes of neighbouring words."""
    words = (text or "").lower().split()
    hashes = [xxhash.xxh64_intdigest(f"{a} {b}") for a, b in set(zip(words, words[1:], strict=False))]
    return " ".join(map(str, nsmallest(2, hashes) or words))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([signature(t) for t in texts], pa.string())], ["text", "toxic", "sig"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n1, n0): weighted toxic and clean texts with a term, in parts that are to be summed."""
    names = ["term", "n1", "n0"]
    toxic, clean = Counter(), Counter()

    def given() -> pa.RecordBatch:
        terms = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([float(c[t]) for t in terms], pa.float64()) for c in (toxic, clean)]], names)

    for batch in batches:
        for text, p, weight in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            terms = terms_of(words_of(text))
            for counts, share in ((toxic, p * weight), (clean, (1 - p) * weight)):
                if share > 1e-3:
                    for t in terms:
                        counts[t] += share
            if len(toxic) + len(clean) > _HELD:
                yield given()
                toxic.clear()
                clean.clear()
    yield given()


def learn_terms(rows: DataFrame, most: int, least: float = 3.0, ratio: float = 1.5) -> list[str]:
    """Terms of toxic texts by falling confidence: in ``least`` of them, with a log ratio to clean ones clearly above ``ratio``.

    ``rows`` has text and toxic, a share of 0 to 1. Texts with one signature count as one.
    """
    signed = base.stage(rows.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(_signatures, "text string, toxic double, sig string"), "term-texts")
    sizes = signed.groupBy("sig").agg((1 / F.count("*")).alias("weight"))  # at most the sample's rows
    weighted = signed.join(sizes, "sig").select("text", "toxic", "weight")
    totals = weighted.agg(F.coalesce(F.sum(F.col("toxic") * F.col("weight")), F.lit(0.0)), F.coalesce(F.sum((1 - F.col("toxic")) * F.col("weight")), F.lit(0.0))).first()
    counts = weighted.mapInArrow(_term_counts, "term string, n1 double, n0 double").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    lower = F.round(F.log(a / (totals[0] + 1)) - F.log(b / (totals[1] + 1)) - 1.64 * F.sqrt(1 / a + 1 / b), 9)
    clear = counts.where(F.col("n1") >= least).withColumn("lower", lower).where(F.col("lower") > ratio)
    return [r["term"] for r in clear.orderBy(F.desc("lower"), "term").limit(most).select("term").collect()]  # at most ``most``


def dealt_into_lists(terms: list[str]) -> dict[str, int]:
    """The list of each term: the clearest in short lists of their own, each list longer than the one before."""
    return {t: min(LISTS - 1, int(2 * math.log2(i / 8 + 1))) for i, t in enumerate(terms)}


def _vote(lists: dict[str, int]):
    vocabulary = Vocabulary(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [votes_of(t.as_py(), lists, vocabulary) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.string())], ["doc_id", "key", "votes"])

    return run


@dataclass
class LabelModel:
    """Class shares, each voter's parent in the tree, and vote rates by class, parent's vote and own vote."""

    share: np.ndarray
    parents: list[int | None]
    rates: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of toxic against clean for rows of votes."""
        total = np.full(len(votes), np.log(self.share[1]) - np.log(self.share[0]))
        for j, parent in enumerate(self.parents):
            above = votes[:, parent] if parent is not None else np.zeros(len(votes), dtype=np.uint8)
            total += np.log(self.rates[j, 1, above, votes[:, j]]) - np.log(self.rates[j, 0, above, votes[:, j]])
        return total

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -500, 500)))


def fit_label_model(pairs: np.ndarray) -> LabelModel:
    """The model of summed pair counts: class, voter, vote, voter, vote."""
    n_voters = pairs.shape[1]
    own = np.stack([pairs[:, j, :, j, :].diagonal(axis1=1, axis2=2) for j in range(n_voters)], axis=1)  # class, voter, vote
    sizes = own[:, 0].sum(axis=1)
    alone = (own + 0.5) / (sizes[:, None, None] + 1.5)
    # conditional mutual information of each pair of voters given the class
    joint = (pairs + alone[:, :, :, None, None] * alone[:, None, None]) / (sizes[:, None, None, None, None] + 1)
    apart = joint.sum(axis=4, keepdims=True) * joint.sum(axis=2, keepdims=True)
    shared = np.tensordot((sizes + 1) / (sizes + 1).sum(), (joint * np.log(joint / apart)).sum(axis=(2, 4)), axes=1)
    parents: list[int | None] = [None] * n_voters
    reach = {j: 0 for j in range(1, n_voters)}
    while reach:  # the spanning tree of the largest information
        j = max(reach, key=lambda k: (round(shared[reach[k], k], 12), -k))
        parents[j] = reach.pop(j)
        for k in reach:
            if shared[j, k] > shared[reach[k], k]:
                reach[k] = j
    rates = np.repeat(alone.transpose(1, 0, 2)[:, :, None], 3, axis=2)
    for j, parent in enumerate(parents):
        if parent is not None:
            together = pairs[:, parent, :, j, :]
            rates[j] = (together + alone[:, j][:, None]) / (together.sum(axis=2, keepdims=True) + 1)
    return LabelModel((sizes + 1) / (sizes + 1).sum(), parents, rates)


def _digits(column: pa.Array) -> np.ndarray:
    joined = "".join(column.to_pylist()).encode()
    return (np.frombuffer(joined, dtype=np.uint8) - 48).reshape(len(column), len(VOTERS))


def _pair_counts(model: LabelModel | None, anchored: bool):
    """(cell, value): pair counts by class of a task's patterns (votes, label, n).

    Before there is a model, labels alone count; without any, rows with two toxic votes pass for toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * len(VOTERS), 3 * len(VOTERS)))
        for batch in batches:
            votes, n = _digits(batch.column(0)), batch.column(2).to_numpy().astype(float)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(label)
            if model is not None:
                toxic, weight = model.posterior(votes), n
            elif anchored:
                toxic, weight = np.zeros(len(n)), n * known
            else:
                toxic, weight = np.where((votes == 2).sum(axis=1) >= 2, 0.9, 0.05), n
            toxic = np.where(known, label, toxic)
            hot = (votes[:, :, None] == np.arange(3)).reshape(len(n), -1).astype(float)
            for y, share in enumerate((1 - toxic, toxic)):
                total[y] += (hot * (weight * share)[:, None]).T @ hot
        flat = total.ravel()
        found = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(flat[found])], ["cell", "value"])

    return run


def learn_label_model(patterns: DataFrame, rounds: int = 12, settled: float = 1e-3) -> LabelModel:
    """From distinct patterns (votes, label, n); ``label`` is null where it is unknown or may not be used."""
    anchored = patterns.where("label = 1").limit(1).count() > 0
    model = None
    for _ in range(rounds):
        summed = patterns.select("votes", "label", "n").mapInArrow(_pair_counts(model, anchored), "cell long, value double")
        pairs = np.zeros(2 * (3 * len(VOTERS)) ** 2)
        for cell, value in summed.groupBy("cell").agg(F.sum("value")).collect():  # a fixed number of cells
            pairs[cell] = value
        found = fit_label_model(pairs.reshape(2, len(VOTERS), 3, len(VOTERS), 3))
        moved = 1.0 if model is None else max(np.abs(found.share - model.share).max(), np.abs(found.rates - model.rates).max())
        model = found
        if moved < settled:
            break
    return model


def voter_report(model: LabelModel) -> list[tuple[str, float, float, str | None]]:
    """(voter, share of toxic texts it calls toxic, share of clean texts it calls toxic, the voter it depends on)."""
    out, marginal = [], {}
    order = sorted(range(len(VOTERS)), key=lambda j: _depth(model.parents, j))
    for j in order:
        parent = model.parents[j]
        marginal[j] = model.rates[j][:, 0] if parent is None else np.einsum("ya,yab->yb", marginal[parent], model.rates[j])
        out.append((VOTERS[j], float(marginal[j][1, 2]), float(marginal[j][0, 2]), None if parent is None else VOTERS[parent]))
    return sorted(out)


def _depth(parents: list[int | None], j: int) -> int:
    return 0 if parents[j] is None else 1 + _depth(parents, parents[j])


def _posteriors(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.posterior(_digits(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "key", "toxic"])

    return run


def _majority(labels: DataFrame) -> DataFrame:
    graded = base.pick(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null")
    return graded.groupBy("doc_id").agg((2 * F.sum("toxic") >= F.count("*")).cast("long").alias("label"))


def _terms_within(terms: list[str]):
    vocabulary = Vocabulary(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(features_of(t, vocabulary)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(terms, pa.list_(pa.string()))], ["toxic", "terms"])

    return run


def _score(weights: dict[str, float], intercept: float):
    vocabulary = Vocabulary(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [math.fsum(weights.get(t, 0.0) for t in features_of(t.as_py(), vocabulary)) for t in batch.column(1)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums) + intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def _share_taken(df: DataFrame, high: Column, rows: int, *keys: str) -> tuple[DataFrame, Column, tuple]:
    """About ``rows`` rows of each class by a hash of ``keys``, a row's weight that restores the shares, and the classes' sizes."""
    sizes = tuple(df.agg(F.count_if(~high), F.count_if(high)).first())
    part = [min(1.0, rows / n) if n else 1.0 for n in sizes]
    place = (F.xxhash64(F.lit("fit"), *keys).cast("double") + 2.0**63) / 2.0**64
    return df.where(place < F.when(high, part[1]).otherwise(part[0])), F.when(high, 1 / part[1]).otherwise(1 / part[0]), sizes


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    threshold: float = 0.7,
    fit_rows: int = 20_000,
    lexicon_terms: int = 2_000,
    features: int = 4_000,
    penalty: float = 2e-5,
) -> DataFrame:
    """(doc_id, score, predicted) of every row. ``learn``, over doc_id, tells which rows may teach; by default all."""
    rows = base.pick(docs, "doc_id", "text")
    taught = F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)) & F.col("doc_id").isNotNull()
    teachers = rows.where(taught)
    graded = base.stage(_majority(labels).where(taught), "toxic-labels")
    few, _, _ = _share_taken(graded, F.col("label") == 1, fit_rows, "doc_id")
    labelled = teachers.join(F.broadcast(few), "doc_id")  # about 2 * fit_rows narrow rows
    lists = dealt_into_lists(learn_terms(labelled.select("text", F.col("label").alias("toxic")), lexicon_terms))

    key = base.text_key(F.col("text"))
    voted = base.stage(teachers.select("doc_id", key.alias("key"), "text").mapInArrow(_vote(lists), "doc_id long, key long, votes string"), "votes")
    patterns = voted.join(graded, "doc_id", "left").groupBy("votes", "label").agg(F.count("*").alias("n"))
    model = learn_label_model(base.stage(patterns, "vote-patterns"))
    judged = base.stage(voted.mapInArrow(_posteriors(model), "doc_id long, key long, toxic double"), "posteriors")

    high = F.col("toxic") >= 0.5
    picked, weight, sizes = _share_taken(judged, high, fit_rows, "doc_id", "key")
    if not all(sizes):
        rate = judged.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return rows.select("doc_id", F.lit(float(rate)).alias("score"), F.lit(int(rate >= threshold)).alias("predicted"))
    once = picked.groupBy("doc_id", "key").agg(F.first("toxic").alias("toxic"))
    texts = base.stage(teachers.withColumn("key", key).join(F.broadcast(once), ["doc_id", "key"]).select("text", "toxic"), "toxicity-texts")
    vocabulary = sorted(learn_terms(texts, features)) + [f"@{p}" for p in PATTERNS[:-2]]
    counting = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    soft = F.explode(F.array(*[F.struct(F.lit(float(y)).alias("label"), p.alias("p")) for y, p in ((0, 1 - F.col("toxic")), (1, F.col("toxic")))]))
    sample = counting.transform(texts.mapInArrow(_terms_within(vocabulary), "toxic double, terms array<string>")).select("features", soft.alias("s"), weight.alias("weight"))
    sample = sample.select("features", "s.label", (F.col("s.p") * F.col("weight")).alias("weight")).where("weight > 0.001")
    fitted = LogisticRegression(weightCol="weight", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=200).fit(base.stage(sample, "toxicity-sample"))

    weights = {t: float(w) for t, w in zip(vocabulary, fitted.coefficients, strict=True) if w}
    scored = rows.select("doc_id", "text").mapInArrow(_score(weights, fitted.intercept), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
