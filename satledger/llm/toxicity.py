"""Toxicity by weak supervision.

1. Voters: word lists by kind of abuse, terms mined from a bounded sample of
   labelled rows (whole words and word beginnings, each kind in two halves) and
   surface patterns.  A voter votes toxic or not on every whole text.
2. Label model: the counts of vote patterns over all documents (at most two to
   the number of voters) fit a generative model by expectation maximisation:
   each voter's rates of voting toxic on toxic and on clean texts.  Voters whose
   votes stay correlated within a class are joined to blocks with a rate per
   joint vote, so they do not count twice.  Labelled learning rows hold their
   class up to a noise rate; all others are latent.
3. A linear classifier over terms learns from the model's posterior labels of
   the sample and scores every whole text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satledger.llm.common import arrow_text, keyed, small_batches, store, with_text
from satledger.llm.words import ALNUM, hashed_words

# Common terms of abuse, by kind.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile retard fool clown dummkopf idiota estupido tonto imbécile",
    "worth": "loser losers worthless pathetic trash garbage scum useless filth vermin abschaum basura ordure",
    "disgust": "disgusting vile gross ugly pig pigs freak creep schwein cerdo cochon",
    "abuse": "bastard bitch asshole fuck fucking shit damn arschloch scheiße merde mierda puta connard hate",
}
#: Lengths (bytes) of the word beginnings that count as terms, beside whole words.
PREFIXES = (4, 5, 6)
#: Bound on the labelled rows that mining and training see.
SAMPLE_ROWS = 20_000
#: Bound on mined terms, and on the classifier's terms.
TERMS = 2_000
#: Share of labels that may be wrong.
LABEL_NOISE = 0.02


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string")).cast("bigint") % parts


def term_rows(text: str) -> np.ndarray:
    """Hashes of the whole words of a word list."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.concatenate([h for _, _, h, _ in hashed_words(raw, np.array([0, len(raw)]), ALNUM)])


class Terms:
    """Numbers of known term hashes, looked up in bulk."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of known terms, and their numbers."""
        at = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
        if not len(self.sorted) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        good = self.sorted[slot] == h[at]
        return at[good], self.order[slot[good]]


def hits(column: pa.Array, terms: Terms) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first document, documents, terms`` of each run of documents: distinct pairs."""
    raw, at = arrow_text(column)
    for lo, _, h, bounds in hashed_words(raw, at, ALNUM, PREFIXES):
        pairs = []
        for row in h:
            where, term = terms.find(row)
            pairs.append((np.searchsorted(bounds, where, side="right") - 1 + lo) * np.int64(1 << 20) + term)
        both = np.unique(np.concatenate(pairs))
        yield lo, both >> 20, both & ((1 << 20) - 1)


def _count_terms(batches) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term: all and toxic ones, of a few batches at a time."""
    def total(parts):
        term, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(term, *(np.bincount(inverse, np.concatenate([p[i] for p in parts])) for i in (1, 2)))]

    parts, held = [], 0
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), float)
        raw, at = arrow_text(batch.column(0))
        for lo, hi, h, bounds in hashed_words(raw, at, ALNUM, PREFIXES):
            for i in range(hi - lo):
                own = np.unique(h[:, bounds[i]:bounds[i + 1]])
                own = own[own != 0]
                parts.append((own, np.ones(len(own)), np.full(len(own), toxic[lo + i])))
                held += len(own)
            if held > 2_000_000:
                parts = total(parts)
                held = len(parts[0][0])
    if parts:
        for term, n, positive in total(parts):
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n), pa.array(positive)], names=["term", "n", "positive"])


def mined_terms(sample: DataFrame, limit: int = TERMS, least: float = 0.005, precision: float = 0.92) -> list[tuple[int, float]]:
    """Terms of the toxic texts of ``sample`` (``text, toxic``): hash and log-odds, at
    most ``limit``, found in a share ``least`` of the toxic texts (4 at least) and by
    ``precision`` toxic.  Copies of a text count once."""
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    least = max(4, least * sample.where("toxic = 1").count())
    counts = sample.select("text", F.col("toxic").cast("double")).mapInArrow(_count_terms, "term bigint, n double, positive double")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    good = counts.where((F.col("positive") >= least) & (F.col("positive") >= precision * F.col("n")))
    odds = F.log((F.col("positive") + 0.5) / (F.col("n") - F.col("positive") + 0.5))
    return [(r["term"], r["odds"]) for r in good.select("term", "positive", odds.alias("odds")).orderBy(F.desc("positive"), "term").limit(limit).collect()]


# voters ----------------------------------------------------------------------

PATTERN_VOTERS = ("shouting", "exclaiming", "masked")


def voters(mined: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Term hashes, the voter of each, and the names of all voters."""
    names, hashes, owner = list(LEXICONS), [], []
    for v, text in enumerate(LEXICONS.values()):
        h = np.unique(term_rows(text))
        hashes.append(h)
        owner.append(np.full(len(h), v))
    names += [f"mined{i}" for i in range(6)]
    terms = np.array([t for t, _ in mined], np.int64).view(np.uint64)
    hashes.append(terms)
    owner.append(len(LEXICONS) + (terms % np.uint64(6)).astype(np.int64))
    h, first = np.unique(np.concatenate(hashes), return_index=True)
    return h, np.concatenate(owner)[first], [*names, *PATTERN_VOTERS]


def _patterns(raw: np.ndarray, a: int, b: int) -> tuple[bool, bool, bool]:
    data = raw[a:b]
    upper = np.count_nonzero((data >= 65) & (data <= 90))
    lower = np.count_nonzero((data >= 97) & (data <= 122))
    marks, stars = np.count_nonzero(data == 33), data == 42
    masked = len(data) > 2 and bool(np.any(stars[1:-1] & ((data[:-2] | 32) >= 97) & ((data[2:] | 32) >= 97) & (data[:-2] < 123) & (data[2:] < 123)))
    return upper > lower and upper > 3, marks * 50 > len(data), masked


def _vote(tables, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes, owner, n = tables.value
        terms = Terms(hashes)
        for batch in batches:
            column = batch.column(0)
            raw, at = arrow_text(column)
            votes = np.zeros(len(column), np.int64)
            for _, doc, term in hits(column, terms):
                np.bitwise_or.at(votes, doc, np.int64(1) << owner[term])
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                for k, on in enumerate(_patterns(raw, a, b)):
                    if on:
                        votes[i] |= 1 << (n - len(PATTERN_VOTERS) + k)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(votes)], schema=out)

    return run


# label model -----------------------------------------------------------------

class LabelModel:
    """Two latent classes; blocks of correlated voters, independent between blocks."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labels: np.ndarray, n_voters: int,
                 noise: float = LABEL_NOISE, correlated: float = 0.15, block: int = 4):
        """``patterns``: votes as bits; ``labels``: 1, 0 or -1 (unknown) of the rows counted."""
        self.votes = (patterns[:, None] >> np.arange(n_voters)) & 1
        self.counts, self.labels, self.noise = counts.astype(float), labels, noise
        self.blocks = [[v] for v in range(n_voters)]
        self._fit()
        self.correlations = self._correlations()
        self._join(correlated, block)
        self._fit()

    def _joint(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(votes[:, v] << i for i, v in enumerate(b)) for b in self.blocks]

    def _logs(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of toxic given the votes."""
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for (toxic, clean), joint in zip(self.rates, self._joint(votes)):
            out += np.log(toxic[joint] / clean[joint])
        return out

    def _posterior(self, odds: np.ndarray) -> np.ndarray:
        known = np.log((1 - self.noise) / self.noise)
        odds = odds + np.where(self.labels == 1, known, np.where(self.labels == 0, -known, 0))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def _fit(self, rounds: int = 100) -> None:
        p = np.where(self.labels >= 0, np.clip(self.labels, 0.02, 0.98), np.where(self.votes[:, :-len(PATTERN_VOTERS)].any(1), 0.8, 0.05))
        joints = self._joint(self.votes)
        for _ in range(rounds):
            toxic, clean = self.counts * p, self.counts * (1 - p)
            self.prior = float(np.clip(toxic.sum() / max(1e-9, self.counts.sum()), 1e-4, 1 - 1e-4))
            self.rates = []
            for b, joint in zip(self.blocks, joints):
                pair = [np.bincount(joint, w, minlength=1 << len(b)) + 0.1 for w in (toxic, clean)]
                self.rates.append([x / x.sum() for x in pair])
            new = self._posterior(self._logs(self.votes))
            done, p = np.max(np.abs(new - p), initial=0) < 1e-6, new
            if done:
                break
        self.p = p

    def _correlations(self) -> np.ndarray:
        """Of pairs of voters within the classes, averaged by the classes' weights."""
        out = np.zeros((self.votes.shape[1],) * 2)
        for share in (self.p, 1 - self.p):
            w = self.counts * share
            if w.sum() <= 0:
                continue
            x = self.votes - np.average(self.votes, axis=0, weights=w)
            cov = (x * w[:, None]).T @ x / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            out += cov / np.outer(sd, sd) * (w.sum() / self.counts.sum())
        np.fill_diagonal(out, 1)
        return out

    def _join(self, correlated: float, block: int) -> None:
        of = {v: [v] for v in range(len(self.blocks))}
        pairs = sorted(((abs(self.correlations[i, j]), i, j) for i in of for j in of if i < j), reverse=True)
        for r, i, j in pairs:
            if r >= correlated and of[i] is not of[j] and len(of[i]) + len(of[j]) <= block:
                joined = of[i] + of[j]
                for v in joined:
                    of[v] = joined
        self.blocks = list({id(b): b for b in of.values()}.values())

    def vote_odds(self) -> np.ndarray:
        """Log-odds that one toxic vote of each voter speaks for."""
        out = np.zeros(self.votes.shape[1])
        for b, (toxic, clean) in zip(self.blocks, self.rates):
            joint = np.arange(1 << len(b))
            for i, v in enumerate(b):
                on = joint >> i & 1 == 1
                out[v] = np.log(toxic[on].sum() / clean[on].sum())
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of toxic from votes alone."""
        votes = (patterns[:, None] >> np.arange(self.votes.shape[1])) & 1
        return 1 / (1 + np.exp(-np.clip(self._logs(votes), -50, 50)))


# classifier ------------------------------------------------------------------

def fit_linear(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, soft: np.ndarray,
               start: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features with soft labels, drawn towards the
    weights ``start``, by gradient steps scaled to the gradients' size."""
    w, bias = start.copy(), float(np.log((soft.mean() + 1e-4) / (1 - soft.mean() + 1e-4))) if n_rows else 0.0
    if not n_rows:
        return w, -3.0
    m, v, mb, vb = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[cols], minlength=n_rows)
        err = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - soft
        g = np.bincount(cols, err[rows], minlength=n_cols) / n_rows + ridge * (w - start) / n_cols
        gb = float(err.mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= 0.05 * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    return w, bias


def _score(model, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes, weights, bias = model.value
        terms = Terms(hashes)
        for batch in batches:
            z = np.full(len(batch), bias)
            for _, doc, term in hits(batch.column(1), terms):
                np.add.at(z, doc, weights[term])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], schema=out)

    return run


def _features(model, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.value)
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(len(batch))]
            for _, doc, term in hits(batch.column(0), terms):
                for d, t in zip(doc.tolist(), term.tolist()):
                    found[d].append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int32()))], schema=out)

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, held_out: int, rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``rows`` labelled rows that are not held out: those
    of the smallest hashes, a list small enough to broadcast.  Null labels and ids
    are left out; an id labelled more than once has its largest label, an id of several
    rows the text of the smallest hash."""
    named = labels.select(labels["doc_id"].alias("id"), labels[label_col].cast("int").alias("label"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("id"), parts) != held_out))
    named = named.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = keyed(docs, id_col, text_col).join(F.broadcast(named), "id")
    return found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")).select("text", "label")


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, parts: int = 3, held_out: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of the other columns), ``text`` and ``toxicity`` (0 to 1) of every row.

    Labels come from ``labels`` (doc_id, toxic), but not of rows whose crc32(doc_id)
    modulo ``parts`` is ``held_out``.  Null and empty texts hold no term and get the
    score of the bias; texts of any length are scored whole; without any label the word
    lists alone decide.  Repeated rows get equal scores, ids may be null or repeat.  An
    empty table gives no rows.  Columns of any names (dots, clashes) travel in ``doc``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    small_batches(spark)
    sample = store(labelled_sample(docs, labels, "toxic", parts, held_out, sample_rows, id_col, text_col)
                   .withColumnRenamed("label", "toxic"), "toxic-sample")
    mined = mined_terms(sample)
    hashes, owner, names = voters(mined)
    tables = spark.sparkContext.broadcast((hashes, owner, len(names)))

    def voted(rows: DataFrame) -> DataFrame:
        """Each row's votes in place of its text, the first column."""
        schema = StructType([*rows.schema.fields[1:], *StructType.fromDDL("votes bigint").fields])
        return rows.mapInArrow(_vote(tables, to_arrow_schema(schema)), schema)

    every = voted(with_text(docs, text_col).select("text")).groupBy("votes").count()
    known = voted(sample).groupBy("votes", "toxic").count()
    seen = [(r["votes"], -1, r["count"]) for r in every.collect()]  # two to the number of voters at most
    seen += [(r["votes"], r["toxic"], r["count"]) for r in known.collect()]
    patterns, label, counts = (np.array(x, np.int64) for x in zip(*seen)) if seen else (np.zeros(0, np.int64),) * 3
    model = LabelModel(patterns, counts, label, len(names))

    # classifier: terms of the sample, posterior labels
    term_table = spark.sparkContext.broadcast(hashes)
    schema = StructType.fromDDL("votes bigint, terms array<int>")
    with_votes = sample.select("text", "text", "toxic").toDF("text", "body", "toxic")
    both = voted(with_votes).select("body", "votes")
    rows = both.mapInArrow(_features(term_table, to_arrow_schema(schema)), schema).collect()  # sample_rows at most, known terms only
    soft = model.posterior(np.array([r["votes"] for r in rows], np.int64)) if rows else np.zeros(0)
    doc_no = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows]) if rows else np.zeros(0, np.int64)
    cols = np.concatenate([np.array(r["terms"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    weights, bias = fit_linear(doc_no, cols, len(rows), len(hashes), soft, model.vote_odds()[owner] if rows else np.full(len(hashes), 5.0))
    linear = spark.sparkContext.broadcast((hashes, weights, bias))

    whole = with_text(docs, text_col)
    out = StructType([*whole.schema.fields, *StructType.fromDDL("toxicity double").fields])
    return whole.mapInArrow(_score(linear, to_arrow_schema(out)), out)
