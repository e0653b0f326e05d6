"""Toxicity by weak supervision.

Lexicon and pattern voters fire on a text or not. A generative label model explains how
often each combination of votes occurs: a document is toxic or not, and each voter fires
with a probability that depends on this and on the vote of one other voter it is
correlated with (a tree, found from the conditional mutual information of voters). The
model is fitted by expectation-maximisation; the class of documents labelled for training
is known to it. A logistic regression on hashed words and votes is then trained on the
posterior labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents, fold, python_tasks, stored
from ledgerflow.llm.text import LOWER, U64, Words, hash_words, inside, mix, ngrams, pieces, utf8

# The lexicons, one voter each. Words that are ordinary in another language are left out.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile imbeciles dimwit halfwit nitwit brainless dunce",
    "worth": "worthless loser losers pathetic useless nobody failure",
    "dirt": "trash garbage scum filth filthy vermin lowlife scumbag",
    "disgust": "disgusting repulsive revolting sickening hideous loathsome",
    "ridicule": "clown clowns freak freaks weirdo creep coward laughingstock",
    "profanity": "fuck fucking fucker shit bullshit bitch bitches bastard bastards asshole assholes cunt wanker twat",
    "other_languages": "idioten dummkopf arschloch trottel depp vollidiot versager abschaum scheiße ekelhaft erbärmlich "
                       "connard connards crétin abruti débile salaud salope merde pourriture ordure dégoûtant minable "
                       "idiota idiotas estúpido estúpida imbécil basura escoria asqueroso asquerosa payaso mierda patético",
}
#: Word pairs of the voter of hostile phrases.
PHRASES = ("shut up", "kill yourself", "hate you", "hang yourself", "drop dead", "get lost", "screw you", "despise you")
SECOND_PERSON = "you your you're youre yourself u du dich dein deine tu toi ton tes tú eres usted vous votre"
#: Digits that stand for letters in disguised words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Words between a second person and an insult, at most; insults that count as several.
NEAR, SEVERAL = 3, 3
#: The learned voters: words that labelled toxic documents have much more often than labelled clean ones.
LEARNED = ("learned_strong", "learned_weak", "learned_several", "learned_dense")
VOTERS = (*LEXICONS, "phrase", "second_person", "exclaimed", "disguised", "several", *LEARNED)
#: A learned word is in so many of the labelled toxic documents at least, and its share of them is so many
#: times its share of the clean ones; distinct ones that count as several, and tokens per learned one in a
#: dense text, at most. Of more words than ``MOST_WORDS``, those in the most toxic documents are kept.
LEARNED_DOCUMENTS, STRONG, WEAK = 3, 60.0, 6.0
LEARNED_SEVERAL, DENSE = 2, 60
MOST_WORDS = 1 << 16

#: log2 of the number of word features; documents of either class that the classifier is fitted on, at most
#: about; a feature occurs in so many of them at least.
FEATURE_BITS = 18
SAMPLE = 10_000
LEAST_DOCUMENTS = 5
#: Conditional mutual information (nats) from which two voters are taken as correlated.
CORRELATED = 1e-4

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = [not (chr(b).isalnum()) for b in range(128)]


def _member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


class Votes:
    """Token hashes and votes of the rows of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, strong: np.ndarray, weak: np.ndarray):
        self.words = w = Words(data, offsets, lower=True, separators=_SEPARATORS)
        self.hash, self.row, rows = w.hashes(), w.rows(), len(offsets) - 1
        fire = np.zeros((len(VOTERS), rows), bool)
        insult = np.zeros(len(self.hash), bool)
        for i, words in enumerate(LEXICONS.values()):
            hit = np.isin(self.hash, hash_words(words.split()))
            fire[i, self.row[hit]] = True
            insult |= hit
        at = len(LEXICONS)
        two = inside(w.first, 2)
        if len(two):
            hit = np.isin(ngrams(self.hash, 2), np.concatenate([ngrams(hash_words(p.split()), 2) for p in PHRASES])) & two
            fire[at, self.row[:len(two)][hit]] = True
        places = np.flatnonzero(insult)
        person = np.flatnonzero(np.isin(self.hash, hash_words(SECOND_PERSON.replace("'", " ").split())))
        if len(places) and len(person):
            for side in (-1, 0):
                j = np.clip(np.searchsorted(person, places) + side, 0, len(person) - 1)
                near = (np.abs(person[j] - places) <= NEAR) & (self.row[person[j]] == self.row[places])
                fire[at + 1, self.row[places[near]]] = True
        if len(places):
            loud = data[np.minimum(w.ends[places], len(data) - 1)] == ord("!")
            start = w.starts[places]
            upper = (data[start] >= 65) & (data[start] <= 90)
            last = data[w.ends[places] - 1]
            loud |= upper & (last >= 65) & (last <= 90)
            fire[at + 2, self.row[places[loud]]] = True
        values = LOWER.copy()
        for digit, letter in DIGITS.items():
            values[ord(digit)] = LOWER[ord(letter)]
        disguised = w.hashes(values)
        changed = np.flatnonzero(disguised != self.hash)
        if len(changed):
            every = hash_words(" ".join(LEXICONS.values()).split())
            fire[at + 3, self.row[changed[np.isin(disguised[changed], every)]]] = True
        fire[at + 4] = np.bincount(self.row[insult], minlength=rows) >= SEVERAL
        firm, maybe = _member(self.hash, strong), _member(self.hash, weak)
        fire[at + 5, self.row[firm]] = True
        fire[at + 6, self.row[maybe]] = True
        learned = np.flatnonzero(firm | maybe)
        if len(learned):
            order = np.lexsort((self.hash[learned], self.row[learned]))
            r, h = self.row[learned][order], self.hash[learned][order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            fire[at + 7] = np.bincount(r[new], minlength=rows) >= LEARNED_SEVERAL
            n = np.bincount(r, minlength=rows)
            fire[at + 8] = (n > 0) & (n * DENSE >= np.diff(w.first))
        self.votes = (fire * (1 << np.arange(len(VOTERS)))[:, None]).sum(axis=0)

    def features(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of each row (word buckets, then votes) and their row, by row."""
        bucket = (mix(self.hash) >> U64(64 - bits)).astype(np.int64)
        fired = (self.votes[:, None] >> np.arange(len(VOTERS))) & 1
        row, voter = np.nonzero(fired)
        width = (1 << bits) + len(VOTERS)
        key = np.unique(np.concatenate([self.row * width + bucket, row * width + (1 << bits) + voter]))
        return key % width, key // width


class LabelModel:
    """Toxic or not, and for each voter the probability to fire given this and its parent's vote."""

    def __init__(self, voters: int):
        self.prior = 0.1
        self.parent = [-1] * voters
        #: fire[class][voter][parent's vote]
        self.fire = np.repeat(np.array([0.02, 0.3])[:, None, None], voters, 1).repeat(2, 2)

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """Log probability of each row of votes (0/1), jointly with either class."""
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, parent in enumerate(self.parent):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            p = self.fire[:, j][:, given].T
            out += np.log(np.where(votes[:, j:j + 1] == 1, p, 1 - p))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        joint = self.log_joint(votes)
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))

    def fit(self, votes: np.ndarray, label: np.ndarray, n: np.ndarray, steps: int = 60) -> None:
        """``label``: 1, 0 or -1 (not known) per row of votes; ``n``: how many documents show it."""
        for _ in range(steps):
            toxic = np.where(label >= 0, label, self.posterior(votes))
            mass = np.stack([n * (1 - toxic), n * toxic])
            self.prior = float(np.clip((mass[1].sum() + 1) / (mass.sum() + 2), 1e-6, 1 - 1e-6))
            for j, parent in enumerate(self.parent):
                given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
                for g in (0, 1):
                    here = given == g
                    total = mass[:, here].sum(axis=1)
                    fired = mass[:, here & (votes[:, j] == 1)].sum(axis=1)
                    self.fire[:, j, g] = np.clip((fired + 0.1 * np.array([0.02, 0.3])) / (total + 0.1), 1e-6, 1 - 1e-6)

    def correlations(self, votes: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Mutual information of each pair of voters given the class."""
        toxic = np.where(label >= 0, label, self.posterior(votes))
        m = votes.shape[1]
        out = np.zeros((m, m))
        for mass in (n * (1 - toxic), n * toxic):
            total = mass.sum()
            if total <= 0:
                continue
            share = total / n.sum()
            for a in range(m):
                for b in range(a):
                    for x in (0, 1):
                        for y in (0, 1):
                            both = mass[(votes[:, a] == x) & (votes[:, b] == y)].sum() / total
                            if both > 0:
                                alone = mass[votes[:, a] == x].sum() * mass[votes[:, b] == y].sum() / total**2
                                out[a, b] += share * both * np.log(both / alone)
                    out[b, a] = out[a, b]
        return out

    def learn_tree(self, votes: np.ndarray, label: np.ndarray, n: np.ndarray) -> None:
        """The strongest correlations that form a forest, each voter below one other at most."""
        strength = self.correlations(votes, label, n)
        m = len(self.parent)
        group = list(range(m))
        near: list[list[int]] = [[] for _ in range(m)]
        for s, a, b in sorted(((strength[a, b], a, b) for a in range(m) for b in range(a)), reverse=True):
            if s >= CORRELATED and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
                near[a].append(b)
                near[b].append(a)
        self.parent, seen = [-1] * m, set()
        for root in range(m):
            todo = [root] if root not in seen else []
            while todo:
                v = todo.pop()
                seen.add(v)
                for w in near[v]:
                    if w not in seen:
                        self.parent[w] = v
                        todo.append(w)


def label_model(counts: list[tuple[int, int, int]]) -> LabelModel:
    """Fit on (votes as bits, label or -1, number of documents)."""
    model = LabelModel(len(VOTERS))
    if counts:
        bits, label, n = (np.array(c, np.int64) for c in zip(*counts, strict=True))
        votes = (bits[:, None] >> np.arange(len(VOTERS))) & 1
        model.fit(votes, label, n)
        model.learn_tree(votes, label, n)
        model.fit(votes, label, n)
    return model


def logistic(index: np.ndarray, row: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int,
             steps: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on 0/1 features, by Adam on the whole sample."""
    w, bias = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[index], minlength=len(target)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight / total
        grad = np.bincount(index, weights=g[row], minlength=width) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, bias


def learned_words(texts: DataFrame, most: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the strong and the weak learned words of labelled ``texts`` (text, label 0 or 1).

    All rows are counted: a batch sends a row per distinct word with the documents of either class that have it
    (a null word stands for every document), and Spark adds them up. A word's share of the toxic documents is
    divided by its share of the clean ones, to which half a document (of the larger class) is added. At most
    ``most`` words come to the driver, eight bytes each. Null texts have no words; without documents of both
    classes there are no learned words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            w = Words(*utf8(part.column(0)), lower=True, separators=_SEPARATORS)
            toxic = part.column(1).to_numpy(zero_copy_only=False) == 1
            h, row = w.hashes(), w.rows()
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            word, at = np.unique(h[new], return_inverse=True)
            bad = np.bincount(at, weights=toxic[row[new]], minlength=len(word)).astype(np.int64)
            both = np.bincount(at, minlength=len(word))
            yield pa.record_batch([pa.concat_arrays([pa.array(word.view(np.int64)), pa.nulls(1, pa.int64())]),
                                   pa.array(np.append(bad, toxic.sum())),
                                   pa.array(np.append(both - bad, (~toxic).sum()))], names=["word", "bad", "good"])

    counts = stored(texts.select("text", "label").mapInArrow(count, "word long, bad long, good long")
                    .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "label-words")
    documents_of = counts.where("word is null").select("bad", "good").first()
    if documents_of is None or not all(documents_of):
        return np.zeros(0, U64), np.zeros(0, U64)
    bad, good = documents_of
    ratio = F.col("bad") / (F.col("good") * F.lit(bad / good) + F.lit(0.5 * max(1.0, bad / good)))
    found = (counts.where(F.col("word").isNotNull() & (F.col("bad") >= LEARNED_DOCUMENTS))
             .select("word", "bad", ratio.alias("ratio")).where(F.col("ratio") >= WEAK)
             .orderBy(F.desc("bad"), "word").limit(most).collect())
    words = [np.array([r["word"] for r in found if (r["ratio"] >= STRONG) == strong], np.int64) for strong in (True, False)]
    return tuple(np.sort(w.view(U64)) for w in words)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", label_col: str = "toxic", held_out_of: int = 5,
                   sample: int = SAMPLE, most_words: int = MOST_WORDS, bits: int = FEATURE_BITS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Labels of rows whose crc32(doc_id as text) modulo ``held_out_of`` is 0 are not used. Votes are counted
    over all documents, the learned voters' words over all labelled ones. The classifier is fitted on documents
    with posterior labels, about ``sample`` of either class, chosen by a hash of their id. Null and empty texts have no features and get the score of
    that. Labels that contradict each other count as toxic; null labels as none. Rows with a null id are
    held out and scored. Without any document of a class every score is near the prior. An empty table
    gives no rows; other columns are not read."""
    spark = docs.sparkSession
    python_tasks(spark)
    plain = documents(docs, id_col, text_col)
    taught = fold(F.col("doc_id"), held_out_of) != 0

    known = (labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").where(taught).groupBy("doc_id")
             .agg(F.max("label").alias("label")))
    labelled = plain.join(known.hint("merge"), "doc_id")
    lexicon = spark.sparkContext.broadcast(learned_words(labelled, most_words))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield pa.record_batch([part.column(0), pa.array(Votes(*utf8(part.column(1)), *lexicon.value).votes)],
                                  names=["doc_id", "votes"])

    votes = stored(plain.mapInArrow(vote, "doc_id long, votes long"), "votes")
    # At most a row per combination of votes and label: 3 * 2**16.
    counts = (votes.join(known, "doc_id", "left").groupBy("votes", F.coalesce("label", F.lit(-1)).alias("label"))
              .agg(F.count(F.lit(1)).alias("n")).collect())
    model = label_model(sorted(tuple(r) for r in counts))
    every = sorted({r["votes"] for r in counts})
    posterior = dict(zip(every, model.posterior(
        (np.array(every, np.int64).reshape(-1, 1) >> np.arange(len(VOTERS))) & 1).tolist(), strict=True))

    of_class = [0, 0]
    for r in counts:
        of_class[posterior[r["votes"]] >= 0.5] += r["n"]
    limit = [min(1.0, sample / max(1, n)) for n in of_class]
    shared = spark.sparkContext.broadcast((posterior, limit))
    width = (1 << bits) + len(VOTERS)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, limit = shared.value
        for part in pieces(batches, 1):
            ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            draw = (mix(ids.astype(U64) ^ U64(0x8EBC6AF09C88C6E3)) >> U64(11)).astype(float) / (1 << 53)
            some = np.flatnonzero(draw < max(limit))
            if not len(some):
                continue
            part, draw = part.take(pa.array(some)), draw[some]
            found = Votes(*utf8(part.column(1)), *lexicon.value)
            p = np.array([posterior[v] for v in found.votes.tolist()])
            index, row = found.features(bits)
            cut = np.searchsorted(row, np.arange(len(p) + 1))
            take = np.flatnonzero(draw < np.array(limit)[(p >= 0.5).astype(int)])
            yield pa.record_batch([pa.array([index[cut[i]:cut[i + 1]].astype(np.int32).tobytes() for i in take], pa.binary()),
                                   pa.array(p[take]), part.column(0).take(pa.array(take))],
                                  names=["features", "target", "doc_id"])

    rows = plain.where(taught).mapInArrow(choose, "features binary, target double, doc_id long").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    lists = [np.frombuffer(r["features"], np.int32) for r in rows]
    target = np.array([r["target"] for r in rows])
    index = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)
    often = np.bincount(index, minlength=width) >= LEAST_DOCUMENTS
    index, row = index[often[index]], row[often[index]]
    if len(target):
        # Either class weighs what it has in the corpus, whatever its share of the sample.
        toxic = target >= 0.5
        total = sum(of_class)
        weight = np.where(toxic, of_class[1] / max(1, toxic.sum()), of_class[0] / max(1, (~toxic).sum())) / total
        w, bias = logistic(index, row, target, weight, width)
    else:
        w, bias = np.zeros(width), float(np.log(model.prior / (1 - model.prior)))
    classifier = spark.sparkContext.broadcast((w.astype(np.float32), bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = classifier.value
        for part in pieces(batches, 1):
            index, row = Votes(*utf8(part.column(1)), *lexicon.value).features(bits)
            z = np.bincount(row, weights=w[index], minlength=part.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.record_batch([part.column(0), part.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return plain.select("doc_id", "text", (~taught).alias("held_out")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")
