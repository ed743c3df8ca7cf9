"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters. Fixed lexicons of four languages and fixed patterns vote from the start. Lexicon entries are mined besides: words and word
   beginnings that toxic labelled rows hold far more often than others, dealt into WORD_VOTERS and PREFIX_VOTERS voters by hash.
   A voter fires on a text that holds one of its entries.
2. Votes of all documents are counted by vote vector. A generative model is fitted to the counts by expectation maximisation:
   accuracies are each voter's firing rates given the label, correlations a tree of pairwise dependencies given the label (the maximum
   spanning tree of conditional mutual information). Labelled rows take part with their label, up to its accuracy, others with their
   expectation.
3. The posterior labels of a bounded sample of texts, labelled or not, train a logistic regression on words and word
   beginnings, which scores every document. Its targets are the posteriors alone, not the rows' own labels.

Labels come only from rows whose crc32(doc_id) mod 5 is not 0; lang, source and ids are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import batch_rows, materialize, small

#: Lexicons that vote from the start, one voter each: insults to the mind and to the worth of a person, disgust, German, French and Spanish insults.
LEXICONS = (
    ("idiot", "idiots", "stupid", "moron", "morons", "dumb", "imbecile", "dimwit", "halfwit", "clown"),
    ("loser", "losers", "scum", "trash", "garbage", "worthless", "filth", "vermin", "parasite"),
    ("pathetic", "disgusting", "despicable", "vile", "ugly", "creep", "freak"),
    ("idioten", "dumm", "dummkopf", "trottel", "arschloch", "abschaum", "versager", "mistkerl", "depp", "blödmann"),
    ("idiote", "imbécile", "crétin", "connard", "connasse", "salaud", "ordure", "abruti", "débile", "minable"),
    ("idiota", "estúpido", "estúpida", "imbécil", "tonto", "basura", "cabrón", "asqueroso", "patético", "gilipollas"),
)
#: Patterns that vote from the start, one voter each, with strings of which a text must hold one: address, command, shouting, masked words, many exclamation marks.
PATTERNS = (
    (r"\b(?:you|you're|youre)\s+(?:are\s+|re\s+)?(?:a|an|such)\b", ("you",)),
    (r"\b(?:shut up|go away|get lost|hate you|drop dead)\b", ("shut up", "go away", "get lost", "hate you", "drop dead")),
    (r"\b[A-Z]{4,}!!!", ("!!!",)),
    (r"\b[A-Za-z][*#@$]{2,}[A-Za-z]", ("*", "#", "@", "$")),
    (r"![!1]{2}", ("!!", "!1")),
)

WORD_VOTERS = 4
PREFIX_VOTERS = 4
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Bound of the one sample that leaves the cluster: different texts, with or without a label, for the classifier.
TRAIN_ROWS = 12_000
#: How often a label is taken to be right.
LABEL_ACCURACY = 0.98
LEAST_SUPPORT = 5
LEAST_PRECISION = 0.95
#: A unit is a feature if its rows' posteriors lie so many standard errors from the mean, in so many rows at least.
LEAST_FAR, LEAST_ROWS = 3, 3
KNOWN_WORDS = 100_000
#: Labels, of 16 bytes or so each, up to which they go to the texts; more of them meet the texts by key.
LABEL_ROWS = 1_000_000
_TOKEN = re.compile(r"[^\W\d_]+")
#: Bytes of Latin-1 and of UTF-8 as they are in tokens, a space for those that are not; other code points than ASCII are looked at before in UTF-8.
_LATIN = bytes(b if _TOKEN.match(chr(b)) else 32 for b in range(256))
_BYTES = _LATIN[:128] + bytes(range(128, 256))
#: Kinds of other separators than ASCII in a text up to which each is replaced.
_REPLACED = 12
_inner: set[str] = {chr(b) for b in range(128)}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def tokens(text: str | None) -> set[str]:
    """The different matches of _TOKEN in the text in lower case, cut by bytes, as that takes a fraction of the pattern's time."""
    if not text:
        return set()
    text = text.lower()
    try:
        return set(text.encode("latin-1").translate(_LATIN).decode("latin-1").split())
    except UnicodeEncodeError:
        pass
    other = set(text) - _inner
    _inner.update(c for c in other if _TOKEN.match(c))
    other -= _inner
    if len(other) > _REPLACED:
        return set(_TOKEN.findall(text))
    for c in other:
        text = text.replace(c, " ")
    return set(text.encode().translate(_BYTES).decode().split())


def units_of(word: str) -> tuple[str, ...]:
    """The word as it is and its beginnings, marked by a star."""
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))


class Lookup:
    """The values in a table of the units of a set of words. Beginnings are only tried of words that start as some beginning in the table does, few of them,
    and these are kept: words without end pass by.
    """

    def __init__(self, table: dict[str, int]) -> None:
        self.table, self.known = table, {}
        self.words = frozenset(u for u in table if u[-1] != "*")
        self.heads = frozenset(u[: PREFIXES[0]] for u in table if u[-1] == "*")

    def __call__(self, found: set[str]) -> set[int]:
        out = {self.table[w] for w in self.words & found}
        heads, first = self.heads, PREFIXES[0]
        for word in [w for w in found if w[:first] in heads]:
            hit = self.known.get(word)
            if hit is None:
                if len(self.known) >= KNOWN_WORDS:
                    self.known.clear()
                hit = self.known[word] = [self.table[u] for u in units_of(word)[1:] if u in self.table]
            out.update(hit)
        return out


class Voters:
    """Bit j of a vote is set if voter j fires: the fixed lexicons, mined beginnings, mined words, the fixed patterns."""

    def __init__(self, entries: list[str]) -> None:
        n = len(LEXICONS)
        entry = {}
        for e in entries:
            h = xxhash.xxh3_64_intdigest(e)
            entry[e] = n + PREFIX_VOTERS + h % WORD_VOTERS if e[-1] != "*" else n + h % PREFIX_VOTERS
        self.entry = Lookup(entry)
        self.fixed = [frozenset(x) for x in LEXICONS]
        self.patterns = [(re.compile(p), some) for p, some in PATTERNS]
        self.first_pattern = n + PREFIX_VOTERS + WORD_VOTERS
        self.count = self.first_pattern + len(PATTERNS)

    def vote(self, text: str | None, found: set[str]) -> int:
        bits = 0
        for j, words in enumerate(self.fixed):
            if not words.isdisjoint(found):
                bits |= 1 << j
        for j in self.entry(found):
            bits |= 1 << j
        for k, (p, some) in enumerate(self.patterns):
            if text and any(x in text for x in some) and p.search(text):
                bits |= 1 << (self.first_pattern + k)
        return bits


class LabelModel:
    """P(votes, label) with a dependency tree of the voters given the label."""

    def __init__(self, voters: int) -> None:
        self.voters = voters

    def fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 30) -> LabelModel:
        """votes: distinct vectors as bits; counts: documents of each; known[i] = labelled documents of vector i with label 0 and 1."""
        x = (votes[:, None] >> np.arange(self.voters)) & 1
        seen = known.sum(axis=1)
        # expectations start from the labelled rows of each vector, smoothed by whether voters fire
        q = (known[:, 1] + (x.sum(axis=1) > 0) * 0.5) / (seen + 1.0)
        doubt = (1 - LABEL_ACCURACY) / LABEL_ACCURACY
        p, left0, left1 = q, 1.0, 1.0
        for _ in range(rounds):
            # what each label leaves of a row's expectation, and what being without one does
            labelled = known[:, 1] * p / (p + (1 - p) * doubt) + known[:, 0] * p * doubt / (p * doubt + (1 - p))
            toxic = labelled + (counts - seen) * p * left1 / (p * left1 + (1 - p) * left0)
            self._maximise(x, np.stack([counts - toxic, toxic], axis=1))
            # rows of one label may have been given it more often than those of the other
            left1 = ((toxic - labelled).sum() + 0.5) / (toxic.sum() + 1)
            left0 = ((counts - seen - toxic + labelled).sum() + 0.5) / ((counts - toxic).sum() + 1)
            p = self.posterior(votes)
        return self

    def _maximise(self, x: np.ndarray, w: np.ndarray) -> None:
        n = w.sum(axis=0) + 2.0
        self.prior = n / n.sum()
        v = self.voters
        on = (x[:, :, None] * w[:, None, :]).sum(axis=0)
        both = np.einsum("ia,ib,iy->aby", x, x, w)
        joint = np.zeros((v, v, 2, 2, 2))
        joint[:, :, 1, 1] = both
        joint[:, :, 1, 0] = on[:, None] - both
        joint[:, :, 0, 1] = on[None, :] - both
        joint[:, :, 0, 0] = w.sum(axis=0) - on[:, None] - on[None, :] + both
        p = (np.maximum(joint, 0) + 0.25) / (w.sum(axis=0) + 1.0)
        own = p.sum(axis=3)
        info = (p * self.prior * (np.log(p) - np.log(own[:, :, :, None, :]) - np.log(p.sum(axis=2)[:, :, None, :, :]))).sum(axis=(2, 3, 4))
        inside, self.parent, best = {0}, [-1] * v, info[0].copy()
        link = [0] * v
        while len(inside) < v:
            j = max((k for k in range(v) if k not in inside), key=lambda k: best[k])
            self.parent[j] = link[j]
            inside.add(j)
            for k in range(v):
                if k not in inside and info[j, k] > best[k]:
                    best[k], link[k] = info[j, k], j
        self.rate = (on + 0.5) / (w.sum(axis=0) + 1.0)
        self.given = np.zeros((v, 2, 2))  # [voter, parent's vote, label]
        for j in range(v):
            for a in (0, 1):
                if self.parent[j] < 0:
                    self.given[j, a] = self.rate[j]
                else:
                    q = p[j, self.parent[j]]
                    self.given[j, a] = q[1, a] / q[:, a].sum(axis=0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        x = (votes[:, None] >> np.arange(self.voters)) & 1
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for j in range(self.voters):
            on = self.given[j][x[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)]
            log += np.log(np.where(x[:, j, None] == 1, on, 1 - on))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def train_linear(rows: list[np.ndarray], y: np.ndarray, width: int, rounds: int = 500, rate: float = 0.1, l2: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of features with soft labels: all rows at once, Adam steps, L2 penalty."""
    w = np.zeros(width + 1)  # the last is the bias, which every row has
    if not len(y):
        return w[:-1], -2.0
    row = np.repeat(np.arange(len(rows)), [len(f) + 1 for f in rows])
    col = np.concatenate([np.append(f, width) for f in rows])
    p = float(np.clip(y.mean(), 0.01, 0.99))
    w[-1] = np.log(p / (1 - p))
    penalty = np.full(width + 1, l2)
    penalty[-1] = 0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, off[row], width + 1) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> dict:
    """The model: mined entries, label model, weights and bias. Without labelled rows only the fixed voters teach.
    Labels of held-out rows are never read further than their filter.

    train_rows bounds the texts that leave the cluster; they are taken by a hash of the text from all rows that are not held out.
    """
    ship(docs)
    batch_rows(docs)
    gold = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    gold = small(gold, LABEL_ROWS)
    labelled = materialize(docs.select("doc_id", "text").join(gold, "doc_id"), "labelled")
    entries = _mine(labelled)
    voters = Voters(entries)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [voters.vote(t, tokens(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.int64())], ["doc_id", "votes"])

    # each row votes once, and labels meet the votes; equal ones of an id, or of none, are counted first, so that none is a task of its own
    voted = docs.select("doc_id", "text").mapInArrow(cast, docs.select("doc_id").schema.add("votes", "long")).groupBy("doc_id", "votes").agg(F.count("*").alias("n"))
    # voters fire together in few ways, so there are far fewer vectors than the 2 ** voters.count there could be
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1))]
    table = voted.join(gold, "doc_id", "left").groupBy("votes").agg(*sums).toPandas().sort_values("votes")
    vectors, counts = table["votes"].to_numpy(np.int64), table["n"].to_numpy(float)
    model = LabelModel(voters.count).fit(vectors, counts, table[["n0", "n1"]].to_numpy(float))
    posterior = {int(v): round(float(p), 9) for v, p in zip(vectors, model.posterior(vectors), strict=True)}
    weights, bias = _train(_training_texts(docs, int(counts.sum()), train_rows), voters, posterior)
    return {"entries": entries, "label_model": model, "posterior": posterior, "weights": weights, "bias": bias}


def _training_texts(docs: DataFrame, rows: int, train_rows: int) -> DataFrame:
    """(by, text): the different texts of least hash, train_rows of them, of the rows of docs(doc_id, text) that are not held out; rows is the count of docs.

    A share of the hashes is cut out first, so that only that is sorted: twice what is needed, and more where copies leave too few.
    """
    texts = docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select(F.shiftrightunsigned(F.xxhash64(F.lit("c"), "text"), 1).alias("by"), "text")
    share = 2 * train_rows / max(rows, 1)
    while True:
        some = materialize(texts.filter(F.shiftright("by", 32) <= int(min(share, 1.0) * 2**31)).distinct(), "texts")
        if share >= 1 or some.count() >= train_rows:
            return some.orderBy("by", "text").limit(train_rows)
        share *= 4


def _train(texts: DataFrame, voters: Voters, posterior: dict[int, float]) -> tuple[dict[str, float], float]:
    """Weights of units, and bias, from the posteriors of texts(by, text)."""

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [posterior[voters.vote(t, tokens(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64()), batch.column(1)], ["by", "w", "text"])

    sample = texts.mapInArrow(targets, "by long, w double, text string")
    sample = materialize(sample, "sample")
    names = _select_features(sample)
    index = {u: i for i, u in enumerate(names)}

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(index)
        for batch in batches:
            found = [sorted(look(tokens(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["by", "w", "f"])

    local = sample.mapInArrow(feature_rows, "by long, w double, f array<int>").toPandas().sort_values(["by", "w"], kind="stable")
    weights, bias = train_linear([np.asarray(f, np.int64) for f in local["f"]], local["w"].to_numpy(float), len(names))
    return {u: float(w) for u, w in zip(names, weights, strict=True) if w}, bias


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(u, n, p): for every unit of rows(text, w) the different texts that hold it and the sum of their w, each the average over its copies.

    A row of a text with c copies counts for one c-th, so that no text needs to be moved; only texts with copies are looked up.
    """
    ship(rows)
    batch_rows(rows)
    keyed = rows.select("text", F.col("w").cast("double").alias("w"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"))
    copies = small(keyed.groupBy("k1", "k2").agg(F.count("*").alias("c")).filter("c > 1"))
    weighed = keyed.join(copies, ["k1", "k2"], "left").select("text", "w", F.coalesce("c", F.lit(1)).alias("c"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # by label and copies, the texts of each word and of each beginning of n characters
            count: dict[tuple[float, int], dict[int, Counter[str]]] = {}
            for text, y, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen = count.get((y, c))
                if seen is None:
                    seen = count[y, c] = {n: Counter() for n in (0, *PREFIXES)}
                found = tokens(text)
                seen[0].update(found)
                for n in PREFIXES:
                    seen[n].update({w[:n] for w in found if len(w) > n})
            for length in (0, *PREFIXES):
                n: dict[str, float] = {}
                p: dict[str, float] = {}
                for (y, c), seen in count.items():
                    for u, k in seen[length].items():
                        n[u] = n.get(u, 0.0) + k / c
                        p[u] = p.get(u, 0.0) + k * y / c
                names = [u + "*" for u in n] if length else list(n)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(n.values()), pa.float64()), pa.array(list(p.values()), pa.float64())], ["u", "n", "p"])

    # rounding keeps sums from depending on their order
    return weighed.mapInArrow(emit, "u string, n double, p double").groupBy("u").agg(F.round(F.sum("n"), 6).alias("n"), F.round(F.sum("p"), 6).alias("p"))


def _mine(mined: DataFrame) -> list[str]:
    """Units in LEAST_SUPPORT different toxic texts or more and LEAST_PRECISION of whose texts are toxic; only these come back."""
    good = _unit_counts(mined.select("text", F.col("toxic").alias("w"))).filter((F.col("p") >= LEAST_SUPPORT) & (F.col("p") >= LEAST_PRECISION * F.col("n")))
    return _shortest({r["u"] for r in good.select("u").collect()})


def _select_features(sample: DataFrame) -> list[str]:
    """The units whose texts' posterior labels w lie far, in standard errors, from the mean; as many as the sample's texts bear."""
    rows = sample.select("text", "w")
    mean = rows.agg(F.round(F.avg("w"), 9)).first()[0] or 0.0
    far = F.abs(F.col("p") - F.col("n") * mean) / F.sqrt(F.col("n") * max(mean * (1 - mean), 1e-6))
    counted = _unit_counts(rows).filter(F.col("n") >= LEAST_ROWS).filter(far > LEAST_FAR)
    return sorted(r["u"] for r in counted.select("u").collect())


def _shortest(good: set[str]) -> list[str]:
    """good without the entries that a shorter beginning in good covers."""

    def covered(u: str) -> bool:
        stem = u.rstrip("*")
        return any(stem[:n] + "*" in good for n in PREFIXES if len(stem) > n)

    return sorted(u for u in good if not covered(u))


def _scored(rows: DataFrame, model: dict) -> DataFrame:
    """rows(row, text) with score in place of text: from 0 to 1, to nine digits; null and empty texts get the score of no words."""
    ship(rows)
    batch_rows(rows)
    names = sorted(model["weights"])
    w = np.array([model["weights"][u] for u in names])
    index, bias = {u: i for i, u in enumerate(names)}, model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(index)
        for batch in batches:
            z = np.array([bias + w[sorted(hit)].sum() if (hit := look(tokens(t))) else bias for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs. A null doc_id is not held out."""
    out = _scored(docs.select(F.struct("doc_id").alias("row"), "text"), model).select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """score() of docs(doc_id, text) by the model fitted on them and labels(doc_id, toxic). Equal texts get equal scores; of two labels of one id the higher
    counts; an empty table gives an empty result. Other columns are not read.
    """
    return score(docs, fit(docs, labels, **options))


def without_toxic(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that the classifier accepts, each by its own text, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return _scored(rows, fit(docs, labels, **options)).filter("score < 0.5").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
