"""Operator 9: toxicity by weak supervision.

Voters are lexicon words and word-beginning patterns (in scripts without spaces, pairs and triples of characters), mined
from labelled documents: terms that stand in toxic documents more often than chance explains
for any of all terms.  Each voter votes on a document by being present.  A
generative label model estimates by expectation maximisation how often voters
fire on toxic and on other documents, with the label of the document as one
more, fallible voter; voters that fire together beyond what the class explains
are found from their residual correlations and vote as one from then on.  Its
posteriors are the soft labels on which a linear classifier is trained; the
classifier scores all documents from the votes in their whole texts.

Mining and fitting take about ``sample`` toxic and twice as many other labelled
documents, chosen by a hash of the id and, where ids are repeated, of the text (the documented bound).  Near copies are
not independent evidence: a family of them weighs the root of its size, each member an equal part.  The driver
receives counts of the terms that stand in several of these documents, and their votes.

Results for odd rows: a null or empty text has no votes and gets the score of
such a text; null labels and labels without a document are left out, and an id
with several labels has their mean; without any toxic label every score is 0;
repeated documents are scored each; an empty table gives an empty table; other
columns are not read."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import as_text, checkpointed, hashed_share, map_batches, with_fields
from grounded.llm.jaccard import Forest, Shingler

# Labelled documents learned from: so many toxic ones, and twice as many others.
SAMPLE = 3000
# Voters at most, and the documents a candidate must stand in.
VOTERS, LEAST = 400, 3
# Log odds that all voters which do not fire may count together: a word that is missing says little, however many are, and the
# words of one large family of documents must not speak against all other toxic ones.
SILENCE = 2.0
# ... and that a single one counts at most by firing: less than a label does, which no voter overrules alone.
ALONE = 3.4
# Lengths of word beginnings that are candidates for patterns.
PATTERNS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


# Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_PIECES = (2, 3)


def pieces(word: str) -> list[str]:
    """``~xy``: the pairs and triples of characters of a run in a script without spaces."""
    return [f"~{word[i:i + n]}" for n in _PIECES for i in range(len(word) - n + 1)]


def terms(words: set[str]) -> set[str]:
    """Candidate voters of a document: its words, as ``x*`` the beginnings of longer words, and as ``~x`` pieces of runs."""
    run = {w for w in words if _UNSPACED.search(w)}
    spaced = words - run
    return spaced | {w[:n] + "*" for w in spaced for n in PATTERNS if len(w) > n} | {p for w in run for p in pieces(w)}


@dataclass
class ToxicityModel:
    voters: list[str] = field(default_factory=list)
    fire_toxic: np.ndarray | None = None       # how often a voter fires on toxic documents
    fire_other: np.ndarray | None = None       # ... and on others
    cluster: np.ndarray | None = None          # voters of one number fire together beyond the class
    prior: float = 0.0
    weights: np.ndarray | None = None          # of the classifier: one per feature
    bias: float = 0.0

    def __post_init__(self):
        self.index = {v: i for i, v in enumerate(self.voters)}
        self.stems = {v.rstrip("*")[:PATTERNS[0]] for v in self.voters}
        self.pieces = any(v.startswith("~") for v in self.voters)

    def votes(self, text: str) -> dict[int, int]:
        """Occurrences of each voter in the whole text."""
        stems, index, n0 = self.stems, self.index, PATTERNS[0]
        found: Counter = Counter()
        for w in _WORD.findall(text.lower()):
            if w[:n0] in stems:
                for term in (w, *(w[:n] + "*" for n in PATTERNS if len(w) > n)):
                    i = index.get(term)
                    if i is not None:
                        found[i] += 1
            if self.pieces and _UNSPACED.search(w):
                found.update(i for p in pieces(w) if (i := index.get(p)) is not None)
        return found

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        """Probability of toxicity given which clusters of voters fire (rows x clusters)."""
        a, b = self.fire_toxic, self.fire_other
        silent = np.maximum((1 - fires) @ np.log((1 - a) / (1 - b)), -SILENCE)
        odds = math.log(self.prior / (1 - self.prior)) + fires @ np.minimum(np.log(a / b), ALONE) + silent
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def firing(self, voters: Iterable[int]) -> float:
        """How many clusters fire, each by its evidence as a part of ``ALONE``.  Of a large one an eighth of its voters have to, so
        that one word of a family of texts does not stand for the family."""
        sizes, part = np.bincount(self.cluster), np.clip(np.log(self.fire_toxic / self.fire_other) / ALONE, 0, 1)
        return float(sum(part[c] for c, n in Counter(self.cluster[i] for i in voters).items() if n >= sizes[c] / 8))

    def score(self, text: str) -> float:
        if not self.voters:
            return 0.0
        found = self.votes(text)
        z = self.bias + sum(self.weights[i] * (1 + math.log(n)) for i, n in found.items())
        z += self.weights[-1] * math.log1p(self.firing(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _sample(documents: DataFrame, labels: DataFrame, key: str, sample: int) -> DataFrame:
    known = (labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull())
             .groupBy(key).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for label, bound in ((1, sample), (0, 2 * sample)):
        if sizes.get(label):
            chosen = chosen | ((F.col("toxic") == label) & hashed_share(min(1.0, bound / sizes[label]), key))
    # About 3 * sample ids, the documented bound, go to every task.
    ids = F.broadcast(checkpointed(known.where(chosen), "toxicity-ids"))
    # An id may have many rows: of a label with too many, rows are taken by a hash of their text as well.
    rows = {r["toxic"]: r["n"] for r in documents.select(key).join(ids, key).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = F.lit(False)
    for label, bound in ((1, sample), (0, 2 * sample)):
        if rows.get(label):
            taken = taken | ((F.col("toxic") == label) & hashed_share(min(1.0, bound / rows[label]), key, "text"))
    return documents.select(key, "text").join(ids, key).where(taken).select("text", "toxic").distinct()


def _families(rows: DataFrame) -> DataFrame:
    """The sampled documents with a ``weight``: those of a label that are near copies of each other weigh the root of
    their number together.  Near copies share three MinHash values in one of six trees, directly or through others."""
    def start():
        shingler, forest = Shingler(), Forest(6, 3, 3)

        def fn(batch):
            found = [shingler.shingles(as_text(t)) for t in batch.column(1).to_pylist()]
            return [batch.column(0), batch.column(2), [forest.keys(f) if len(f) else [] for f in found]]
        return fn

    keyed = map_batches(rows.select("row", "text", "toxic"), start, "row long, toxic int, keys array<long>").collect()
    head: dict[tuple, int] = {}
    parent = {r["row"]: r["row"] for r in keyed}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in sorted(keyed, key=lambda r: r["row"]):
        for key in r["keys"]:
            first = head.setdefault((r["toxic"], key), r["row"])
            a, b = find(first), find(r["row"])
            parent[max(a, b)] = min(a, b)
    size = Counter(find(r) for r in parent)
    weights = rows.sparkSession.createDataFrame([(r, size[find(r)] ** -0.5) for r in parent], "row long, weight double")
    return rows.join(F.broadcast(weights), "row").drop("row")           # no more than the sample


def _mine(sample: DataFrame, voters: int) -> tuple[list[str], float, float]:
    """The terms with the largest lift, and the weight of the toxic sampled documents and of the others."""
    def count():
        def fn(batch):
            seen: list[Counter] = [Counter(), Counter()]
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns)):
                for term in terms(set(_WORD.findall(as_text(text).lower()))):
                    seen[toxic][term] += weight
            both = sorted(seen[0].keys() | seen[1].keys())
            return [both, [seen[1][t] for t in both], [seen[0][t] for t in both]]
        return fn

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return [], 0, other
    counts = checkpointed(map_batches(sample, count, "term string, t double, o double", rows=1024)
                          .groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
                          .where(F.col("t") + F.col("o") >= LEAST), "toxicity-terms")
    n_terms = counts.count()
    # Chernoff bound on the chance that so many of a term's documents are toxic; below one in all terms is evidence.
    share, n = toxic / (toxic + other + 1.0), F.col("t") + F.col("o")
    part = lambda k, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)
    evidence = part(F.col("t"), share) + part(F.col("o"), 1 - share)
    best = (counts.withColumn("evidence", evidence)
            .where((F.col("t") > n * share) & (F.col("evidence") >= math.log(max(2, n_terms))))
            .orderBy(F.desc("evidence"), "term").limit(4 * voters))
    return specific({r["term"]: (r["t"], r["o"]) for r in best.collect()})[:voters], toxic, other


def specific(counts: dict[str, tuple[float, float]]) -> list[str]:
    """The terms without patterns that a longer term of theirs all but explains."""
    kept = []
    for term, (toxic, other) in counts.items():
        stem = term.rstrip("*")
        longer = (c for t, c in counts.items() if t != term and t.rstrip("*").startswith(stem)) if term.endswith("*") else ()
        if not any(t >= 0.8 * toxic and o <= other for t, o in longer):
            kept.append(term)
    return kept


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE,
        voters: int = VOTERS) -> ToxicityModel:
    """Learns from the texts of ``documents`` that have a row in ``labels`` (``key``, ``toxic``)."""
    rows = checkpointed(_sample(documents, labels, key, sample).withColumn("row", F.monotonically_increasing_id()),
                        "toxicity-sample")
    rows = checkpointed(_families(rows), "toxicity-families").select("text", "toxic", "weight")
    mined, toxic, other = _mine(rows, voters)
    if not mined:
        return ToxicityModel()
    model = ToxicityModel(mined)

    def vote():
        def fn(batch):
            found = [model.votes(as_text(t)) for t in batch.column(0).to_pylist()]
            return [[sorted(f) for f in found], [[f[i] for i in sorted(f)] for f in found], batch.column(1), batch.column(2)]
        return fn

    # About 3 * sample rows of votes.
    found = map_batches(rows, vote, "voters array<int>, counts array<int>, toxic int, weight double").collect()
    found.sort(key=lambda r: (r["toxic"], r["voters"], r["counts"], r["weight"]))
    weight = np.array([r["weight"] for r in found])
    fires, given = np.zeros((len(found), len(mined))), np.array([r["toxic"] for r in found], float)
    for i, r in enumerate(found):
        fires[i, r["voters"]] = 1
    # The sample holds more toxic documents than the table; posteriors are those of the sample's mixture.
    model.prior = toxic / (toxic + other) if other else 0.5
    posterior = label_model(model, fires, given, weight)
    train_linear(model, [dict(zip(r["voters"], r["counts"])) for r in found], posterior, weight)
    return model


def label_model(model: ToxicityModel, fires: np.ndarray, given: np.ndarray, weight: np.ndarray | None = None,
                trust: float = 0.97, rounds: int = 25) -> np.ndarray:
    """Firing rates and correlations of the voters; returns the posteriors of the rows.

    ``given`` is the label as a voter that is right with probability ``trust``.  After two rounds correlated
    voters are joined to clusters, which fire if any of theirs does, or in a large one an eighth."""
    label_odds = np.where(given > 0.5, 1, -1) * math.log(trust / (1 - trust))
    p = np.where(given > 0.5, trust, 1 - trust)
    model.cluster, votes = np.arange(fires.shape[1]), fires
    weight = np.ones(len(fires)) if weight is None else weight
    for step in range(rounds):
        if step == 2:
            model.cluster = clusters(fires, p, weight)
            votes = np.stack([fires[:, model.cluster == c].mean(1) >= 1 / 8 for c in range(model.cluster.max() + 1)], 1).astype(float)
        t, o = p * weight, (1 - p) * weight
        model.fire_toxic = np.clip((t @ votes + 0.5) / (t.sum() + 1), 1e-4, 1 - 1e-4)
        model.fire_other = np.clip((o @ votes + 0.05) / (o.sum() + 1), 1e-5, 1 - 1e-4)
        model.prior = float(np.clip(t.sum() / weight.sum(), 1e-3, 1 - 1e-3))
        q = model.posterior(votes)
        odds = np.log(np.clip(q, 1e-12, 1 - 1e-12) / np.clip(1 - q, 1e-12, 1)) + label_odds
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - p).max() < 1e-4 and step > 4
        p = new
        if done:
            break
    return p


def clusters(fires: np.ndarray, p: np.ndarray, weight: np.ndarray, bound: float = 0.5) -> np.ndarray:
    """A number per voter: voters whose residuals, given the class, correlate above ``bound`` share it."""
    t, o = p * weight, (1 - p) * weight
    toxic, other = t @ fires / max(t.sum(), 1e-9), o @ fires / max(o.sum(), 1e-9)
    residual = (fires - np.outer(p, toxic) - np.outer(1 - p, other)) * np.sqrt(weight)[:, None]
    residual /= np.sqrt((residual ** 2).sum(0)) + 1e-9
    near = residual.T @ residual > bound
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] < 0:
            label[start], todo = label.max() + 1, [start]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (label < 0))
                label[new] = label[start]
                todo += new.tolist()
    return label


def train_linear(model: ToxicityModel, votes: list[dict[int, int]], posterior: np.ndarray, weight: np.ndarray | None = None,
                 hold: float = 0.2) -> None:
    """Logistic regression on the posteriors (Newton steps); terms of toxicity never count against it.

    Features: 1 plus the logarithm of each voter's count, and the logarithm of 1 plus the clusters that fire, by their evidence."""
    n = len(model.voters)
    weight = np.ones(len(votes)) if weight is None else weight
    x = np.zeros((len(votes), n + 2))
    for i, found in enumerate(votes):
        for v, k in found.items():
            x[i, v] = 1 + math.log(k)
        x[i, n] = math.log1p(model.firing(found))
    x[:, n + 1] = 1
    w, ridge = np.zeros(n + 2), np.full(n + 2, hold)
    ridge[n:] = 0.05
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (q * (1 - q) + 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (posterior - q)) - ridge * w)
        w = w + np.clip(step, -4, 4)
        w[:n + 1] = np.maximum(w[:n + 1], 0)
        if np.abs(step).max() < 1e-4:
            break
    model.weights, model.bias = w[:n + 1], float(w[n + 1])


def score(documents: DataFrame, model: ToxicityModel, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``score`` and ``predicted`` for every row, from the whole text alone."""
    rows = documents.select(*keys, F.col(text).alias("__in"))
    shared = documents.sparkSession.sparkContext.broadcast(model)        # at most VOTERS terms

    def start():
        m = shared.value

        def fn(batch):
            return [*batch.columns[:-1], [m.score(as_text(t)) for t in batch.columns[-1].to_pylist()]]
        return fn

    return (map_batches(rows, start, with_fields(rows.drop("__in"), "score double"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
