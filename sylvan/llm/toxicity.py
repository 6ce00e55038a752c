"""Toxicity by weak supervision (operator 5).

Many weak voters look at a document: a fixed lexicon for each language, patterns (shouting, masked
letters, abuse in the second person), and groups of words and word beginnings mined from
labelled rows: on either half of the sample those vote that the other half showed. A voter fires or doesn't. The given label of a training row is one more voter whose
accuracy is estimated like the others'. A generative label model has the true class as
its hidden variable: the class draws the votes, and a voter may also depend on one other voter, its parent in a
tree (the heaviest spanning forest of the voters' mutual information given the class, edges beyond chance only). So
the parameters are the class's share, and each voter's rate of firing for each class and each vote of its parent:
accuracies and correlations, all estimated by expectation maximisation from the votes. The given label has no
parent and is none: it errs independently of the others given the class. A voter fires at least as often in
class 1 as in class 0. A linear (logistic) classifier is trained on the posterior
labels, over words and word beginnings, and scores every whole text.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, at most
``PER_CLASS`` of each class (the first by MD5 of the doc_id; the classes' true shares
are counted over all such rows). Signs are counted in the cluster; what reaches the driver is at most
``SIGNS`` signs, and for each sampled row those it holds, however long its text. Labels, lang, source and doc_id
are never inputs of a score. Conflicting labels of one doc_id count as toxic; other values than 0 and 1
are ignored; of rows that share a doc_id the one with the smallest text is learnt from. Without labelled rows
the lexicon alone decides. An empty table gives an empty result; other columns play no part.

Null and empty texts get the score of a text without any sign, which is below 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import discard, free, materialise, release, ship

#: Labelled rows of each class that the models are fitted on, at most.
PER_CLASS = 3000
#: Lengths of word beginnings that may be signs.
BEGINNINGS = (4, 5, 6, 7)
#: Steps at which the number of a text's words of one beginning is a sign.
STEPS = (1, 2, 3, 5)
#: Mined signs, at most, best first; of these, beginnings that the classifier takes up.
SIGNS, BEGINS = 6000, 600
#: Voters of mined words and of mined beginnings; each has signs of like information.
GROUPS = (12, 6)
#: Documents of the sample that a mined sign is in, at least.
SUPPORT = 5
MEMO = 100_000

# A fixed lexicon: common insults in the languages of the corpus.
LEXICONS = (
    frozenset(
        """
        idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool imbecile
        cretin dimwit filth filthy vermin pig swine bastard bitch whore slut asshole dick jerk freak creep parasite coward liar
        """.split()
    ),
    frozenset("idiote imbécile crétin connard connasse salaud salope ordure pourriture abruti débile minable raclure".split()),
    frozenset("dummkopf trottel arschloch schwein drecksack abschaum versager wichser schlampe hurensohn blödmann widerlich".split()),
    frozenset("idiota imbécil estúpido estúpida basura gilipollas cabrón cabron mierda asqueroso asquerosa puta payaso perdedor".split()),
)
LEXICON = frozenset().union(*LEXICONS)
WORD = re.compile(r"[^\W_]+")
SHOUT = re.compile(r"\b[A-Z]{4,}!{2,}")
MASKED = re.compile(r"\b[A-Za-z]+[*@$#]+[A-Za-z]+\b")
YOU = re.compile(r"\b(?:you|you're|tu es|du bist|eres)\b(?:\s+\S+){0,2}\s+(?:" + "|".join(sorted(map(re.escape, LEXICON))) + r")\b", re.IGNORECASE)


def patterns(text: str | None) -> list[bool]:
    text = text or ""
    return [bool(SHOUT.search(text)), bool(MASKED.search(text)), bool(YOU.search(text))]


def level(count: int, words: int) -> list[str]:
    """Steps that a beginning's count passes, absolute and against the number of distinct words."""
    share = count / max(words, 1)
    return [f"n{k}" for k in (1, 2, 3, 5, 8) if count >= k] + [f"s{k}" for k in (1, 2, 4, 8) if share * 100 >= k and count >= 2]


@dataclass
class Model:
    """A linear classifier: bias, weights of words, and weights of (beginning, step)."""

    bias: float = -3.0
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(LEXICON, 4.0))
    begin: dict[str, dict[str, float]] = field(default_factory=dict)
    _memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "words": self.words, "begin": self.begin, "_memo": {}}

    def look(self, w: str) -> tuple[float, tuple[str, ...]] | None:
        """A word's own weight and the known beginnings it has; None if it has neither."""
        known = tuple(w[:n] for n in BEGINNINGS if len(w) > n and w[:n] in self.begin)
        own = self.words.get(w, 0.0)
        return (own, known) if known or own else None

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        memo, z, begin = self._memo, self.bias, {}
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            try:
                hit = memo[w]
            except KeyError:
                hit = memo[w] = self.look(w)
            if hit is not None:
                z += hit[0]
                for b in hit[1]:
                    begin[b] = begin.get(b, 0) + 1
        for b, n in begin.items():
            weights = self.begin[b]
            for step in level(n, len(words)):
                z += weights.get(step, 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def signs_of(text: str | None) -> Iterator[tuple[str, int]]:
    """The text's signs: (word, 0), and (beginning, step) for each step that the beginning's count of words passes."""
    words = set(WORD.findall((text or "").lower()))
    yield from ((w, 0) for w in words)
    begin = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) > n)
    yield from ((b, k) for b, c in begin.items() for k in STEPS if c >= k)


def counted(sample: DataFrame) -> DataFrame:
    """s, k, half, a, b: in how many rows of class 1 and class 0 of a half of the sample each sign is. ``sample``: half,
    toxic and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for half, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.update((s, k, half, t) for s, k in signs_of(text))
            columns = list(zip(*((*key, n) for key, n in held.items()), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["s", "k", "half", "t", "n"])

    each = sample.select("half", "toxic", "text").mapInArrow(run, "s string, k int, half int, t int, n long")
    count = lambda t: F.sum(F.when(F.col("t") == t, F.col("n")).otherwise(0))
    return materialise(each.groupBy("s", "k", "half").agg(count(1).alias("a"), count(0).alias("b")), "toxic-signs")


def mined(held: DataFrame, ones: int, zeros: int) -> list[tuple[str, int]]:
    """Signs that tell the classes apart: (word, 0) or (beginning, least count), best information first,
    at most one step for each beginning. ``held``: s, k, a, b as :func:`counted` has them; ``ones``, ``zeros``: the rows."""
    words = held.where("k = 0")
    # beginnings count that several words of class 1 have
    starts = F.explode(F.filter(F.array(*[F.when(F.length("s") > n, F.substring("s", 1, n)) for n in BEGINNINGS]), lambda x: x.isNotNull()))
    variety = words.where("a > 0").select(starts.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("words"))
    trials = words.count() + 4 * variety.count()

    def divergence(p: Column, q: Column) -> Column:
        return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))

    pooled = (F.col("a") + F.col("b") + 0.2) / (ones + zeros + 2)
    gain = ones * divergence((F.col("a") + 0.1) / (ones + 1), pooled) + zeros * divergence((F.col("b") + 0.1) / (zeros + 1), pooled)
    known = words.union(held.where("k > 0").join(variety.where(F.col("words") >= SUPPORT).select("s"), "s", "left_semi").select(*words.columns))
    known = known.where((F.col("a") + F.col("b") >= SUPPORT) & (F.col("a") * zeros > 3 * F.col("b") * ones)).withColumn("gain", gain)
    # beyond what so many trials give by chance; the best step of a beginning
    best = known.where(F.col("gain") > math.log(max(trials, 2))).groupBy("s", (F.col("k") > 0).alias("begins")).agg(F.max(F.struct("gain", "k")).alias("m"))
    rows = best.select("s", "m.k", "m.gain").orderBy(F.desc("gain"), "s", "k").limit(SIGNS).collect()
    return [(r["s"], r["k"]) for r in rows]


@dataclass
class LabelModel:
    """The class's share, each voter's parent (-1: none), and rates of firing: [class, parent's vote, voter]."""

    share: float
    parent: np.ndarray
    rates: np.ndarray

    def joint(self, fires: np.ndarray) -> np.ndarray:
        """Log of the probability of each row's votes together with class 0 and class 1."""
        up = np.where(self.parent >= 0, fires[:, self.parent], 0).astype(int)
        each = np.arange(fires.shape[1])
        out = []
        for c, prior in ((0, 1 - self.share), (1, self.share)):
            r = self.rates[c][up, each]
            out.append(math.log(prior) + np.log(np.where(fires > 0, r, 1 - r)).sum(axis=1))
        return np.column_stack(out)

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        z = self.joint(fires)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -40, 40)))


def forest(fires: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Parents of the voters: the heaviest spanning forest of mutual information given the class. Voter 0 stands alone."""
    n, m = fires.shape
    info = np.zeros((m, m))
    for q in (post, 1 - post):
        total = max(q.sum(), 1e-9)
        on = q @ fires / total
        both = (fires * q[:, None]).T @ fires / total
        for x, px in ((1, on), (0, 1 - on)):
            for y, py in ((1, on), (0, 1 - on)):
                p = both if x and y else px[:, None] - both if x else py[None, :] - both if y else 1 - on[:, None] - on[None, :] + both
                p = np.clip(p, 1e-12, None)
                info += total / n * p * np.log(p / np.clip(np.outer(px, py), 1e-12, None))
    parent, joined = np.full(m, -1), {1} if m > 1 else set()
    best = {j: (info[1, j], 1) for j in range(2, m)}
    while best:  # Prim's algorithm; an edge stays if it is worth its two parameters
        j = max(best, key=lambda x: (best[x][0], -x))
        gain, up = best.pop(j)
        if gain > math.log(n) / n:
            parent[j] = up
        joined.add(j)
        for k in best:
            best[k] = max(best[k], (info[j, k], j))
    return parent


def label_model(fires: np.ndarray, clean: tuple[int, ...] = (), rounds: int = 100) -> LabelModel:
    """Fit by expectation maximisation. ``fires``: rows x voters of 0 and 1, the given labels first, from which
    it starts; ``clean``: voters for class 0."""
    n, m = fires.shape
    post = np.clip(fires[:, 0] * 0.9 + 0.05, 0, 1)
    sign = np.array([-1 if j in clean else 1 for j in range(m)])
    parent = np.full(m, -1)
    for turn in range(rounds):
        if turn % 10 == 5:
            parent = forest(fires, post)
        up = np.where(parent >= 0, fires[:, parent], 0)
        rates = np.empty((2, 2, m))
        weight = np.empty((2, 2, m))
        for c, q in ((0, 1 - post), (1, post)):
            for v in (0, 1):
                here = q[:, None] * (up == v)
                weight[c, v] = here.sum(axis=0) + 1
                rates[c, v] = ((here * fires).sum(axis=0) + 0.5) / weight[c, v]
        pooled = (rates * weight).sum(axis=0) / weight.sum(axis=0)
        rates = np.where((rates[1] - rates[0]) * sign < 0, pooled, rates)  # no better than chance: says nothing
        model = LabelModel(float(np.clip(post.mean(), 0.01, 0.99)), parent, np.clip(rates, 1e-4, 1 - 1e-4))
        after = model.posterior(fires)
        if turn > 20 and np.abs(after - post).max() < 1e-4:
            break
        post = after
    return model


def groups(found: tuple[tuple[str, int], ...]) -> list[frozenset[tuple[str, int]]]:
    """Mined voters: signs of like information together; always as many."""
    own = [s for s in found if s[0] not in LEXICON]
    out = []
    for kind, many in zip(([s for s in own if s[1] == 0], [s for s in own if s[1]]), GROUPS, strict=True):
        size = max(1, -(-len(kind) // many))
        out += [frozenset(kind[i * size : (i + 1) * size]) for i in range(many)]
    return out


@dataclass(frozen=True)
class Signs:
    """What is looked for in the sampled rows: the classifier's signs, and those that vote on the rows of either half,
    which were mined from the other half: a sign's chance hits are no votes."""

    found: tuple[tuple[str, int], ...]
    votes: tuple[tuple[tuple[str, int], ...], tuple[tuple[str, int], ...]]

    def words(self) -> list[str]:
        return sorted(LEXICON | {s for s, k in self.found if k == 0})

    def begins(self) -> list[str]:
        return list(dict.fromkeys(s for s, k in self.found if k))[:BEGINS]

    def features(self) -> list[tuple[str, str]]:
        """(word, "") and (beginning, step) by the number of the feature."""
        return [(w, "") for w in self.words()] + [(b, s) for b in self.begins() for s in level(100, 100)]

    def looker(self):
        """A function of half and text: which voters fire, and the numbers of the text's features."""
        number = {x: i for i, x in enumerate(self.features())}
        begins, voters = set(self.begins()), [groups(v) for v in self.votes]

        def look(half: int, text: str | None) -> tuple[list[bool], list[int]]:
            signs = set(signs_of(text))
            words = {s for s, k in signs if k == 0}
            votes = [*patterns(text), *(not words.isdisjoint(x) for x in LEXICONS), *(not signs.isdisjoint(g) for g in voters[half])]
            begin = Counter(b for w in words for n in BEGINNINGS if len(w) > n and (b := w[:n]) in begins)
            got = [number[w, ""] for w in words if (w, "") in number] + [number[b, s] for b, n in begin.items() for s in level(n, len(words))]
            return votes, sorted(got)

        return look


def fit(signs: Signs, rows: list[tuple[int, list[bool], list[int]]], share: float, posterior: bool = True) -> Model:
    """The classifier from labelled rows (label, votes, features); ``share``: of class 1 among all. ``posterior``:
    whether it is trained on the label model's posterior, or on the given labels themselves."""
    y = np.array([t for t, _, _ in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model()
    fires = np.array([[t, *votes] for t, votes, _ in rows], float)
    target = label_model(fires).posterior(fires) if posterior else y
    # the sample holds the given labels in other shares than the table
    odds = share / (1 - share) * (1 - y.mean()) / y.mean()
    names = signs.features()
    row = np.repeat(np.arange(len(rows)), [len(f) for _, _, f in rows])
    col = np.concatenate([np.array(f, int) for _, _, f in rows])
    weights, bias = logistic(row, col, len(rows), len(names), target, np.where(y > 0, odds, 1.0))
    model = Model(float(min(bias, -1.0)), {}, {})
    for (s, step), w in zip(names, weights.tolist(), strict=True):
        if not step:
            # words of the lexicon that the sample lacks keep a part of the lexicon's weight
            model.words[s] = w if w else (2.5 if s in LEXICON else 0.0)
        elif w:
            model.begin.setdefault(s, {})[step] = w
    return model


def logistic(row: np.ndarray, col: np.ndarray, n: int, m: int, target: np.ndarray, importance: np.ndarray, ridge: float = 0.05, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over 0/1 features given as coordinates (Adagrad, full batch)."""
    w, bias = np.zeros(m), math.log((target @ importance + 0.5) / ((1 - target) @ importance + 0.5))
    gw, gb = np.full(m, 1e-6), 1e-6
    for _ in range(rounds):
        z = bias + np.bincount(row, weights=w[col], minlength=n)
        d = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad, gradb = np.bincount(col, weights=d[row], minlength=m) + ridge * w, d.sum()
        gw, gb = gw + grad**2, gb + gradb**2
        w -= 0.5 * grad / np.sqrt(gw)
        bias -= 0.5 * gradb / math.sqrt(gb)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, posterior: bool = True) -> Model:
    """Fit on labelled rows of the training folds; what reaches the driver is bounded by ``per_class`` and ``SIGNS``."""
    ship(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    given = given.where(~held_out(F.col("doc_id")))
    sizes = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return Model()
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    one = given.where("toxic = 1").select("doc_id", "toxic").distinct().orderBy(*order).limit(per_class)
    zero = given.where("toxic = 0").select("doc_id", "toxic").distinct().orderBy(*order).limit(per_class)
    chosen = one.union(zero).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows of two numbers
    # a doc_id that the table repeats counts once; the order of tasks plays no part
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("m")).select("doc_id", "m.toxic", "m.text")
    sample = materialise(sample.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "toxic-sample")
    many = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}  # four rows
    held = counted(sample)
    whole = held.groupBy("s", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = mined(whole, *(sum(n for (_, x), n in many.items() if x == t) for t in (1, 0)))
    other = [mined(held.where(F.col("half") == 1 - h).drop("half"), many.get((1 - h, 1), 0), many.get((1 - h, 0), 0)) for h in (0, 1)]
    signs = Signs(tuple(found), (tuple(other[0]), tuple(other[1])))
    discard(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = signs.looker()
        for batch in batches:
            seen = [look(h, x) for h, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v for v, _ in seen], pa.list_(pa.bool_())), pa.array([f for _, f in seen], pa.list_(pa.int32()))], names=["doc_id", "toxic", "votes", "features"])
        release()

    got = sample.select("doc_id", "toxic", "half", "text").mapInArrow(run, "doc_id long, toxic int, votes array<boolean>, features array<int>")
    rows = sorted((r["doc_id"], r["toxic"], list(r["votes"]), list(r["features"])) for r in got.toLocalIterator())
    discard(sample)
    return fit(signs, [r[1:] for r in rows], sizes[1] / (sizes[0] + sizes[1]), posterior)


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_column(model: Model):
    """A vectorised function of the text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series([model.score(x) for x in text], dtype="float64")
        model._memo.clear()  # noqa: SLF001
        release()

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model)(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not call toxic, whole; columns of any name pass through."""
    ship(docs.sparkSession)
    (name,) = free(docs, "toxicity")
    return docs.withColumn(name, score_column(model)(F.col("text").cast("string"))).where(F.col(name) < 0.5).drop(name)
