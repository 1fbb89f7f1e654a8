"""Statistics, pair features, ranking metrics and models."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.portable import jaro_winkler, share, tokens
from tessera.functions.ranks import before
from tessera.operators import boosting
from tessera.operators.joins import GRAPH_CTES, found, jaccard, rounded
from tessera.operators.retrieval import COSINE, cosine_top
from tessera.plans.staging import stage
from tessera.plans.tables import Query, Tables

col = F.col


# Statistics


def t_cdf(x: float, df: float) -> float:
    """Student's distribution function, by the continued fraction of the incomplete beta function."""
    a, b, z = df / 2, 0.5, df / (df + x * x)

    def fraction(a, b, z):
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * z / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 300):
            for term in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + term / (c if abs(c) > tiny else tiny)
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z)) if 0 < z < 1 else 0.0
    tail = front * fraction(a, b, z) / a if z < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - z) / b
    return 1 - tail / 2 if x > 0 else tail / 2


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _growth(t: Tables) -> DataFrame:
    """Yearly growth of each kind: least squares of the log of counts."""
    n = t.pubs.filter("year <= 2000").groupBy("kind", "year").agg(F.count("*").alias("n"))
    y, x = F.log("n"), col("year").cast("double")
    return n.groupBy("kind").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("years"))


PERIODS = ((1995, 2000), (1995, 1997), (1998, 2000))


def _growth_periods(t: Tables) -> DataFrame:
    """Yearly growth of each kind and of all, in three periods, with Student's interval for the slope and the doubling time."""
    n = t.pubs.groupBy("kind", "year").agg(F.count("*").alias("n"))
    n = n.unionByName(t.pubs.groupBy(F.lit("all").alias("kind"), "year").agg(F.count("*").alias("n")))
    spans = F.broadcast(t.spark.createDataFrame([(a, b, t_quantile(0.975, b - a - 1)) for a, b in PERIODS], "since int, until int, quantile double"))
    y, x = F.log("n"), col("year").cast("double")
    fit = n.join(spans, col("year").between(col("since"), col("until"))).groupBy("kind", "since", "until", "quantile")
    # the residual sum of squares is syy - slope * sxy
    fit = fit.agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count("*").alias("years"))
    half = col("quantile") * F.sqrt(F.greatest(col("syy") - col("slope") * col("sxy"), F.lit(0.0)) / (col("years") - 2) / col("sxx"))
    return fit.select("kind", "since", "until", "slope", "r2", (col("slope") - half).alias("low"), (col("slope") + half).alias("high"), F.when(F.abs("slope") > 1e-9, F.log(F.lit(2.0)) / col("slope")).alias("doubling"))


def _top_share(t: Tables) -> DataFrame:
    """Mean, median and largest number of papers a person, and the share of the most productive hundredth (at least one)."""
    n = t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("v"))
    h = n.groupBy("v").agg(F.count("*").alias("c"))
    totals = n.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.median("v").alias("mid"), F.max("v").alias("most"), F.greatest(F.lit(1), F.floor(F.count("*") / 100)).alias("k"))
    ranked = before(h, [col("v").desc()], {"above": col("c")}).crossJoin(F.broadcast(totals))
    taken = F.sum(F.greatest(F.lit(0), F.least(col("c"), col("k") - col("above"))) * col("v"))
    return ranked.groupBy("n", "s", "mid", "most", "k").agg((taken / col("s")).alias("top"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two whole-number labels beyond chance, disagreements weighted by their squared distance, from counts."""
    cell = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pa, pb = cell.groupBy(col(a).alias("x")).agg(F.sum("n").alias("na")), cell.groupBy(col(b).alias("y")).agg(F.sum("n").alias("nb"))
    seen = cell.agg(F.sum("n").alias("n"), F.sum(col("n") * (col(a) - col(b)) ** 2).alias("seen"))
    chance = pa.crossJoin(F.broadcast(pb)).agg(F.sum(col("na") * col("nb") * (col("x") - col("y")) ** 2).alias("chance"))  # a row a label
    return seen.crossJoin(F.broadcast(chance)).select("n", (1 - F.try_divide(col("seen") * col("n"), col("chance"))).alias("kappa"))


def _weighted(t: Tables) -> DataFrame:
    """Of a customer's segment number and nation modulo five."""
    number = F.length("c_mktsegment") % 5
    return weighted_kappa(t.table("customer").select(number.alias("a"), (col("c_nationkey") % 5).alias("b")), "a", "b")


def growth_interval(rows: list[tuple[float, float]], level: float = 0.95) -> tuple[float, float, float]:
    """(Slope, low, high) of log counts on years, with Student's interval; for a handful of yearly totals."""
    x, y = (np.array(v, float) for v in zip(*rows, strict=True))
    y = np.log(y)
    sxx = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / sxx
    rest = y - y.mean() - slope * (x - x.mean())
    half = t_quantile(0.5 + level / 2, len(x) - 2) * math.sqrt((rest**2).sum() / (len(x) - 2) / sxx)
    return slope, slope - half, slope + half


def _gini(t: Tables) -> DataFrame:
    """Gini coefficient, share of the top hundredth and power-law exponent of papers a person, from the histogram."""
    n = t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    h = before(n, [col("v")], {"mass": col("c") * col("v")})  # a row for each distinct value
    total = h.agg(F.sum("c").alias("n"), F.sum(col("c") * col("v")).alias("s"))
    area = F.sum(col("c") * (2 * col("mass") + col("c") * col("v")))
    tail = F.when(col("v") >= 20, col("c"))
    return h.crossJoin(F.broadcast(total)).groupBy("n", "s").agg((1 - area / (col("n").cast("double") * col("s"))).alias("gini"), (1 + F.sum(tail) / F.sum(tail * F.log(col("v") / 19.5))).alias("alpha"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties at their mean, from counts of distinct values."""
    n = df.groupBy(value).agg(F.count("*").alias("c"))
    return df.join(before(n, [col(value)], {"below": col("c")}).select(value, (col("below") + (col("c") + 1) / 2).alias(name)), value)


def _spearman(t: Tables) -> DataFrame:
    per = t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("papers"), F.sum(col("has_orcid").cast("int")).alias("orcid"))
    r = average_ranks(average_ranks(per, "papers", "ra"), "orcid", "rb")
    return r.agg(F.count("*").alias("people"), F.corr("ra", "rb").alias("rho"))


def _kappa(t: Tables) -> DataFrame:
    """Agreement of two labels beyond chance."""
    x = t.table("labels").filter("quality IS NOT NULL AND toxic IS NOT NULL").agg(F.count("*").alias("n"), share(col("quality") == col("toxic")).alias("po"), F.avg("quality").alias("a"), F.avg("toxic").alias("b"))
    pe = col("a") * col("b") + (1 - col("a")) * (1 - col("b"))
    return x.withColumn("kappa", (col("po") - pe) / (1 - pe))


def _wilson(t: Tables) -> DataFrame:
    z = 1.959964
    x = t.pubs.groupBy("venue").agg(F.count("*").alias("n"), share(col("has_oa")).alias("p"))
    mid = (col("p") + z * z / (2 * col("n"))) / (1 + z * z / col("n"))
    half = z / (1 + z * z / col("n")) * F.sqrt(col("p") * (1 - col("p")) / col("n") + z * z / (4.0 * col("n") * col("n")))
    return x.select("venue", "n", (mid - half).alias("low"), (mid + half).alias("high"))


# Pairs, metrics and models


def pair_features(t: Tables) -> DataFrame:
    """Pairs of people of one name: shared co-authors and venues, and how close their years are.

    Shared neighbours are counted by joining (name, other) rows, not by comparing sets: a pair meets once for each neighbour
    it shares, and a hot name is split by the skew join."""
    people = t.persons.filter("page_kind = 'numbered'").select("person", "name")
    authored = t.authored.select("pid", "person", "venue", "year")
    met = authored.select("pid", "person").join(authored.select("pid", col("person").alias("other")), "pid").filter("person <> other").select("person", "other").distinct()
    own = authored.groupBy("person").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.collect_set("venue").alias("venues"))  # a person's venues are few
    x = stage(people.join(own, "person").join(met.groupBy("person").agg(F.count("*").alias("n")), "person", "left").fillna(0, ["n"]), "people")
    rows = stage(met.join(x.select("person", "name"), "person"), "met")
    side = lambda df, s: df.select("name", *[col(c).alias(f"{c}_{s}") for c in df.columns if c not in ("name", "other")], *[c for c in df.columns if c == "other"])
    shared = side(rows, "a").join(side(rows, "b"), ["name", "other"]).filter("person_a < person_b").groupBy("person_a", "person_b").agg(F.count("*").alias("shared"))
    pairs = side(x, "a").join(side(x, "b"), "name").filter("person_a < person_b").join(shared, ["person_a", "person_b"], "left").fillna(0, ["shared"])
    gap = F.greatest(F.lit(0), F.greatest("first_a", "first_b") - F.least("last_a", "last_b"))
    return pairs.select("person_a", "person_b", "shared", F.size(F.array_intersect("venues_a", "venues_b")).alias("venues"), gap.alias("gap"), col("n_a").alias("na"), col("n_b").alias("nb"))


def _nb(t: Tables) -> DataFrame:
    """The source that each item's words point to: naive Bayes over words of the texts."""
    each = t.texts.select("id", "source", F.explode(F.array_distinct(tokens(col("text")))).alias("token"))
    n = each.groupBy("token", "source").agg(F.count("*").alias("n"))
    prior = t.texts.groupBy("source").agg(F.count("*").alias("docs"))
    q = t.table("benchmark").select("item_id", F.explode(F.array_distinct(tokens(col("text")))).alias("token"))
    pairs = q.join(n, "token").join(prior, "source")
    s = pairs.groupBy("item_id", "source").agg(F.round(F.sum(F.log(col("n") + 0.1) - F.log(F.lit(0.1)) - F.log((col("docs") + 1).cast("double"))), 6).alias("score"), F.count("*").alias("known"))
    w = Window.partitionBy("item_id").orderBy(col("score").desc(), "source")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


def _deciding(p, then):
    """Of an anchor that has candidates which come true: those at or before the fifth place, and those that tie with the first that
    comes true."""
    true = p.among(then) == 1
    if not true.any():
        return true
    fifth = np.partition(p.score, -min(5, len(p.score)))[-min(5, len(p.score))]
    return (p.score >= fifth) | (p.score == p.score[true].max())


def _rank_metrics(t: Tables) -> DataFrame:
    """MRR, hits and precision of candidate links ordered by Adamic-Adar, ties by a hash. All candidates are counted; rows are made of
    those only whose place decides, whole classes of ties with the number of candidates above."""
    jitter = F.md5(F.concat(col("a").cast("string"), F.lit("-"), col("b").cast("string")))
    w = Window.partitionBy("a", "above").orderBy(jitter)
    r = found(t, ["above", "y"], _deciding).withColumn("rank", col("above") + F.row_number().over(w))
    per = r.groupBy("a").agg(F.min(F.when(col("y") == 1, col("rank"))).alias("first"), F.sum(F.when(col("rank") <= 5, col("y"))).alias("top"))
    return per.agg(F.count("*").alias("queries"), F.avg(1.0 / col("first")).alias("mrr"), F.avg((col("first") <= 5).cast("int")).alias("hits5"), F.avg(col("top") / 5).alias("p5"))


def _bins(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at = np.minimum(np.floor(x["common"] / (x["da"].astype(np.int64) + x["db"] - x["common"]) * 50 + 1e-9), 9).astype(np.int64)
    pairs, came = np.bincount(at, minlength=10), np.bincount(at, x["y"], 10).astype(np.int64)
    return {"bin": np.flatnonzero(pairs), "pairs": pairs[pairs > 0], "came": came[pairs > 0]}


def _calibration(t: Tables) -> DataFrame:
    """How often candidates come true, by bins of their Jaccard similarity; counted where the candidates are found."""
    n = found(t, ["common", "da", "db", "y"], fold=_bins, schema="bin long, pairs long, came long")
    return n.groupBy("bin").agg(F.sum("pairs").alias("pairs"), (F.sum("came") / F.sum("pairs")).alias("came"))


def bcubed(df: DataFrame, truth: str, found: str) -> DataFrame:
    """B-cubed precision and recall from counts of (truth, cluster) cells; no pairs are formed."""
    cell = df.groupBy(truth, found).agg(F.count("*").alias("n"))
    a, b = cell.groupBy(truth).agg(F.sum("n").alias("na")), cell.groupBy(found).agg(F.sum("n").alias("nb"))
    x = cell.join(a, truth).join(b, found)
    return x.agg(F.sum("n").alias("items"), (F.sum(col("n") * col("n") / col("nb")) / F.sum("n")).alias("precision"), (F.sum(col("n") * col("n") / col("na")) / F.sum("n")).alias("recall"))


def _vectors(t: Tables) -> DataFrame:
    """Precision of nearest vectors by label."""
    return cosine_top(t).groupBy("want").agg(F.count("*").alias("neighbours"), share(col("want") == col("label")).alias("precision"))


def jaro_resolve(t: Tables, least: float = 0.86) -> DataFrame:
    """Names alike within blocks of their first three letters, by Jaro-Winkler."""
    n = t.persons.select("name").distinct()
    p = n.select("name", F.substring("name", 1, 3).alias("k")).join(n.select(col("name").alias("other"), F.substring("name", 1, 3).alias("k")), "k").filter("name < other AND abs(length(name) - length(other)) <= 6")
    return p.withColumn("s", F.round(jaro_winkler("name", "other"), 6)).filter(col("s") >= least)


#: What the trees see of a pair.
SEEN = ("common", "adamic", "allocation", "jaccard", "attachment", "strength")


def _seen(x: dict[str, np.ndarray]) -> list[np.ndarray]:
    made = {"jaccard": jaccard, "attachment": lambda x: x["da"].astype(np.int64) * x["db"]}
    return [made[c](x) if c in made else x[c] for c in SEEN]


def tested(a: int) -> bool:
    """Anchors that are scored and not trained on: three buckets of ten, as bucket(a + 1, 10)."""
    return int(hashlib.md5(str(a + 1).encode()).hexdigest()[:8], 16) % 10 < 3


class _Values:
    """How often each step of a value occurs in a block."""

    def __init__(self):
        self.n = np.zeros((len(SEEN), boosting.STEPS), np.int64)

    def add(self, x: dict[str, np.ndarray]) -> None:
        for n, v in zip(self.n, _seen(x), strict=True):
            n += np.bincount(boosting.steps(v), minlength=boosting.STEPS)

    def end(self) -> dict[str, np.ndarray]:
        column, step = np.nonzero(self.n)
        return {"at": column * boosting.STEPS + step, "n": self.n[column, step]}


class _Cells:
    """How many pairs of a block are in each cell, and how many of them come true."""

    def __init__(self, bins: np.ndarray):
        self.bins, self.parts, self.rows = bins, [], 0

    def add(self, x: dict[str, np.ndarray]) -> None:
        key, n = np.unique(boosting.cells(_seen(x), self.bins) << 1 | x["y"], return_counts=True)
        self.parts.append((key, n))
        self.rows += len(key)
        if self.rows > 4_000_000:
            self._join()

    def _join(self) -> None:
        key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in self.parts]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *[n for _, n in self.parts]]), len(key)).astype(np.int64)
        self.parts, self.rows = [(key, n)], 0

    def end(self) -> dict[str, np.ndarray]:
        self._join()
        ((key, n),) = self.parts
        return {"cell": key >> 1, "ones": n * (key & 1), "zeros": n * (1 - (key & 1))}


def link_model(t: Tables, rounds: int = 20) -> DataFrame:
    """Gradient-boosted trees on candidate links: trained on most anchors, scored on the rest. The pairs are walked three times and
    never written: to count their values, which gives the bins; to count cells of equal bins, on which the trees are trained; and to
    be scored by the task that finds them."""
    columns = ["common", "adamic", "allocation", "strength", "da", "db", "y"]
    trained = lambda a: not tested(a)
    values = found(t, columns, schema="at long, n long", only=trained, gather=_Values).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(SEEN) * boosting.STEPS, np.int64)
    counts[values["at"].to_numpy()] = values["n"].to_numpy()
    bins = np.stack([boosting.bins_of(n) for n in counts.reshape(len(SEEN), -1)])
    cells = found(t, columns, schema="cell long, ones long, zeros long", only=trained, gather=lambda: _Cells(bins)).groupBy("cell").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).orderBy("cell").toArrow()
    model = boosting.boost(boosting.apart(cells["cell"].to_numpy(), len(SEEN)), cells["ones"].to_numpy(), cells["zeros"].to_numpy(), rounds)

    def score(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        cell, at = np.unique(boosting.cells(_seen(x), bins), return_inverse=True)
        return {"a": x["a"], "b": x["b"], "y": x["y"].astype(float), "p": rounded(model.chance(boosting.apart(cell, len(SEEN))))[at]}

    return found(t, columns, fold=score, schema="a long, b long, y double, p double", only=tested)


def agglomerate(distance: np.ndarray, cut: float, size: np.ndarray | None = None) -> np.ndarray:
    """Average-linkage clusters of a distance matrix, merged while the least distance is within the cut; a row may stand for
    ``size`` equal items. The least of each row is kept, and looked for anew only where a merge took it."""
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if size is None else size.astype(float), np.arange(n)
    least = d.min(1) if n else np.zeros(0)
    for _ in range(n - 1):
        i = int(np.argmin(least))
        if not least[i] <= cut:
            break
        i, j = sorted((i, int(np.argmin(d[i]))))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        took = np.minimum(d[i], d[j]) <= least
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        least = np.minimum(least, new)
        least[j] = np.inf
        took[i], took[j] = True, False
        took &= least < np.inf
        for r in np.flatnonzero(took):
            least[r] = d[r].min()
        size[i] += size[j]
        label[label == j] = i
    return label


#: Venues up to which sets are looked at by moments first; rows of distances that are made at once.
MOMENTS, ROWS = 128, 256


def one_cluster(m: np.ndarray, n: np.ndarray, cut: float) -> bool:
    """Whether average linkage surely merges all sets (rows of 0 and 1, n equal ones each) into one cluster, without a matrix.

    Of two or more clusters, the smallest leaves half of the people or more outside. The mean distance of a set to these is at most
    its mean plus its deviation over all. Where this is within the cut for every set, it is so for the mean over the smallest
    cluster, and some other cluster is near enough to be merged with it. First 1 - common / (size + size) is taken, which is no less
    than the distance and whose moments come from those of the sets of each size; where that does not do, the distance itself."""
    size, total, safe = m.sum(1), float(n.sum()), cut - 1e-4
    todo = np.arange(len(m))
    if m.shape[1] <= MOMENTS:
        mean, square = np.zeros(len(m)), np.zeros(len(m))
        for r in np.unique(size):
            y, w = m[size == r].astype(float), n[size == r].astype(float)
            first, second, both = w @ y, (y * w[:, None]).T @ y, size + r
            one, two = m @ first / both, ((m @ second) * m).sum(1) / both**2
            mean += w.sum() - one
            square += w.sum() - 2 * one + two
        mean /= total
        todo = np.flatnonzero(mean + np.sqrt(np.maximum(square / total - mean**2, 0)) > safe)
    own = n.astype(np.float32)
    for lo in range(0, len(todo), ROWS):
        some = todo[lo : lo + ROWS]
        common = m[some] @ m.T
        d = 1 - common / np.maximum(size[some][:, None] + size - common, 1)
        mean = (d @ own) / total
        if (mean + np.sqrt(np.maximum((d * d) @ own / total - mean**2, 0)) > safe).any():
            return False
    return True


def clusters_of_sets(m: np.ndarray, n: np.ndarray, cut: float) -> np.ndarray:
    """Average-linkage clusters of sets by the share that is not common: a label a row, that of one of the cluster's rows; the first
    where all are one. A matrix is made only where that is not clear beforehand."""
    if len(m) > 1 and one_cluster(m, n, cut):
        return np.zeros(len(m), np.int64)
    wide = m.astype(float)
    common = wide @ wide.T
    either = wide.sum(1)[:, None] + wide.sum(1)[None, :] - common
    return agglomerate(1 - common / np.maximum(either, 1), cut, n)


def cluster_blocks(t: Tables, cut: float = 0.9) -> DataFrame:
    """People of one name clustered by the share of common venues; a cluster is named by its smallest person.

    People with equal sets of venues are at distance 0, so that average linkage merges them first: a task gets each set once,
    with the number of people that have it. A name whose sets surely end as one cluster takes no matrix of them."""
    own = t.authored.groupBy("person").agg(F.array_sort(F.collect_set("venue")).alias("venues")).join(t.persons.filter("page_kind = 'numbered'").select("person", "name"), "person")
    own = stage(own, "own")
    kinds = stage(own.groupBy("name", "venues").agg(F.count("*").alias("n"), F.min("person").alias("first")), "kinds")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        size = pdf["venues"].map(len).to_numpy()
        at, names = pd.factorize(np.concatenate(pdf["venues"].to_numpy()))
        m = np.zeros((len(pdf), len(names)), np.float32)
        m[np.repeat(np.arange(len(pdf)), size), at] = 1
        ids = pdf["first"].to_numpy()
        label = clusters_of_sets(m, pdf["n"].to_numpy(), cut)
        return pd.DataFrame({"name": pdf["name"], "venues": pdf["venues"], "cluster": ids[label]})

    found = kinds.groupBy("name").applyInPandas(run, "name string, venues array<string>, cluster long")
    return own.join(found, ["name", "venues"]).select("person", "cluster")


QUERIES = {
    "growth_periods": Query(
        "kind:s since:l until:l slope:d r2:d low:d high:d doubling:d", _growth_periods,
        "SELECT kind, since, until, slope, r2, slope - q * half AS low, slope + q * half AS high, CASE WHEN abs(slope) > 1e-9 THEN ln(2) / slope END AS doubling FROM (SELECT kind, since, until, q, regr_slope(ln(n), year) AS slope, regr_r2(ln(n), year) AS r2, "
        "sqrt(greatest(regr_syy(ln(n), year) - regr_slope(ln(n), year) * regr_sxy(ln(n), year), 0) / (count(*) - 2) / regr_sxx(ln(n), year)) AS half FROM g JOIN p ON year BETWEEN since AND until GROUP BY 1, 2, 3, 4)",
        "g AS (SELECT kind, year, count(*)::DOUBLE AS n FROM pubs GROUP BY 1, 2 UNION ALL SELECT 'all', year, count(*) FROM pubs GROUP BY 2), p(since, until, q) AS (VALUES " + ", ".join(f"({a}, {b}, {t_quantile(0.975, b - a - 1)!r}::DOUBLE)" for a, b in PERIODS) + ")",
    ),
    "top_share": Query(
        "n:l s:l mid:d most:l k:l top:d", _top_share,
        "SELECT n, s, mid, most, k, (SELECT sum(v) FROM (SELECT v FROM per ORDER BY v DESC LIMIT (SELECT greatest(1, count(*) // 100) FROM per))) / s AS top FROM (SELECT count(*) AS n, sum(v) AS s, median(v) AS mid, max(v) AS most, greatest(1, count(*) // 100) AS k FROM per)",
        "per AS (SELECT person, count(*) AS v FROM slots WHERE NOT on_bin GROUP BY 1)",
    ),
    "weighted_kappa": Query(
        "n:l kappa:d", _weighted,
        "SELECT count(*) AS n, 1 - sum((a - b) ** 2) / (SELECT sum((x.a - y.b) ** 2) / count(*) FROM l x CROSS JOIN l y) / count(*) AS kappa FROM l", "l AS (SELECT length(c_mktsegment) % 5 AS a, c_nationkey % 5 AS b FROM customer)",
    ),
    "growth_rate_ols": Query("kind:s slope:d intercept:d r2:d years:l", _growth, "SELECT kind, regr_slope(ln(n), year) AS slope, regr_intercept(ln(n), year) AS intercept, regr_r2(ln(n), year) AS r2, count(*) AS years FROM (SELECT kind, year, count(*) AS n FROM pubs WHERE year <= 2000 GROUP BY 1, 2) GROUP BY 1"),
    "gini_tail": Query("n:l s:l gini:d alpha:d", _gini, "SELECT n, s, 1 - sum(c * (2 * coalesce(mass, 0) + c * v)) / (n::DOUBLE * s) AS gini, 1 + sum(c) FILTER (v >= 20) / sum(c * ln(v / 19.5)) FILTER (v >= 20) AS alpha FROM (SELECT v, c, sum(c * v) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mass, sum(c) OVER () AS n, sum(c * v) OVER () AS s FROM (SELECT v, count(*) AS c FROM (SELECT person, count(*) AS v FROM slots WHERE NOT on_bin GROUP BY 1) GROUP BY 1)) GROUP BY n, s"),
    "spearman": Query("people:l rho:d", _spearman, "SELECT count(*) AS people, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY papers) + (count(*) OVER (PARTITION BY papers) - 1) / 2.0 AS ra, rank() OVER (ORDER BY orcid) + (count(*) OVER (PARTITION BY orcid) - 1) / 2.0 AS rb FROM (SELECT person, count(*) AS papers, sum(has_orcid::INT) AS orcid FROM slots WHERE NOT on_bin GROUP BY 1))"),
    "kappa": Query("n:l po:d kappa:d", _kappa, "SELECT n, po, (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) AS kappa FROM (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"),
    "wilson": Query("venue:s n:l low:d high:d", _wilson, "SELECT venue, n, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS low, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS high FROM (SELECT venue, count(*)::DOUBLE AS n, avg(has_oa::INT) AS p, 1.959964::DOUBLE AS z FROM pubs GROUP BY 1)"),
    "pair_features": Query("person_a:l person_b:l shared:l venues:l gap:l na:l nb:l", pair_features, "SELECT a.person AS person_a, b.person AS person_b, len(list_intersect(a.others, b.others)) AS shared, len(list_intersect(a.venues, b.venues)) AS venues, greatest(0, greatest(a.first, b.first) - least(a.last, b.last)) AS gap, len(a.others) AS na, len(b.others) AS nb FROM x a JOIN x b ON a.name = b.name AND a.person < b.person", "w AS (SELECT a.person, list(DISTINCT b.person) AS others FROM authored a JOIN authored b ON a.pid = b.pid AND a.person <> b.person GROUP BY 1), o AS (SELECT person, list(DISTINCT venue) AS venues, min(year) AS first, max(year) AS last FROM authored GROUP BY 1), x AS (SELECT name, person, venues, first, last, coalesce(others, []) AS others FROM persons JOIN o USING (person) LEFT JOIN w USING (person) WHERE page_kind = 'numbered')"),
    "nb_centroid_scores": Query("item_id:l source:s score:d known:l rank:l", _nb, "SELECT item_id, source, score, known, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank FROM (SELECT item_id, source, round(sum(ln(n + 0.1::DOUBLE) - ln(0.1::DOUBLE) - ln((docs + 1)::DOUBLE)), 6) AS score, count(*) AS known FROM q JOIN n USING (token) JOIN p USING (source) GROUP BY 1, 2) QUALIFY rank <= 5", "e AS (SELECT DISTINCT id, source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM texts), n AS (SELECT token, source, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT source, count(*) AS docs FROM texts GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM benchmark)"),
    "rank_metrics": Query("queries:l mrr:d hits5:d p5:d", _rank_metrics, "SELECT count(*) AS queries, avg(1.0::DOUBLE / first) AS mrr, avg((first <= 5)::INT) AS hits5, avg(top / 5.0::DOUBLE) AS p5 FROM (SELECT a, min(rank) FILTER (y = 1) AS first, sum(y) FILTER (rank <= 5) AS top, sum(y) AS all_ FROM (SELECT c.a, coalesce(f.y, 0) AS y, row_number() OVER (PARTITION BY c.a ORDER BY round(adamic, 6) DESC, md5(c.a::VARCHAR || '-' || c.b::VARCHAR)) AS rank FROM cand c LEFT JOIN (SELECT DISTINCT a, b, 1 AS y FROM adj WHERE year BETWEEN 1999 AND 2000) f ON f.a = c.a AND f.b = c.b) GROUP BY 1 HAVING sum(y) > 0)", GRAPH_CTES),
    "calibration": Query("bin:l pairs:l came:d", _calibration, "SELECT least(floor(common / (x.degree + z.degree - common) * 50 + 1e-9), 9) AS bin, count(*) AS pairs, avg(coalesce(f.y, 0)) AS came FROM cand c JOIN deg x ON x.a = c.a JOIN deg z ON z.a = c.b LEFT JOIN (SELECT DISTINCT a, b, 1 AS y FROM adj WHERE year BETWEEN 1999 AND 2000) f ON f.a = c.a AND f.b = c.b GROUP BY 1", GRAPH_CTES),
    "bcubed": Query("items:l precision:d recall:d", lambda t: bcubed(t.persons, "name", "brand"), "SELECT sum(n) AS items, sum(n * n / nb) / sum(n) AS precision, sum(n * n / na) / sum(n) AS recall FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY name) AS na, sum(count(*)) OVER (PARTITION BY brand) AS nb FROM persons GROUP BY name, brand)"),
    "vector_precision": Query("want:l neighbours:l precision:d", _vectors, "SELECT want, count(*) AS neighbours, avg((want = label)::INT) AS precision FROM cos GROUP BY 1", COSINE),
    "jaro_resolve": Query("name:s other:s s:d", jaro_resolve, "SELECT a.name, b.name AS other, round(jaro_winkler_similarity(a.name, b.name), 6) AS s FROM (SELECT DISTINCT name FROM persons) a JOIN (SELECT DISTINCT name FROM persons) b ON substr(a.name, 1, 3) = substr(b.name, 1, 3) AND a.name < b.name AND abs(length(a.name) - length(b.name)) <= 6 WHERE round(jaro_winkler_similarity(a.name, b.name), 6) >= 0.86"),
    "gbt_train": Query("a:l b:l y:d p:d", link_model, rounded=True),
    "cluster_blocks": Query("person:l cluster:l", cluster_blocks),
}
