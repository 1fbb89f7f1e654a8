"""Telling people of one name apart: blocks, instances, pair features and samples, scores, assignments of held-out papers, and
the splitting of bins.

An instance is a person's paper. Pairs are formed within a name and between the instances that the caps, which are parameters
of the method, leave; so a task's share of a name is bounded by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.measures import adjusted_rand, confusion, separation, separation_sql
from tessera.functions.portable import bucket
from tessera.functions.ranks import before
from tessera.plans.tables import Query, Tables

col = F.col
#: People that make a name a block; blocks, people of a block and papers of a person that are taken, in the order of a hash.
MIN_PEOPLE, MAX_BLOCKS, MAX_PEOPLE, MAX_PAPERS = 2, 200, 30, 4
POSITIVES, NEGATIVES = 40, 80
THRESHOLD = 0.35
#: What an assignment needs: score, lead over the next, strongest single link; below the ceiling nobody is meant.
ACCEPT, MARGIN, LINK, CEILING, OUTLIER = 0.3, 0.05, 0.4, 0.15, 3.0


def hashed(*columns: str) -> Column:
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))


def blocks(t: Tables) -> DataFrame:
    """(name, people): names that several people share, a sample by hash."""
    n = t.persons.filter("page_kind = 'numbered'").groupBy("name").agg(F.count("*").alias("people")).filter(col("people") >= MIN_PEOPLE)
    return n.orderBy(hashed("name"), "name").limit(MAX_BLOCKS)


def instances(t: Tables) -> DataFrame:
    """(name, person, pid, ...): a bounded number of people of a block, of papers of a person; who else is on the paper, without
    the person and without the block's own name, and the words of their names."""

    def make(t: Tables) -> DataFrame:
        people = t.persons.filter("page_kind = 'numbered'").join(F.broadcast(blocks(t).select("name")), "name")
        some = people.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(hashed("person"), "person"))).filter(col("r") <= MAX_PEOPLE).select("person", "name", "brand")
        mine = t.slots.join(some, "person")
        chosen = mine.withColumn("r", F.row_number().over(Window.partitionBy("person").orderBy(hashed("pid"), "pid"))).filter(col("r") <= MAX_PAPERS).drop("r")
        named = t.slots.join(chosen.select("pid").distinct(), "pid").join(t.persons.select("person", col("name").alias("n")), "person")
        with_ = named.groupBy("pid").agg(F.collect_set("person").alias("ids"), F.collect_set("n").alias("names"))
        x = chosen.join(with_, "pid").join(t.pubs.select("pid", "year", "venue", "prefix", "kind"), "pid")
        names = F.array_remove("names", col("name"))
        words = F.array_distinct(F.filter(F.split(F.array_join(names, " "), " "), lambda w: F.length(w) >= 4))
        return x.select("name", "person", "pid", "position", "n_authors", "year", "venue", "prefix", (col("kind") == "preprint").alias("is_preprint"), col("brand").alias("form"), F.when(col("has_orcid"), col("brand")).alias("orcid"), F.array_remove("ids", col("person")).alias("ids"), names.alias("names"), words.alias("toks"))

    return t.once("instances", make)


RAW = "y bucket year_gap same_venue same_prefix any_preprint team_diff team_min same_form shared_ids ids_a ids_b shared_names names_a names_b shared_toks toks_a toks_b orcid_match both_first both_last".split()
DERIVED = "ids_jaccard names_jaccard toks_jaccard has_shared_id has_shared_name ids_min names_min".split()


def pairs(t: Tables) -> DataFrame:
    """All pairs of instances of a name, on different papers, with their features."""

    def make(t: Tables) -> DataFrame:
        x = instances(t)
        side = lambda s: x.select("name", *[col(c).alias(f"{c}_{s}") for c in x.columns if c != "name"])
        p = side("a").join(side("b"), "name").filter("pid_a < pid_b")
        same = lambda c: (col(f"{c}_a") == col(f"{c}_b")).cast("int")
        shared = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
        p = p.select(
            "name", "pid_a", "pid_b", "person_a", "person_b", same("person").alias("y"), bucket(col("name"), 10).alias("bucket"), F.abs(col("year_a") - col("year_b")).alias("year_gap"), same("venue").alias("same_venue"), same("prefix").alias("same_prefix"),
            (col("is_preprint_a") | col("is_preprint_b")).cast("int").alias("any_preprint"), F.abs(col("n_authors_a") - col("n_authors_b")).alias("team_diff"), F.least("n_authors_a", "n_authors_b").alias("team_min"), same("form").alias("same_form"),
            shared("ids").alias("shared_ids"), F.size("ids_a").alias("ids_a"), F.size("ids_b").alias("ids_b"), shared("names").alias("shared_names"), F.size("names_a").alias("names_a"), F.size("names_b").alias("names_b"),
            shared("toks").alias("shared_toks"), F.size("toks_a").alias("toks_a"), F.size("toks_b").alias("toks_b"), F.coalesce(same("orcid"), F.lit(-1)).alias("orcid_match"),
            ((col("position_a") == 1) & (col("position_b") == 1)).cast("int").alias("both_first"), ((col("position_a") == col("n_authors_a")) & (col("position_b") == col("n_authors_b"))).cast("int").alias("both_last"),
        )
        jaccard = lambda c: F.coalesce(F.try_divide(col(f"shared_{c}").cast("double"), col(f"{c}_a") + col(f"{c}_b") - col(f"shared_{c}")), F.lit(0.0))
        p = p.withColumns({
            "ids_jaccard": jaccard("ids"), "names_jaccard": jaccard("names"), "toks_jaccard": jaccard("toks"), "has_shared_id": (col("shared_ids") > 0).cast("int"), "has_shared_name": (col("shared_names") > 0).cast("int"),
            "ids_min": F.least("ids_a", "ids_b"), "names_min": F.least("names_a", "names_b"),
        })
        return p.withColumn("score", F.round(sum(F.lit(w) * col(c) for c, w in WEIGHTS.items()), 6))

    return t.once("pairs", make)


#: A plain score of a pair, for what needs one without training.
WEIGHTS = {"ids_jaccard": 0.3, "same_venue": 0.2, "toks_jaccard": 0.1, "same_form": 0.4}


def quota(t: Tables) -> DataFrame:
    """A bounded number of pairs of a name, of one person and of two."""
    w = Window.partitionBy("name", "y").orderBy(hashed("pid_a", "pid_b"), "person_a", "person_b")
    return pairs(t).withColumn("r", F.row_number().over(w)).filter(F.expr(f"r <= CASE WHEN y = 1 THEN {POSITIVES} ELSE {NEGATIVES} END")).select("name", "pid_a", "pid_b", "person_a", "person_b", "y")


def metrics(t: Tables) -> DataFrame:
    """How well the plain score, and the baseline of a common co-author, tell pairs of one person."""
    p = pairs(t)
    one = lambda name, score, yes: separation(p.withColumn("s", score), "s", "y").crossJoin(F.broadcast(confusion(p, yes, "y"))).withColumn("arm", F.lit(name))
    return one("score", col("score"), col("score") >= THRESHOLD).unionByName(one("baseline", col("shared_ids").cast("double"), col("shared_ids") > 0))


def importance(t: Tables) -> DataFrame:
    """What average precision loses when one feature's values are dealt to other pairs: each pair gets the value of the pair
    that has its place in another hash order."""
    p = pairs(t).select("y", *WEIGHTS, hashed("pid_a", "pid_b", "person_a", "person_b").alias("here"), hashed("person_b", "person_a", "pid_b", "pid_a").alias("there"))
    place = lambda df, by: before(df, [col(by)], {"place": F.lit(1)})
    here = t.once("here", lambda _: place(p, "here").drop("here", "there"))
    there = t.once("there", lambda _: place(p.select("there", *WEIGHTS), "there").select("place", *[col(c).alias(f"{c}_other") for c in WEIGHTS]))
    both = t.once("dealt", lambda _: here.join(there, "place"))
    score = lambda other: F.round(sum(F.lit(w) * col(f"{c}_other" if c == other else c) for c, w in WEIGHTS.items()), 6)
    full = separation(both.withColumn("s", score(None)), "s", "y").select(col("ap").alias("full"))
    out = None
    for c in WEIGHTS:
        one = separation(both.withColumn("s", score(c)), "s", "y").crossJoin(F.broadcast(full)).select(F.lit(c).alias("feature"), (col("full") - col("ap")).alias("drop"))
        out = one if out is None else out.unionByName(one)
    return out


def rand_index(t: Tables) -> DataFrame:
    """The adjusted Rand index of clustering a name's people by their brand."""
    return adjusted_rand(t.persons.filter("page_kind = 'numbered'"), "name", "brand")


def both_ways(t: Tables) -> DataFrame:
    p = pairs(t).select("name", "pid_a", "pid_b", "person_a", "person_b", "score")
    turned = p.select("name", col("pid_b").alias("pid_a"), col("pid_a").alias("pid_b"), col("person_b").alias("person_a"), col("person_a").alias("person_b"), "score")
    return p.unionByName(turned)


def assignments(t: Tables) -> DataFrame:
    """For each person with three instances or more, the first is held out and scored against every person of the name: the best,
    its lead over the next, how far it stands out, its strongest link, and whether it is right and would be named. Means are
    taken of millionths, as whole numbers, so that ties are ties in every engine."""
    mine = instances(t).groupBy("name", "person").agg(F.count("*").alias("n"), F.min("pid").alias("held")).filter("n >= 3").select("name", col("person").alias("person_a"), col("held").alias("pid_a"))
    s = both_ways(t).join(mine, ["name", "person_a", "pid_a"]).groupBy("name", "person_a", "pid_a", "person_b").agg(F.expr("(sum(CAST(round(score * 1e6) AS BIGINT)) div count(*)) / 1e6").alias("score"), F.max("score").alias("link"))
    w = Window.partitionBy("name", "person_a")
    ranked = s.withColumn("r", F.row_number().over(w.orderBy(col("score").desc(), "person_b")))
    other = F.when(col("r") > 1, col("score"))
    best = lambda c: F.max(F.when(col("r") == 1, col(c))).alias(c)
    d = ranked.groupBy("name", "person_a", "pid_a").agg(best("person_b"), best("score"), best("link"), F.coalesce(F.max(F.when(col("r") == 2, col("score"))), F.lit(0.0)).alias("next"), F.avg(other).alias("mean"), F.stddev_pop(other).alias("sd"), F.count(other).alias("others"))
    d = d.withColumns({"margin": F.round(col("score") - col("next"), 4), "z": F.round(F.when(col("others") >= 4, (col("score") - col("mean")) / (col("sd") + 1e-6)), 1), "correct": col("person_b") == col("person_a")})
    named = (col("score") >= ACCEPT) & (col("margin") >= MARGIN) & (F.coalesce("z", F.lit(1e9)) >= OUTLIER) & (col("link") >= LINK)
    outcome = F.when(col("score") < CEILING, "new").when(named, "accepted").otherwise("uncertain")
    return d.withColumn("outcome", outcome)


def precision_curve(t: Tables) -> DataFrame:
    """Assignments and the share that is right, from each score upwards; the least score that reaches a target is the threshold."""
    n = assignments(t).groupBy("score").agg(F.count("*").alias("c"), F.sum(col("correct").cast("int")).alias("ok"))
    up = before(n, [col("score").desc()], {"cb": col("c"), "okb": col("ok")})
    return up.select("score", (col("cb") + col("c")).alias("named"), ((col("okb") + col("ok")) / (col("cb") + col("c"))).alias("precision"))


def thinned(t: Tables) -> DataFrame:
    """Blocks made to look like bins: most people keep one instance, every third keeps two."""
    w = Window.partitionBy("person").orderBy("pid")
    return instances(t).withColumn("r", F.row_number().over(w)).filter(col("r") <= F.when(bucket(col("person"), 3) == 0, 2).otherwise(1)).select("name", "person", "pid")


def bins(t: Tables) -> DataFrame:
    """The bins by the papers that lie on them, and how many people of the name have a page."""
    known = t.persons.filter("page_kind = 'numbered'").groupBy("name").agg(F.count("*").alias("numbered"))
    on = t.slots.filter("on_bin").groupBy("person").agg(F.count("*").alias("papers"))
    return t.persons.filter("page_kind = 'disambiguation'").join(on, "person").join(known, "name", "left").fillna(0, ["numbered"]).orderBy(col("papers").desc(), "person").limit(50)


def split_bins(t: Tables, cut: float = 0.8, most: int = 300) -> DataFrame:
    """The papers on a bin clustered by common co-authors, complete linkage, its latest ``most`` papers; and for each cluster the
    person of the name who shares most co-authors with it, if any: accepted, uncertain or new."""
    w = Window.partitionBy("person").orderBy(col("year").desc(), "pid")
    on = t.slots.filter("on_bin").select("pid", "person").join(t.pubs.select("pid", "year"), "pid").withColumn("r", F.row_number().over(w)).filter(col("r") <= most)
    others = t.slots.filter("NOT on_bin").join(on.select("pid").distinct(), "pid").groupBy("pid").agg(F.collect_set("person").alias("ids"))
    rows = on.join(others, "pid", "left").select("person", "pid", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        sets = [set(x) for x in pdf["ids"]]
        distance = np.array([[1 - len(a & b) / max(1, len(a | b)) for b in sets] for a in sets])
        return pd.DataFrame({"person": pdf["person"], "pid": pdf["pid"], "cluster": pdf["pid"].to_numpy()[complete(distance, cut)]})

    found = t.once("bin_clusters", lambda _: rows.groupBy("person").applyInPandas(run, "person long, pid long, cluster long"))
    members = found.join(t.slots.filter("NOT on_bin").select("pid", col("person").alias("other")), "pid").select("person", "cluster", "other").distinct()
    names = t.persons.filter("page_kind = 'numbered'").select("name", col("person").alias("page"))
    met = t.authored.select("pid", "person").join(t.authored.select("pid", col("person").alias("other")), "pid").filter("person <> other").select(col("person").alias("page"), "other").distinct()
    shared = members.join(t.persons.select("person", "name"), "person").join(met, "other").join(names, ["name", "page"]).groupBy("person", "cluster", "page").agg(F.count("*").alias("shared"))
    size = members.groupBy("person", "cluster").agg(F.count("*").alias("others"))
    scored = shared.join(size, ["person", "cluster"]).withColumn("score", col("shared") / col("others"))
    by = Window.partitionBy("person", "cluster").orderBy(col("score").desc(), "page")
    first = scored.select("*", F.row_number().over(by).alias("r"), (col("score") - F.coalesce(F.lead("score").over(by), F.lit(0.0))).alias("margin")).filter("r = 1")
    outcome = F.when(F.coalesce("score", F.lit(0.0)) < CEILING, "new").when((col("score") >= ACCEPT) & (col("margin") >= MARGIN), "accepted").otherwise("uncertain")
    sizes = found.groupBy("person", "cluster").agg(F.count("*").alias("papers"))
    return sizes.join(first, ["person", "cluster"], "left").withColumn("outcome", outcome).select("person", "cluster", "papers", "page", "score", "outcome")


def complete(distance: np.ndarray, cut: float) -> np.ndarray:
    """Complete-linkage clusters: two merge while the largest distance between their members is within the cut."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label = np.arange(len(d))
    while len(d) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        if d[i, j] > cut:
            break
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        label[label == j] = i
    return label


def merged(t: Tables) -> DataFrame:
    """Clusters of a bin that were accepted for one person become one; the others stay."""
    s = t.once("split", split_bins)
    key = F.when(col("outcome") == "accepted", F.concat(F.lit("p"), col("page").cast("string"))).otherwise(F.concat(F.lit("c"), col("cluster").cast("string")))
    return s.groupBy("person", key.alias("group")).agg(F.count("*").alias("clusters"), F.sum("papers").alias("papers"), F.min("score").alias("weakest"))


CTES = f"""
blk AS MATERIALIZED (SELECT name, count(*) AS people FROM persons WHERE page_kind = 'numbered' GROUP BY 1 HAVING count(*) >= {MIN_PEOPLE} ORDER BY md5(name), name LIMIT {MAX_BLOCKS}),
ppl AS (SELECT person, name, brand FROM persons JOIN blk USING (name) WHERE page_kind = 'numbered' QUALIFY row_number() OVER (PARTITION BY name ORDER BY md5(person::VARCHAR), person) <= {MAX_PEOPLE}),
cho AS MATERIALIZED (SELECT s.*, name, brand FROM slots s JOIN ppl USING (person) QUALIFY row_number() OVER (PARTITION BY person ORDER BY md5(pid::VARCHAR), pid) <= {MAX_PAPERS}),
ctx AS (SELECT pid, list(DISTINCT person) AS ids, list(DISTINCT name) AS names FROM slots JOIN persons USING (person) WHERE pid IN (SELECT pid FROM cho) GROUP BY 1),
ins AS MATERIALIZED (SELECT *, list_distinct(list_filter(string_split(array_to_string(names, ' '), ' '), lambda w: length(w) >= 4)) AS toks FROM (SELECT c.name, c.person, c.pid, c.position, c.n_authors, p.year, p.venue, p.prefix, p.kind = 'preprint' AS is_preprint, brand AS form,
    CASE WHEN has_orcid THEN brand END AS orcid, list_filter(ids, lambda x: x <> c.person) AS ids, list_filter(names, lambda x: x <> c.name) AS names FROM cho c JOIN ctx USING (pid) JOIN pubs p USING (pid))),
j AS (SELECT a.name, a.pid AS pid_a, b.pid AS pid_b, a.person AS person_a, b.person AS person_b, (a.person = b.person)::INT AS y, ('0x' || substr(md5(a.name), 1, 8))::BIGINT % 10 AS bucket, abs(a.year - b.year) AS year_gap, (a.venue = b.venue)::INT AS same_venue,
    (a.prefix = b.prefix)::INT AS same_prefix, (a.is_preprint OR b.is_preprint)::INT AS any_preprint, abs(a.n_authors - b.n_authors) AS team_diff, least(a.n_authors, b.n_authors) AS team_min, (a.form = b.form)::INT AS same_form,
    len(list_intersect(a.ids, b.ids)) AS shared_ids, len(a.ids) AS ids_a, len(b.ids) AS ids_b, len(list_intersect(a.names, b.names)) AS shared_names, len(a.names) AS names_a, len(b.names) AS names_b, len(list_intersect(a.toks, b.toks)) AS shared_toks, len(a.toks) AS toks_a, len(b.toks) AS toks_b,
    coalesce((a.orcid = b.orcid)::INT, -1) AS orcid_match, (a.position = 1 AND b.position = 1)::INT AS both_first, (a.position = a.n_authors AND b.position = b.n_authors)::INT AS both_last FROM ins a JOIN ins b ON a.name = b.name AND a.pid < b.pid),
jj AS (SELECT *, {', '.join(f"coalesce(shared_{c}::DOUBLE / nullif({c}_a + {c}_b - shared_{c}, 0), 0) AS {c}_jaccard" for c in ('ids', 'names', 'toks'))}, (shared_ids > 0)::INT AS has_shared_id, (shared_names > 0)::INT AS has_shared_name, least(ids_a, ids_b) AS ids_min, least(names_a, names_b) AS names_min FROM j),
prs AS MATERIALIZED (SELECT *, round({' + '.join(f'{w}::DOUBLE * {c}' for c, w in WEIGHTS.items())}, 6) AS score FROM jj)"""
HELD = f"""{CTES},
sym AS (SELECT name, pid_a, person_a, person_b, score FROM prs UNION ALL SELECT name, pid_b, person_b, person_a, score FROM prs),
hold AS (SELECT name, person, min(pid) AS held FROM ins GROUP BY 1, 2 HAVING count(*) >= 3),
sco AS (SELECT name, person_a, pid_a, person_b, (sum(round(score * 1e6)::BIGINT) // count(*)) / 1e6::DOUBLE AS score, max(score) AS link FROM sym JOIN hold USING (name) WHERE person = person_a AND held = pid_a GROUP BY 1, 2, 3, 4),
rkd AS (SELECT *, row_number() OVER (PARTITION BY name, person_a ORDER BY score DESC, person_b) AS r FROM sco),
dec AS (SELECT name, person_a, pid_a, max(person_b) FILTER (r = 1) AS person_b, max(score) FILTER (r = 1) AS score, max(link) FILTER (r = 1) AS link, coalesce(max(score) FILTER (r = 2), 0) AS next, avg(score) FILTER (r > 1) AS mean, stddev_pop(score) FILTER (r > 1) AS sd, count(*) FILTER (r > 1) AS others FROM rkd GROUP BY 1, 2, 3),
asg AS MATERIALIZED (SELECT *, round(score - next, 4) AS margin, round(CASE WHEN others >= 4 THEN (score - mean) / (sd + 1e-6) END, 1) AS z, person_a = person_b AS correct FROM dec)"""
INSTANCE = "name:s person:l pid:l position:l n_authors:l year:l venue:s is_preprint:b orcid:s"
PAIR = "name:s pid_a:l pid_b:l person_a:l person_b:l " + " ".join(f"{c}:{'d' if 'jaccard' in c else 'l'}" for c in RAW + DERIVED) + " score:d"
NAMES = lambda spec: ", ".join(c.split(":")[0] for c in spec.split())


def _arm(name: str, score: str, yes: str) -> str:
    return f"SELECT '{name}' AS arm, s.*, c.tp, c.fp, c.fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {separation_sql('prs', score)} s, (SELECT count(*) FILTER ({yes} AND y = 1) AS tp, count(*) FILTER ({yes} AND y = 0) AS fp, count(*) FILTER (NOT ({yes}) AND y = 1) AS fn FROM prs) c"


def _dealt(other: str | None) -> str:
    return "round(" + " + ".join(f"{w}::DOUBLE * {c + '_other' if c == other else c}" for c, w in WEIGHTS.items()) + ", 6)"


DEALT = f"""{CTES},
pq AS (SELECT *, concat_ws('-', pid_a, pid_b, person_a, person_b) AS k1, concat_ws('-', person_b, person_a, pid_b, pid_a) AS k2 FROM prs),
dealt AS MATERIALIZED (SELECT * FROM (SELECT y, {', '.join(WEIGHTS)}, row_number() OVER (ORDER BY md5(k1)) AS place FROM pq) JOIN (SELECT {', '.join(f'{c} AS {c}_other' for c in WEIGHTS)}, row_number() OVER (ORDER BY md5(k2)) AS place FROM pq) USING (place))"""

QUERIES = {
    "name_blocks": Query("name:s people:l", blocks, "SELECT * FROM blk", CTES),
    "instances": Query(INSTANCE + " ids:l names:l toks:l", lambda t: instances(t).withColumns({c: F.size(c) for c in ("ids", "names", "toks")}), f"SELECT {NAMES(INSTANCE)}, len(ids) AS ids, len(names) AS names, len(toks) AS toks FROM ins", CTES),
    "instance_pairs": Query(PAIR, pairs, f"SELECT {NAMES(PAIR)} FROM prs", CTES),
    "quota_pairs": Query(
        "name:s pid_a:l pid_b:l person_a:l person_b:l y:l", quota,
        f"SELECT name, pid_a, pid_b, person_a, person_b, y FROM prs QUALIFY row_number() OVER (PARTITION BY name, y ORDER BY md5(concat_ws('-', pid_a, pid_b)), person_a, person_b) <= CASE WHEN y = 1 THEN {POSITIVES} ELSE {NEGATIVES} END", CTES,
    ),
    "pairwise_metrics": Query("arm:s pairs:l positives:l auc:d ap:d tp:l fp:l fn:l precision:d recall:d f1:d", metrics, _arm("score", "score", f"score >= {THRESHOLD}") + " UNION ALL " + _arm("baseline", "shared_ids::DOUBLE", "shared_ids > 0"), CTES),
    "permutation_importance": Query("feature:s drop:d", importance, " UNION ALL ".join(f"SELECT '{c}' AS feature, a.ap - b.ap AS \"drop\" FROM {separation_sql('dealt', _dealt(None))} a, {separation_sql('dealt', _dealt(c))} b" for c in WEIGHTS), DEALT),
    "adjusted_rand": Query(
        "items:l ari:d", rand_index,
        "SELECT items, (paired - a * b / (items * (items - 1) / 2)) / ((a + b) / 2 - a * b / (items * (items - 1) / 2)) AS ari FROM (SELECT sum(n) AS items, sum(n * (n - 1) / 2) AS paired, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY name)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY brand)) AS b FROM cell)",
        "cell AS (SELECT name, brand, count(*)::DOUBLE AS n FROM persons WHERE page_kind = 'numbered' GROUP BY 1, 2)",
    ),
    "assignments": Query(
        "name:s person_a:l pid_a:l person_b:l score:d margin:d z:d link:d correct:b outcome:s", assignments,
        f"SELECT name, person_a, pid_a, person_b, score, margin, z, link, correct, CASE WHEN score < {CEILING} THEN 'new' WHEN score >= {ACCEPT} AND margin >= {MARGIN} AND coalesce(z, 1e9) >= {OUTLIER} AND link >= {LINK} THEN 'accepted' ELSE 'uncertain' END AS outcome FROM asg", HELD,
    ),
    "precision_curve": Query("score:d named:l precision:d", precision_curve, "SELECT score, sum(c) OVER w AS named, sum(ok) OVER w / sum(c) OVER w AS precision FROM (SELECT score, count(*) AS c, sum(correct::INT) AS ok FROM asg GROUP BY 1) WINDOW w AS (ORDER BY score DESC)", HELD),
    "thinned_blocks": Query("name:s person:l pid:l", thinned, "SELECT name, person, pid FROM ins QUALIFY row_number() OVER (PARTITION BY person ORDER BY pid) <= CASE WHEN ('0x' || substr(md5(person::VARCHAR), 1, 8))::BIGINT % 3 = 0 THEN 2 ELSE 1 END", CTES),
    "largest_bins": Query("person:l name:s papers:l numbered:l", bins, "SELECT person, name, papers, coalesce(numbered, 0) AS numbered FROM persons JOIN (SELECT person, count(*) AS papers FROM slots WHERE on_bin GROUP BY 1) USING (person) LEFT JOIN (SELECT name, count(*) AS numbered FROM persons WHERE page_kind = 'numbered' GROUP BY 1) USING (name) WHERE page_kind = 'disambiguation' ORDER BY papers DESC, person LIMIT 50"),
    "split_bins": Query("person:l cluster:l papers:l page:l score:d outcome:s", split_bins),
    "merged_bins": Query("person:l group:s clusters:l papers:l weakest:d".replace("group:s", "label:s"), lambda t: merged(t).withColumnRenamed("group", "label")),
}
