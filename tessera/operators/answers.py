"""What answers and judges are measured by: numbers and their grounding, reference answers from raw tables, agreement of judges,
samples, controls and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.portable import share
from tessera.functions.ranks import before
from tessera.operators.joins import adjacency
from tessera.operators.retrieval import COSINE, cosine_top
from tessera.operators.search import CTES, targets
from tessera.plans.tables import Query, Tables

col = F.col
CUT = 300


def folded(t: Tables) -> DataFrame:
    return t.texts.select("id", X.fold(F.substring("text", 1, 60)).alias("fold"))


def link_ids(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", X.link_id(col("url")).alias("link"))


def plain_pages(t: Tables) -> DataFrame:
    plain = X.without_markup(col("html"))
    return t.table("pages").select("page_id", F.length(plain).alias("n"), F.md5(plain).alias("mark"))


def cut_texts(t: Tables) -> DataFrame:
    short = X.cut(col("text"), CUT)
    return t.texts.select("id", F.length(short).alias("n"), F.md5(short).alias("mark"))


def text_numbers(t: Tables) -> DataFrame:
    n = X.numbers(col("text"))
    return t.texts.filter(~F.contains("text", F.lit("+"))).select("id", F.size(n).alias("n"), F.array_max(F.filter(n, lambda x: x < 1e9)).alias("most"))


def abbreviations(t: Tables) -> DataFrame:
    """Which names the two-letter abbreviations of names stand for."""
    names = t.persons.select("name").distinct()
    short = names.select(F.array_join(F.transform(F.split("name", " "), lambda w: F.concat(F.left(w, F.lit(2)), F.lit("."))), " ").alias("short")).distinct()
    return names.join(F.broadcast(short), X.abbreviates(col("short"), col("name")))  # a few dozen names


def grounding(t: Tables) -> DataFrame:
    """Answers that state prices in thousands, every other one wrong, checked against the price: how many are grounded."""
    stated = F.when(col("pid") % 2 == 0, col("price")).otherwise(col("price") * 1.1 + 1000)
    answer = F.concat(F.lit("It costs "), F.format_string("%.2f", F.round(stated / 1000, 2)), F.lit(" thousand."))
    checked = F.forall(X.numbers(answer), lambda n: X.grounded(n, F.array(col("price"))))
    return t.pubs.groupBy((col("pid") % 2).alias("wrong")).agg(F.count("*").alias("answers"), F.count_if(checked).alias("grounded"))


def questions(t: Tables, each: int = 20) -> DataFrame:
    """Reference answers of seven types, from the raw tables: (type, subject, answer), some subjects of each by hash."""
    lines = t.table("lineitem").select(col("l_orderkey").alias("o"), col("l_partkey").alias("p")).distinct()
    orders = t.table("orders").select(col("o_orderkey").alias("o"), F.year("o_orderdate").alias("year"), col("o_custkey").alias("c"))
    person = lines.join(orders, "o").filter(col("p") % 50 != 0)
    both = lines.join(lines.withColumnRenamed("p", "q"), "o").filter("p <> q AND p % 50 <> 0 AND q % 50 <> 0")
    nation = t.table("customer").join(t.table("nation"), col("c_nationkey") == col("n_nationkey")).select(col("c_custkey").alias("c"), col("n_name").alias("venue"))
    at = person.join(nation, "c")
    main = at.groupBy("p", "venue").agg(F.count("*").alias("n")).groupBy("p").agg(F.min(F.struct((-col("n")).alias("n"), "venue")).alias("x"))
    first = person.groupBy("p").agg(F.min("year").alias("y"))
    kinds = {
        "papers": person.groupBy("p").agg(F.count("*").cast("string").alias("answer")),
        "first year": first.select("p", col("y").cast("string").alias("answer")),
        "co-authors": both.groupBy("p").agg(F.countDistinct("q").cast("string").alias("answer")),
        "venue": main.select("p", col("x.venue").alias("answer")),
        "papers in first year": person.join(first, "p").filter("year = y").groupBy("p").agg(F.count("*").cast("string").alias("answer")),
        "venues": at.groupBy("p").agg(F.countDistinct("venue").cast("string").alias("answer")),
        "strongest co-author": both.groupBy("p", "q").agg(F.count("*").alias("n")).groupBy("p").agg(F.min(F.struct((-col("n")).alias("n"), "q")).alias("x")).select("p", col("x.q").cast("string").alias("answer")),
    }
    out = None
    for name, rows in kinds.items():
        one = rows.select(F.lit(name).alias("type"), col("p").alias("subject"), "answer")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("type").orderBy(F.md5(F.concat("type", col("subject").cast("string"))), "subject")
    return out.withColumn("r", F.row_number().over(w)).filter(col("r") <= each).drop("r")


def gold(t: Tables) -> DataFrame:
    """Of a gold set's cases by kind: the share with the right tool, of refusals among those that had to be refused, of grounded
    answers, and the median time. The events stand for cases."""
    e = t.table("events")
    must = col("event_id") % 10 == 0
    return e.groupBy("event_type").agg(F.count("*").alias("cases"), share(col("user_id") % 3 != 0).alias("right_tool"), share(F.when(must, col("value") < 50)).alias("refused"), share(F.when(~must, col("value") >= 10)).alias("grounded"), F.median("value").alias("median"))


def bearing(t: Tables) -> DataFrame:
    """Recall among the first five and ten, and the reciprocal rank of the first hit, where several vectors bear on a query: those of
    its label."""
    w = Window.partitionBy("item_id").orderBy(col("score").desc(), "id")
    hits = cosine_top(t).withColumn("r", F.row_number().over(w)).withColumn("hit", col("want") == col("label"))
    all_ = t.table("embeddings").groupBy(col("label").alias("want")).agg((F.count("*") - 1).alias("all"))
    per = hits.groupBy("item_id", "want").agg(F.count_if(col("hit") & (col("r") <= 5)).alias("h5"), F.count_if("hit").alias("h10"), F.min(F.when(col("hit"), col("r"))).alias("first")).join(F.broadcast(all_), "want")
    part = lambda h, k: F.avg(F.try_divide(col(h).cast("double"), F.least(col("all"), F.lit(k)))).alias(f"recall{k}")
    return per.groupBy("want").agg(F.count("*").alias("queries"), part("h5", 5), part("h10", 10), F.avg(F.coalesce(1.0 / col("first"), F.lit(0.0))).alias("mrr"))


def derangement(t: Tables) -> DataFrame:
    """A control: each query is given the text of the next one in a hash order, never its own. How many texts then hold the query,
    and how many of their own do."""
    known = t.once("targets", targets)
    placed = t.once("placed", lambda _: before(known.withColumn("k", F.md5(col("item_id").cast("string"))), [col("k"), col("item_id")], {"place": F.lit(1)}).select("item_id", "id", col("place").cast("long").alias("place")))
    n = placed.agg(F.count("*").alias("n"))
    other = placed.crossJoin(F.broadcast(n)).select(((col("place") + col("n") - 1) % col("n")).alias("place"), col("id").alias("other"))
    texts = t.texts.select("id", "text")
    x = placed.join(other, "place").join(t.table("benchmark").select("item_id", col("text").alias("item")), "item_id").join(texts, "id").join(texts.select(col("id").alias("other"), col("text").alias("text2")), "other")
    return x.agg(F.count("*").alias("queries"), F.count_if(F.contains("text", col("item"))).alias("own"), F.count_if(F.contains("text2", col("item")) & (col("id") != col("other"))).alias("foreign"))


def fresh(t: Tables, k: int = 50) -> DataFrame:
    """A sample by hash of the last full year's papers that are open and no preprints."""
    return t.pubs.filter("year = 2000 AND has_oa AND kind <> 'preprint'").orderBy(F.md5(col("pid").cast("string")), "pid").limit(k).select("pid", "venue")


def judged(t: Tables) -> DataFrame:
    """Two judges' marks from 0 to 2 of each paper, by group: the order's priority and its price."""
    a = F.least(F.lit(2), F.floor((F.substring("o_orderpriority", 1, 1).cast("int") - 1) / 2))
    b = F.when(col("o_totalprice") > 300000, 0).when(col("o_totalprice") > 150000, 1).otherwise(2)
    return t.table("orders").select(col("o_orderstatus").alias("g"), a.cast("int").alias("a"), b.alias("b"))


def judge_agreement(t: Tables) -> DataFrame:
    """By group: exact agreement, kappa, kappa with squared distances, and how much kinder the first judge is."""
    cell = judged(t).groupBy("g", "a", "b").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    total, row, column = F.sum("n").over(w), F.sum("n").over(Window.partitionBy("g", "a")), F.sum("n").over(Window.partitionBy("g", "b"))
    x = cell.select("*", total.alias("t"), row.alias("ra"), column.alias("rb"))  # nine rows a group
    marks = x.groupBy("g", "t").agg(F.sum(F.when(col("a") == col("b"), col("n")).otherwise(0)).alias("same"), F.sum(col("n") * (col("a") - col("b")) ** 2).alias("far"), F.sum(col("n") * (col("a") - col("b"))).alias("gap"))
    pa = x.groupBy("g", col("a").alias("i")).agg(F.max("ra").alias("na"))
    pb = x.groupBy("g", col("b").alias("j")).agg(F.max("rb").alias("nb"))
    chance = pa.join(pb, "g").groupBy("g").agg(F.sum(F.when(col("i") == col("j"), col("na") * col("nb")).otherwise(0)).alias("cs"), F.sum(col("na") * col("nb") * (col("i") - col("j")) ** 2).alias("cf"))
    m = marks.join(chance, "g")
    po, pe = col("same") / col("t"), col("cs") / (col("t") * col("t"))
    return m.select("g", col("t").alias("n"), po.alias("exact"), ((po - pe) / (1 - pe)).alias("kappa"), (1 - col("far") * col("t") / col("cf")).alias("weighted"), (col("gap") / col("t")).alias("gap"))


def judge_confusion(t: Tables) -> DataFrame:
    return judged(t).groupBy("a", "b").agg(F.count("*").alias("n"))


def slowest(t: Tables) -> DataFrame:
    """The three largest values of each kind of event, and the share of errors among its user's events."""
    e = t.table("events").select("event_id", "event_type", "user_id", "value")
    w = Window.partitionBy("event_type").orderBy(col("value").desc(), "event_id")
    fallback = e.groupBy("user_id").agg(share(col("event_type") == "error").alias("errors"))
    return e.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").join(fallback, "user_id")


def invariants(t: Tables) -> DataFrame:
    """What has to hold of any data: kinds add up, filters narrow, caps are no counts, bins are nobody, pairs are symmetric."""
    p, s = t.pubs, t.slots
    one = lambda df, **kw: df.agg(*[v.alias(k) for k, v in kw.items()])
    kinds = one(p.groupBy("kind").agg(F.count("*").alias("n")), a=F.sum("n")).crossJoin(one(p, b=F.count("*"))).select(F.lit("kinds add up").alias("name"), (col("a") == col("b")).alias("holds"))
    narrow = one(p, a=F.count_if((col("year") >= 1998) & (col("kind") == "journal")), b=F.count_if(col("year") >= 1998), c=F.count("*")).select(F.lit("filters narrow").alias("name"), ((col("a") <= col("b")) & (col("b") <= col("c"))).alias("holds"))
    capped = s.groupBy("person").agg(F.count("*").alias("n")).agg(F.bool_and(F.least("n", F.lit(3)) <= col("n")).alias("holds")).select(F.lit("a capped list is no count").alias("name"), "holds")
    nobody = t.authored.agg((F.count_if("on_bin") == 0).alias("holds")).select(F.lit("bins are nobody").alias("name"), "holds")
    pairs = adjacency(t)
    both = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "year").agg(F.count("*").alias("n")).agg(F.bool_and(col("n") == 2).alias("holds")).select(F.lit("pairs are symmetric").alias("name"), "holds")
    return kinds.unionByName(narrow).unionByName(capped).unionByName(nobody).unionByName(both)


SPACE = "[ \\t\\r\\n\\f\\x0B]+"
CLEAN = f"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '{SPACE}', ' ', 'g')), '^(?i:abstract|summary)[:.] ?', '')"
FACTOR = "CASE s " + " ".join(f"WHEN '{k}' THEN {v:.0f}" for k, v in X.SCALES.items()) + " ELSE 1 END"
RAW = """ln AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
per AS MATERIALIZED (SELECT p, o, year(o_orderdate) AS year, n_name AS venue FROM ln JOIN orders ON o = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE p % 50 <> 0),
bth AS MATERIALIZED (SELECT a.p, b.p AS q FROM ln a JOIN ln b ON a.o = b.o AND a.p <> b.p WHERE a.p % 50 <> 0 AND b.p % 50 <> 0),
fst AS (SELECT p, min(year) AS y FROM per GROUP BY 1),
qa AS (SELECT 'papers' AS type, p AS subject, count(*)::VARCHAR AS answer FROM per GROUP BY 2 UNION ALL SELECT 'first year', p, y::VARCHAR FROM fst UNION ALL SELECT 'co-authors', p, count(DISTINCT q)::VARCHAR FROM bth GROUP BY 2
    UNION ALL SELECT 'venue', p, arg_min(venue, (-n, venue)) FROM (SELECT p, venue, count(*) AS n FROM per GROUP BY 1, 2) GROUP BY 2 UNION ALL SELECT 'papers in first year', p, count(*)::VARCHAR FROM per JOIN fst USING (p) WHERE year = y GROUP BY 2
    UNION ALL SELECT 'venues', p, count(DISTINCT venue)::VARCHAR FROM per GROUP BY 2 UNION ALL SELECT 'strongest co-author', p, arg_min(q, (-n, q))::VARCHAR FROM (SELECT p, q, count(*) AS n FROM bth GROUP BY 1, 2) GROUP BY 2)"""
JUDGED = "jd AS (SELECT o_orderstatus AS g, least(2, (substr(o_orderpriority, 1, 1)::INT - 1) // 2) AS a, CASE WHEN o_totalprice > 300000 THEN 0 WHEN o_totalprice > 150000 THEN 1 ELSE 2 END AS b FROM orders)"

QUERIES = {
    "folded_titles": Query("id:l fold:s", folded, "SELECT id, regexp_replace(lower(strip_accents(substr(text, 1, 60))), '[^a-z0-9]', '', 'g') AS fold FROM texts"),
    "link_ids": Query("page_id:l link:s", link_ids, "SELECT page_id, concat_ws('/', regexp_extract(u, '/([a-z]{2})/[0-9]+', 1), regexp_extract(u, '/([0-9]+)(?:v[0-9]+)?$', 1)) AS link FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)"),
    "plain_pages": Query("page_id:l n:l mark:s", plain_pages, f"SELECT page_id, length(x) AS n, md5(x) AS mark FROM (SELECT page_id, {CLEAN} AS x FROM pages)"),
    "cut_texts": Query(
        "id:l n:l mark:s", cut_texts,
        f"SELECT id, length(y) AS n, md5(y) AS mark FROM (SELECT id, CASE WHEN length(x) <= {CUT} THEN x WHEN length(s) > {int(CUT * 0.6)} THEN s || ' [...]' ELSE rtrim(substr(x, 1, {CUT})) || ' [...]' END AS y FROM (SELECT id, x, regexp_extract(substr(x, 1, {CUT}), '(?s)^(.*\\.) ', 1) AS s FROM (SELECT id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS x FROM texts)))",
    ),
    "text_numbers": Query(
        "id:l n:l most:d", text_numbers,
        f"SELECT id, count(v) AS n, max(v * f) FILTER (v * f < 1e9) AS most FROM (SELECT id, replace(v, ',', '')::DOUBLE AS v, {FACTOR} AS f FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{X.SCALED}', 1)) AS v, unnest(regexp_extract_all(lower(text), '{X.SCALED}', 2)) AS s FROM texts WHERE NOT contains(text, '+')) UNION ALL SELECT id, NULL, NULL FROM texts WHERE NOT contains(text, '+')) GROUP BY 1",
    ),
    "abbreviations": Query(
        "name:s short:s", abbreviations,
        "SELECT name, short FROM nm JOIN (SELECT DISTINCT array_to_string(list_transform(string_split(name, ' '), lambda w: substr(w, 1, 2) || '.'), ' ') AS short FROM nm) ON regexp_matches(lower(name), '(^| )' || array_to_string(list_transform(list_filter(string_split(replace(lower(short), '.', ' '), ' '), lambda w: w <> ''), lambda w: w || '[^ ]*'), ' (?:.* )?'))",
        "nm AS (SELECT DISTINCT name FROM persons)",
    ),
    "grounding_lint": Query(
        "wrong:l answers:l grounded:l", grounding,
        "SELECT pid % 2 AS wrong, count(*) AS answers, count(*) FILTER (abs(n - price) <= price * 0.0005 + 1e-9 OR abs(n - 100 * price) <= 100 * price * 0.0005 + 1e-9 OR abs(n - price) < 0.05 * pow(10, floor(log10(greatest(price, 1))) - 2)) AS grounded FROM (SELECT pid, price, printf('%.2f', round(CASE WHEN pid % 2 = 0 THEN price ELSE price * 1.1 + 1000 END / 1000, 2))::DOUBLE * 1000 AS n FROM pubs) GROUP BY 1",
    ),
    "structured_questions": Query("type:s subject:l answer:s", questions, "SELECT type, subject, answer FROM qa QUALIFY row_number() OVER (PARTITION BY type ORDER BY md5(type || subject::VARCHAR), subject) <= 20", RAW),
    "gold_summary": Query(
        "event_type:s cases:l right_tool:d refused:d grounded:d median:d", gold,
        "SELECT event_type, count(*) AS cases, avg((user_id % 3 <> 0)::INT) AS right_tool, avg(CASE WHEN event_id % 10 = 0 THEN (value < 50)::INT END) AS refused, avg(CASE WHEN event_id % 10 <> 0 THEN (value >= 10)::INT END) AS grounded, median(value) AS median FROM events GROUP BY 1",
    ),
    "bearing_recall": Query(
        "want:l queries:l recall5:d recall10:d mrr:d", bearing,
        """SELECT want, count(*) AS queries, avg(h5 / least(total, 5)::DOUBLE) AS recall5, avg(h10 / least(total, 10)::DOUBLE) AS recall10, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM (
           SELECT item_id, want, count(*) FILTER (label = want AND r <= 5) AS h5, count(*) FILTER (label = want) AS h10, min(r) FILTER (label = want) AS first FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS r FROM cos) GROUP BY 1, 2)
           JOIN (SELECT label AS want, count(*) - 1 AS total FROM embeddings GROUP BY 1) USING (want) GROUP BY 1""", COSINE,
    ),
    "derangement_control": Query(
        "queries:l own:l foreign:l".replace("foreign", "others"), lambda t: derangement(t).withColumnRenamed("foreign", "others"),
        "SELECT count(*) AS queries, count(*) FILTER (contains(a.text, q.text)) AS own, count(*) FILTER (contains(b.text, q.text) AND a.id <> b.id) AS others FROM pl x JOIN pl y ON y.place = (x.place + 1) % (SELECT count(*) FROM pl) JOIN benchmark q ON q.item_id = x.item_id JOIN texts a ON a.id = x.id JOIN texts b ON b.id = y.id",
        CTES + ", pl AS (SELECT item_id, id, row_number() OVER (ORDER BY md5(item_id::VARCHAR), item_id) - 1 AS place FROM target)",
    ),
    "fresh_sample": Query("pid:l venue:s", fresh, "SELECT pid, venue FROM pubs WHERE year = 2000 AND has_oa AND kind <> 'preprint' ORDER BY md5(pid::VARCHAR), pid LIMIT 50"),
    "judge_agreement": Query(
        "g:s n:l exact:d kappa:d weighted:d gap:d", judge_agreement,
        """SELECT g, n, po AS exact, (po - pe) / (1 - pe) AS kappa, 1 - far / cf AS weighted, gap FROM (SELECT g, count(*) AS n, avg((a = b)::INT) AS po, avg((a - b) ** 2) AS far, avg(a - b) AS gap FROM jd GROUP BY 1)
           JOIN (SELECT g, sum(na * nb) FILTER (a = b) AS pe, sum(na * nb * (a - b) ** 2) AS cf FROM (SELECT g, a, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g) AS na FROM jd GROUP BY 1, 2) JOIN (SELECT g, b, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g) AS nb FROM jd GROUP BY 1, 2) USING (g) GROUP BY 1) USING (g)""", JUDGED,
    ),
    "judge_confusion": Query("a:l b:l n:l", judge_confusion, "SELECT a, b, count(*) AS n FROM jd GROUP BY 1, 2", JUDGED),
    "slowest_events": Query(
        "event_type:s rank:l event_id:l value:d errors:d", slowest,
        "SELECT event_type, rank, event_id, value, errors FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) JOIN (SELECT user_id, avg((event_type = 'error')::INT) AS errors FROM events GROUP BY 1) USING (user_id) WHERE rank <= 3",
    ),
    "invariants": Query("name:s holds:b", invariants, "SELECT * FROM (VALUES ('kinds add up', true), ('filters narrow', true), ('a capped list is no count', true), ('bins are nobody', true), ('pairs are symmetric', true)) v(name, holds)"),
}
