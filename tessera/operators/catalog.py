"""The tools as a catalogue: what each takes, in which ranges, under which other names, and one door that calls them.

A tool returns a DataFrame and a note that says which population it counts. What it cannot answer it refuses, with the reason
and what would help; it never guesses a key and never counts a capped list."""

from __future__ import annotations

import inspect
import json
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.portable import share
from tessera.operators import profiles, retrieval
from tessera.operators.graph import EDGES, degrees, edges
from tessera.operators.tools import Refused
from tessera.plans.tables import Query, Tables
from tessera.sources import storage

col = F.col
FIRST_YEAR, LAST_YEAR = 1995, 2001
KINDS = ("journal", "conference", "preprint")
PUBLISHED = "Journal and conference papers; preprints are left out."

# Counting


def _facts(t: Tables) -> DataFrame:
    """(pid, ..., n_authors, orcid, unknown): papers with what their slots say."""
    s = t.slots.groupBy("pid").agg(F.max("n_authors").alias("n_authors"), F.bool_or("has_orcid").alias("orcid"), F.bool_or("on_bin").alias("unknown"))
    return t.pubs.join(s, "pid", "left").fillna(0, ["n_authors"]).fillna(False, ["orcid", "unknown"])


def count(t: Tables, first: int | None = None, last: int | None = None, kind: str | None = None, venue: str | None = None, person: int | None = None, min_authors: int | None = None, max_authors: int | None = None,
          open_access: bool | None = None, orcid: bool | None = None, unidentified: bool | None = None, contains: str | None = None) -> DataFrame:
    """Papers by kind under any of eleven filters; the kinds do not overlap."""
    if first is not None and last is not None and first > last:
        raise Refused("the first year is after the last")
    found = _facts(t)
    tests = [
        (first, col("year") >= first), (last, col("year") <= last), (kind, col("kind") == kind), (venue, col("venue") == venue), (min_authors, col("n_authors") >= min_authors), (max_authors, col("n_authors") <= max_authors),
        (open_access, col("has_oa") == open_access), (orcid, col("orcid") == orcid), (unidentified, col("unknown") == unidentified), (contains, F.contains(F.lower("segment"), F.lit((contains or "").lower()))),
    ]
    for value, test in tests:
        found = found if value is None else found.filter(test)
    if person is not None:
        found = found.join(t.slots.filter(col("person") == person).select("pid"), "pid", "left_semi")
    return found.groupBy("kind").agg(F.count("*").alias("papers"))


_JC, _TEAM = "kind <> 'preprint'", "kind <> 'preprint' AND n_authors > 0"
#: Metric -> (expression, the same in SQL, population, note)
METRICS = {
    "papers": ("count(*)", "count(*)", _JC, PUBLISHED),
    "mean_authors": ("avg(n_authors)", "avg(n_authors)", _TEAM, PUBLISHED + " Papers without authors are left out."),
    "median_authors": ("median(n_authors)", "median(n_authors)", _TEAM, PUBLISHED + " Papers without authors are left out."),
    "single_author_share": ("100 * avg(INT(n_authors = 1))", "100 * avg((n_authors = 1)::INT)", _TEAM, PUBLISHED),
    "large_team_share": ("100 * avg(INT(n_authors >= 6))", "100 * avg((n_authors >= 6)::INT)", _TEAM, PUBLISHED + " Six authors or more."),
    "open_access_share": ("100 * avg(INT(has_oa))", "100 * avg(has_oa::INT)", _JC, PUBLISHED),
    "building_share": ("100 * avg(INT(segment = 'BUILDING'))", "100 * avg((segment = 'BUILDING')::INT)", _JC, PUBLISHED),
    "orcid_share": ("100 * avg(INT(orcid))", "100 * avg(orcid::INT)", _JC, PUBLISHED + " A paper counts if any author carries one."),
    "unidentified_share": ("100 * avg(INT(unknown))", "100 * avg(unknown::INT)", "true", "All records, preprints too. A paper counts if any author lies on a shared name."),
    "preprints": ("count(*)", "count(*)", "kind = 'preprint'", "Preprints only."),
}


def timeseries(t: Tables, metric: str, first: int = FIRST_YEAR, last: int = LAST_YEAR, venue: str | None = None) -> DataFrame:
    """A metric by year, over the metric's own population."""
    if metric not in METRICS:
        raise Refused(f"no such metric: {metric}; there are {', '.join(METRICS)}")
    value, _, population, _ = METRICS[metric]
    found = _facts(t).filter(population).filter(col("year").between(first, last))
    return (found if venue is None else found.filter(col("venue") == venue)).groupBy("year").agg(F.round(F.expr(value).cast("double"), 6).alias("value"), F.count("*").alias("papers"))


def all_series(t: Tables) -> DataFrame:
    out = None
    for m in METRICS:
        one = timeseries(t, m).withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


TERM = re.compile(r"[a-z0-9][a-z0-9 \-+.#]{0,38}")


def title_terms(t: Tables, terms: list[str], first: int = 2000, last: int = 2009) -> DataFrame:
    """The share of a year's texts that hold each of up to six terms as whole words, in the plural too."""
    clean = [x.strip().lower() for x in terms if x and x.strip()]
    if not 1 <= len(clean) <= 6:
        raise Refused("give one to six terms")
    for x in clean:
        if not TERM.fullmatch(x):
            raise Refused(f"unsupported term {x!r}: letters, digits, spaces, - + . # only")
    pattern = lambda x: r"(?:^|[^a-z0-9_])" + re.sub(r"([^a-z0-9 ])", r"\\\1", x) + r"s?(?:[^a-z0-9_]|$)"  # noqa: E731  the ends of words that all engines agree on
    shares = [F.round(100 * share(F.lower("text").rlike(pattern(x))), 3).alias(f"t{i}") for i, x in enumerate(clean)]
    return t.texts.filter(col("year").between(first, last)).groupBy("year").agg(F.count("*").alias("texts"), *shares)


def facts(t: Tables) -> DataFrame:
    """The headline numbers: (k, v)."""
    p = t.pubs.agg(F.count("*").alias("publications"), F.count_if(col("kind") != "preprint").alias("published"), F.count_if(col("kind") == "preprint").alias("preprints"), F.countDistinct("venue").alias("venues"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    q = t.persons.agg(F.count("*").alias("pages"), F.count_if(col("page_kind") == "disambiguation").alias("bins"), F.count_if(col("page_kind") == "numbered").alias("numbered"))
    wide = p.crossJoin(F.broadcast(q))
    return wide.select(*[col(c).cast("long").alias(c) for c in wide.columns]).unpivot([], wide.columns, "k", "v")


def leaderboards(t: Tables, k: int = 20) -> DataFrame:
    """(board, rank, name, value): people by papers and by co-authors, venues and shared names by size."""
    people = t.persons.filter("page_kind <> 'disambiguation'").select("person", "name")
    papers = people.join(t.slots.groupBy("person").agg(F.count("*").alias("value")), "person")
    met = people.join(degrees(t.once("edges", edges)).select(col("node").alias("person"), col("degree").alias("value")), "person")
    boards = {
        "papers": papers.select(F.concat_ws(" ", "name", col("person").cast("string")).alias("name"), "value"), "co-authors": met.select(F.concat_ws(" ", "name", col("person").cast("string")).alias("name"), "value"),
        "venues": t.pubs.filter(_JC).groupBy(col("venue").alias("name")).agg(F.count("*").alias("value")), "names": t.persons.filter("page_kind = 'numbered'").groupBy("name").agg(F.count("*").alias("value")),
    }
    out = None
    for board, rows in boards.items():
        one = profiles.first_of(rows.withColumn("board", F.lit(board)), "board", k, col("value").desc(), col("name"))
        out = one if out is None else out.unionByName(one)
    return out


# Lookups


def person(t: Tables, key: int | str) -> int:
    """The id of a person given as an id or as a name that is theirs alone; refused otherwise."""
    if isinstance(key, int) or str(key).isdigit():
        if t.persons.filter(col("person") == int(key)).isEmpty():
            raise Refused(f"there is nobody with the id {key}; look for the name first")
        return int(key)
    found = t.persons.filter(F.lower("name") == key.lower()).select("person").limit(2).collect()
    if len(found) != 1:
        raise Refused(f"{'nobody' if not found else 'more than one person'} is called {key!r}; look for the name and take an id")
    return found[0]["person"]


def paper(t: Tables, key: int | None = None, title: str | None = None) -> DataFrame:
    """A text by its id, or by its title whatever its case and signs."""
    if (key is None) == (title is None):
        raise Refused("give either a key or a title")
    if key is not None:
        return t.texts.filter(col("id") == key).select("id", "year", "source")
    norm = re.sub("[^a-z0-9]", "", title.lower())
    if len(norm) < 3:
        raise Refused("the title is too short")
    return t.texts.filter(F.startswith("norm", F.lit(norm))).select("id", "year", "source")


def search_papers(t: Tables, query: str, k: int = 10) -> DataFrame:
    """Texts for a query by words and vector; where no word of it is known, those that hold all its words as they stand."""
    if len(query.strip()) < 3:
        raise Refused("type at least three characters")
    one = t.spark.createDataFrame([(0, query)], "item_id long, text string")
    hits = retrieval.top(retrieval.bm25(t, items=one), k)
    if not hits.isEmpty():
        return hits.join(t.texts.select("id", "year", "source"), "id").select("rank", "id", "year", "source")
    return profiles.paper_search(t, tuple(query.split()[:8]), None, None, None, k).select(F.lit(None).cast("int").alias("rank"), "id", "year", "source")


#: What the tables hold, for questions about the data itself.
DOCS = [
    ("papers", "A paper is an order. Its year is the year of the order, its kind follows from the status: conference, journal or preprint. Preprints are counted apart."),
    ("authors", "An author slot is a distinct part of an order; its position follows from the part's number. A person is a part."),
    ("shared names", "Every fiftieth person is a shared name, a bin: several people under one name. A bin is never counted as a person, has no career and no co-authors."),
    ("co-authors", "Two people are co-authors if they share a paper of two to fifty authors. Degrees count people, not papers."),
    ("venues", "A venue is the nation of the customer, its group the region. The share of open papers follows from the price."),
    ("texts", "Texts are documents with a language and a source. Copies share a normalised title of lower-case letters and digits."),
    ("search", "Search ranks texts by words, by vectors and by both. The word ranking counts less where its best text holds few of the query's words."),
    ("years", "The last year is not complete; the last full year is the year before."),
]


def docs_lookup(question: str, top: int = 3) -> list[tuple[str, float]]:
    """The descriptions most like a question: the idf of shared words over the root of a description's length."""
    words = lambda s: [w for w in re.findall("[a-z]+", s.lower()) if len(w) > 2]
    bags = [Counter(words(f"{a} {b}")) for a, b in DOCS]
    df = Counter(w for b in bags for w in b)
    asked = Counter(words(question))
    score = [sum((math.log(len(DOCS) / df[w]) + 1) * min(n, b[w]) for w, n in asked.items() if w in b) / math.sqrt(sum(b.values())) for b in bags]
    best = sorted(range(len(DOCS)), key=lambda i: (-score[i], DOCS[i][0]))[:top]
    return [(DOCS[i][0], round(score[i], 6)) for i in best if score[i] > 0]


def model_cards(t: Tables, folder: str) -> DataFrame:
    """(model, metric, value) of all models below a folder: what their ``metrics.json`` files say."""
    rows = []
    for e in storage.listed(t.spark, folder):
        for name, value in sorted((storage.read_json(t.spark, f"{e.path}/metrics.json") or {}).items()) if e.is_folder else []:
            rows.append((e.name, name, json.dumps(value)))
    return t.spark.createDataFrame(rows, "model string, metric string, value string")


# The door


@dataclass(frozen=True)
class Tool:
    run: Callable
    about: str
    #: Parameter -> allowed values (a tuple) or range (a range)
    allowed: dict
    note: str = ""


YEARS = range(1900, 2101)
RENAMED = {"from": "first", "to": "last", "year_from": "first", "year_to": "last", "frm": "first", "limit": "k", "top": "k", "author": "person", "author_key": "person", "sid": "venue", "q": "query", "words": "query", "type": "kind"}
TOOLS = {
    "count_papers": Tool(count, "How many papers there are under filters, by kind.", {"first": YEARS, "last": YEARS, "kind": KINDS, "min_authors": range(0, 1000), "max_authors": range(0, 1000)}, "No filter means every record."),
    "papers_timeseries": Tool(timeseries, "A metric by year.", {"metric": tuple(METRICS), "first": YEARS, "last": YEARS}),
    "title_terms": Tool(title_terms, "How often terms stand in texts, by year.", {"first": YEARS, "last": YEARS}, "Words of the text only: a text can be about a term without holding it."),
    "dataset_facts": Tool(facts, "The headline numbers.", {}),
    "leaderboards": Tool(leaderboards, "The largest people, venues and names.", {"k": range(1, 2001)}),
    "top_venues": Tool(profiles.top_venues, "The leading venues of a span of years.", {"first": YEARS, "last": YEARS, "k": range(1, 201), "least": range(1, 10_000)}, PUBLISHED + " Small venues can be missing."),
    "author_papers": Tool(profiles.author_papers, "People's latest papers under filters, with their true number.", {"first": YEARS, "last": YEARS, "kind": KINDS}),
    "search_papers": Tool(search_papers, "Texts for a query.", {"k": range(1, 201)}),
    "paper_detail": Tool(paper, "A text by key or title.", {}),
    "rising_words": Tool(lambda t, rising=True: _rising(t, rising), "Words whose share grew or shrank most.", {"rising": (True, False)}),
}


def _rising(t: Tables, rising: bool) -> DataFrame:
    from tessera.operators.analytics import _changing

    return _changing(t, rising)


def schema(name: str) -> dict:
    """A tool's parameters as a JSON schema."""
    tool, kinds = TOOLS[name], {"int": "integer", "float": "number", "bool": "boolean", "list": "array"}
    out, required = {}, []
    for p in list(inspect.signature(tool.run).parameters.values())[1:]:
        said = str(p.annotation)
        out[p.name] = {"type": next((v for k, v in kinds.items() if said.startswith(k)), "string")}
        limit = tool.allowed.get(p.name)
        out[p.name] |= {"enum": list(limit)} if isinstance(limit, tuple) else {"minimum": limit.start, "maximum": limit.stop - 1} if limit else {}
        if p.default is inspect.Parameter.empty:
            required.append(p.name)
    return {"name": name, "description": tool.about, "parameters": {"type": "object", "properties": out, "required": required, "additionalProperties": False}}


def call(t: Tables, name: str, **given) -> DataFrame:
    """Runs a tool. Other names of parameters are understood; unknown ones and values out of range are refused."""
    if name not in TOOLS:
        raise Refused(f"no such tool: {name}; there are {', '.join(TOOLS)}")
    tool = TOOLS[name]
    takes = list(inspect.signature(tool.run).parameters.values())[1:]
    named = {}
    for k, v in given.items():
        k = RENAMED.get(k, k) if k not in {p.name for p in takes} else k
        if k not in {p.name for p in takes}:
            raise Refused(f"{name} has no parameter {k}; it takes {', '.join(p.name for p in takes) or 'none'}")
        limit = tool.allowed.get(k)
        if limit is not None and v is not None and v not in limit:
            raise Refused(f"{k} has to be one of {', '.join(map(str, limit))}" if isinstance(limit, tuple) else f"{k} has to lie from {limit.start} to {limit.stop - 1}")
        named[k] = v
    if missing := [p.name for p in takes if p.default is inspect.Parameter.empty and p.name not in named]:
        raise Refused(f"{name} needs {', '.join(missing)}")
    return tool.run(t, **named)


CALLS = [
    ("count_papers", {"from": 1996, "to": 1998}), ("count_papers", {"kind": "book"}), ("count_papers", {"first": 1999, "last": 1998}), ("count_papers", {"colour": "red"}), ("papers_timeseries", {}), ("papers_timeseries", {"metric": "preprints"}),
    ("title_terms", {"terms": ["the", "a;b"]}), ("title_terms", {"terms": ["the"]}), ("leaderboards", {"top": 0}), ("leaderboards", {"top": 5}), ("search_papers", {"q": "x"}), ("paper_detail", {}), ("nothing", {}),
]


def calls(t: Tables) -> DataFrame:
    """What the door makes of a list of calls: rows returned, or refused."""
    out = []
    for i, (name, args) in enumerate(CALLS):
        try:
            out.append((i, name, "ok", call(t, name, **args).count()))
        except Refused:
            out.append((i, name, "refused", 0))
    return t.spark.createDataFrame(out, "i long, tool string, outcome string, n long")


FACTS = "fc AS MATERIALIZED (SELECT p.*, coalesce(n_authors, 0) AS n_authors, coalesce(orcid, false) AS orcid, coalesce(unknown, false) AS unknown FROM pubs p LEFT JOIN (SELECT pid, max(n_authors) AS n_authors, bool_or(has_orcid) AS orcid, bool_or(on_bin) AS unknown FROM slots GROUP BY 1) USING (pid))"
DEGREE = f"{EDGES}, dg AS (SELECT node, count(*) AS value FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1)"
ASKED = ("what is a shared name or bin", "which years are complete", "how are co-authors counted", "zzz")

QUERIES = {
    "count_filters": Query(
        "kind:s papers:l", lambda t: count(t, first=1996, last=2000, min_authors=2, max_authors=6, open_access=True, orcid=True, unidentified=False, contains="b"),
        "SELECT kind, count(*) AS papers FROM fc WHERE year BETWEEN 1996 AND 2000 AND n_authors BETWEEN 2 AND 6 AND has_oa AND orcid AND NOT unknown AND contains(lower(segment), 'b') GROUP BY 1", FACTS,
    ),
    "count_of_person": Query("kind:s papers:l", lambda t: count(t, person=7, venue=None), "SELECT kind, count(*) AS papers FROM pubs WHERE pid IN (SELECT pid FROM slots WHERE person = 7) GROUP BY 1"),
    "metric_series": Query("metric:s year:l value:d papers:l", all_series, " UNION ALL ".join(f"SELECT '{m}' AS metric, year, round({sql}, 6) AS value, count(*) AS papers FROM fc WHERE {where} AND year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} GROUP BY 2" for m, (_, sql, where, _) in METRICS.items()), FACTS),
    "title_terms": Query(
        "year:l texts:l t0:d t1:d t2:d", lambda t: title_terms(t, ["the", "license", "tion"]),
        r"SELECT year, count(*) AS texts, " + ", ".join(rf"round(100 * avg(regexp_matches(lower(text), '(?:^|[^a-z0-9_]){x}s?(?:[^a-z0-9_]|$)')::INT), 3) AS t{i}" for i, x in enumerate(("the", "license", "tion"))) + " FROM texts WHERE year BETWEEN 2000 AND 2009 GROUP BY 1",
    ),
    "dataset_facts": Query(
        "k:s v:l", facts,
        " UNION ALL ".join(f"SELECT '{k}' AS k, ({v})::BIGINT AS v" for k, v in {
            "publications": "SELECT count(*) FROM pubs", "published": "SELECT count(*) FROM pubs WHERE kind <> 'preprint'", "preprints": "SELECT count(*) FROM pubs WHERE kind = 'preprint'", "venues": "SELECT count(DISTINCT venue) FROM pubs",
            "first_year": "SELECT min(year) FROM pubs", "last_year": "SELECT max(year) FROM pubs", "pages": "SELECT count(*) FROM persons", "bins": "SELECT count(*) FROM persons WHERE page_kind = 'disambiguation'", "numbered": "SELECT count(*) FROM persons WHERE page_kind = 'numbered'",
        }.items()),
    ),
    "leaderboards": Query(
        "board:s rank:l name:s value:l", leaderboards,
        """SELECT board, row_number() OVER (PARTITION BY board ORDER BY value DESC, name) AS rank, name, value FROM (SELECT 'papers' AS board, name || ' ' || person AS name, n AS value FROM persons JOIN (SELECT person, count(*) AS n FROM slots GROUP BY 1) USING (person) WHERE page_kind <> 'disambiguation'
           UNION ALL SELECT 'co-authors', name || ' ' || person, value FROM persons JOIN dg ON node = person WHERE page_kind <> 'disambiguation' UNION ALL SELECT 'venues', venue, count(*) FROM pubs WHERE kind <> 'preprint' GROUP BY 2 UNION ALL SELECT 'names', name, count(*) FROM persons WHERE page_kind = 'numbered' GROUP BY 2) QUALIFY rank <= 20""", DEGREE,
    ),
    "docs_lookup": Query("question:s rank:l topic:s", lambda t: t.spark.createDataFrame([(q, i + 1, name) for q in ASKED for i, (name, _) in enumerate(docs_lookup(q, 1))], "question string, rank int, topic string"), f"SELECT * FROM (VALUES ('{ASKED[0]}', 1, 'shared names'), ('{ASKED[1]}', 1, 'years'), ('{ASKED[2]}', 1, 'co-authors')) v(question, rank, topic)"),
    "tool_calls": Query(
        "i:l tool:s outcome:s n:l", calls,
        "SELECT * FROM (VALUES (0, 'count_papers', 'ok', (SELECT count(DISTINCT kind) FROM pubs WHERE year BETWEEN 1996 AND 1998)), (1, 'count_papers', 'refused', 0), (2, 'count_papers', 'refused', 0), (3, 'count_papers', 'refused', 0), (4, 'papers_timeseries', 'refused', 0), (5, 'papers_timeseries', 'ok', (SELECT count(DISTINCT year) FROM pubs WHERE kind = 'preprint')), "
        "(6, 'title_terms', 'refused', 0), (7, 'title_terms', 'ok', (SELECT count(DISTINCT year) FROM texts)), (8, 'leaderboards', 'refused', 0), (9, 'leaderboards', 'ok', 20), (10, 'search_papers', 'refused', 0), (11, 'paper_detail', 'refused', 0), (12, 'nothing', 'refused', 0)) v(i, tool, outcome, n)",
    ),
}
