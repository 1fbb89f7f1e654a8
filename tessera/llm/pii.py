"""Personal data and secrets by weak supervision, in DataFrame functions only.

Base spans are what the four strict patterns match (``BASE``). Further candidates come from looser patterns
(``LOOSE``): phone numbers without a plus, spelled-out addresses, cards with other separators, IPv6, and, as a kind of
their own without a strict pattern, runs of letters and digits long enough for a key or token. Labelers vote on
every candidate, base or not: its shape, a gazetteer (country codes, card issuers, top-level domains, reserved
networks, prefixes of keys), cue words before it, and what touches it. Each vote is -1, 0 (none) or 1.

The votes are counted by pattern, a table of at most 5 * 3**4 * 2 * 3 rows. From the counts, expectation-maximisation
estimates how often each labeler is right on true and on false candidates of each kind, starting from what is believed of
it. Its posteriors are the soft labels of a logistic span classifier over votes by kind and length, fitted to the same counts. That
classifier decides on the loose candidates; base spans stay as they are. Its weights enter the plan as literals, so a text
is judged where its candidates are.

Positions: a pattern's matches and the pieces between them, both from one pass of the regex engine each, give every
offset as a running sum of lengths in code points, taken in blocks so that many matches in one text stay cheap. Patterns use
possessive repeats and refuse to start inside a run, so no text makes them backtrack; ``\\G`` lets a match start where the
last one ended. Whether a candidate overlaps a base span is found by binary search among the spans of each kind.

Nulls and edge cases: a null text is empty and has no spans. Without candidates nothing is fitted and nothing added. Repeated rows
get equal results. An empty table gives an empty result. Other columns travel in one struct, so their names cannot clash;
columns ``base`` and ``spans`` are replaced, and the text is left out.
"""

from __future__ import annotations

import functools
import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import kept
from tessera.llm.ranking import count_below
from tessera.plans.staging import stage

#: The kinds with a strict pattern, then those the method alone finds.
STRICT = ("email", "ip", "card", "phone")
KINDS = (*STRICT, "secret")

#: Strict patterns, as given, in a form that cannot backtrack. A match of the card pattern is always a whole run of
#: digits, so runs of other than 16 to 19 digits are passed over here already.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+ ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9./])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,512}+={0,2}+(?![A-Za-z0-9_+/=-])",
}

# Gazetteers and cue words
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|au|ch|at|nl|be)$", r"(?i)\.(?:invalid|test|localhost|local)$"),
    "ip": (r"^(?!0\.|127\.|22[4-9]\.|2[34][0-9]\.|25[0-5]\.)", r"^(?:0\.|127\.|22[4-9]\.|2[34][0-9]\.|25[0-5]\.)"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)", r"^[01789]"),
    "secret": (r"^(?:gh[oprsu]_|github_pat_|A[KS]IA|sk[-_]|xox[abprs]-|AIza|eyJ|glpat-)", r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|^[A-Za-z]+[-_][0-9]+$|^[A-Za-z_-]{12,}[0-9]{1,4}$"),
    "phone": (r"^\+?(?:1|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])\b|^\([2-9]|^[2-9]", r"^\+?0|^\(?[01]"),
}
CUES = {
    "email": r"(?i)mail|contact|write|kontakt|schreib|correo|courriel|\bto:|from:",
    "ip": r"(?i)\bip\b|address|host|server|login|from|client",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "secret": r"(?i)token|secret|passw|api[ _-]?key|access[ _-]?key|private[ _-]?key|\bauth|bearer|credential|clave|schl[uü]ssel|passwort",
    "phone": r"(?i)\btel|phone|call|mobile|\bcell|fax|sms|whatsapp|anruf|llam|appel",
}
#: Words that speak against any kind, and against one.
AGAINST = r"(?i)version|\bv\.?$|build|isbn|issn|order|invoice|serial|\bno\.?$|section|chapter|figure|table|page|release|\bsku\b|\bdoi\b"
AGAINST_KIND = {"secret": r"|(?i)commit|\bsha-?[0-9]|\bhash|checksum|\bmd5|etag|uuid|revision|digest|https?:|www\."}
CUE_CHARS = 40
#: Matches a block of the running sums.
BLOCK = 64
VOTES = ("shape", "gazetteer", "cue", "border")
ROUNDS = 50


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def strict(kind: str, match: Column) -> Column:
    """Whether a match of the strict pattern counts."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _shape(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "card":
        ok = F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    elif kind == "phone":
        ok = n.between(8, 15) & ~match.rlike(r"([0-9])\1{6}")
    elif kind == "secret":
        rest = lambda c: F.length(F.regexp_replace(match, c, ""))  # noqa: E731  characters that are left without these
        ok = (4 * (F.length(match) - rest("[0-9]")) >= F.length(match)) | ((F.length(match) > rest("[0-9]")) & (F.length(match) > rest("[a-z]")) & (F.length(match) > rest("[A-Z]")))
    elif kind == "email":
        ok = ~match.rlike(r"^[._%+-]|[.]{2}|-$")
    else:
        ok = match.rlike(r"^[0-9.]+$") | match.rlike(r"[A-Fa-f]")
    return F.when(ok, 1).otherwise(-1)


def _border(kind: str, before: Column, after: Column) -> Column:
    """Votes on what touches the match: letters and digits for kinds that stand alone, quotes and assignments for secrets."""
    if kind == "secret":
        return F.when(before.rlike(r"[=:]\s*[\"'`]?$") | (before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")), 1).when(before.rlike(r"[./@#&?]$") | after.rlike(r"^[@.]"), -1).otherwise(0)
    return F.when(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"), -1).otherwise(1)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def _running(values: Column) -> Column:
    """Running sums of an array of bigint. An accumulator that holds an array would be copied at every step; here a sum is
    over the whole blocks before an element's own and the elements of that block up to it."""

    def sums(v):
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda bs: _let(F.transform(bs, _sum), lambda totals: F.flatten(F.transform(bs, lambda b, k: _let(_sum(F.slice(totals, F.lit(1), k)), lambda low: F.transform(b, lambda _, j: low + _sum(F.slice(b, F.lit(1), j + 1))))))))

    return _let(values, sums)


def _found(kind: str, base: bool, matches: Column, pieces: Column) -> Column:
    """Candidates of one pattern from its matches and the pieces around them."""
    yes, no = GAZETTEER[kind]
    around = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, before: F.struct(m.alias("m"), before.alias("b")))
    around = F.zip_with(around, F.slice(pieces, F.lit(2), F.size(matches)), lambda x, after: F.struct(x["m"].alias("m"), x["b"].alias("b"), after.alias("a")))
    ends = _running(F.transform(around, lambda x: (F.length(x["b"]) + F.length(x["m"])).cast("long")))

    def place(x, end):
        return F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["b"], F.lit(CUE_CHARS)).alias("b"), F.left(x["a"], F.lit(1)).alias("a"))

    placed = F.zip_with(around, ends, place)
    good = F.filter(placed, lambda c: strict(kind, c["m"])) if base else placed
    return F.transform(
        good,
        lambda c: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.lit(base).alias("base"),
            _shape(kind, c["m"]).alias("shape"),
            _vote(c["m"].rlike(yes), c["m"].rlike(no)).alias("gazetteer"),
            _vote(c["b"].rlike(CUES[kind]), c["b"].rlike(AGAINST + AGAINST_KIND.get(kind, ""))).alias("cue"),
            _border(kind, c["b"], c["a"]).alias("border"),
            F.least(F.floor(F.length(c["m"]) / 8), F.lit(2)).cast("int").alias("length"),
        ),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs as the struct ``doc``, without the text, with ``base`` and ``loose``: arrays of candidates with
    votes."""
    rest = kept(docs, text)
    value = F.coalesce(F.col("text"), F.lit(""))
    hint = {"email": F.instr(value, "@") > 0, "phone": F.instr(value, "+") > 0, "ip": value.rlike("[0-9]\\."), "card": value.rlike("[0-9]")}
    loose_hint = {"email": (F.instr(value, "at]") > 0) | (F.instr(value, "at)") > 0), "ip": value.rlike("(?::[0-9A-Fa-f]{1,4}){3}"), "card": value.rlike("[0-9][./][0-9]"), "phone": value.rlike("[0-9][ .-][0-9]|[0-9]\\)"), "secret": value.rlike("[0-9]")}
    none = F.array().cast("array<string>")
    patterns = [(k, True, BASE[k], hint[k]) for k in STRICT] + [(k, False, LOOSE[k], loose_hint[k]) for k in KINDS]
    name = lambda k, b: f"{'base' if b else 'loose'}_{k}"
    rows = docs.select(F.struct(*(rest or [F.lit(0).alias("_")])).alias("doc"), F.col(f"`{text}`").alias("text"))
    matched = rows.withColumns({name(k, b): F.when(h, F.regexp_extract_all(value, F.lit(p), F.lit(0))).otherwise(none) for k, b, p, h in patterns})
    cut = matched.withColumns({f"{name(k, b)}_pieces": F.when(F.size(name(k, b)) > 0, F.split(value, p, -1)).otherwise(none) for k, b, p, _ in patterns}).drop("text")
    found = cut.withColumns({f"of_{name(k, b)}": _found(k, b, F.col(name(k, b)), F.col(f"{name(k, b)}_pieces")) for k, b, _, _ in patterns})
    own = F.struct(*[F.col(f"of_base_{k}.{edge}").alias(f"{edge}_{k}") for k in STRICT for edge in ("start", "end")])

    def free(c, spans):
        """Whether no base span of any kind overlaps; those of one kind are in order and apart."""
        return functools.reduce(Column.__and__, [count_below(spans[f"start_{k}"], c["end"]) == count_below(spans[f"end_{k}"], c["start"] + 1) for k in STRICT])

    every = F.concat(*[F.col(f"of_loose_{k}") for k in KINDS])
    loose = F.when(F.size(every) == 0, every).otherwise(_let(own, lambda spans: F.filter(every, lambda c: free(c, spans))))
    return found.select("doc", F.concat(*[F.col(f"of_base_{k}") for k in STRICT]).alias("base"), loose.alias("loose"))


# Expectation-maximisation and classifier, on counts of vote patterns


#: What is believed of each labeler beforehand, as the share of its votes that are right, and how many votes that is worth.
BELIEVED = {"shape": 0.6, "gazetteer": 0.8, "cue": 0.9, "border": 0.75}
BELIEF = 10.0


def reliabilities(counts: list[tuple], rounds: int = ROUNDS) -> tuple[dict, dict, list[float]]:
    """From (kind, base, votes, length, n): the share of true candidates by kind; by (kind, labeler, truth) how often the
    labeler's vote on such candidates is right, where it votes; and each row's posterior. A labeler that does not vote says
    nothing. Base spans are known to be true."""
    prior = dict.fromkeys(range(len(KINDS)), 0.5)
    right = {(k, j, t): BELIEVED[name] for k in prior for j, name in enumerate(VOTES) for t in (0, 1)}
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for kind, base, votes, _, _ in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                yes, no = right[kind, j, 1], right[kind, j, 0]
                odds += {1: math.log(yes / (1 - no)), -1: math.log((1 - yes) / no), 0: 0.0}[v]
            posterior.append(1.0 if base else 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for k in prior:
            rows = [(c, p) for c, p in zip(counts, posterior, strict=True) if c[0] == k]
            prior[k] = (1 + sum(p * c[4] for c, p in rows if not c[1])) / (2 + sum(c[4] for c, _ in rows if not c[1]))
            for (j, name), t in product(enumerate(VOTES), (0, 1)):
                voted = [(c[4] * (p if t else 1 - p), c[2][j] == (1 if t else -1)) for c, p in rows if c[2][j]]
                right[k, j, t] = (BELIEF * BELIEVED[name] + sum(w for w, ok in voted if ok)) / (BELIEF + sum(w for w, _ in voted))
    return prior, right, posterior


def _features(kind: int, votes: tuple, length: int) -> list[int]:
    """Indices of the features that are on: kind, votes on any kind, length, votes by kind."""
    plain = 3 * len(VOTES)
    on = [3 * j + v + 1 for j, v in enumerate(votes)]
    return [kind, *[len(KINDS) + f for f in on], len(KINDS) + plain + length, *[len(KINDS) + plain + 3 + kind * plain + f for f in on]]


N_FEATURES = len(KINDS) + 3 * len(VOTES) * (1 + len(KINDS)) + 3


def classifier(counts: list[tuple], posterior: list[float], rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Weights of a logistic classifier fitted to the posteriors. Kinds count alike, however many candidates they have."""
    total = {k: sum(c[4] for c in counts if c[0] == k) for k in range(len(KINDS))}
    rows = [(_features(c[0], c[2], c[3]), p, c[4] / total[c[0]]) for c, p in zip(counts, posterior, strict=True)]
    w = [0.0] * N_FEATURES
    for _ in range(rounds):
        slope = [1e-3 * x for x in w]
        for on, p, n in rows:
            d = n * (1 / (1 + math.exp(-sum(w[i] for i in on))) - p)
            for i in on:
                slope[i] += d
        w = [x - rate * s for x, s in zip(w, slope, strict=True)]
    return w


def fit(found: DataFrame) -> list[float] | None:
    """The classifier's weights from all candidates of a table."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("c")).select("c.*")
    rows = each.groupBy("kind", "base", *VOTES, "length").count().collect()  # bounded by the number of vote patterns
    counts = sorted((r["kind"], r["base"], tuple(r[v] for v in VOTES), r["length"], r["count"]) for r in rows)
    return classifier(counts, reliabilities(counts)[2]) if counts else None


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with ``base`` and ``spans``: arrays of (kind, start, end) in order of kind and start."""
    found = stage(candidates(docs, text), "candidates")
    weights = fit(found) or [-1.0] * N_FEATURES
    weight = F.split(F.lit(",".join(f"{w:.9f}" for w in weights)), ",").cast("array<double>")
    base, plain = len(KINDS), 3 * len(VOTES)

    def accepted(c):
        votes = [F.lit(3 * j + 1) + c[v] for j, v in enumerate(VOTES)]
        on = [c["kind"], F.lit(base + plain) + c["length"], *[base + v for v in votes], *[F.lit(base + plain + 3) + c["kind"] * plain + v for v in votes]]
        return sum((F.element_at(weight, i + 1) for i in on), F.lit(0.0)) >= 0

    short = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    added = F.concat(F.transform("base", short), F.transform(F.filter("loose", accepted), short))
    return found.select(*[c for c in kept(docs, text, "base", "spans", name="doc")], F.array_sort(F.transform("base", short)).alias("base"), F.array_sort(added).alias("spans"))


def listed(of: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str = "text") -> Column:
    """The text with each span of a column ``spans`` replaced by its kind; overlapping spans become one."""
    ordered = F.array_sort(F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        more = F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
