"""Personal data by weak supervision, in DataFrame expressions alone.

Regular expressions propose candidates: the four base kinds (email, ip, card, phone), and looser ones (written-out
addresses, phone numbers without a plus, names after a form of address, secrets such as access tokens).  Labelers
vote on each candidate: its format, gazetteers, the words before it, the marks around it and its shape.
Expectation maximisation over the vote patterns of all candidates estimates how reliable each labeler is for each
kind, drawn towards its rates over all kinds where a kind has few candidates, and with that how likely each
candidate is personal data.  A logistic span classifier is trained on these likelihoods; besides the votes it sees
the span's length, its mix of letters and digits, the word before it (hashed) and the character after it, so it can
tell apart candidates whose votes are alike.  It decides on the looser candidates.  Base candidates whose format
holds are kept whatever the votes.

The labelers of words see 24 code points before a span and 2 after it.  A labeler that hardly ever votes on what is no
personal data says little there, and its rate on that side stays near the prior (0.8).

The patterns of votes and features are counted by Spark; they take finitely many values, so what the driver gets
has a bound (``kinds * 3**labelers * features``, some thousands in practice) at any size of the corpus.

Starts and ends are code points, ends exclusive.  Null texts count as empty and have no spans.  Looser spans that
touch a base span are dropped.  Repeated rows are treated alike; without any candidate nothing is learned.  Spans of
any length and number are found; the work grows linearly with both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.native import let, running, running_sums
from wareflow.llm.shared import saved

#: The base kinds in their order.  Possessive loops and look-behinds change no match; they keep
#: long runs of letters or digits from being walked again from each of their places.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Se(?:ñ|n)or(?:a|ita)?)"
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "email_text": r"(?i)[(\[ ]at[)\] ]", "phone_text": r"[0-9]{3}[ .-][0-9]{4}", "name": rf"\b{_TITLES}\b", "secret": r"[A-Za-z0-9_/+=-]{20}"}
#: Looser candidates.
LOOSE = {
    "email_text": r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[a-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]++)++",
    "phone_text": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "name": rf"\b{_TITLES}\b\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-][A-Za-z0-9_/+=-]{19,}+",
}
KINDS = [*BASE, *LOOSE]

#: Words that speak for a kind when they stand before it, and marks and words that speak against any.
_CONTEXT = {
    "email": r"e-?mail|mail|contact|write|from|to|kontakt|courriel|contactez|correo|escriba",
    "ip": r"ip|address|host|server|client|adresse|serveur|servidor|direcci[oó]n",
    "card": r"card|visa|mastercard|amex|credit|debit|pan|karte|kreditkarte|carte|tarjeta",
    "phone": r"tel|telephone|phone|call|fax|mobile|cell|telefon|rufen|appelez|t[eé]l[eé]phone|tel[eé]fono|ll[aá]menos",
    "name": r"from|to|signed|dear|by|name|liebe[rs]?|geehrter?|cher|ch[eè]re|estimad[oa]",
    "secret": r"token|secret|password|passwd|pwd|passwort|contrase[nñ]a|(?:api|access|private|auth)[ _-]?key|key|bearer|authorization",
}
_AGAINST = r"(?i)(?:\b(?:version|release|isbn|issn|order|invoice|ticket|section|chapter|figure|table|page|build|commit|checksum|sha(?:1|256)|md5)\W{0,4}|[\\#_$€£])$"
_GIVEN = (
    r"(?i)\b(?:James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Daniel|Matthew|Mark|George|Steven|Edward|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Sarah|Karen|Emma|Alice"
    r"|Anna|Anne|Maria|Peter|Hans|Klaus|J[uü]rgen|Wolfgang|Stefan|Heinz|Ursula|Monika|Sabine|Petra|Jean|Pierre|Marie|Jacques|Michel|Philippe|Nathalie|Isabelle|Sophie|Claire|Paul|Luc"
    r"|Jos[eé]|Juan|Carmen|Luis|Carlos|Antonio|Manuel|Francisco|Javier|Pablo|Luc[ií]a|Elena|Rosa|Pilar)\b"
)
_DOMAIN = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|be|pl|ca|us|br|mx|ar|jp|cn|au)$"
_PRIVATE = r"^(?:0|10|127|255|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_KEYS = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abpr]-|sk-|pk_live_|eyJ)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
LABELERS = ("format", "gazetteer", "before", "around", "shape")
#: Numbers of values of the classifier's features: length, mix of characters, word before, character after.
FEATURES = {"size": 4, "mix": 4, "word": 16, "next": 4}


def _luhn(digits: Column) -> Column:
    def add(acc: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        doubled = digit * 2
        return acc + F.when(k % 2 == 0, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _format(kind: str, value: Column) -> Column:
    """Whether a candidate passes its kind's test of format; null for digits that are too few or many for a card."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)))
    if kind in ("phone", "phone_text"):
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _votes(kind: str, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """1: personal data, -1: not, 0: abstains."""
    yes, no, none = (F.lit(x).cast("tinyint") for x in (1, -1, 0))
    otherwise = none
    if kind in ("email", "email_text"):
        known, shape = F.regexp_replace(value, r"(?i) ?(?:\(dot\)|\[dot\]) ?", ".").rlike(_DOMAIN), value.rlike(r"^[A-Za-z0-9]") & value.rlike(r"[A-Za-z]{2}$")
    elif kind == "ip":
        known, shape, otherwise = ~value.rlike(_PRIVATE), ~value.rlike(r"(?:^|\.)0[0-9]") & (F.length(value) >= 9), no
    elif kind == "card":
        known, shape = value.rlike("^[3-6]"), value.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$")
    elif kind in ("phone", "phone_text"):
        known, shape = value.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1-6]|9[0-5])") | value.rlike(r"^\("), value.rlike(r"[ ().-]")
    elif kind == "secret":
        # Letters and digits that take turns, as in no word or date.
        turns = F.length(F.regexp_replace(F.regexp_replace(value, "[^0-9]++", "a"), "[0-9]++", "0"))
        known, shape = value.rlike(_KEYS), (turns >= 4) & ~value.rlike(r"^[A-Za-z]++(?:[-_/][A-Za-z0-9]++)*+$")
    else:
        known, shape = value.rlike(_GIVEN), value.rlike(r" [A-Z][a-z]+ [A-Z]")
    context = rf"(?i)\b(?:{_CONTEXT[kind.removesuffix('_text')]})\W{{0,5}}$"
    format_ = _format(kind, value)
    return {
        "format": F.when(format_, yes).when(~format_, no),
        "gazetteer": F.when(known, yes).otherwise(otherwise),
        "before": F.when(before.rlike(context), yes).when(before.rlike(_AGAINST), no).otherwise(none),
        "around": F.when(before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]"), no).when(before.rlike(r"[\"'(<\[|:=]\s?$"), yes).otherwise(none),
        "shape": F.when(shape, yes).otherwise(no),
    }


def _features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """What the classifier sees besides the votes, each a small number."""
    n, word = F.length(value), F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]{0,5}$", 1))
    made = {
        "size": F.when(n < 12, 0).when(n < 18, 1).when(n < 30, 2).otherwise(3),
        "mix": F.when(value.rlike("[A-Za-z]"), 0).otherwise(2) + F.when(value.rlike("[0-9]"), 0).otherwise(1),
        "word": F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(FEATURES["word"] - 1)) + 1),
        "next": F.when(after == "", 0).when(after.rlike(r"^\s"), 1).when(after.rlike(r"^[.,;:!?)\]\"']"), 2).otherwise(3),
    }
    return {name: column.cast("tinyint") for name, column in made.items()}


def _found(kind: str, text: Column) -> Column:
    """The candidates of a kind: array of (start, kind number, end, base, votes, features)."""
    pattern = BASE.get(kind) or LOOSE[kind]

    def placed(x: Column) -> Column:
        pieces, hits = x["pieces"], x["hits"]
        steps = F.transform(hits, lambda h, i: (F.length(pieces[i]) + F.when(i > 0, F.length(hits[i - 1])).otherwise(0)).cast("long"))

        def one(starts: Column, h: Column, i: Column) -> Column:
            before, after = F.right(pieces[i], F.lit(24)), F.left(pieces[i + 1], F.lit(2))
            votes = _votes(kind, h, before, after)
            base = F.coalesce(votes["format"] == 1, F.lit(False)) if kind in BASE else F.lit(False)
            more = [v.alias(k) for k, v in (votes | _features(h, before, after)).items()]
            return F.struct(starts[i].alias("start"), F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"), (starts[i] + F.length(h)).alias("end"), base.alias("base"), *more)

        return let(running_sums(steps), lambda starts: F.transform(hits, lambda h, i: one(starts, h, i)))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    small = ",".join(f"{k}:tinyint" for k in (*LABELERS, *FEATURES))
    empty = F.array().cast(f"array<struct<start:bigint,kind:tinyint,end:bigint,base:boolean,{small}>>")
    needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
    return F.when(needed, let(both, placed)).otherwise(empty)


def candidates(docs: DataFrame, text: str = "text", column: str = "candidates") -> DataFrame:
    """``docs`` with all candidates of each whole text.  Digit runs that can be no card are left out."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(column, F.filter(F.concat(*[_found(kind, whole) for kind in KINDS]), lambda c: c["format"].isNotNull()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 40, drawn: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """How likely each pattern is personal data, and the labelers' rates of right votes: [kind, labeler, side (not, is)].

    A kind's rates are drawn towards those over all kinds with the weight of ``drawn`` candidates, and these towards
    four fifths, so labelers start out better than chance.  Patterns come with their kind, votes and count.
    """
    likely = np.clip(0.5 + votes.sum(axis=1) / (2 * votes.shape[1]), 0.05, 0.95)
    each = np.unique(kinds)
    right = np.full((kinds.max() + 1, votes.shape[1], 2), 0.8)
    for _ in range(rounds):
        # M: the rates over all kinds, then by kind, and each kind's share of personal data.
        side = np.stack([1 - likely, likely], axis=1) * counts[:, None]
        correct = np.stack([votes < 0, votes > 0], axis=2)
        voted = (votes != 0)[:, :, None]
        hit, of = correct * side[:, None, :], voted * side[:, None, :]
        pooled = (4 + hit.sum(axis=0)) / (5 + of.sum(axis=0))
        prior = np.full(kinds.max() + 1, 0.5)
        for k in each:
            here = kinds == k
            right[k] = (drawn * pooled + hit[here].sum(axis=0)) / (drawn + of[here].sum(axis=0))
            prior[k] = (1 + side[here, 1].sum()) / (2 + counts[here].sum())
        # E
        r = np.clip(right[kinds], 1e-6, 1 - 1e-6)
        odds = np.where(votes > 0, np.log(r[:, :, 1] / (1 - r[:, :, 0])), np.where(votes < 0, np.log((1 - r[:, :, 1]) / r[:, :, 0]), 0.0))
        likely = _sigmoid(np.log(prior / (1 - prior))[kinds] + odds.sum(axis=1))
    return likely, right


def _columns(kinds: np.ndarray, votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The classifier's inputs: a place for each kind, each labeler's yes and no, and each value of each feature."""
    parts = [kinds[:, None] == np.arange(len(KINDS))]
    parts += [votes[:, j : j + 1] == np.array([-1, 1]) for j in range(votes.shape[1])]
    parts += [features[:, j : j + 1] == np.arange(n) for j, n in enumerate(FEATURES.values())]
    return np.concatenate(parts, axis=1).astype(float)


def span_classifier(kinds: np.ndarray, votes: np.ndarray, features: np.ndarray, counts: np.ndarray, likely: np.ndarray, steps: int = 500, rate: float = 2.0) -> np.ndarray:
    """The weights of a logistic regression of the likelihoods on votes and features, by gradient descent."""
    x, share = _columns(kinds, votes, features), counts / counts.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        weights -= rate * (x.T @ (share * (_sigmoid(x @ weights) - likely)) + 1e-4 * weights)
    return weights


def learn(found: DataFrame, column: str = "candidates") -> dict | None:
    """Labeler reliabilities by expectation maximisation, then a logistic classifier on the likelihoods."""
    names = ["kind", *LABELERS, *FEATURES]
    each = found.select(F.explode(column).alias("c")).select(*[F.col(f"c.{k}").alias(k) for k in names])
    rows = sorted(tuple(r) for r in each.groupBy(*names).agg(F.count("*").alias("n")).collect())
    if not rows:
        return None
    table = np.array(rows, np.int64)
    kinds, votes, features, counts = table[:, 0], table[:, 1 : 1 + len(LABELERS)], table[:, 1 + len(LABELERS) : -1], table[:, -1].astype(float)
    likely, right = expectation_maximisation(kinds, votes, counts)
    reliability = {KINDS[k]: {name: right[k, j].tolist() for j, name in enumerate(LABELERS)} for k in np.unique(kinds)}
    return {"reliability": reliability, "weights": span_classifier(kinds, votes, features, counts, likely).tolist()}


def _score(c: Column, model: dict) -> Column:
    """The classifier's log odds of a candidate."""
    left = iter(model["weights"])

    def table(n: int) -> Column:
        return F.array(*[F.lit(next(left)) for _ in range(n)])

    z = F.get(table(len(KINDS)), c["kind"].cast("int"))
    for name in LABELERS:
        no, yes = next(left), next(left)
        z = z + F.when(c[name] > 0, F.lit(yes)).when(c[name] < 0, F.lit(no)).otherwise(F.lit(0.0))
    for name, n in FEATURES.items():
        z = z + F.get(table(n), c[name].cast("int"))
    return z


def _before_and_after(spans: Column, body) -> Column:
    """``body`` of the furthest end among the spans so far, and the nearest start among those still to come, by place.

    Spans are in order of their start; ends of spans that do not count are -1, starts of such the largest number.
    """
    ends = running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(-1).cast("long"))), lambda a, b: F.greatest(a, b))
    starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(F.lit((1 << 63) - 1)))), lambda a, b: F.least(a, b)))
    return let(ends, lambda e: let(starts, lambda s: body(e, s)))


def decide(found: DataFrame, model: dict | None, column: str = "candidates", spans: str = "spans") -> DataFrame:
    """``found`` with ``spans``: the accepted candidates (start, kind, end, base), by start and kind."""

    def slim(c: Column) -> Column:
        return F.struct(c["start"], c["kind"], c["end"], c["base"])

    def accepted(c: Column) -> Column:
        return c["base"] if model is None else c["base"] | ((c["kind"] >= len(BASE)) & (_score(c, model) >= 0))

    def apart(ordered: Column) -> Column:
        # A looser span stays where no base span before it ends in it and none after it starts in it.
        def free(ends: Column, starts: Column) -> Column:
            return F.filter(ordered, lambda c, i: c["base"] | ((F.get(ends, i) <= c["start"]) & (F.get(starts, i) >= c["end"])))

        return F.when(F.exists(ordered, lambda c: ~c["base"]), _before_and_after(ordered, free)).otherwise(ordered)

    taken = F.array_sort(F.transform(F.filter(F.col(column), accepted), slim))
    return found.withColumn(spans, let(taken, apart))


def kind_name(kind: Column) -> Column:
    """Written-out addresses and numbers are of the kind that they spell."""
    names = F.array(*[F.lit(k.removesuffix("_text")) for k in KINDS])
    return names[kind.cast("int")]


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of the pieces that a text is cut into before parts of it are taken out.
_PIECE = 4096


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text cut into pieces."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
    at, to = (start % _PIECE + 1).cast("int"), (end - F.floor((end - 1) / _PIECE) * _PIECE).cast("int")
    long = F.concat(F.substring(F.get(pieces, first), at, F.lit(_PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.left(F.get(pieces, last), to))
    return F.when(end <= start, "").when(first == last, F.substring(F.get(pieces, first), at, (end - start).cast("int"))).otherwise(long)


def redact(docs: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap become one."""
    whole = F.col(text)

    def made(s: Column, pieces: Column, ends: Column) -> Column:
        # What stands before a span and its mark; nothing for a span that starts within an earlier one.
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long"))
            return F.when(x["start"] >= before, F.concat(_part(pieces, before, x["start"]), F.lit("["), F.upper(kind_name(x["kind"])), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(s, piece), ""), _part(pieces, F.element_at(ends, -1), F.length(whole).cast("long")))

    cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    redacted = let(cut, lambda pieces: let(ends, lambda e: made(F.col(spans), pieces, e)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, redacted).otherwise(whole))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: personal data in every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = saved(candidates(docs).drop("text"))
    spans = decide(found, learn(found))
    base = F.filter("spans", lambda s: s["base"])

    def number(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
