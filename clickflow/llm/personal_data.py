r"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Candidates are the matches of fixed patterns: those of the base kinds (email,
ip, card, phone), and looser ones for spelled-out addresses, national phone
numbers, identity numbers, account numbers and names. For every candidate
labelers vote for or against personal data, or abstain:

* patterns look at the span's form (check digits, ranges, digit counts), at
  what it touches and at its digits' variety,
* gazetteers know top-level domains, card issuers, calling codes, reserved
  networks, first names, and capitalised words that are no names,
* context labelers look for cue words around it, for and against.

Expectation-maximisation over the table of distinct vote patterns of a kind
gives every labeler's reliabilities (how often it votes for where it should,
and against) and each kind's share of true spans, and thereby a probability
for every pattern. With these as soft labels a logistic regression on votes,
kind, length and digits is trained, one row per distinct combination, weighed
by its count. It decides on candidates; base spans always stay, and candidates
that overlap one are left out.

Everything is DataFrame functions and Spark ML: per text the matches are taken
by ``split`` and ``regexp_extract_all`` in one scan, and running sums of
lengths give the offsets in code points. What is collected is one row per kind. Copies of a text are one text, found by a hash of the content.

Patterns are written so that a long run of like characters is read once:
possessive quantifiers, and look-behinds that let a match only start where a
run starts or the last match ended.

Defined cases: a null or empty text has no spans; repeated rows and texts equal
under several ids each get their text's spans; null ids are ordinary; other columns are
ignored; without any candidate nothing is trained and nothing added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickflow.llm.common import keep

BEFORE, AFTER, SHOWN = 40, 24, 64
ROUNDS = 12
LEAST_PROBABILITY = 0.5
#: A labeler is taken to be better than chance, and never quite sure.
LEAST_RELIABLE, MOST_RELIABLE = 0.6, 0.99


@dataclass(frozen=True)
class Pattern:
    kind: str
    pattern: str
    base: bool = False
    literal: str = ""  # every match contains it: a cheap test before the pattern


_MAIL = "A-Za-z0-9._%+-"
#: Fixed patterns of the base kinds, written without backtracking.
BASE = (
    Pattern("email", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "@"),
    Pattern("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, "."),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++", True),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, "+"),
)
PATTERNS = BASE + (
    Pattern("email", rf"(?<![{_MAIL}])[{_MAIL}]{{1,64}}+\x20?(?:\(at\)|\[at\]|(?<=\x20)at\x20)\x20?[A-Za-z0-9-]{{1,63}}+"
                     r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,6}+", literal="at"),
    Pattern("phone", r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    Pattern("id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", literal="-"),
    Pattern("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    Pattern("name", r"(?<![\p{L}\p{N}])(?!(?:Mrs?|Ms|Dr|Herr|Frau|Monsieur|Madame|Dear)\b)\p{Lu}\p{Ll}{1,15}+\x20\p{Lu}\p{Ll}{1,20}+(?![\p{L}\p{N}])"),
)
KINDS = ("email", "ip", "card", "phone", "id", "iban", "name")
BASE_KINDS = KINDS[:4]

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Fixed gazetteers.
TOP_DOMAINS = "com org net edu gov int info biz io dev app eu us uk de fr es it nl be at ch se no dk fi pl pt ca au nz jp cn in br mx ru"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|6011|64|65|35)"
RESERVED_IPS = r"^0*(?:0|10|127|2[2-5][0-9])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\."
CALLING_CODES = r"^\+?0*(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SK"
FIRST_NAMES = (
    "Adam Alice Anna Anne Antonio Barbara Benjamin Carlos Carmen Charles Christian Claire Daniel David Elena Elizabeth Emily Emma "
    "Eva Francisco Frank Hans Isabel Jack James Jane Jean Jennifer John Jose Joseph Juan Julia Julie Karl Klaus Laura Linda Lisa "
    "Louis Lucia Luis Manuel Maria Marie Martin Mary Michael Nicolas Olivia Oliver Pablo Patricia Paul Peter Pierre Richard Robert "
    "Sarah Sofia Sophie Stefan Susan Thomas Ursula Victor William Wolfgang")
NO_NAMES = (
    "The This That These Those New North South East West United Monday Tuesday Wednesday Thursday Friday Saturday Sunday January "
    "February March April May June July August September October November December Der Die Das Ein Eine El La Los Las Le Les Une")
#: Fixed cue words, for each kind and against any.
CUES = {
    "email": r"e-?mail|contact|kontakt|correo|courriel|write to|reach (?:me|us)",
    "ip": r"\bip\b|address|host|server|login|from|client",
    "card": r"card|visa|mastercard|amex|credit|kreditkarte|tarjeta|carte",
    "phone": r"phone|\btel\b|call|mobile|cell|\bfax\b|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp",
    "id": r"\bssn\b|social security|\btax\b|passport|identity|\bid\b",
    "iban": r"iban|account|konto|cuenta|compte|bank",
    "name": r"my name is|\bi am\b|\bmrs?\.?\b|\bms\.?\b|\bdr\.?\b|signed|sincerely|herrn?\b|frau\b|se[nñ]ora?\b|monsieur|madame|dear|contact",
}
AGAINST = r"version|\bv\.?$|isbn|order|invoice|serial|part no|release|build|sku|article|figure|table|section|example|[#$€£=]\x20?$"
LABELERS = ("form", "edges", "variety", "gazetteer", "cue", "against")


def _let(value, f) -> F.Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _matches(text, at: int, p: Pattern) -> F.Column:
    """The pattern's matches in ``text``: pattern number, place, length of the text before, the span, what stands around it."""
    found = text.rlike(p.pattern)
    if p.literal:
        found = F.contains(text, F.lit(p.literal)) & found
    # the text between matches: one piece more than there are matches
    pieces = F.split(text, p.pattern, -1)
    listed = _let(pieces, lambda gaps: F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(p.pattern), F.lit(0)).alias("hit"), gaps.alias("gap"),
                     F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")),
        lambda m, i: F.struct(F.lit(at).alias("at"), i.alias("i"), F.length(m["gap"]).alias("gap"), m["hit"].alias("hit"),
                              F.right(m["gap"], F.lit(BEFORE)).alias("before"), F.left(m["next"], F.lit(AFTER)).alias("after"))))
    listed = F.filter(listed, lambda m: m["hit"].isNotNull())  # the last piece has no match
    return F.coalesce(F.when(found, listed), F.array().cast(
        "array<struct<at:int,i:int,gap:int,hit:string,before:string,after:string>>"))


def _content(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _digits(text) -> F.Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _check_sum(digits) -> F.Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    short = F.reverse(F.left(digits, F.lit(19)))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), lambda i: F.substring(short, i, F.lit(1)))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _mod_97(iban) -> F.Column:
    """Whether an account number passes its check (letters count from 10)."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    each = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(each, F.lit(0), lambda s, c: F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)) == 1


def _by_kind(cases: dict, otherwise=None) -> F.Column:
    out = F.when(F.lit(False), F.lit(otherwise))
    for kind, value in cases.items():
        out = out.when(F.col("kind") == kind, value)
    return out.otherwise(F.lit(otherwise))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per text (``content``) and candidate: ``kind``, ``start``, ``end``, ``base``, the span and what stands around it."""
    text = F.col(text_col)
    matches = F.concat(*(_matches(text, at, p) for at, p in enumerate(PATTERNS)))
    # the condition stands after the grouping: before it, Spark would search every text twice
    per_text = keep(docs.where(text.isNotNull()).select(_content(text).alias("content"), matches.alias("matches"))
                    .groupBy("content").agg(F.any_value("matches").alias("matches")).where(F.size("matches") > 0))
    one = per_text.select("content", F.explode("matches").alias("m")).select("content", "m.*") \
        .withColumn("size", F.length("hit")).withColumn("digits", _digits(F.col("hit"))) \
        .withColumn("kind", F.element_at(F.array(*(F.lit(p.kind) for p in PATTERNS)), F.col("at") + 1))
    n = F.length("digits")
    holds = _by_kind({"email": F.lit(True), "ip": F.col("hit").rlike(IP), "phone": n.between(9, 15),
                      "card": F.when(n.between(13, 19), _check_sum(F.col("digits"))).otherwise(False)})
    along = Window.partitionBy("content", "at").orderBy("i")
    placed = (one.withColumn("base", (F.col("at") < len(BASE)) & holds).withColumn("n_digits", n)
              .withColumn("digits", F.left("digits", F.lit(19))).withColumn("hit", F.left("hit", F.lit(SHOWN)))
              .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("long"))
              .withColumn("start", F.col("end") - F.col("size"))
              # a run of digits that is no card by its length is none by any other sign
              .where((F.col("kind") != "card") | F.col("n_digits").between(13, 19)))
    by_start = Window.partitionBy("content")
    so_far = F.max(F.when(F.col("base"), F.col("end"))).over(
        by_start.orderBy("start", F.col("end").desc(), "at").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(
        by_start.orderBy(F.col("start").desc(), "end", F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(so_far, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    return placed.withColumn("free", free).where("base or free").select(
        "content", "kind", "start", "end", "base", "hit", "digits", "n_digits", "size", "before", "after")


def _vote(for_, against=None) -> F.Column:
    """1, -1 or 0 (abstains); null conditions do not hold."""
    vote = F.when(for_, 1)
    return (vote if against is None else vote.when(against, -1)).otherwise(0)


def votes(found: DataFrame) -> DataFrame:
    """``found`` with a column per labeler: 1 for, -1 against, 0 abstains."""
    hit, digits, n = F.col("hit"), F.col("digits"), F.col("n_digits")
    before, after = F.lower("before"), F.lower("after")
    words = F.split(hit, " ")
    listed = lambda names, x: F.array_contains(F.array(*(F.lit(w) for w in names.split())), x)
    form = _by_kind({
        "email": F.col("base") | hit.rlike(r"[\[(]at[\])]|\x20dot\x20|[\[(]dot[\])]"), "ip": hit.rlike(IP), "card": F.col("base"),
        "phone": F.col("base") | n.between(10, 11), "id": ~digits.rlike("^(?:000|666|9)|^...00|0000$"),
        "iban": F.when(F.col("kind") == "iban", _mod_97(hit)), "name": hit.rlike(r"^\S{3,} \S{3,}$")})
    touches = before.rlike(r"[\p{L}\p{N}_/\\=&]$") | after.rlike(r"^(?:[\p{L}\p{N}_/\\=&]|\.[0-9])")
    # names at the start of a sentence may be any words
    begins = (F.col("kind") == "name") & ((before == "") | before.rlike(r"[.!?:;\n\"]\s*$"))
    varied = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
                                                 lambda i: F.substring(digits, i, F.lit(1)))))
    flat = (F.col("kind") != "name") & (F.col("kind") != "email") & ((varied <= 2) | digits.rlike("123456789|987654321"))
    known = _by_kind({
        "email": listed(TOP_DOMAINS, F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1))), "card": digits.rlike(CARD_ISSUERS),
        "phone": hit.rlike(CALLING_CODES) & hit.startswith("+"), "iban": listed(IBAN_COUNTRIES, F.left(hit, F.lit(2))),
        "name": listed(FIRST_NAMES, words[0])}, None)
    unknown = _by_kind({
        "email": ~hit.rlike(r"[A-Za-z]{2,}$"), "ip": hit.rlike(RESERVED_IPS), "card": ~digits.rlike(CARD_ISSUERS),
        "iban": ~listed(IBAN_COUNTRIES, F.left(hit, F.lit(2))),
        "name": listed(NO_NAMES, words[0]) | listed(NO_NAMES, words[1]) | ~listed(FIRST_NAMES, words[0])}, None)
    cue = _by_kind({kind: before.rlike(pattern) for kind, pattern in CUES.items()})
    return found.withColumns({
        "form": _vote(form, ~form), "edges": _vote(F.lit(False), touches | begins), "variety": _vote(F.lit(False), flat),
        "gazetteer": _vote(known, unknown), "cue": _vote(cue, (F.col("kind") == "name") & ~cue),
        "against": _vote(F.lit(False), before.rlike(AGAINST))})


def _log_odds(model: dict) -> F.Column:
    """Log-odds of a vote pattern under the estimated reliabilities."""
    def total(share, reliable):
        odds = F.lit(math.log(share / (1 - share)))
        for labeler, (yes, no) in reliable.items():
            odds = odds + F.when(F.col(labeler) == 1, math.log(yes / (1 - no))).when(
                F.col(labeler) == -1, math.log((1 - yes) / no)).otherwise(0.0)
        return odds

    return _by_kind({kind: total(*own) for kind, own in model.items()}, 0.0)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Per kind the share of true spans and each labeler's (votes for where true, votes against where not).

    ``patterns`` has one row per kind and vote pattern with its count ``n``,
    at most 3 to the number of labelers for a kind, whatever the number of
    candidates. All rounds of a kind are one fold over these rows. Ten imagined
    votes per labeler, eight of them right, keep rare labelers near their start.
    """
    doubles = lambda values: F.array(*(F.lit(float(x)) for x in values))
    surest = doubles(0.95 if x == "form" else 0.8 for x in LABELERS)
    start = F.struct(F.lit(0.5).alias("share"), surest.alias("yes"), surest.alias("no"))

    def within(x, low, high):
        return F.least(F.greatest(x, F.lit(low)), F.lit(high))

    def expected(row, model):
        """The row's votes and its counts of true and of other spans."""
        odds = F.aggregate(
            F.arrays_zip(row["v"].alias("v"), model["yes"].alias("yes"), model["no"].alias("no")),
            F.log(model["share"] / (1 - model["share"])), lambda s, x: s + F.when(x["v"] == 1, F.log(x["yes"] / (1 - x["no"]))).when(
                x["v"] == -1, F.log((1 - x["yes"]) / x["no"])).otherwise(0.0))
        return _let(row["n"] / (1 + F.exp(-odds)), lambda true: F.struct(
            row["v"].alias("v"), true.alias("true"), (row["n"] - true).alias("other")))

    def refined(rows):
        def total(weight, at=None, vote=None):
            one = (lambda r: r[weight]) if at is None else lambda r: F.when(r["v"][at] == vote, r[weight]).otherwise(0.0)
            return F.aggregate(rows, F.lit(0.0), lambda s, r: s + one(r))

        def reliable(weight, vote):
            shares = ((total(weight, at, vote) + 8) / (total(weight, at, vote) + total(weight, at, -vote) + 10)
                      for at in range(len(LABELERS)))
            return F.array(*(within(x, LEAST_RELIABLE, MOST_RELIABLE) for x in shares))

        share = (total("true") + 1) / (total("true") + total("other") + 2)
        return F.struct(within(share, 0.01, 0.99).alias("share"), reliable("true", 1).alias("yes"), reliable("other", -1).alias("no"))

    per_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(
        F.struct(F.array(*LABELERS).alias("v"), F.col("n").cast("double").alias("n")))).alias("rows"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda model, _: _let(
        F.transform("rows", lambda row: expected(row, model)), refined))
    return {r["kind"]: (r["m"]["share"], dict(zip(LABELERS, zip(r["m"]["yes"], r["m"]["no"]))))
            for r in per_kind.select("kind", fold.alias("m")).collect()}


def _features() -> list:
    """Features of a candidate, each of few distinct values."""
    return [F.col(x).cast("double") for x in LABELERS] + [(F.col("kind") == k).cast("double") for k in KINDS] + [
        F.least(F.floor(F.log2(F.col("size"))), F.lit(8)).cast("double"), F.least("n_digits", F.lit(20)).cast("double") / 10]


def train(voted: DataFrame) -> list | None:
    """Coefficients and intercept of the span classifier, or None without candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    patterns = keep(voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    if not patterns.limit(1).count():
        return None
    p = 1 / (1 + F.exp(-_log_odds(estimate(patterns))))
    rows = voted.select(F.array(*_features()).alias("f"), F.round(p, 9).alias("p")).groupBy("f", "p").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct combination: few, whatever the number of candidates
    rows = keep(rows.orderBy("f", "p").coalesce(1))
    both = rows.select("f", F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")).union(
        rows.select("f", F.lit(0.0), F.col("n") * (1 - F.col("p"))))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(
        both.where("weight > 0").select(array_to_vector("f").alias("features"), "label", "weight"))
    return [*model.coefficients.toArray().tolist(), model.intercept]


def probability(model: list) -> F.Column:
    """The classifier's probability for a candidate with votes."""
    return 1 / (1 + F.exp(-sum((f * c for f, c in zip(_features(), model)), F.lit(model[-1]))))


def personal_spans(docs: DataFrame, text_col: str = "text", least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """Per text (``content``): every span that stays, with ``kind``, ``start``, ``end``, ``base`` and ``probability``."""
    voted = keep(votes(candidates(docs, text_col)))
    model = train(voted)
    found = voted.withColumn("probability", F.lit(None).cast("double") if model is None else probability(model))
    return found.where(F.col("base") | (F.col("probability") >= least_probability)).select(
        "content", "kind", "start", "end", "base", "probability", "hit")


def personal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, counts of the base kinds, a digest of the base spans and all spans."""
    order = F.create_map(*(F.lit(x) for at, kind in enumerate(KINDS) for x in (kind, at)))
    span = F.struct(order[F.col("kind")].alias("at"), "start", "end", "kind", "base")
    per_text = keep(personal_spans(docs, text_col).groupBy("content").agg(F.array_sort(F.collect_set(span)).alias("found")))
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = F.coalesce(F.col("found"), F.array().cast(per_text.schema["found"].dataType))
    base = F.filter(found, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    texts = docs.select(F.col(id_col), _content(F.col(text_col)).alias("content"))
    return texts.join(per_text, "content", "left").select(
        id_col, *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found).alias("spans"))
