"""Personal data in texts by weak supervision, in DataFrame operations only.

Patterns give candidates: of each base kind every match, valid or not, and wider forms that the base patterns miss. Five
labelers (strict pattern, gazetteer, context, edges, shape) vote 1, -1 or 0 on each. Expectation-maximisation estimates how
reliable the labelers are from the counts of their vote patterns, a table whose size the number of labelers bounds. The
posteriors then train the final span classifier, a logistic regression over votes, kind and length, again from counts.
Valid base matches always stay; the classifier decides about the wider forms.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolex.llm.common import stored

#: Fixed order of kinds.
KINDS = ("email", "ip", "card", "phone")
# Quantifiers are possessive where that changes no match, and a match begins at the begin of its run: no text is searched in
# quadratic time, and none needs a deep stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms that the base patterns miss: a written-out at and dot, numbers without country code.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?<!\+[0-9] )(?<!\+[0-9][0-9] )(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text is looked at closely for a kind only if it holds this.
HINTS = {("email", True): "@", ("phone", True): "+", ("email", False): "(?i)[(\\[]at[)\\]]"}

# Gazetteers: common top-level domains, calling codes, issuers' first digits.
DOMAINS = "com org net edu gov int info biz io dev app de fr es it uk nl be ch at pl se no dk fi pt ie cz ru ua tr br mx ar cl us ca au nz jp cn in kr za"
CALLING = r"^(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|pay|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|dial|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
}
AGAINST = r"(?i)\b(?:version|v|release|isbn|issn|order|invoice|section|chapter|serial|sku|apache|cc by[a-z-]*)\W*$"
LABELERS = ("strict", "gazetteer", "context", "edges", "shape")
LENGTHS = (8, 12, 16, 20, 30)
#: Characters of context before and after a candidate.
BEFORE, AFTER = 40, 2

PART = "kind string, base boolean, i int, gap int, match string, before string, after string"


def _parts(kind: str, base: bool, pattern: str, text: Column) -> tuple[Column, Column]:
    """All matches of a pattern, and their parts: how far each lies behind the match before, and what is around it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    hint = HINTS.get((kind, base))
    if hint:
        some = text.contains(hint) if base else text.rlike(hint)
        matches = F.when(some, matches).otherwise(F.array().cast("array<string>"))
    digits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    worth = {"card": lambda m: digits(m) >= 13, "phone": lambda m: digits(m) >= 8}.get(kind, lambda m: F.lit(True))
    return matches, lambda found: F.when(F.exists(found, worth), _around(kind, base, pattern, text, found))


def _around(kind: str, base: bool, pattern: str, text: Column, found: Column) -> Column:
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("last"), F.left(g, F.lit(AFTER)).alias("first")))
    return F.transform(
        F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(2))).alias("h")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), x["g"]["n"].alias("gap"), x["m"].alias("match"), x["g"]["last"].alias("before"), x["h"]["first"].alias("after")),
    )


def _scan(documents: DataFrame, doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for each document with the parts of all patterns."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    names = [*((k, True) for k in KINDS), *((k, False) for k in WIDE)]
    patterns = {(k, b): (BASE if b else WIDE)[k] for k, b in names}
    built = {n: _parts(*n, patterns[n], F.col("__body")) for n in names}
    carried = [F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)]
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("__body"), *carried)
    rows = rows.select("*", *(built[n][0].alias(f"m{i}") for i, n in enumerate(names)))
    empty = F.array().cast(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in PART.split(', '))}>>")
    parts = [F.coalesce(built[n][1](F.col(f"m{i}")), empty) for i, n in enumerate(names)]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(f"keep_{i}" for i in range(len(keep))), F.concat(*parts).alias("parts"))
    return stored(rows, "personal-data")


def _candidates(scanned: DataFrame) -> DataFrame:
    """Candidates with their places (code points, end exclusive), whether they are valid base matches, and votes."""
    rows = scanned.select("row", F.explode("parts").alias("p")).select("row", "p.*").filter("match IS NOT NULL")
    order = W.partitionBy("row", "kind", "base").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("match")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("match", "[^0-9]", "")
    rows = rows.withColumn("digits", digits).withColumn("n_digits", F.length(digits))
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    # Luhn: from the right, every second digit doubled, nine taken off what passes nine.
    flipped = F.transform(F.split(F.reverse("digits"), ""), lambda x: x.cast("int"))
    doubled = F.transform(flipped, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0
    card = F.when(F.col("n_digits").between(14, 19), luhn).otherwise(False)
    checks = F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", F.col("match").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
    checks = checks.when(F.col("kind") == "card", card).otherwise(F.col("n_digits").between(10, 15))
    rows = rows.withColumn("valid", checks)
    # Of long digit runs only those near a card's length are candidates; the same for numbers after a plus.
    likely = F.when(F.col("kind") == "card", F.col("n_digits").between(13, 19)).when(F.col("kind") == "phone", F.col("n_digits").between(8, 17)).otherwise(True)
    rows = rows.filter(F.col("valid") | likely)
    return rows.select("row", "kind", "base", "start", "end", "valid", F.least(size, F.lit(99)).alias("size"), *(v.cast("int").alias(n) for n, v in _votes().items()))


def _votes() -> dict[str, Column]:
    kind, match = F.col("kind"), F.col("match")
    yes = lambda c: F.when(c, 1).otherwise(-1)

    def by(**columns: Column) -> Column:
        out = F.lit(0)
        for k, c in columns.items():
            out = F.when(kind == k, c).otherwise(out)
        return out

    strict = by(
        email=F.when(F.col("base"), yes(match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"))).otherwise(0),
        ip=yes(F.col("valid")),
        card=yes(F.col("valid")),
        phone=F.when(F.col("base"), yes(F.col("valid"))).otherwise(0),
    )
    gazetteer = by(
        email=yes(F.lower(F.regexp_extract(match, r"([A-Za-z]+)[)\]]?$", 1)).isin(DOMAINS.split())),
        ip=yes(~match.rlike(r"^0*(?:0|127|22[4-9]|2[3-9][0-9])\.")),
        card=yes(F.col("digits").rlike(ISSUERS)),
        phone=F.when(F.col("base"), yes(F.col("digits").rlike(CALLING))).otherwise(yes(F.col("digits").rlike("^[2-9]"))),
    )
    cue = F.lit(False)
    for k, pattern in CUES.items():
        cue = cue | ((kind == k) & F.col("before").rlike(pattern))
    context = F.when(F.col("before").rlike(AGAINST), -1).when(cue, 1).otherwise(0)
    edges = yes(~F.coalesce(F.col("before"), F.lit("")).rlike(r"[\p{L}\p{N}_@#/]$") & ~F.coalesce(F.col("after"), F.lit("")).rlike(r"^[\p{L}\p{N}_@#/]"))
    various = F.size(F.array_distinct(F.split("digits", "")))
    shape = by(
        email=yes(F.length(match).between(6, 60)),
        ip=yes(~match.rlike(r"(?:^|\.)0[0-9]")),
        card=yes((various > 3) & match.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{2,6}){2,4})$")),
        phone=yes((various > 3) & F.col("n_digits").between(10, 13)),
    )
    return dict(zip(LABELERS, (strict, gazetteer, context, edges, shape), strict=True))


class Model:
    """What is learned from the counts of vote patterns; the counts are few however many texts there are."""

    def __init__(self, counts: list[tuple], rounds: int = 40):
        """counts: (kind, base, length class, votes..., n)."""
        self.counts = [(c[0], c[1], c[2], tuple(c[3 : 3 + len(LABELERS)]), c[-1]) for c in counts]
        self.prior = dict.fromkeys(KINDS, 0.5)
        # Chance of each vote of each labeler, for true and false candidates; to begin with, labelers are mostly right.
        self.rates = {(name, truth, vote): (0.6 if (vote > 0) == truth else 0.2) if vote else 0.2 for name, truth, vote in product(LABELERS, (True, False), (-1, 0, 1))}
        for _ in range(rounds):
            self._step()
        self.weights: dict[str, float] = {}
        self._fit()

    def posterior(self, kind: str, votes: tuple) -> float:
        yes, no = math.log(self.prior[kind]), math.log(1 - self.prior[kind])
        for name, vote in zip(LABELERS, votes, strict=True):
            yes += math.log(self.rates[name, True, vote])
            no += math.log(self.rates[name, False, vote])
        return 1 / (1 + math.exp(min(700.0, no - yes)))

    def _step(self) -> None:
        held = [(kind, votes, n, self.posterior(kind, votes)) for kind, _, _, votes, n in self.counts]
        for kind in KINDS:
            own = [(n, p) for k, _, n, p in held if k == kind]
            self.prior[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        for i, name in enumerate(LABELERS):
            for truth in (True, False):
                mass = {v: 0.5 + (1.0 if v and (v > 0) == truth else 0.0) for v in (-1, 0, 1)}
                for _, votes, n, p in held:
                    mass[votes[i]] += n * (p if truth else 1 - p)
                total = sum(mass.values())
                self.rates.update({(name, truth, v): m / total for v, m in mass.items()})

    @staticmethod
    def features(kind: str, base: bool, length: int, votes: tuple) -> list[str]:
        return ["bias", f"kind={kind}", f"base={base}", f"length={length}", *(f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True))]

    def _fit(self, rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> None:
        """Logistic regression on the posteriors, by gradient steps scaled to each weight's history."""
        rows = [(self.features(k, b, s, v), math.log1p(n), self.posterior(k, v)) for k, b, s, v, n in self.counts]
        total = sum(n for _, n, _ in rows) or 1.0
        history: dict[str, float] = {}
        for _ in range(rounds):
            slope: dict[str, float] = {}
            for names, n, target in rows:
                error = n / total * (self.chance(names) - target)
                for name in names:
                    slope[name] = slope.get(name, 0.0) + error
            for name, g in slope.items():
                g += ridge * self.weights.get(name, 0.0)
                history[name] = history.get(name, 1e-8) + g * g
                self.weights[name] = self.weights.get(name, 0.0) - rate * g / math.sqrt(history[name])

    def chance(self, names: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(self.weights.get(n, 0.0) for n in names)))))

    def column(self) -> Column:
        """The classifier as an expression over a candidate's columns."""
        score = F.lit(self.weights.get("bias", 0.0))
        for name, weight in sorted(self.weights.items()):
            column, _, value = name.partition("=")
            if value:
                score = score + F.when(F.col(column).cast("string") == value.lower() if column == "base" else F.col(column).cast("string") == value, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-score))


def _length_class() -> Column:
    out = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        out = F.when(F.col("size") <= LENGTHS[i], i).otherwise(out)
    return out


def find_personal_data(documents: DataFrame, least: float = 0.9, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of e-mail and IP addresses, card and phone numbers in each whole text.

    Returns doc_id, spans (array of start, place of the kind in KINDS, end, kind, base; code points, end exclusive, in order)
    and the columns named in ``keep`` as keep_0 and so on: a row for each row of the input, also for a null or empty text
    (no spans), a null id or rows that share one. Wider forms count from a chance of ``least``, and where no base span is.
    """
    scanned = _scan(documents, doc_id, text, keep)
    found = stored(_candidates(scanned).withColumn("length", _length_class()), "candidates")
    model = Model(found.groupBy("kind", "base", "length", *LABELERS).count().collect())
    spans = found.filter((F.col("base") & F.col("valid")) | (~F.col("base") & (model.column() >= least)))
    spans = spans.withColumn("place", F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int"))
    # A wider form goes where a base span lies: the furthest end so far, and the next begin.
    forward = W.partitionBy("row").orderBy("start", "place", F.desc("base")).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("row").orderBy(F.desc("start"), F.desc("place"), F.asc("base")).rowsBetween(W.unboundedPreceding, 0)
    spans = spans.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(forward)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(back))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    spans = spans.filter(F.col("base") | free)
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind", "base"))).alias("spans"))
    none = F.array().cast(lists.schema["spans"].dataType)
    return scanned.drop("parts").join(lists, "row", "left").withColumn("spans", F.coalesce("spans", none)).drop("row")


def mask_personal_data(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """The documents with the name of its kind in place of each span of personal data, as in ``<EMAIL>``.

    Of spans that overlap, the one that begins first takes the whole stretch. Columns stay as they are, but for ``text`` (and
    ``n_chars``, where there is one) of documents with spans. Every row stays.
    """
    names = documents.columns
    held = {n: F.col(f"keep_{i}") for i, n in enumerate(names)}
    rows = find_personal_data(documents, least, doc_id, text, tuple(names))
    # Fold the spans, which come in order: the text up to a span, then its name; an overlapping one only moves the end.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
    body = held[text]

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(body, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))
        return F.struct(F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    end = F.aggregate("spans", start, step)
    rows = rows.withColumn("folded", F.when(F.size("spans") > 0, end))
    masked = F.concat(F.array_join("folded.out", ""), F.substring(body, (F.col("folded.at") + 1).cast("int"), F.length(body)))
    touched = F.size("spans") > 0
    values = held | {text: F.when(touched, masked).otherwise(body)}
    if "n_chars" in names:
        values["n_chars"] = F.when(touched, F.length(masked).cast("long")).otherwise(held["n_chars"])
    return rows.select(*(values[n].alias(n) for n in names))
