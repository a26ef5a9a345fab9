"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns propose spans: the four base kinds, which always stay, and looser
forms (written-out addresses, national phone numbers, social security numbers,
IPv6 addresses, bank account numbers, and secrets such as access tokens).  Five labelers vote on each proposed
span (personal, not, or no vote): the strict pattern, gazetteers of domain
endings, reserved addresses, issuers and countries, cue words before the span,
counter cues around it, and its form.  Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability and each
pattern's probability (Dawid and Skene, 1979); a logistic model of kind, votes
and surroundings, trained on these probabilities, is the final classifier of
the looser spans.  Only counts by vote pattern, whose number is bounded by the
labelers and not by the data, come to the driver.

A long text is cut into windows of about WINDOW code points, at places that
no pattern spans (after a line's end, or before a space between small letters),
so that the work grows with the text and not with its square; only a run
without such a place is one longer window.  Spark has no function that gives a
match's place, so a window is split at the pattern and the lengths of the parts
and of the matches are added up, in code points.  The patterns use possessive repetition and look back one character
where the plain form would retry from every character of a run: they match the
same spans in linear time without deep recursion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.session import materialize

#: Base kinds in their order: pattern, and a short pattern without which nothing matches.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Looser kinds, found by one pattern with a group for each.
LOOSE = {
    "email_spelled": r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "phone_national": r"(?<![0-9A-Za-z+.)-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])(?![\x20.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "secret": r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]{0,20}[0-9])[0-9A-Za-z+/_-]{20,128}+(?![0-9A-Za-z+/_-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
KINDS = [*BASE, *LOOSE]
#: Gazetteers (fixed values).
TLDS = "com org net edu gov mil int info biz name io ai app dev de fr es it uk us ca au jp cn in br nl se no dk fi pl ch at be ie pt mx ar ru eu example test".split()
IBAN_LANDS = "AD AE AL AT AZ BA BE BG BH BR CH CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS SA SE SI SK SM TN TR".split()
RESERVED_IP = r"^0*(?:0|10|127|255)\.|^0*192\.0*168\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*169\.0*254\."
CUES = {
    "email": r"mail|contact|write|reach|address|schreib|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|login|client",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|mobile|cell|fax|whatsapp|ruf|appel|llama",
    "ssn": r"ssn|social|security",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "secret": r"token|secret|passw|api[_-]?key|access[_-]?key|private[_-]?key|bearer|auth|credential",
}
SECRET_FORMS = r"^(?:AKIA|ASIA|AIza|gh[opsu]_|glpat-|xox[abp]-|[sp]k_(?:live|test)_)"
#: Forms that digests have, too.
DIGEST_FORMS = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
#: What is no secret though it looks like one.
SECRET_COUNTER = r"(?i)(?:sha-?[0-9]*|md5|hash|checksum|digest|commit|revision|etag|uuid|blob|tree|parent|object)\x20?(?:of\x20)?[=:]?\x20?[\x22']?$"
COUNTER = r"(?i)(?:\bv|version|release|build|rev|section|isbn|doi|token|sha|hash|order|serial|part|no\.|[=\x22#$€£/_])\x20?$"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            F.substring(back, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(back, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


#: Code points of a window, and of those before it that its first spans are seen with.
WINDOW, BEFORE = 16384, 40
#: Running sums are made in chunks, so that adding to an array copies a chunk and not the whole.
CHUNK = 512


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: within a lambda, Spark evaluates an expression at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column) -> Column:
    """The sum of all earlier numbers at each place of an array."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    none = F.array().cast("array<int>")

    def short(a: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    chunks = F.transform(F.sequence(F.lit(0), ((F.size(numbers) - 1) / CHUNK).cast("int")), lambda c: F.slice(numbers, (c * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    firsts = short(F.transform(chunks, total), F.lit(0))
    return F.when(F.size(numbers) == 0, none).otherwise(F.flatten(F.zip_with(chunks, firsts, short)))


def windows(text: Column) -> Column:
    """The text's windows in order: array of (text, offset, before)."""
    cut = rf"(?s).{{{WINDOW}}}(?:.*?(?:\n|[a-z](?=\x20[a-z]))|.*\z)|.+\z"
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("offset"), F.lit("").alias("before")))

    def placed(parts: Column) -> Column:
        offsets = _let(F.transform(parts, F.length), _running)
        last = F.slice(F.concat(F.array(F.lit("")), parts), F.lit(1), F.size(parts))
        zipped = F.arrays_zip(parts.alias("text"), offsets.alias("offset"), last.alias("last"))
        return F.transform(zipped, lambda w: F.struct(w["text"].alias("text"), w["offset"].alias("offset"), F.substring(w["last"], -BEFORE, BEFORE).alias("before")))

    return F.when(F.length(text) > WINDOW, _let(F.regexp_extract_all(text, F.lit(cut), 0), placed)).otherwise(whole)


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(both: Column) -> Column:
        lengths = F.transform(both, lambda x: F.length(x["part"]) + F.length(x["value"]))
        span = lambda x, at: F.struct((at + F.length(x["part"])).alias("start"), (at + F.length(x["part"]) + F.length(x["value"])).alias("end"), x["value"].alias("value"))
        return F.zip_with(both, _let(lengths, _running), span)

    def placed(found: Column) -> Column:
        both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("part"), found.alias("value"))
        return F.when(F.size(found) > 0, _let(both, spans)).otherwise(none)

    return F.when(text.rlike(needs), _let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(none)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)


def _loose_kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(LOOSE.items()):
        out = F.when(value.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


#: A window's text is looked into through pieces of so many code points.
PIECE = 512


def _between(pieces: Column, first: Column, length: Column) -> Column:
    """At most PIECE code points of a text that is cut into pieces."""
    j = F.floor(first / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, j), F.lit("")), F.coalesce(F.get(pieces, j + 1), F.lit("")))
    return F.substring(two, first - j * PIECE + 1, length)


def _seen(pieces: Column, shift: Column, s: Column) -> Column:
    """A span with what stands before and after it; its text begins ``shift`` code points into the pieces."""
    start = s["start"] + shift
    first = F.greatest(start - BEFORE, F.lit(0))
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        _between(pieces, first, start - first).alias("before"), _between(pieces, s["end"] + shift, F.lit(2)).alias("after"),
    )


def _votes(s: Column) -> Column:
    """The five votes on a span, and its surroundings: 1 personal, -1 not, 0 none."""
    kind, value, before, after = s["kind"], s["value"], s["before"], s["after"]
    of = lambda *names: kind.isin(*names)
    yes = lambda cond: F.when(cond, 1).otherwise(-1)
    digits = _digits(value)
    strict = F.when(of(*BASE), 1).otherwise(0)
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(of("email", "email_spelled"), yes(ending.isin(*TLDS)))
        .when(of("ip"), yes(~value.rlike(RESERVED_IP)))
        .when(of("card"), yes(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)")))
        .when(of("ssn"), yes(~value.rlike(r"^(?:000|666|9)")))
        .when(of("ipv6"), yes(~value.rlike(r"(?i)^(?:fe80|fc|fd|2001:0?db8|0{1,4}:)")))
        .when(of("iban"), yes(F.substring(value, 1, 2).isin(*IBAN_LANDS)))
        .when(of("phone_national"), yes(~digits.rlike(r"^(?:000|0|1)")))
        .when(of("secret"), F.when(value.rlike(SECRET_FORMS), 1).when(value.rlike(DIGEST_FORMS), -1).otherwise(0))
        .otherwise(0)
    )
    cue = F.lit(0)
    for name, words in CUES.items():
        cue = F.when(kind.startswith(name) & before.rlike(f"(?i)(?:{words})"), 1).otherwise(cue)
    # a secret is hardly told from other long words but by its cue, so that its absence is a vote as well
    cue = F.when(of("secret") & (cue == 0), -1).otherwise(cue)
    other = F.when(of("secret"), before.rlike(SECRET_COUNTER)).otherwise(before.rlike(COUNTER))
    counter = F.when(other | after.rlike(r"^[A-Za-z0-9_=/]"), -1).otherwise(0)
    form = (
        F.when(of("email"), yes(~value.rlike(r"\.\.|^\.|\.@")))
        .when(of("ip"), yes(~value.rlike(r"(?:^|\.)0[0-9]")))
        .when(of("card"), 1)
        .when(of("phone"), F.when(F.length(digits).between(10, 13), 1).otherwise(0))
        .when(of("ssn"), yes(~value.rlike(r"-00-|-0000$")))
        .when(of("secret"), yes(value.rlike(r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})")))
        .when(of("iban"), yes(F.length(F.regexp_replace(value, " ", "")).between(15, 34) & value.rlike(r"[0-9]{4}")))
        .otherwise(0)
    )
    edge = F.when(before.rlike(r"[\s(\[{<,;:\x22']$") | (before == ""), 1).otherwise(0)
    size = F.when(F.length(value) <= 12, 0).when(F.length(value) <= 20, 1).otherwise(2)
    return F.struct(
        kind.alias("kind"),
        *[c.cast("int").alias(f"v{i}") for i, c in enumerate((strict, gazetteer, cue, counter, form))],
        edge.cast("int").alias("edge"),
        size.cast("int").alias("size"),
    )


def proposed(docs: DataFrame, *keep: Column) -> DataFrame:
    """Adds to the columns ``keep`` of each row: base (spans in base order) and
    loose (looser spans that overlap no base span, each with its votes).  A
    null text counts as empty and has no spans, as an empty table has no rows;
    a text of any length is searched whole, window by window."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = lambda name, c: F.inline(F.array(F.struct(c.alias(name))))  # noqa: E731  behind a generator: computed once
    whole = docs.select(*keep, one("__w", windows(text)))
    kept = [F.col(f"`{c}`") for c in whole.columns if c != "__w"]

    valid = lambda k: lambda s: _valid(k, s["value"])
    voted = lambda k: lambda s: s["votes"]["kind"] == k

    def searched(w: Column) -> Column:
        base = F.concat(*[F.filter(_named(k, _matches(w["text"], p, n)), valid(k)) for k, (p, n) in BASE.items()])
        loose = F.transform(
            _matches(w["text"], "|".join(LOOSE.values()), r"[0-9]|[(\[]at[)\]]"),
            lambda s: F.struct(_loose_kind(s["value"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
        ).cast(SPAN)
        pieces = F.regexp_extract_all(F.concat(w["before"], w["text"]), F.lit(rf"(?s).{{1,{PIECE}}}"), 0)
        # most windows have no span, and are not cut up
        pieces = F.when(F.size(base) + F.size(loose) > 0, pieces)
        return F.struct(F.length(w["before"]).alias("shift"), w["offset"].alias("offset"), base.alias("base"), loose.alias("any"), pieces.alias("pieces"))

    def judged(x: Column) -> Column:
        free = F.filter(x["any"], lambda s: s["kind"].isNotNull() & ~F.exists(x["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        place = lambda s: F.struct((s["start"] + x["offset"]).alias("start"), (s["end"] + x["offset"]).alias("end"), _votes(s).alias("votes"))
        voted_on = lambda spans: F.transform(F.transform(spans, lambda s: _seen(x["pieces"], x["shift"], s)), place)
        return F.struct(voted_on(x["base"]).alias("base"), voted_on(free).alias("loose"))

    found = whole.select(*kept, one("__f", F.transform("__w", searched)))
    done = found.select(*kept, one("__j", F.transform("__f", judged)))
    by_kind = lambda spans: F.concat(*[F.filter(spans, voted(k)) for k in BASE])
    return done.select(*kept, by_kind(F.flatten(F.transform("__j", lambda j: j["base"]))).alias("base"), F.flatten(F.transform("__j", lambda j: j["loose"])).alias("loose"))


VOTES = [f"v{i}" for i in range(5)]


@dataclass(frozen=True)
class Model:
    """Weights of the final classifier, and the reliabilities it was trained with."""

    kind: dict[str, float] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    bias: float = 0.0
    hit: dict[str, list[float]] = field(default_factory=dict)
    miss: dict[str, list[float]] = field(default_factory=dict)

    def log_odds(self, votes: Column) -> Column:
        out = F.lit(float(self.bias))
        for k, w in sorted(self.kind.items()):
            out = out + F.when(votes["kind"] == k, float(w)).otherwise(0.0)
        for (name, value), w in sorted(self.weights.items()):
            out = out + F.when(votes[name] == value, float(w)).otherwise(0.0)
        return out


def family(kind: str) -> str:
    """Looser kinds share their labelers' reliabilities with the base kind they vary."""
    return "ip" if kind == "ipv6" else kind.split("_")[0]


def reliabilities(patterns: list[tuple[dict, int]], rounds: int = 30):
    """Expectation-maximisation over vote patterns and their counts: for each
    family of kinds and each labeler the chance that its vote is positive on
    personal and on other spans (hit, miss), and each pattern's probability of
    being personal.  The chances start at 0.8 and 0.2 and are held there by a
    few pseudo-counts."""
    families = sorted({family(k) for k in KINDS})
    hit, miss = {f: [0.8] * 5 for f in families}, {f: [0.2] * 5 for f in families}
    prior = dict.fromkeys(families, 0.5)
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (p, _) in enumerate(patterns):
            f = family(p["kind"])
            odds = math.log(prior[f] / (1 - prior[f]))
            for k, v in enumerate(VOTES):
                if p[v]:
                    a, b = (hit[f][k], miss[f][k]) if p[v] > 0 else (1 - hit[f][k], 1 - miss[f][k])
                    odds += math.log(a / b)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for f in families:
            own = [(p, n, q) for q, (p, n) in zip(post, patterns) if family(p["kind"]) == f]
            total = sum(n for _, n, _ in own)
            prior[f] = min(0.95, max(0.05, (sum(n * q for _, n, q in own) + 5) / (total + 10)))
            for k, v in enumerate(VOTES):
                for to, first, weight in ((hit, 0.8, lambda q: q), (miss, 0.2, lambda q: 1 - q)):
                    up = sum(weight(q) * n for p, n, q in own if p[v] > 0)
                    all_ = sum(weight(q) * n for p, n, q in own if p[v])
                    to[f][k] = min(0.98, max(0.02, (up + 20 * first) / (all_ + 20)))
    return hit, miss, post


def fit(found: DataFrame, rounds: int = 400, rate: float = 1.0) -> Model:
    """Train on what proposed() returned (written, so that it is searched for
    once).  A pattern weighs as the logarithm of its count, so that rare ones
    are learned beside frequent ones.  Without any span, as of an empty table
    or of null and empty texts, the model keeps nothing loose; spans that recur
    in repeated rows count each time."""
    fields = ["kind", *VOTES, "edge", "size"]
    votes = found.select(F.explode(F.transform(F.concat("base", "loose"), lambda s: s["votes"])).alias("v")).select("v.*")
    rows = votes.groupBy(*fields).agg(F.count("*").alias("n")).collect()  # bounded by the number of patterns
    patterns = sorted([({f: r[f] for f in fields}, r["n"]) for r in rows], key=lambda x: str(x))
    if not patterns:
        return Model(bias=-1.0)
    hit, miss, post = reliabilities(patterns)
    kind = {k: 0.0 for k in KINDS}
    weights = {(f, v): 0.0 for f in [*VOTES, "edge", "size"] for v in {p[f] for p, _ in patterns}}
    bias, total = 0.0, sum(math.log1p(n) for _, n in patterns)
    for _ in range(rounds):
        g_bias, g_kind, g_weight = 0.0, dict.fromkeys(kind, 0.0), dict.fromkeys(weights, 0.0)
        for (p, n), q in zip(patterns, post):
            z = bias + kind[p["kind"]] + sum(weights[f, p[f]] for f in [*VOTES, "edge", "size"])
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) * math.log1p(n) / total
            g_bias += g
            g_kind[p["kind"]] += g
            for f in [*VOTES, "edge", "size"]:
                g_weight[f, p[f]] += g
        bias -= rate * g_bias
        for k in kind:
            kind[k] -= rate * (g_kind[k] + 1e-4 * kind[k])
        for k in weights:
            weights[k] -= rate * (g_weight[k] + 1e-4 * weights[k])
    return Model(kind, weights, bias, hit, miss)


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def decide(found: DataFrame, model: Model) -> DataFrame:
    """Replaces base and loose by base and spans: arrays of (kind, start, end),
    base in base order, spans all kept ones by kind as listed, then start.
    Rows without a span have empty arrays; other columns are kept."""
    plain = lambda s: F.struct(s["votes"]["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    added = F.filter("loose", lambda s: model.log_odds(s["votes"]) >= 0)
    base = F.transform("base", plain)
    all_ = F.transform(F.concat(F.col("base"), added), plain)
    by_kind = F.concat(*[F.array_sort(F.filter(all_, is_kind(k))) for k in KINDS])
    return found.withColumn("spans", by_kind).withColumn("base", base).drop("loose")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that
    overlap the first (then the longest) one is replaced.  Done window by
    window, as no span reaches over two; a null text stays null."""

    def one(w: Column) -> Column:
        own = F.filter(spans, lambda s: (s["start"] >= w["offset"]) & (s["start"] < w["offset"] + F.length(w["text"])))
        ordered = F.array_sort(F.transform(own, lambda s: F.struct((s["start"] - w["offset"]).alias("a"), (w["offset"] - s["end"]).alias("b"), s["kind"].alias("kind"))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def put(acc: Column, s: Column) -> Column:
            more = F.array(F.substring(w["text"], acc["at"] + 1, s["a"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(s["a"] < acc["at"], acc).otherwise(F.struct((-s["b"]).alias("at"), F.concat(acc["out"], more).alias("out")))

        rest = lambda d: F.concat(F.array_join(d["out"], ""), F.substring(w["text"], d["at"] + 1, F.length(w["text"])))
        return F.when(F.size(own) == 0, w["text"]).otherwise(F.aggregate(ordered, start, put, rest))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(windows(text), one), ""))


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, with personal
    data in text replaced and n_chars, if there is such a column, brought in
    line.  Null texts stay null; texts without a span stay as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = materialize(proposed(docs, row), "proposed")
    done = decide(found, fit(found)).select("row", redact(F.col("row.text"), F.col("spans")).alias("new"))
    own = {"text": F.col("new"), "n_chars": F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[(own.get(f.name) if own.get(f.name) is not None else F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
