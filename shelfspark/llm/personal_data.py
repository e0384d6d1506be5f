"""Personal data in listing texts by weak supervision: labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import cut_lineage, listing_texts

KINDS = ("email", "ip", "card", "phone", "secret")
# Kinds with a plain pattern; secrets come from the labelers alone.
BASE_KINDS = KINDS[:4]
# Same matches as the plain patterns, written so that each text position is tried once and nothing recurses.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Forms that the plain patterns miss: spelt-out addresses, national numbers.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,64}){1,8}"
NATIONAL_PHONE = r"(?<![0-9+.,])\(?0[0-9]{2}\)?[ -]?[0-9]{2,3}[ -]?[0-9]{2}[ -]?[0-9]{1,3}(?![0-9])"
# Keys and access tokens: one run of letters, digits, underscores and hyphens.
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"

# Gazetteers; fixed values.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "md", "ro", "ru", "ua", "eu", "de", "fr", "es", "it", "uk", "us")
CALLING_CODES = ("1", "7", "33", "34", "39", "40", "44", "48", "49", "90", "373", "380")
MOBILE_PREFIXES = ("06", "07", "02", "05", "08")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "60", "65", "35", "22", "23", "24", "25", "26", "27")
LOCAL_NETS = ("0.", "255.")
SECRET_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk_live_", "sk_test_", "pk_live_", "xoxb-", "xoxp-", "eyJ")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
# Context words before a span, by kind; fixed values.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "scrie", "почта"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "iban", "cont", "карта"),
    "phone": ("tel", "phone", "call", "mobil", "fax", "whatsapp", "viber", "sunati", "тел"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "bearer", "credential", "parola", "пароль"),
}
AGAINST = ("sku", "ean", "isbn", "cod", "code", "model", "order", "version", "ver", "articol", "артикул", "price", "lei", "mdl")
CONTEXT_CHARS = 32
# Labelers: rate of 'yes' on personal data and on other spans that EM starts from, and the spans this guess counts for.
START = {"format": (0.9, 0.9, 5), "check": (0.95, 0.05, 100), "gazetteer": (0.8, 0.5, 5), "context": (0.8, 0.2, 5), "edges": (0.9, 0.7, 5)}
VOTERS = tuple(START)
ROUNDS = 15
_CHUNK = 256


def _running(values: Column) -> Column:
    """Sums of all values before each one, in chunks so that long arrays are not copied once per value."""
    def before(part: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(F.lit(0)), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v))),
                       1, F.size(part))

    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / _CHUNK).cast("int") - 1),
                         lambda i: F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v))
    return F.flatten(F.zip_with(chunks, before(totals), lambda c, base: F.transform(before(c), lambda v: v + base)))


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (start, end, match, before, after) in code points; leftmost, non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.char_length(m) + F.char_length(g))
    parts = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"),
                         F.slice(gaps, 2, F.size(found)).alias("n"), _running(lengths).alias("s"))
    spans = F.transform(parts, lambda p: F.struct(
        (p["s"] + F.char_length(p["g"])).alias("start"), (p["s"] + F.char_length(p["g"]) + F.char_length(p["m"])).alias("end"),
        p["m"].alias("match"), F.right(p["g"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(p["n"], F.lit(1)).alias("after")))
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("match"),
                                    F.lit("").alias("before"), F.lit("").alias("after"))), 1, 0)
    return F.when(possible, F.when(F.size(found) > 0, spans).otherwise(none)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def _starts(text: Column, prefixes) -> Column:
    return text.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def _words(words) -> str:
    return r"(?i)(?<![\p{L}])(?:" + "|".join(words) + r")[\p{L}]{0,3}[^\p{L}]{0,12}$"


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 0 against, null where the labeler abstains."""
    return F.when(yes, 1).when(no, 0)


def candidates(text: Column) -> Column:
    """Array of candidate spans with the labelers' votes; ``base`` marks the plain patterns' own finds."""
    def labelled(kind: str, spans: Column, form: bool, check: Callable, gazetteer: Callable) -> Column:
        def judge(s: Column) -> Column:
            passed = check(s["match"])
            own = F.lit(form) & passed
            # The last letter run before the span may also be glued to it.
            glued = s["before"].rlike(r"[\p{L}0-9_=/]$") | s["after"].rlike(r"^[\p{L}0-9_=/]")
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), own.alias("base"),
                F.lit(int(form)).alias("format"), passed.cast("int").alias("check"),
                gazetteer(s["match"]).cast("int").alias("gazetteer"),
                _vote(s["before"].rlike(_words(CUES[kind])), s["before"].rlike(_words(AGAINST))).alias("context"),
                _vote(~glued, glued).alias("edges"))
        return F.transform(spans, judge)

    at, plus = F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    spelt = F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]"))
    always = F.lit(True)

    def count(lo, hi):
        return lambda m: F.length(_digits(m)).between(lo, hi)

    def domain(m):
        return F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)

    def random(m):
        """Hexadecimal of 32 or more with letters, or mixed case with three digits and no hyphen."""
        hexadecimal = m.rlike("^[0-9a-fA-F]{32,}$") & m.rlike("[a-fA-F]") & m.rlike("[0-9]")
        mixed = ~F.contains(m, F.lit("-")) & m.rlike("[a-z]") & m.rlike("[A-Z]") & (F.length(_digits(m)) >= 3)
        return hexadecimal | mixed | _starts(m, SECRET_PREFIXES)

    return F.concat(
        labelled("email", _matches(text, EMAIL, at), True, lambda m: F.lit(True), domain),
        labelled("email", _matches(text, SPELT_EMAIL, spelt), False, lambda m: F.lit(True), domain),
        labelled("ip", _matches(text, IP, always), True, _octets, lambda m: ~_starts(m, LOCAL_NETS)),
        labelled("card", _matches(text, CARD, always), True, lambda m: _luhn(_digits(m)), lambda m: _starts(m, CARD_PREFIXES)),
        labelled("phone", _matches(text, PHONE, plus), True, count(9, 15),
                 lambda m: _starts(_digits(m), CALLING_CODES)),
        labelled("phone", _matches(text, NATIONAL_PHONE, always), False, count(9, 10),
                 lambda m: _starts(_digits(m), MOBILE_PREFIXES)),
        labelled("secret", _matches(text, SECRET, always), False, random,
                 lambda m: _starts(m, SECRET_PREFIXES) | F.length(m).isin(*DIGEST_LENGTHS)))


def _posterior(model: dict) -> Column:
    """Chance that a span is personal data, from the votes and the model's reliabilities, per kind."""
    out = None
    for kind, (prior, rates) in model.items():
        odds = F.lit(math.log(prior / (1 - prior)))
        for voter, (true, false) in rates.items():
            for vote, (a, b) in ((1, (true, false)), (0, (1 - true, 1 - false))):
                odds = odds + F.when(F.col(voter) == vote, F.lit(math.log(a / b))).otherwise(0.0)
        chance = 1 / (1 + F.exp(-odds))
        out = F.when(F.col("kind") == kind, chance) if out is None else out.when(F.col("kind") == kind, chance)
    return out


def estimate_reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over vote patterns (kind, votes, n): per kind the prior, and per labeler its rates of 'yes'.

    Patterns are at most kinds x 3^labelers rows whatever the corpus; one row per kind reaches
    the driver in a round.  Counts are smoothed by the ``START`` rates, which a kind without any
    span keeps.
    """
    model = {k: (0.7, {v: START[v][:2] for v in VOTERS}) for k in range(len(KINDS))}
    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(p * n).alias("yes"), F.sum(n).alias("all")]
        for v in VOTERS:
            sums += [F.sum(F.when(F.col(v) == 1, p * n).otherwise(0.0)).alias(f"{v}_hit"),
                     F.sum(F.when(F.col(v).isNotNull(), p * n).otherwise(0.0)).alias(f"{v}_yes"),
                     F.sum(F.when(F.col(v) == 1, (1 - p) * n).otherwise(0.0)).alias(f"{v}_miss"),
                     F.sum(F.when(F.col(v).isNotNull(), (1 - p) * n).otherwise(0.0)).alias(f"{v}_no")]
        for r in patterns.withColumn("p", _posterior(model)).groupBy("kind").agg(*sums).collect():
            rates = {v: ((r[f"{v}_hit"] + true * n) / (r[f"{v}_yes"] + n), (r[f"{v}_miss"] + false * n) / (r[f"{v}_no"] + n))
                     for v, (true, false, n) in START.items()}
            model[r.kind] = ((r.yes + 7) / (r["all"] + 10), rates)
    return model


def _features() -> list[Column]:
    votes = [F.coalesce(F.col(v) * 2.0 - 1.0, F.lit(0.0)).alias(f"f_{v}") for v in VOTERS]
    return votes + [(F.col("kind") == k).cast("double").alias(f"f_kind{k}") for k in range(1, len(KINDS))]


def train_classifier(patterns: DataFrame, model: dict) -> Column:
    """Logistic span classifier trained on the EM chances as soft labels; a column over the vote columns."""
    soft = patterns.withColumn("p", _posterior(model)).select("*", *_features())
    soft = soft.withColumn("y", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn(
        "w", F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")) * F.col("n"))
    names = [c for c in soft.columns if c.startswith("f_")]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(soft)
    fitted = LogisticRegression(labelCol="y", weightCol="w", regParam=0.001, maxIter=50).fit(rows)
    odds = F.lit(float(fitted.intercept))
    for feature, weight in zip(_features(), fitted.coefficients):
        odds = odds + feature * F.lit(float(weight))
    return 1 / (1 + F.exp(-odds))


def find_personal_data(observations: DataFrame, key: str = "observation_id", text: str = "description",
                       threshold: float = 0.5) -> DataFrame:
    """Find e-mail addresses, IP addresses, card and phone numbers, and secrets, in every whole text.

    Regex, check-digit, gazetteer, context and edge labelers vote on all candidate spans;
    expectation-maximisation over the counted vote patterns of the corpus estimates how reliable
    they are, and a logistic classifier is trained on the resulting chances.  The plain
    patterns' valid finds always stay; other candidates are added from ``threshold`` on, those
    that fail their check (digit sum, range, length) only after a context word for their kind.

    Result, one row per observation, repeated rows included: ``key`` and ``spans``, an array of
    (kind, start, end, base, chance), by kind (email, ip, card, phone, secret), then start, in code
    points, end exclusive; of two spans of one kind and start the shorter comes first.  A null or
    empty text has no spans; a very long one is searched whole, each position once.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = cut_lineage(listing_texts(observations, key, text).select(F.col(key).alias("id"), candidates(F.col(text)).alias("found")))
    patterns = cut_lineage(rows.select(F.explode("found").alias("s")).select("s.kind", *[f"s.{v}" for v in VOTERS])
                           .groupBy("kind", *VOTERS).agg(F.count("*").cast("double").alias("n")))
    if patterns.isEmpty():
        chance = F.lit(0.0)
    else:
        chance = train_classifier(patterns, estimate_reliabilities(patterns))
    # The table of patterns is tiny; the chance is looked up in it, not computed per span.
    scored = patterns.select("kind", *VOTERS, chance.alias("chance")).collect()
    lookup = {tuple(-1 if x is None else x for x in r[:-1]): r.chance for r in scored}
    table = F.create_map(*[F.lit(x) for k, c in lookup.items() for x in (":".join(map(str, k)), c)]) if lookup else None

    def judged(s: Column) -> Column:
        pattern = F.concat_ws(":", *[F.coalesce(s[v], F.lit(-1)).cast("string") for v in ("kind", *VOTERS)])
        value = F.element_at(table, pattern) if table is not None else F.lit(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
                        F.when((s["check"] == 1) | F.coalesce(s["context"] == 1, F.lit(False)), value).otherwise(0.0).alias("chance"))

    rows = rows.select("id", F.filter(F.transform("found", judged), lambda s: s["base"] | (s["chance"] >= threshold)).alias("found"))
    # What lies in a plain find of its kind, or in a secret, adds nothing.
    secret = KINDS.index("secret")
    over = F.filter("found", lambda s: s["base"] | (s["kind"] == secret))
    inside = lambda s: F.exists(over, lambda o: (o["base"] & (o["kind"] == s["kind"]) | (o["kind"] == secret) & (s["kind"] != secret))
                                & (o["start"] < s["end"]) & (s["start"] < o["end"]))
    spans = F.array_sort(F.filter("found", lambda s: s["base"] | ~inside(s)))
    named = F.transform(spans, lambda s: F.struct(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["base"].alias("base"), s["chance"].alias("chance")))
    return rows.select(F.col("id").alias(key), named.alias("spans"))
