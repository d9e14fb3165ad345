"""Personal data by weak supervision: labelers vote on candidate spans, a model decides.

*Base* spans (email, ip, card, phone) follow fixed patterns and always stay. Further
candidates (secret, account, local_phone) come from looser patterns. On every candidate
labelers vote for, against or not at all: the form of the value (regex), words before it
(gazetteer), the characters around it (context) and the mix of its characters (variety).
Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is; there are at most ``kinds * 3 ** labelers`` patterns at any input size, and all
documents are counted. Its posteriors label the candidates for the final span classifier, a
naive Bayes model over categories of the span, again fitted from counts. A candidate that is
not of the base becomes a span when the classifier gives it at least one half.

Everything that reads text is DataFrame code. Start and end are code points, the end is
exclusive. Null texts are empty and have no spans; a null id stays null; repeated rows give
repeated rows; other columns are not read. Spans of different kinds may overlap. Without any
candidate in the table the model is empty and only base spans are returned.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import documents, let, query
from linkcast.session import stage

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "account", "local_phone")
KINDS = BASE + EXTRA
LABELERS = ("regex", "gazetteer", "context", "variety")

# Possessive forms of the base patterns: the same matches, without a stack of retries on long
# runs. \G admits an address that starts right where the one before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![@A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+().-])(?<!\+[0-9]{1,3} ?)(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Words that announce a value, by kind.
GAZETTEER = {
    "email": "mail|e-mail|email|contact|write|courriel|correo",
    "ip": "ip|host|server|address|adresse|from",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "secret": "token|secret|password|passwd|pwd|api[_-]?key|key|bearer|credential",
    "account": "account|iban|konto|compte|cuenta|card",
    "local_phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
}


def running_sum(values: Column) -> Column:
    """Sums of an array's elements up to and with each, in blocks of about the root of its size."""

    def blocked(v: Column) -> Column:
        def with_width(b: Column) -> Column:
            add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
            blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int"))
            sums = F.transform(blocks, lambda k: add(F.slice(v, k * b + 1, b)))

            def heads(s: Column) -> Column:
                first = F.transform(blocks, lambda k: add(F.slice(s, F.lit(1), k)))
                return let(first, lambda h: F.transform(
                    v,
                    lambda x, i: F.get(h, F.floor(i / b).cast("int"))
                    + add(F.slice(v, F.floor(i / b).cast("int") * b + 1, i % b + 1)),
                ))

            return let(sums, heads)

        return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")), with_width)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, blocked))


def find(text: Column, pattern: str) -> Column:
    """All matches, left to right: array of (start, end, value, before, after).

    The text between matches comes from ``split``; running sums of the lengths give the places.
    ``before`` and ``after`` are what stands between this match and its neighbours, cut to 24
    and 4 characters.
    """

    def placed(pieces: Column) -> Column:
        def with_values(values: Column) -> Column:
            sizes = F.transform(values, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))
            return let(running_sum(sizes), lambda ends: F.transform(
                values,
                lambda v, i: F.struct(
                    (F.get(ends, i) - F.length(v)).alias("start"),
                    F.get(ends, i).alias("end"),
                    v.alias("value"),
                    F.right(F.get(pieces, i), F.lit(24)).alias("before"),
                    F.left(F.get(pieces, i + 1), F.lit(4)).alias("after"),
                ),
            ))

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_values)

    return let(F.split(text, pattern), placed)


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn test."""
    backwards = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    doubled = F.transform(
        backwards,
        lambda d, i: let(d.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def iban(value: Column) -> Column:
    """Whether the check digits of an international account number are right (ISO 7064, mod 97)."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    add = lambda a, c: let(number(c), lambda v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), add) == 1


def _votes(kind: str, m: Column) -> list[Column]:
    """Votes of the labelers in their order: 1 for, -1 against, 0 none."""
    value, before, after = m["value"], m["before"], m["after"]
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(value, "[^A-Za-z0-9]", ""), "")))
    forms = {
        "email": r"^[A-Za-z0-9].*\.[A-Za-z]{2,}$",
        "ip": OCTETS,
        "card": r"^(?:[0-9]{15,16}|(?:[0-9]{4}[ -]){3}[0-9]{4})$",
        "phone": r"^\+[0-9]{1,3}[ (]",
        "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:AKIA|ghp_|sk-|xox).*)$",
        "account": r"^[A-Z]{2}",
        "local_phone": r"^\(",
    }
    strict = value.rlike(forms[kind])
    floor = {"secret": 8, "email": 5}.get(kind, 4)
    against = F.lit(-1 if kind in ("secret", "account") else 0)
    if kind == "account":  # a number whose check digit is wrong, or an international one
        strict = strict & F.when(strict, iban(value)).otherwise(False)
    quoted = before.rlike(r"[=:]\s?[\"']?$") | (before.rlike(r"[\"']$") & after.rlike(r"^[\"']"))
    glued = before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")
    return [
        F.when(strict, 1).otherwise(against),
        F.when(before.rlike(rf"(?i)(?<![a-z])(?:{GAZETTEER[kind]})[\W_]{{0,6}}$"), 1).otherwise(0),
        F.when(quoted, 1).when(glued, -1).otherwise(0),
        F.when(variety >= floor, 1).otherwise(-1),
    ]


CATEGORIES = 5


def _features(m: Column, form: Column) -> Column:
    """Categories of a span for the final classifier, one character each; ``form`` is the vote on the value."""
    value = m["value"]
    share = F.floor(4 * _digits(value) / F.greatest(F.length(value), F.lit(1))).cast("string")
    size = F.least(F.floor(F.length(value) / 8), F.lit(9)).cast("string")
    side = lambda c, at: (
        F.when(c == "", "e").when(c.rlike(at[0] + r"[A-Za-z0-9]" + at[1]), "w")
        .when(c.rlike(at[0] + r"\s" + at[1]), "s").when(c.rlike(at[0] + r"[\"'=:]" + at[1]), "q").otherwise("o")
    )
    return F.concat(share, size, side(m["before"], ("", "$")), side(m["after"], ("^", "")), (form + 1).cast("string"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): per document an array of (kind, start, end, base, votes, features)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    at, digit = F.contains("text", F.lit("@")), F.col("text").rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    look = lambda gate, pattern: F.when(gate, find(F.col("text"), pattern)).otherwise(none)
    found = rows.select(
        "doc_id",
        look(at, EMAIL).alias("email"),
        F.filter(look(digit, IP), lambda m: m["value"].rlike(OCTETS)).alias("ip"),
        look(digit, DIGITS).alias("numbers"),
        F.filter(
            look(F.contains("text", F.lit("+")), PHONE), lambda m: _digits(m["value"]).between(9, 15)
        ).alias("phone"),
        look(digit, SECRET).alias("secret"),
        look(digit, IBAN).alias("iban"),
        look(digit, LOCAL).alias("local_phone"),
    )
    sized = F.filter("numbers", lambda m: _digits(m["value"]).between(12, 19))
    found = found.withColumn("sized", sized).select(
        "*",
        F.filter("sized", lambda m: luhn(m["value"])).alias("card"),
        F.concat(F.filter("sized", lambda m: ~luhn(m["value"])), "iban").alias("account"),
    )

    def judged(k: int, kind: str) -> Column:
        return F.transform(kind, lambda m: let(F.array(*_votes(kind, m)), lambda votes: F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            F.lit(kind in BASE).alias("base"), votes.alias("votes"), _features(m, F.get(votes, 0)).alias("features"),
        )))

    return found.select("doc_id", F.concat(*[judged(k, kind) for k, kind in enumerate(KINDS)]).alias("spans"))


def fit_votes(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple, float]:
    """Probability per (kind, votes) that a candidate is real, by expectation-maximisation.

    Each kind has a share of real candidates, each labeler a distribution over its votes on
    real and on other candidates. Counts are smoothed by one. Starts from the mean vote.
    """
    guess = {(k, v): min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for k, v, _ in patterns}
    for _ in range(rounds if patterns else 0):
        share, of = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: 1.0)
        for k, votes, n in patterns:
            p = guess[k, votes]
            for real, w in ((0, n * (1 - p)), (1, n * p)):
                share[k][real] += w
                for j, v in enumerate(votes):
                    of[j, v, real] += w
        total = {(j, real): sum(of[j, v, real] for v in (-1, 0, 1)) for j in range(len(LABELERS)) for real in (0, 1)}
        for k, votes, _ in patterns:
            odds = math.log(share[k][1] / share[k][0])
            for j, v in enumerate(votes):
                odds += math.log(of[j, v, 1] / total[j, 1]) - math.log(of[j, v, 0] / total[j, 0])
            guess[k, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return guess


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(values.items()))]) if values else F.create_map(
        F.lit(""), F.lit(0.0)
    )


def fit_classifier(spans: DataFrame, posterior: dict[tuple, float]) -> dict[str, float]:
    """Log-odds of naive Bayes by "kind", and by "kind:position:category", from soft labels."""
    key = F.concat_ws(":", F.col("kind").cast("string"), F.concat_ws(",", F.col("votes").cast("array<string>")))
    table = {f"{k}:{','.join(map(str, v))}": p for (k, v), p in posterior.items()}
    # At most kinds * 5 * 10 * 5 * 5 * 3 rows.
    sums = (
        spans.select("kind", "features", F.element_at(_literal_map(table), key).alias("p"))
        .groupBy("kind", "features")
        .agg(F.round(F.sum("p"), 6).alias("real"), F.count("*").alias("n"))
        .collect()
    )
    real, every = defaultdict(float), defaultdict(float)
    for kind, features, r, n in sums:
        for name in [f"{kind}", *(f"{kind}:{i}:{c}" for i, c in enumerate(features))]:
            real[name] += r
            every[name] += n
    odds = {}
    for name in every:
        # Smoothed towards the share of the kind, so that a category without evidence says nothing.
        kind = name.split(":")[0]
        share = (real[kind] + 0.5) / (every[kind] + 1)
        odds[name] = math.log((real[name] + share) / (every[name] - real[name] + 1 - share))
        if name != kind:
            odds[name] -= math.log(share / (1 - share))
    return odds


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): per document an array of (start, kind, end, base, score), in text order."""
    found = stage(candidates(docs, id_col, text_col), "pii-candidates")
    flat = found.select(F.inline("spans"))
    counts = flat.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    posterior = fit_votes(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counts))
    odds = _literal_map(fit_classifier(flat, posterior))

    def score(s: Column) -> Column:
        kind = s["kind"].cast("string")
        weights = [kind, *(
            F.concat(kind, F.lit(f":{i}:"), F.substring(s["features"], i + 1, 1)) for i in range(CATEGORIES)
        )]
        log_odds = sum((F.coalesce(F.element_at(odds, w), F.lit(0.0)) for w in weights), F.lit(0.0))
        return F.round(1 / (1 + F.exp(-log_odds)), 6)

    scored = F.transform(
        "spans",
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                           s["base"].alias("base"), score(s).alias("score")),
    )
    keep = F.filter(scored, lambda s: s["base"] | (s["score"] >= 0.5))
    return found.select("doc_id", F.sort_array(keep).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


@query("op7_pii")
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and places of personal data per document."""
    found = find_pii(documents(spark, sf))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS) if kind in EXTRA], F.size("spans").cast("long").alias("n_spans"),
    )
