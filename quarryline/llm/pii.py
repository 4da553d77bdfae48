"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Built-in expressions only, one narrow stage, no shuffle. Null text is taken as empty; a text
without findings gets an empty array. Offsets are code points, ends exclusive. Further
columns of the input stay unless their names are those this operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spans
from ._shared import fresh, table

# Fixed values. Possessive forms of the contract's patterns: the same leftmost matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
BASE = ("email", "ip", "card", "phone")
#: Score without context, and the words that raise it.
SCORES = {
    "email": (0.8, "mail|contact|write|reach"),
    "ip": (0.5, "ip|host|address|server|client"),
    "card": (0.8, "card|visa|master|credit|debit|pay"),
    "phone": (0.6, "phone|call|tel|mobile|fax|reach"),
    "iban": (0.9, "iban|bank|account|transfer"),
    "ssn": (0.3, "ssn|social|security|tax"),
}
#: Words that lower it.
AGAINST = "version|example|order|invoice|isbn"
RAISE, LOWER, LEAST = 0.3, 0.2, 0.5


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn checksum."""
    d = F.reverse(digits(x))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.substring(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return (F.length(d) > 0) & (total % 10 == 0)


def mod97(x: Column) -> Column:
    """Whether an account number has remainder 1 by 97 after its first four characters go to the end."""
    own = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(own, F.lit(5), F.length(own)), F.left(own, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with column out: array of (kind, start, end, text, score), by start, then kind as listed.

    Base kinds stay whatever their score; the kinds added here need LEAST. Repeated rows are
    treated alike; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in df.columns if c != out]
    found_, scored_ = fresh(own, "_found"), fresh(own, "_scored")
    numbers = t.rlike("[0-9]")
    found = df.select(
        *own,
        F.struct(
            _spans.matches(t, EMAIL, F.contains(t, F.lit("@"))).alias("email"),
            _spans.matches(t, IP, numbers).alias("ip"),
            _spans.matches(t, CARD, numbers).alias("card"),
            _spans.matches(t, PHONE, F.contains(t, F.lit("+"))).alias("phone"),
            _spans.matches(t, IBAN, numbers).alias("iban"),
            _spans.matches(t, SSN, numbers & F.contains(t, F.lit("-"))).alias("ssn"),
        ).alias(found_),
    )
    keep = {
        "ip": lambda x: x.rlike(OCTETS),
        "card": luhn,
        "phone": lambda x: F.length(digits(x)).between(10, 15),
        "iban": mod97,
    }
    every = F.concat(*[_spans.spans(F.col(found_)[k], k, i, keep.get(k)) for i, k in enumerate(SCORES)])

    def score(s: Column) -> Column:
        near = F.lower(F.concat_ws(" ", s["before"], s["after"]))
        of = F.lit(0.0)
        for k, (base, words) in SCORES.items():
            of = F.when(s["kind"] == k, F.lit(base) + F.when(near.rlike(rf"\b(?:{words})"), RAISE).otherwise(0.0)).otherwise(of)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), of - F.when(near.rlike(rf"\b(?:{AGAINST})\b"), LOWER).otherwise(0.0))), 6)

    scored = F.transform(
        F.array_sort(every),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score(s).alias("score")),
    )
    kept = F.filter(F.col(scored_), lambda s: s["kind"].isin(*BASE) | (s["score"] >= LEAST))
    return found.select(*own, scored.alias(scored_)).select(*own, kept.alias(out))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[_spans.count_of(F.col("pii"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(_spans.digest(base), 256).alias("base_sha256"),
        _spans.digest(F.col("pii")).alias("spans"),
    )
