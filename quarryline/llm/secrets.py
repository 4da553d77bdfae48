"""Secrets: key patterns, and a battery of randomness tests over every long token.

Built-in expressions only, one narrow stage, no shuffle. Null text is taken as empty; a text
without findings gets an empty array. Offsets are code points, ends exclusive.

A token's encoding (hexadecimal, base 32 or base 64) is inferred from its characters. Its
symbols then face three tests against uniform randomness: Pearson's chi-squared over the
alphabet, the number of runs above and below the alphabet's middle, and the lag-one serial
correlation. A token that passes all three is set against prose: the chi-squared of prose
of the token's length has mean df + PROSE * n, so its lower tail shrinks with length. The
tokens of a text are kept by the Benjamini-Hochberg rule at rate FDR over these tails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spans
from ._shared import fresh, table

# The contract's patterns, possessive or anchored where that leaves the matches as they are.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BASE = ("assign", "access", "hex")
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Excess of alphabet size times the chance that two symbols of prose agree.
PROSE = {"hex": 0.6, "base32": 1.13, "base64": 3.27}
#: Level at which a test of uniform randomness rejects, and the false discovery rate.
REJECT, FDR = 0.001, 0.05


def normal_cdf(z: Column) -> Column:
    """Logistic approximation of the normal distribution, within 0.00015."""
    return 1.0 / (1.0 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _battery(text: Column) -> Column:
    """struct(p_chi, p_runs, p_serial, p_prose) of one token."""
    body = F.regexp_replace(text, "=+$", "")
    name = F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")

    def encoded(s: Column) -> Column:
        plain = F.when(s["name"] == "hex", F.lower(s["body"])).otherwise(F.translate(s["body"], "-_", "+/"))
        alphabet, prose = F.lit(None).cast("string"), F.lit(None).cast("double")
        for k, v in ALPHABETS.items():
            alphabet, prose = F.when(s["name"] == k, v).otherwise(alphabet), F.when(s["name"] == k, PROSE[k]).otherwise(prose)
        return F.struct(plain.alias("plain"), alphabet.alias("alphabet"), prose.alias("prose"))

    def values(s: Column) -> Column:
        v = F.transform(F.split(s["plain"], "(?!^)"), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
        return F.struct(v.alias("v"), F.length(s["alphabet"]).cast("double").alias("k"), s["prose"].alias("prose"))

    def centred(s: Column) -> Column:
        mean = F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + x) / F.size(s["v"])
        return F.struct(s["v"].alias("v"), s["k"].alias("k"), s["prose"].alias("prose"), mean.alias("mean"))

    def tests(s: Column) -> Column:
        v, k, n, mean = s["v"], s["k"], F.size(s["v"]).cast("double"), s["mean"]
        df = k - 1.0
        counts = F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda x: x == c)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
        high = F.transform(v, lambda x: (x * 2.0 > k).cast("int"))
        n1 = F.aggregate(high, F.lit(0.0), lambda a, b: a + b)
        runs = F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high)), lambda a, b: (a != b).cast("int")), F.lit(1.0), lambda a, b: a + b)
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lag = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, x: a + x)
        return F.struct(n.alias("n"), df.alias("df"), chi.alias("chi"), n1.alias("n1"), runs.alias("runs"), F.when(var > 0, lag / var).otherwise(1.0).alias("r"), s["prose"].alias("prose"))

    def tails(s: Column) -> Column:
        n, df, n1 = s["n"], s["df"], s["n1"]
        n2 = n - n1
        cube = (F.pow(s["chi"] / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        expect = 1.0 + 2.0 * n1 * n2 / n
        spread = (expect - 1.0) * (expect - 2.0) / (n - 1.0)
        z_runs = F.when(spread > 0, F.abs(s["runs"] - expect) / F.sqrt(spread)).otherwise(99.0)
        extra = s["prose"] * n
        z_prose = (s["chi"] - df - extra) / F.sqrt(2.0 * (df + 2.0 * extra))
        return F.struct(
            (1.0 - normal_cdf(cube)).alias("p_chi"),
            (2.0 * (1.0 - normal_cdf(z_runs))).alias("p_runs"),
            (2.0 * (1.0 - normal_cdf(F.abs(s["r"]) * F.sqrt(n)))).alias("p_serial"),
            normal_cdf(z_prose).alias("p_prose"),
        )

    out = F.struct(body.alias("body"), name.alias("name"))
    for then in (encoded, values, centred, tests, tails):
        out = _spans.stage(out, then)
    return out


def _discovered(tokens: Column) -> Column:
    """The tokens that the Benjamini-Hochberg rule keeps; those that fail a randomness test count as p = 1."""
    p = F.transform(
        tokens,
        lambda s: F.when(F.least(s["t"]["p_chi"], s["t"]["p_runs"], s["t"]["p_serial"]) >= REJECT, s["t"]["p_prose"]).otherwise(1.0),
    )

    def cut(ordered: Column) -> Column:
        last = F.array_max(F.zip_with(ordered, F.sequence(F.lit(1), F.size(ordered)), lambda x, i: F.when(x <= i * FDR / F.size(ordered), x)))
        return F.coalesce(last, F.lit(-1.0))

    chosen = _spans.stage(p, lambda own: _spans.stage(_spans.stage(F.array_sort(own), cut), lambda most: F.zip_with(tokens, own, lambda s, x: F.when(x <= most, s["span"]))))
    return F.when(F.size(tokens) == 0, F.array().cast(_spans.SPAN)).otherwise(F.filter(chosen, lambda s: s.isNotNull()))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with column out: array of (kind, start, end, text), by start, then assign, access, hex, random.

    Repeated rows are treated alike; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in df.columns if c != out]
    found_, base_, tested_, all_ = (fresh(own, n) for n in ("_found", "_base", "_tested", "_all"))
    found = df.select(
        *own,
        F.struct(*[_spans.matches(t, p).alias(k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", TOKEN))]).alias(found_),
    )
    long_value = lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6
    base = F.concat(*[_spans.spans(F.col(found_)[k], k, i, long_value if k == "assign" else None) for i, k in enumerate(BASE)])
    tested = F.transform(_spans.spans(F.col(found_)["random"], "random", len(BASE)), lambda s: F.struct(s.alias("span"), _battery(s["text"]).alias("t")))
    return (
        found.select(*own, base.alias(base_), tested.alias(tested_))
        .select(*own, F.array_sort(F.concat(base_, _discovered(F.col(tested_)))).alias(all_))
        .select(
            *own,
            F.transform(all_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias(out),
        )
    )


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every secret of text replaced by mark; overlapping spans are replaced as one. Null stays null."""
    found = find_secrets(df, text, own := fresh(df.columns, "_secrets"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))
    t = F.col(text)

    def cut(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["done"], F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["done"]).alias("done"))

    clean = F.aggregate(own, empty, cut, lambda acc: F.concat(acc["done"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    return found.select(*[F.when(F.size(own) > 0, clean).otherwise(t).alias(text) if c == text else F.col(c) for c in df.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[_spans.count_of(F.col("secrets"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(_spans.digest(base), 256).alias("base_sha256"),
        _spans.digest(F.col("secrets")).alias("spans"),
    )
