"""Secret scans with a battery of randomness tests (native).

Base rules are three patterns. Beside them, every run of 20 or more code characters outside the base spans is a
candidate. Its encoding is inferred (hexadecimal, base 32, alphanumeric, base 64), and three tests are made:

* chi-squared: how evenly the characters cover the encoding's alphabet, against what ordinary words would give;
* runs: how often neighbouring characters change their class (lower, upper, digit, other), against ordinary words;
* serial correlation of the character codes, which must be small: it sets aside ladders and repeated patterns.

The first two give a combined p value for "an ordinary word". False discoveries are controlled by Benjamini-Hochberg
over all candidates of the whole table, in strata of length (short tokens are many and weak), on a fixed histogram of
p values, so the threshold costs one small aggregation and no sort.

Nothing is shuffled but that histogram: spans are found and kept within their row.

Edge cases: null text counts as empty: no spans, the digest of the empty string. Repeated rows are scanned each. An
empty table gives an empty table. Input columns with the names of output columns are replaced; the prefix `__se_` is
reserved. Very long texts are scanned whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, quoted, without


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The patterns of the base rules.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
# character by character: the JVM looks a character up in one table then, and goes from range to range otherwise
CODE = f"{UPPER}{LOWER}0123456789+/_=-"
CANDIDATE = f"[{CODE}]{{20,}}"
# whether there is a candidate, by one pass from the text's start: shorter runs and what parts them are never tried again
HAS_RUN = rf"\A(?:[{CODE}]{{0,19}}+[^{CODE}]++)*+[{CODE}]{{20}}"
HEX_RUN = "[0123456789abcdef]{24,}"  # a greedy run is the same with its least length in the pattern
#: What a text must hold for ASSIGN and for ACCESS to match, by plain search.
WORDS, MARK = ("password", "passwd", "secret", "token", "apikey", "api_key"), "AKIA"
KINDS = ("assign", "access", "hex", "random")
OUT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Ordinary words' sum of squared letter shares and chance that neighbours differ in class.
REPEAT, SWITCH = 0.065, 0.12
STRATA, BINS, STEP = (28, 44), 64, 0.25


def found(text: Column, pattern: str, rank: int, kind: str, keep=None, value: int | None = None) -> Column:
    """Leftmost non-overlapping matches as spans in code points, from the matches and the pieces between them."""
    hit, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.transform(gap, F.length).alias("g"), F.transform(hit, F.length).alias("m"), *([F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)), F.length).alias("v")] if value else []))
    names = ["g", "m"] + ["v"] * bool(value)
    sizes = sizes.cast("array<struct<" + ",".join(f"{n}:int" for n in names) + ">>")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(x["m"], F.lit(0))
        good = x["m"].isNotNull() & (keep(x) if keep else F.lit(True))
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(sizes, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic approximation (error under 0.0002), as -log10."""
    x = F.lit(1.5976) * z + F.lit(0.07056) * z * z * z
    # log10(1 + e^x), without overflow
    return (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))) / F.lit(math.log(10))


def evidence(token: Column) -> Column:
    """-log10 of the p value for an ordinary word; null where the serial test sets the token aside."""
    n = F.length(token).cast("double")
    k = F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(token.rlike("^[A-Z2-7]+=*$"), 32.0).when(token.rlike("^[A-Za-z0-9]+$"), 62.0).otherwise(64.0)
    chars = F.split(token, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = k / n * squares - n
    ordinary = n * (k * REPEAT - 1) + (k - 1)
    z_chi = (ordinary - chi) / F.sqrt(2 * (k - 1) * (1 + n * REPEAT))
    classes = F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "U" * 26 + "l" * 26 + "d" * 10 + "o" * 5)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    z_runs = (runs - (1 + (n - 1) * SWITCH)) / F.sqrt((n - 1) * SWITCH * (1 - SWITCH))
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    off = F.transform(codes, lambda x: x - mean)
    square = F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x)
    lag = F.zip_with(F.slice(off, 1, F.size(off) - 1), F.slice(off, 2, F.size(off) - 1), lambda x, y: x * y)
    serial = F.aggregate(lag, F.lit(0.0), lambda a, x: a + x) / square
    p = upper_tail((z_chi + z_runs) / F.lit(math.sqrt(2)))
    return F.when((square > 0) & (F.abs(serial) * F.sqrt(n) < 3), p)


def stratum(n: Column) -> Column:
    return reduce(lambda a, edge: a + (n >= edge).cast("int"), STRATA, F.lit(0))


def blanked(text: Column, base: Column) -> Column:
    """The text with a space for each code point of the base spans (by start), so that places stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), end - begin)).alias("out"))

    done = F.aggregate(base, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, done).otherwise(text)


def candidates(text: Column) -> Column:
    """Spans of a text without its base spans, with their evidence."""
    spans = found(text, CANDIDATE, KINDS.index("random"), "random")
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), evidence(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("p")))


def thresholds(found_in: DataFrame, rate: float) -> list[float]:
    """By stratum of length, the least evidence that Benjamini-Hochberg accepts; from at most 3 * BINS counts."""
    # outer: else a filter on the array goes down and writes its expression out through every stage
    flat = found_in.select(F.explode_outer("__se_found").alias("s")).filter("s is not null")
    counts = flat.groupBy(stratum(F.col("s.end") - F.col("s.start")).alias("k"), F.least(F.lit(BINS - 1), F.floor(F.coalesce("s.p", F.lit(0.0)) / STEP)).cast("int").alias("b")).count().collect()
    out = []
    for k in range(len(STRATA) + 1):
        by = {r["b"]: r["count"] for r in counts if r["k"] == k}
        total, above, least = sum(by.values()), 0, math.inf
        for b in range(BINS - 1, -1, -1):
            above += by.get(b, 0)
            if above and 10 ** -(b * STEP) * total / above <= rate:
                least = b * STEP
        out.append(least)
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = 0.001, detail: bool = False) -> DataFrame:
    """All columns of docs, and those of OUT; with detail also `secret_spans`, an array of (start, rank, kind, end)
    by start. Ends are exclusive, in code points. See the module."""
    keep = without(docs, OUT + ["secret_spans"] * detail)
    t = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(*[quoted(c) for c in keep], t.alias("__se_text"))
    t = F.col("__se_text")
    none = F.array().cast(SPAN)
    # few texts hold a secret's words or a long run, and finding that out is most of the work: plain search where it does,
    # and one pattern for runs, hexadecimal ones among them
    words = F.transform(F.array(F.lower(t)), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in WORDS]))[0]
    rows = rows.withColumn("__se_run", t.rlike(HAS_RUN))
    rows = rows.withColumns({
        "__se_assign": F.when((t.contains(":") | t.contains("=")) & words, found(t, ASSIGN, 0, "assign", lambda x: x["v"] >= 6, 2)).otherwise(none),
        "__se_access": F.when(t.contains(MARK), found(t, ACCESS, 1, "access", lambda x: x["m"] >= 20)).otherwise(none),
        "__se_hex": F.when(F.col("__se_run"), found(t, HEX_RUN, 2, "hex")).otherwise(none),
    })
    rows = rows.withColumn("__se_base", F.array_sort(F.concat("__se_assign", "__se_access", "__se_hex")))
    # what base spans leave of a run is a run of its own
    rows = rows.withColumn("__se_rest", F.when(F.col("__se_run"), blanked(t, F.col("__se_base"))))
    rows = rows.withColumn("__se_found", candidates(F.col("__se_rest")))
    # texts without a run have no candidate, so the threshold's pass looks for runs alone in them
    least = thresholds(rows.filter("__se_run"), rate)

    def passes(s: Column) -> Column:
        return s["p"] >= F.element_at(F.array(*[F.lit(float(x)) for x in least]), stratum(s["end"] - s["start"]) + 1)

    more = F.transform(F.filter(F.coalesce("__se_found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,p:double>>")), passes), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.withColumn("secret_spans" if detail else "__se_all", F.array_sort(F.concat("__se_base", more)))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        *[quoted(c) for c in keep], *[F.size(f"__se_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(shown("__se_base").cast("binary"), 256).alias("base_sha256"), shown("secret_spans" if detail else "__se_all").alias("spans"), *["secret_spans"] * detail,
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rate: float = 0.001) -> DataFrame:
    """The columns of docs, with every span of `scan` in the text replaced by the mask (overlapping spans by one)."""
    spans = scan(docs, text, rate, detail=True)
    t = quoted(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("secret_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    fixed = F.when(F.size("secret_spans") > 0, done).otherwise(t)
    return spans.withColumn("__se_new", fixed).select(*[F.col("__se_new").alias(c) if c == text else quoted(c) for c in docs.columns])
