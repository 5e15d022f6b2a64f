"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests; DataFrame functions only.

``base`` spans are those of three patterns. For further ones, every run of 20 or more characters of the base64
alphabets is tested against uniform draws from the alphabet of its encoding, the first of ``ENCODINGS`` that it fits;
the last one is the whole set of characters, so that no run goes untested:

* chi-squared uniformity of the symbol counts, with the exact mean and variance for short tokens,
* the number of runs of symbols of the lower and upper half of the alphabet,
* serial correlation of neighbouring symbols.

A test that one repeated symbol, or symbols of one half only, leave undefined has p-value 0. A token is consistent with randomness if the smallest of the three p-values, times three, is at least ``reject``.
Whether it could be text instead is a likelihood ratio: symbols drawn from the letter frequencies of text reach the
ratio e**x with probability e**-x at most, whatever the length. Text may be written in capitals, so the smaller ratio
of two models counts, one with the shares of small letters and capitals swapped. These bounds are the p-values of a false-discovery
control (Benjamini and Hochberg) within bands of length: in each band the lowest threshold is taken at which the
expected number of false tokens is at most ``fdr`` of those found. Their counts come from a histogram over all texts,
bands by ``TOP`` whole values, so nothing else is shuffled.

Positions count code points, ends are exclusive. Null counts as empty. Spans that touch a base span are not added.
Repeated rows and null ids are reported one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import stage

#: Kind, pattern, group that is measured, characters it must have. In the order of equal starts.
BASE = [
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    # A run of the class that is too short matches and fails, one that is long enough matches whole: the same spans.
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
#: Runs that are tested; the look-behind starts them only where they begin. A run may follow "=", as values do.
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Encodings in the order in which they are tried: name, pattern of a whole token, symbols in their order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("decimal", "^[0-9]+$", DIGITS),
    ("BASE36", "^(?=.*[0-9])[0-9A-Z]+$", DIGITS + UPPER),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    # Tokens of the two alphabets that lack small letters, capitals or digits.
    ("any64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("any64url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
]
#: Occurrences of a ... z in 1,000 letters of ordinary text (rounded; the model of text, a parameter).
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
#: Of the characters of text tokens: small letters, capitals (spread like small ones, half evenly), digits, others.
SHARES = (0.85, 0.08, 0.05, 0.02)
#: Lengths at which bands begin, and the largest whole log ratio that is told apart.
BANDS, TOP = (20, 32, 64, 512, 4096), 120


def text_model(capitals: bool = False) -> dict[str, float]:
    """Probability of each symbol in ordinary text, or in text written in capitals."""
    total = sum(LETTERS)
    main, other = (str.upper, str.lower) if capitals else (str.lower, str.upper)
    model = {main(c): SHARES[0] * n / total for c, n in zip(LOWER, LETTERS)}
    model |= {other(c): SHARES[1] * (0.5 * n / total + 0.5 / 26) for c, n in zip(LOWER, LETTERS)}
    model |= {c: SHARES[2] / 10 for c in DIGITS}
    return model | {c: SHARES[3] / 4 for c in "+/_-"}


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,match:string>>"

    def step(seen: Column, pair: Column) -> Column:
        start = F.coalesce(F.try_element_at(seen, F.lit(-1))["end"], F.lit(0)) + F.length(pair["gap"])
        return F.concat(seen, F.array(F.struct(start.alias("start"), (start + F.length(pair["match"])).alias("end"), pair["match"].alias("match"))))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("match"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, F.array().cast(kind), step)).otherwise(F.array().cast(kind))


def _tail(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal value (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / (2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def battery(token: Column) -> Column:
    """STRUCT(encoding, size, log_ratio, p_uniform, p_runs, p_serial) of a token; null if it has other characters."""
    which = None
    for name, pattern, symbols in ENCODINGS:
        row = F.struct(F.lit(name).alias("name"), F.lit(symbols).alias("symbols"))
        which = F.when(token.rlike(pattern), row) if which is None else which.when(token.rlike(pattern), row)
    logs = [F.create_map(*[x for c, p in text_model(capitals).items() for x in (F.lit(c), F.log(F.lit(p)))]) for capitals in (False, True)]

    # What a lambda reads is bound by a transform of its own first: the lambda would compute it again for every symbol.
    def split(found: Column) -> Column:
        return F.struct(found.alias("found"), F.filter(F.split(token, ""), lambda c: c != "").alias("c"))

    def numbers(bound: Column) -> Column:
        name, symbols = bound["found"]["name"], bound["found"]["symbols"]
        return F.struct(
            name.alias("name"), bound["c"].alias("c"), F.transform(bound["c"], lambda c: F.instr(symbols, c) - 1).alias("x"),
            F.length(symbols).cast("double").alias("m"), F.size(bound["c"]).cast("double").alias("n"),
        )

    def halves(parts: Column) -> Column:
        x, m, n = parts["x"], parts["m"], parts["n"]
        high = F.transform(x, lambda v: (v * 2 >= m).cast("int"))
        middle = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        pairs = F.sequence(F.lit(1), n.cast("int") - 1)
        return F.struct(parts.alias("parts"), high.alias("high"), middle.alias("middle"), pairs.alias("pairs"))

    def tests(bound: Column) -> Column:
        parts, high, middle, pairs = bound["parts"], bound["high"], bound["middle"], bound["pairs"]
        x, m, n = parts["x"], parts["m"], parts["n"]
        squares = F.aggregate(F.sequence(F.lit(0), m.cast("int") - 1), F.lit(0.0), lambda s, k: s + F.pow(F.size(F.filter(x, lambda v: v == k)), 2))
        chi = squares * m / n - n
        z_chi = (chi - (m - 1)) / F.sqrt(2.0 * (m - 1) * (n - 1) / n)
        ones = F.aggregate(high, F.lit(0), lambda s, v: s + v).cast("double")
        zeros = n - ones
        runs = F.aggregate(pairs, F.lit(1.0), lambda s, i: s + F.when(F.get(high, i) != F.get(high, i - 1), 1.0).otherwise(0.0))
        both = 2.0 * ones * zeros
        z_runs = F.try_divide(runs - (1.0 + both / n), F.sqrt(both * (both - n) / (n * n * (n - 1))))
        spread = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - middle, 2))
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + (F.get(x, i) - middle) * (F.get(x, i - 1) - middle))
        serial = F.try_divide(serial, spread)
        z_serial = (serial + 1.0 / n) * F.sqrt(n)
        ratio = F.least(*[F.aggregate(parts["c"], F.lit(0.0), lambda s, c: s - F.log(m) - F.element_at(model, c)) for model in logs])
        return F.struct(
            parts["name"].alias("encoding"), m.cast("int").alias("size"), ratio.alias("log_ratio"),
            F.coalesce(F.when(z_chi > 0, _tail(z_chi) / 2).otherwise(1.0), F.lit(0.0)).alias("p_uniform"),
            F.coalesce(_tail(z_runs), F.lit(0.0)).alias("p_runs"), F.coalesce(_tail(z_serial), F.lit(0.0)).alias("p_serial"),
        )

    bound = F.array(which)
    for step in (split, numbers, halves, tests):
        bound = F.transform(bound, step)
    return F.when(which.isNotNull(), F.element_at(bound, 1))


def thresholds(candidates: DataFrame, fdr: float) -> dict[int, int]:
    """The whole log ratio from which tokens count, by band; a band without one is left out. ``candidates``: band, ratio, random."""
    counts = candidates.groupBy("band", "ratio").agg(F.count("*").alias("n"), F.sum(F.col("random").cast("long")).alias("random"))
    # At most len(BANDS) x (TOP + 1) rows.
    steps: dict[int, list[tuple[int, int, int]]] = {}
    for row in counts.collect():
        steps.setdefault(row["band"], []).append((row["ratio"], row["n"], row["random"]))
    found = {}
    for band, rows in steps.items():
        tested, passed = sum(n for _, n, _ in rows), 0
        for ratio, _, random in sorted(rows, reverse=True):
            passed += random
            if passed and ratio > 0 and tested * 2.718281828459045 ** -ratio <= fdr * passed:
                found[band] = ratio
    return found


def _base_spans(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(kind, lambda m: F.length(F.regexp_extract(m["match"], pattern, group)) >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame, *, reject: float = 0.003, fdr: float = 0.01) -> DataFrame:
    """doc_id, base ARRAY<STRUCT<start, end, kind>>, added ARRAY<the same>, each in order; one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", *[matches(text, p).alias(kind) for kind, p, _, _ in BASE], matches(text, TOKEN).alias("token"))
    spans = [_base_spans(order, *rule) for order, rule in enumerate(BASE)]
    base = F.array_sort(F.concat(*spans))
    tested = F.transform("token", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["match"]).alias("b")))
    tested = F.filter(tested, lambda t: t["b"].isNotNull())
    band = lambda n: F.lit(0) + sum((n >= b).cast("int") for b in BANDS)
    tested = F.transform(tested, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), band(t["end"] - t["start"]).alias("band"),
        F.greatest(F.lit(0), F.least(F.lit(TOP), F.floor(t["b"]["log_ratio"]))).cast("int").alias("ratio"),
        (3.0 * F.least(t["b"]["p_uniform"], t["b"]["p_runs"], t["b"]["p_serial"]) >= reject).alias("random"),
    ))
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
    rows = stage(found.select("doc_id", base.alias("base"), tested.alias("tested")).select("doc_id", "base", F.filter("tested", free).alias("tested")), "secret-tokens")
    levels = thresholds(rows.select(F.explode("tested").alias("t")).select("t.*"), fdr)
    counts = lambda t: F.coalesce(F.get(F.array(*[F.lit(levels.get(b)).cast("int") for b in range(len(BANDS) + 1)]), t["band"]) <= t["ratio"], F.lit(False))
    added = F.transform(F.filter("tested", lambda t: t["random"] & counts(t)), lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("order"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return rows.select("doc_id", "base", added.alias("added"))


def report(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [_number_of(kind) for kind, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
