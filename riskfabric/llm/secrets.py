"""Secret scans: patterns, and a randomness test battery for tokens that no pattern knows.

Patterns give the base spans. A further candidate is a run of 20 or more characters of the usual encodings with a digit and a
letter; its encoding is the smallest alphabet that holds it. Three tests look at its symbols: chi-squared for a
uniform alphabet, a runs test around the middle of the alphabet, and lag-1 serial correlation. A candidate that fails one
as random data hardly ever would is ordinary text. For the others the chi-squared statistic is compared with what words
of the same length would give (non-central, with the excess of natural letter frequencies), which is the p-value of
"this is text". Short tokens have little evidence either way, so the p-values are held against a false-discovery
bound within classes of length (Benjamini-Hochberg on a grid), over the distinct tokens of all texts.

Spans are found within a row. What crosses rows is the histogram of p-values, classes x bins, and the one threshold
per class that it yields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.common import let

#: Kind, pattern, group whose length counts, least length; in the order of ties.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 or more: a run is matched to its end either way
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RANDOM = "random"
#: Encoding, pattern of its tokens, alphabet, and by how much the squared letter frequencies of text exceed a uniform one.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 1.0),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", 1.0),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.4),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.4),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.1),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.2),
]
#: Random data fails a test at this many standard deviations once in some thousand tokens.
FAIL_Z = 3.3
FALSE_DISCOVERY = 0.01
BINS_PER_DECADE = 10
BINS = 120
BLOCK = 256


def _before(steps: Column) -> Column:
    """Sum of the steps before each one; in blocks, so that long arrays cost little more than their length."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    run = lambda values: F.aggregate(values, zero, step, lambda acc: acc["out"])
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)

    def blocked(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda parts: F.flatten(F.zip_with(
            parts, run(F.transform(parts, total)), lambda part, at: F.transform(run(part), lambda v: v + at))))

    return let(steps, lambda s: F.when(F.size(s) <= BLOCK, run(s)).otherwise(blocked(s)))


def matches_of(text: Column, pattern: str) -> Column:
    """(`start`, `end`, `token`) of the leftmost non-overlapping matches, in code points."""
    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g).cast("long"))
        return let(gaps, lambda g: F.zip_with(
            found, F.zip_with(_before(F.zip_with(g, found, lambda a, m: a + F.length(m))), g, lambda at, a: at + a),
            lambda m, start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("token"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")))


def base_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """(`start`, `rank`, `end`, `kind`) of the matches that are long enough."""
    rank = [b[0] for b in BASE].index(kind)
    found = matches_of(text, pattern)
    if group:
        lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        found = let(found, lambda f: F.when(F.size(f) > 0, F.filter(F.zip_with(f, lengths, lambda m, n: F.when(n >= least, m)), lambda m: m.isNotNull())).otherwise(f))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def candidates_of(text: Column) -> Column:
    """Runs of the usual encodings with a digit and a letter."""
    return F.filter(matches_of(text, CANDIDATE), lambda m: m["token"].rlike("[0-9]") & m["token"].rlike("[A-Za-z]"))


def _case(symbols: Column, of) -> Column:
    out = F.lit(None).cast("double")
    for _, pattern, alphabet, excess in reversed(ENCODINGS):
        out = F.when(symbols.rlike(pattern), of(alphabet, excess)).otherwise(out)
    return out


def text_p_value(token: Column) -> Column:
    """Chance that words of the token's length look as uniform; 1 if a test says that it isn't random, or no encoding fits."""
    def tested(symbols: Column) -> Column:
        n = F.length(symbols).cast("double")

        def of(alphabet: str, excess: float) -> Column:
            k = float(len(alphabet))
            places = F.transform(F.split(symbols, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
            counts = F.transform(F.split(F.lit(alphabet), ""), lambda c: n - F.length(F.replace(symbols, c, F.lit(""))))
            squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)

            def battery(v: Column) -> Column:
                chi = squares * k / n - n
                mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
                pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
                high = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x > k / 2).cast("double"))
                runs = F.aggregate(pairs, F.lit(1.0), lambda s, p: s + ((p["a"] > k / 2) != (p["b"] > k / 2)).cast("double"))
                twice = 2 * high * (n - high)
                z_runs = F.when(twice > n, (runs - 1 - twice / n) / F.sqrt(twice * (twice - n) / (n * n * (n - 1)))).otherwise(F.lit(9.9))
                spread = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
                lag = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
                z_serial = F.when(spread > 0, (lag / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.9))
                z_uniform = (chi - (k - 1)) / (2 * (k - 1)) ** 0.5
                z_text = (chi - (k - 1) - n * excess) / F.sqrt(2 * (k - 1 + 2 * n * excess))
                # Logistic form of the normal distribution function, good to 0.00014.
                p = 1 / (1 + F.exp(-(1.5976 * z_text + 0.070566 * z_text * z_text * z_text)))
                return F.when((F.abs(z_runs) > FAIL_Z) | (F.abs(z_serial) > FAIL_Z) | (z_uniform > FAIL_Z), F.lit(1.0)).otherwise(p)

            return let(places, battery)

        return F.coalesce(_case(symbols, of), F.lit(1.0))

    return let(F.regexp_replace(token, "=+$", ""), tested)


def p_bin(p: Column) -> Column:
    """Bin k holds p in (10^(-(k+1)/10), 10^(-k/10)]; the last one holds the rest."""
    return F.least(F.floor(-BINS_PER_DECADE * F.log10(F.greatest(p, F.lit(1e-300))) + 1e-9).cast("int"), F.lit(BINS))


def length_class(token: Column) -> Column:
    """0 for 20 to 24 characters, then two classes for each doubling."""
    return F.floor(2 * F.log2(F.length(token) / 20.0) + 1e-9).cast("int")


def thresholds(texts: DataFrame, text_col: str, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """By length class the least bin whose tokens are secrets, from the distinct candidate tokens of all texts."""
    tokens = texts.select(F.explode(F.transform(candidates_of(F.coalesce(F.col(text_col), F.lit(""))), lambda m: m["token"])).alias("_token")).distinct()
    counts = tokens.select(length_class(F.col("_token")).alias("_class"), p_bin(text_p_value(F.col("_token"))).alias("_bin")).groupBy("_class", "_bin").count()
    by_class: dict[int, dict[int, int]] = {}
    for r in counts.collect():  # classes x bins rows at most: a class for each half doubling of the length
        by_class.setdefault(r["_class"], {})[r["_bin"]] = r["count"]
    least = {}
    for size, bins in by_class.items():
        total = sum(bins.values())
        for b in range(1, BINS + 1):
            if 10 ** (-b / BINS_PER_DECADE) <= rate * sum(n for at, n in bins.items() if at >= b) / total:
                least[size] = b
                break
    return least


def with_secrets(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY, into: str = "_spans") -> DataFrame:
    """docs with one more column: the sorted spans (`start`, `rank`, `end`, `kind`) of the text, code points, end exclusive.

    Base spans stay; spans of the test battery (kind `random`) are added where they overlap no base span. Null texts count as
    empty. The rate is the share of false discoveries to be expected among the added tokens of each length class.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = thresholds(docs, text_col, rate)
    base = F.concat(*[base_spans(text, *b) for b in BASE])
    if not least:
        return docs.withColumn(into, F.array_sort(base))
    def class_bound(token: Column) -> Column:
        out = F.lit(BINS + 1)
        for size, b in sorted(least.items()):
            out = F.when(length_class(token) == size, F.lit(b)).otherwise(out)
        return out

    random = F.filter(candidates_of(text), lambda m: p_bin(text_p_value(m["token"])) >= class_bound(m["token"]))

    def merged(known: Column) -> Column:
        apart = F.filter(random, lambda m: ~F.exists(known, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.array_sort(F.concat(known, F.transform(apart, lambda m: F.struct(
            m["start"].alias("start"), F.lit(len(BASE)).alias("rank"), m["end"].alias("end"), F.lit(RANDOM).alias("kind")))))

    return docs.withColumn(into, let(base, merged))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are replaced once."""
    state = "struct<at:bigint,parts:array<string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["parts"]).otherwise(
            F.concat(acc["parts"], F.array(before, F.lit(mark)))).alias("parts")).cast(state)

    joined = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
