"""Secret scan: three fixed patterns, and a randomness test battery.

The battery looks at every maximal run of symbols that could be encoded bytes.
It infers the run's encoding (the smallest alphabet that covers it) and asks
two questions.

* Is it random? Chi-squared uniformity over the alphabet, the Wald-Wolfowitz
  runs test about the middle of the alphabet and the lag-1 serial correlation
  are turned into normal scores; their sum of squares is compared with a
  chi-squared distribution of 3 degrees (one-sided for uniformity).
* Could ordinary writing look as random? Its chi-squared statistic is about
  noncentral, with a noncentrality that grows with the run's length, which
  gives a p-value that accounts for length: short runs cannot reach small ones.
  Digits and hex digits are compared with ordinary numbers (dates, counters,
  ids), which favour few symbols, for ordinary letters tell nothing of them.
  Its runs and serial correlation stray further from those of a random run, so
  the probabilities of coming as near to them are p-values too. The three make
  one p-value, by their weighted product (Good's method, weights 1, 1/8, 1/8).

The false-discovery rate over these p-values is held by Benjamini and
Hochberg's step-up rule in strata of encoding and length, over all documents.
The rule needs ranks only: p-values are binned (rounded up), so each stratum is
a histogram of a fixed number of bins and nothing is sorted globally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table, text_or_empty

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# A maximal run of hex digits is long enough exactly if it matches this; short runs need no list.
HEX_LONG = rf"[0-9a-f]{{{HEX_LEAST},}}"

# Encodings from the smallest alphabet on, as (name, pattern, alphabet).
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("base36_upper", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
LEAST_LENGTH = 20  # below this no run can be told from ordinary writing
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}"
LETTER_CONCENTRATION = 0.065  # sum of squared letter shares in ordinary writing
NUMBER_CONCENTRATION = {"decimal": 0.25, "hex": 0.2, "hex_upper": 0.2}  # the same of digits in ordinary numbers
ALPHA = 0.001  # a run is not random if the battery's p-value is below
FDR = 0.01
BINS_PER_DECADE, MOST_BIN = 20, 600
SIDE = 8  # the p-values of runs and serial correlation weigh 1 / SIDE of that of uniformity
BLOCK = 128  # matches whose positions are added up together
LENGTH_EDGES = (24, 32, 40, 56, 80, 128)
# 3-degree chi-squared quantile at 1 - ALPHA.
BATTERY_LIMIT = 16.266

_SPAN = "struct<s:bigint,k:int,e:bigint,kind:string>"


def _matches(text: Column, pattern: str) -> Column:
    """array of (s, e, m) of the leftmost non-overlapping matches, in code
    points: gaps and matches alternate, so their lengths add up to positions.
    They are added up in blocks, for arrays grow by copying."""
    kind = "array<struct<s:bigint,e:bigint,m:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def blocks(all_steps: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_steps, i * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(cut, lambda part: F.aggregate(part, start, step))

    def moved(acc: Column, block: Column) -> Column:
        shift = lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m"))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(block["out"], shift))).alias("out"))

    def joined(all_steps: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(blocks(all_steps), start, moved)["out"])

    return F.when(text.rlike(pattern), F.transform(F.array(steps), joined)[0]).otherwise(F.array().cast(kind))


def _base(text: Column) -> list[tuple[str, Column]]:
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    return [
        ("assign", F.filter(_matches(text, ASSIGN), lambda x: F.length(value(x["m"])) >= ASSIGN_LEAST)),
        ("access", F.filter(_matches(text, ACCESS), lambda x: F.length(x["m"]) >= ACCESS_LEAST)),
        ("hex", _matches(text, HEX_LONG)),
    ]


def _spans(kinds: list[tuple[str, Column]]) -> Column:
    def of_kind(i: int, kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))).cast(f"array<{_SPAN}>")

    return F.array_sort(F.concat(*[of_kind(i, kind, found) for i, (kind, found) in enumerate(kinds)]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, with the asymptotic tail beyond 6."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) / 2.5066282746310002
    upper = F.when(a <= 6, density * poly).otherwise(density / F.greatest(a, F.lit(1.0)))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def combined(p: Column, q: Column, r: Column, side: float = SIDE) -> Column:
    """One p-value of three: the chance that p * (q * r) ** (1 / side) is as
    small, in closed form, if all are uniform."""
    log = lambda x: F.log(F.greatest(x, F.lit(1e-300)))
    t, k = -log(p) - (log(q) + log(r)) / side, side - 1
    both = F.exp(-side * t) * (1 + side * t)
    rest = side**2 * F.exp(-t) * (1 / k**2 - F.exp(-k * t) * (t / k + 1 / k**2))
    return F.least(F.lit(1.0), both + rest)


def _battery(run: Column, letters: bool = True) -> Column:
    """struct(enc, size, bin, tested_bin, random) of a run; null where no
    alphabet covers it. bin is of the p-value against letters, which may be left
    out, tested_bin of the one that the step-up rule takes."""
    enc = reduce(lambda rest, e: F.when(run.rlike(e[1]), F.lit(e[0])).otherwise(rest), reversed(ENCODINGS), F.lit(None).cast("string"))
    alphabet = reduce(lambda rest, e: F.when(run.rlike(e[1]), F.lit(e[2])).otherwise(rest), reversed(ENCODINGS), F.lit(None).cast("string"))
    first = F.struct(run.alias("t"), enc.alias("enc"), alphabet.alias("alphabet"))

    def index(x: Column) -> Column:
        symbols = F.filter(F.split(x["t"], ""), lambda c: c != "")
        return F.struct(x["enc"].alias("enc"), F.length(x["alphabet"]).cast("double").alias("k"), x["alphabet"].alias("alphabet"), x["t"].alias("t"), F.transform(symbols, lambda c: F.instr(x["alphabet"], c) - 1).alias("v"))

    def stats(x: Column) -> Column:
        k, v = x["k"], x["v"]
        n = F.size(v).cast("double")
        mid = (k - 1) / 2
        times = lambda c: F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit("")))
        squares = F.aggregate(F.array_distinct(F.filter(F.split(x["t"], ""), lambda c: c != "")), F.lit(0.0), lambda acc, c: acc + F.pow(times(c).cast("double"), F.lit(2.0)))
        near = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        runs = F.aggregate(near, F.lit(1.0), lambda acc, y: acc + F.when((y["p"] > mid) != (y["q"] > mid), 1.0).otherwise(0.0))
        lag = F.aggregate(near, F.lit(0.0), lambda acc, y: acc + (y["p"] - mid) * (y["q"] - mid))
        return F.struct(x["enc"].alias("enc"), n.alias("n"), k.alias("k"), (squares * k / n - n).alias("chi2"), ((runs - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("zr"), (lag / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1)).alias("zs"))

    def verdict(x: Column) -> Column:
        df, n = x["k"] - 1, x["n"]
        z_chi = (F.cbrt(x["chi2"] / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        total = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2.0)) + x["zr"] * x["zr"] + x["zs"] * x["zs"]

        within = lambda z: 2 * normal_cdf(F.abs(z)) - 1

        def place(concentration: Column) -> Column:
            far = n * F.greatest(x["k"] * concentration - 1, F.lit(0.0))
            p = normal_cdf((x["chi2"] - (df + far)) / F.sqrt(2 * (df + 2 * far)))
            p = combined(p, within(x["zr"]), within(x["zs"]))
            return F.least(F.lit(MOST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")

        ordinary = reduce(lambda rest, e: F.when(x["enc"] == e[0], e[1]).otherwise(rest), NUMBER_CONCENTRATION.items(), F.lit(LETTER_CONCENTRATION))
        bins = [place(F.lit(LETTER_CONCENTRATION)).alias("bin")] if letters else []
        size = reduce(lambda rest, i: F.when(n < LENGTH_EDGES[i], F.lit(i)).otherwise(rest), reversed(range(len(LENGTH_EDGES))), F.lit(len(LENGTH_EDGES)))
        return F.struct(x["enc"].alias("enc"), size.alias("size"), *bins, place(ordinary).alias("tested_bin"), (total <= BATTERY_LIMIT).alias("random"))

    out = first
    for f in (index, stats, verdict):  # one-element arrays bind each step's values once
        out = F.transform(F.array(out), f)[0]
    return out


def _thresholds(tested: DataFrame, fdr: float) -> DataFrame:
    """(enc, size, least): the bins that Benjamini and Hochberg's rule accepts.
    At most 9 encodings x 7 lengths x 601 bins."""
    counts = tested.groupBy("enc", "size", "bin").agg(F.count(F.lit(1)).alias("c"))
    stratum = Window.partitionBy("enc", "size")
    down = stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("m", F.sum("c").over(stratum)).withColumn("rank", F.sum("c").over(down))
    ok = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= fdr * F.col("rank") / F.col("m")
    return ranked.filter(ok).groupBy("enc", "size").agg(F.min("bin").alias("least"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex,
    base_sha256, spans, n_random.

    spans lists kind:start:end (code points, end exclusive) of the base
    patterns and, with kind random, of the runs that the battery adds; a run
    that overlaps a base span adds none. Null text counts as empty: counts of
    0 and an empty list. Repeated rows each get their row. Runs shorter than
    20 symbols are left to the base patterns. The battery's thresholds come from all
    documents, so its spans depend on the corpus; base spans do not; p-values
    that are equal are accepted together. Texts and runs may be of any length.
    An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = _base(text)
    runs = F.transform(_matches(text, CANDIDATE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _battery(x["m"], letters=False).alias("b")))
    seen = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[c.alias(k) for k, c in base], runs.alias("runs"))
    seen = seen.select("rid", "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k, _ in base], _spans([(k, F.col(k)) for k, _ in base]).alias("base"), F.filter("runs", lambda x: x["b"]["enc"].isNotNull() & x["b"]["random"]).alias("runs"), F.transform("runs", lambda x: x["b"]).alias("tested"))
    seen = Table(seen, "secrets").df
    least = _thresholds(seen.select(F.explode("tested").alias("t")).select("t.enc", "t.size", F.col("t.tested_bin").alias("bin")).filter(F.col("enc").isNotNull()), fdr)
    # a bounded lookup (63 strata), so it may be a map that travels with each task
    table = least.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "enc", "size"), "least"))).alias("t"))
    limits = {k: v for k, v in (table.first()[0] or {}).items()}
    lookup = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.lit(None).cast("map<string,int>")

    def added(x: Column) -> Column:
        key = F.concat_ws(":", x["b"]["enc"], x["b"]["size"].cast("string"))
        clear = ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return F.coalesce((x["b"]["tested_bin"] >= lookup[key]) & clear, F.lit(False))

    extra = F.transform(F.filter("runs", added), lambda x: F.struct(x["s"].alias("s"), F.lit(len(base)).alias("k"), x["e"].alias("e"), F.lit("random").alias("kind"))).cast(f"array<{_SPAN}>")
    return seen.withColumn("extra", extra).select(
        F.col("doc_id").alias(id_col),
        *[f"n_{k}" for k, _ in base],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("bigint").alias("n_random"),
    )
