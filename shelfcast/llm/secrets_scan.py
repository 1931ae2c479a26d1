"""Secret scans: known formats, and a battery of randomness tests on other long strings.

Every long run of encoding characters is a candidate.  Its encoding is inferred (the smallest known
alphabet that holds it), and three tests ask whether its characters could be drawn at random from
that alphabet: chi-squared uniformity, runs above and below the middle of the alphabet, and serial
correlation.  Fisher's sum joins them to one p-value.  Among candidates of like length, the step-up
procedure rejects randomness with a bounded false-discovery rate; strings that keep it are secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.llm import spans
from shelfcast.llm.spans import listed, located, normal_tail

KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]
PATTERNS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]+",
               lambda t: t.rlike("[:=]")),
    # shorter matches are dropped and hold no longer one, so only long ones are taken
    "access": (r"AKIA[A-Z0-9]{14,}+", lambda t: t.contains("AKIA")),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}+", None),
    "random": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", None),
}
# fixed values: the alphabets of common encodings, smallest first
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
    # runs that hold characters of both, such as a base64 key behind a prefix with a hyphen
    "joint": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
P_BINS = 400        # p-values are ranked in bins of a tenth of a power of ten


def passed() -> Column:
    """Whether a located match of a base kind counts; ``random`` is judged by the tests."""
    value = F.regexp_extract("match", r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)
    return F.when(F.col("kind") == "assign", F.length(value) >= 12).otherwise(
        F.col("kind").isin("access", "hex"))


def battery(found: DataFrame) -> DataFrame:
    """Adds encoding, size of its alphabet and the joint p-value of randomness."""
    plain = F.regexp_replace("match", "=+$", "")
    alphabet = F.lit(None).cast("string")
    encoding = F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS.items()):
        fits = F.length(F.translate(plain, letters, "")) == 0
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
    df = found.withColumn("plain", plain).withColumn("alphabet", alphabet).withColumn(
        "encoding", encoding).filter("alphabet is not null")
    n, k = F.length("plain").cast("double"), F.length("alphabet").cast("double")
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda acc, c: acc + F.pow(
        F.length("plain") - F.length(F.replace(F.col("plain"), c)), F.lit(2.0)))
    values = F.transform(F.split("plain", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    df = df.withColumn("n", n).withColumn("k", k).withColumn("squares", squares).withColumn(
        "v", values)
    mid, var = (F.col("k") + 1) / 2, (F.col("k") * F.col("k") - 1) / 12
    m = F.col("n") - 1
    pairs = F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"),
                         F.slice("v", 2, F.size("v") - 1).alias("b"))
    turns = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (
        (p["a"] > mid) != (p["b"] > mid)).cast("double"))
    serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mid) * (p["b"] - mid))
    chi = F.col("squares") * F.col("k") / F.col("n") - F.col("n")
    dof = F.col("k") - 1
    # the exact variance of the statistic for n characters, so that short strings are judged
    # fairly; only too uneven a string speaks against randomness
    z_chi = (chi - dof) / F.sqrt(2 * dof * (1 - 1 / F.col("n")))
    z_chi = F.greatest(F.lit(0.0), z_chi)
    z_runs = (turns - m / 2) / F.sqrt(m / 4)
    z_serial = serial / var / F.sqrt(m)
    fisher = F.lit(0.0)
    for z in (z_chi, z_runs, z_serial):
        fisher = fisher - 2 * F.ln(F.greatest(normal_tail(z), F.lit(1e-30)))
    half = fisher / 2                          # chi-squared with six degrees has a closed tail
    p = F.exp(-half) * (1 + half + half * half / 2)
    return df.withColumn("p", F.greatest(p, F.lit(1e-39)))


def non_random(tested: DataFrame, rate: float) -> DataFrame:
    """(band, p_cut): per length band the largest p-value at which the step-up procedure still
    rejects randomness.  Ranks come from counts per bin, so no band is gathered in one task."""
    bins = tested.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("c"))
    rank = F.sum("c").over(Window.partitionBy("band").orderBy("bin"))
    total = F.sum("c").over(Window.partitionBy("band"))
    edge = F.pow(F.lit(10.0), (F.col("bin") + 1) / 10)
    return bins.withColumn("ok", edge <= rate * rank / total).filter("ok").groupBy("band").agg(
        F.max("bin").alias("bin_cut"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         rate: float = 0.05, least_length: int = 20) -> DataFrame:
    """(row, doc_id, base, spans): one row per input row with its base spans and all spans, arrays
    of (start, rank, end, kind) in order of start and kind.

    ``random`` spans are candidates of at least ``least_length`` characters with both a letter and a
    digit, whose randomness isn't rejected in their length band and that overlap no base span.
    Null and empty texts have no spans; null ids and repeated rows are kept, each judged for
    itself; ties in p fall in one bin and share its verdict; an empty table gives an empty result.
    """
    found = spans.find(docs, PATTERNS, id_column, text_column)
    every = located(found)
    entry = F.struct("start", F.array_position(
        F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("rank"), "end", "kind")
    base = every.filter(passed()).groupBy("row").agg(
        F.sort_array(F.collect_list(entry)).alias("base"))
    mixed = (F.col("kind") == "random") & F.col("match").rlike("[0-9]") & F.col("match").rlike(
        "[A-Za-z]") & (F.length("match") >= least_length)
    tested = battery(every.filter(mixed)).withColumn(
        "band", F.least(F.floor(F.log2("n") * 2), F.lit(40)).cast("int")).withColumn(
        "bin", F.greatest(F.floor(F.log10("p") * 10), F.lit(-P_BINS)).cast("int"))
    cuts = non_random(tested, rate)
    chosen = tested.join(cuts, "band", "left").filter(
        F.col("bin_cut").isNull() | (F.col("bin") > F.col("bin_cut")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    more = chosen.groupBy("row").agg(F.collect_list(entry).alias("more"))
    joined = found.select("row", "doc_id").join(base, "row", "left").join(more, "row", "left")
    joined = joined.select("row", "doc_id", F.coalesce("base", empty).alias("base"),
                           F.coalesce("more", empty).alias("more"))
    alone = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (
        s["start"] < b["end"])))
    return joined.select("row", "doc_id", "base",
                         F.sort_array(F.concat("base", alone)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in BASE],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
