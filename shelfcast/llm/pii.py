"""Personal data: generators propose spans, boosted trees choose among the uncertain ones.

The generators are patterns with high recall.  Spans that pass their format check (the base kinds)
always stay.  The others are scored by boosted trees on format and context features.  The trees are
fitted on all candidates of the table: a candidate's features fall into few bins, so a count per
combination of bins holds all that the fit needs, and its size is bounded by the bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.llm import spans
from shelfcast.llm.spans import listed, located

LOCAL = r"[A-Za-z0-9._%+-]"
LABEL = r"[A-Za-z0-9-]"
SEP = r"[\x20-]"
KINDS = ["email", "ip", "card", "phone", "handle", "number"]
BASE = KINDS[:4]
# A match starts where the run of its first class starts, or where the last match ended; saying so
# keeps the search linear in long runs.
PATTERNS: dict[str, tuple[str, object]] = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)+",
              lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.contains(".")),
    # runs of other than 13 to 19 digits would be dropped, so only these are taken
    "card": (rf"(?<![0-9])(?<![0-9]{SEP})[0-9](?:{SEP}?[0-9]){{12,18}}(?!{SEP}?[0-9])", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
    "handle": (rf"(?<!{LOCAL}){LOCAL}{{2,64}}+\x20?[\[({{]\x20?(?i:at)\x20?[\])}}]\x20?{LABEL}{{1,63}}+"
               rf"(?:(?:\x20?[\[({{]\x20?(?i:dot)\x20?[\])}}]\x20?|\.){LABEL}{{1,63}}+){{1,6}}",
               lambda t: t.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]")),
    "number": (r"(?<![0-9A-Za-z.+])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])", None),
}
CUES = (r"(?i)(phone|tel|call|mobile|cell|fax|card|visa|iban|account|acct|ssn|social|passport|"
        r"contact|mail|ip|addr|number|nr)[^0-9A-Za-z]{0,4}\z")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def term(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i))
    return total % 10 == 0


def base_check() -> Column:
    """Whether a located match of a base kind passes its format check."""
    number = digits(F.col("match"))
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.forall(
            F.split("match", r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(F.col("kind") == "card", F.length(number).between(13, 19) & passes_luhn(number))
        .when(F.col("kind") == "phone", F.length(number).between(9, 15))
        .otherwise(False))


def features(found: DataFrame) -> DataFrame:
    """Binned features of candidates: kind, digits, separators, groups, context."""
    number = digits(F.col("match"))
    n = F.length(number)
    seps = F.length("match") - n
    return found.select(
        "*",
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("f_kind"),
        F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 16, 3).otherwise(4).alias("f_digits"),
        F.when(seps == 0, 0).when(seps <= 2, 1).when(seps <= 5, 2).otherwise(3).alias("f_seps"),
        F.col("match").rlike(r"[().]").cast("int").alias("f_marks"),
        F.col("match").rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^(?:[0-9]{4}[ -]){3}[0-9]{4}$").cast(
            "int").alias("f_grouped"),
        F.col("left").rlike(CUES).cast("int").alias("f_cue"),
        F.col("left").rlike(r"[=:]\s{0,2}\z").cast("int").alias("f_assigned"),
        (F.col("left").rlike(r"(?:^|[\s(\[])\z") & F.col("right").rlike(r"^(?:$|[\s.,;:)\]])")).cast(
            "int").alias("f_apart"),
        F.col("left").rlike(r"[0-9][^A-Za-z]{0,6}\z").cast("int").alias("f_near_number"))


FEATURES = ["f_kind", "f_digits", "f_seps", "f_marks", "f_grouped", "f_cue", "f_assigned", "f_apart",
            "f_near_number"]


def fit(counts: list[tuple[tuple[int, ...], float, float]], rounds: int = 40, rate: float = 0.3
        ) -> tuple[float, list[tuple]]:
    """Boosted trees of two levels for the logistic loss, from (bins, negatives, positives).

    Returns the start score and trees ``(feature, cut, (feature, cut, low, high), (…))``: values
    up to the cut go to the first branch.
    """
    neg, pos = sum(c[1] for c in counts), sum(c[2] for c in counts)
    start = math.log((pos + 1) / (neg + 1))
    scores = [start] * len(counts)
    cuts = sorted({(f, c[0][f]) for c in counts for f in range(len(FEATURES))})
    trees = []

    def gain(rows, stats):
        g, h = sum(stats[i][0] for i in rows), sum(stats[i][1] for i in rows)
        return g, h, g * g / (h + 1.0)

    def best_cut(rows, stats):
        whole, best = gain(rows, stats)[2], (1e-9, cuts[0])
        for f, v in cuts:
            low = [i for i in rows if counts[i][0][f] <= v]
            if 0 < len(low) < len(rows):
                held = set(low)
                more = gain(low, stats)[2] + gain([i for i in rows if i not in held], stats)[2] - whole
                best = max(best, (more, (f, v)))
        return best[1]

    for _ in range(rounds if neg and pos else 0):
        stats = []
        for (_, a, b), s in zip(counts, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            stats.append((b - (a + b) * p, (a + b) * p * (1 - p)))
        every = list(range(len(counts)))
        f, v = best_cut(every, stats)
        tree = [f, v]
        for side in ([i for i in every if counts[i][0][f] <= v],
                     [i for i in every if counts[i][0][f] > v]):
            f2, v2 = best_cut(side, stats) if side else (f, v)
            leaf = []
            for part in ([i for i in side if counts[i][0][f2] <= v2],
                         [i for i in side if counts[i][0][f2] > v2]):
                g, h, _ = gain(part, stats)
                leaf.append(rate * g / (h + 1.0))
                for i in part:
                    scores[i] += leaf[-1]
            tree.append((f2, v2, *leaf))
        trees.append(tuple(tree))
    return start, trees


def score(start: float, trees: list[tuple]) -> Column:
    """The trees as one SQL expression."""

    def branch(node):
        f, v, low, high = node
        return F.when(F.col(FEATURES[f]) <= v, F.lit(low)).otherwise(F.lit(high))

    total = F.lit(start)
    for f, v, a, b in trees:
        total = total + F.when(F.col(FEATURES[f]) <= v, branch(a)).otherwise(branch(b))
    return total


def tree_score(start: float, trees: list[tuple], bins: tuple[int, ...]) -> float:
    """The same sum for one combination of bins."""
    total = start
    for f, v, a, b in trees:
        f2, v2, low, high = a if bins[f] <= v else b
        total += low if bins[f2] <= v2 else high
    return total


def calibrated(counts, start, trees, precision: float) -> float:
    """The lowest score above which the labelled candidates reach the precision."""
    ordered = sorted(((tree_score(start, trees, c[0]), c[1], c[2]) for c in counts), reverse=True)
    best, neg, pos = math.inf, 0.0, 0.0
    for i, (s, a, b) in enumerate(ordered):
        neg, pos = neg + a, pos + b
        last = i + 1 == len(ordered) or ordered[i + 1][0] < s
        if last and pos and pos / (pos + neg) >= precision:
            best = s
    return best


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  precision: float = 0.98, rounds: int = 40) -> DataFrame:
    """(row, doc_id, base, spans): one row per input row with its base spans and all spans, arrays
    of (rank, start, end, kind) in order of kind and start.

    Labels for the trees: candidates that overlap a passed base span are positive; candidates that
    failed their check, or stand alone without a cue before them, are negative; the rest is
    unlabelled.  A candidate is redacted when its score reaches the calibrated threshold and it
    overlaps no base span; of such candidates that overlap each other the first stays, and of those
    that begin together the longest.  Null and empty texts have no spans; null ids and repeated
    rows are kept, each judged for itself; without labelled candidates of both classes only base
    spans are returned; an empty table gives an empty result.
    """
    found = spans.find(docs, PATTERNS, id_column, text_column)
    every = features(located(found)).withColumn("passed", base_check())
    base = every.filter("passed").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        F.col("f_kind").alias("rank"), F.col("start"), F.col("end"), F.col("kind")))).alias("base"))
    held = every.join(base, "row", "left").withColumn(
        "base", F.coalesce("base", F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string>>")))
    held = held.withColumn("known", F.exists("base", lambda b: (b["start"] < F.col("end")) & (
        F.col("start") < b["end"])))
    failed = F.col("kind").isin(*BASE) & ~F.col("passed")
    label = F.when(F.col("known"), 1).when(failed | (F.col("f_cue") == 0), 0)
    grouped = held.withColumn("label", label).filter("label is not null").groupBy(*FEATURES).agg(
        F.sum(1 - F.col("label")).alias("neg"), F.sum("label").alias("pos"))
    counts = [(tuple(r[f] for f in FEATURES), float(r.neg), float(r.pos))
              for r in grouped.collect()]            # at most the product of the bins
    start, trees = fit(counts, rounds) if counts else (0.0, [])
    cut = calibrated(counts, start, trees, precision)
    if trees and cut < math.inf:
        chosen = held.filter(~F.col("known") & (score(start, trees) >= cut))
    else:
        chosen = held.filter(F.lit(False))
    kept = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start"), (-F.col("end")).alias("minus_end"), F.col("end"), F.col("f_kind").alias("rank"),
        F.col("kind")))).alias("more"))
    empty = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string>>")
    first = F.aggregate("more", F.struct(F.lit(-1).cast("bigint").alias("to"), empty.alias("out")),
                        lambda acc, x: F.when(x["start"] >= acc["to"], F.struct(
                            x["end"].alias("to"), F.concat(acc["out"], F.array(F.struct(
                                x["rank"].alias("rank"), x["start"].alias("start"),
                                x["end"].alias("end"), x["kind"].alias("kind")))).alias("out"))
                        ).otherwise(acc))["out"]
    kept = kept.select("row", first.alias("more"))
    return found.select("row", "doc_id").join(base, "row", "left").join(kept, "row", "left").select(
        "row", "doc_id", F.coalesce("base", empty).alias("base"),
        F.sort_array(F.concat(F.coalesce("base", empty), F.coalesce("more", empty))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in BASE],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
