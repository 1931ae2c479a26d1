"""Quality rules: plain counts, and tokeniser fertility with rejection bands per language.

A public vocabulary with byte fallback gives each text its characters per token, the share of
byte tokens and the entropy of its tokens.  The bands come from all rows of the table that pass the
plain counts: per language the quartiles widened by a multiple of their distance, never narrower
than a floor, and wider for short texts, whose measures scatter more.  Entropy falls with the length
of a text, so it is held against the line of its language through that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfcast.llm.common import stored, vocabulary

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MOST_SENT_BANDS = 100_000
MEASURES = ["chars_per_token", "byte_share", "entropy_ratio"]
BANDED = [*MEASURES[:2], "entropy_ratio_level"]
SCHEMA = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, "
          "byte_share double, entropy_ratio double")

_PIECES: dict[str, "Pieces"] = {}


class Pieces:
    """Token ids of single words by a sentencepiece vocabulary, kept up to a bound."""

    def __init__(self, path: str, most_words: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.most = most_words
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set(words))
        if new:
            for word, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
                self.known[word] = np.asarray(ids, "<u2").tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u2")


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    m = len(seen)
    pair = np.unique(code[:-1] * m + code[1:], return_inverse=True)[1]
    _, group, counts = np.unique(pair[:-1] * m + code[2:], return_inverse=True, return_counts=True)
    hit = counts[group] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def measure(text: str, vocab: Pieces) -> tuple:
    words = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]
    chars = len(text) - sum(map(text.count, SPACES))
    ids = vocab.ids(words)
    n = len(ids)
    cpt = share = entropy = None
    if n:
        p = np.bincount(ids)
        p = p[p > 0] / n
        cpt, share = chars / n, float(vocab.is_byte[ids].mean())
        # entropy against its largest value for that many tokens, so that length matters little
        entropy = float(-(p * np.log2(p)).sum() / max(1.0, np.log2(n)))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text),
            repeated_words(words), n, cpt, share, entropy)


def measures(docs: DataFrame, vocab: str | None = None, id_column: str = "doc_id",
             text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """Counts and fertility of each row; null text counts as empty, a null language as ``und``."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches):
        model = pieces(path)
        for batch in batches:
            rows = [measure(t.as_py() or "", model) for t in batch.column(2)]
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[x.split()[0] for x in SCHEMA.split(", ")])

    lang = F.col(lang_column).cast("string") if lang_column else F.lit(None).cast("string")
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(lang, F.lit("und")).alias("lang"),
        F.col(text_column).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def sent(per_language: DataFrame, name: str) -> DataFrame:
    """One row per language, sent to all tasks after a look at their count, so that no task gets all
    rows of a frequent language."""
    rows = stored(per_language, name)
    return F.broadcast(rows) if rows.count() <= MOST_SENT_BANDS else rows


def levelled(found: DataFrame) -> DataFrame:
    """Adds ``entropy_ratio_level``: the entropy without the part that follows the length, by a line
    per language over the logarithm of the tokens of the rows that pass the plain counts."""
    length = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    # rounded, so that the order in which rows are added up can't turn a verdict
    slopes = found.filter("not base_failed and n_tokens > 0").groupBy("lang").agg(
        F.round(F.regr_slope("entropy_ratio", length), 6).alias("slope"))
    return found.join(sent(slopes, "slopes"), "lang", "left").withColumn(
        "entropy_ratio_level", F.col("entropy_ratio") - F.coalesce("slope", F.lit(0.0)) * length
    ).drop("slope")


def bands(found: DataFrame, width: float = 2.0,
          floors: tuple[float, float, float] = (0.05, 0.01, 0.04)) -> DataFrame:
    """Per language and measure the quartiles of the rows that pass the plain counts, and the room
    that a text of many tokens has on both sides: ``width`` times their distance or the floor, if
    that is more.  Quartiles are exact, of values rounded to four places: a language has few of
    these, so its counts stay small and no cut of the table can turn a verdict."""
    quartiles = found.filter("not base_failed and n_tokens > 0").groupBy("lang").agg(*[
        F.percentile(F.round(m, 4), F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in BANDED])
    out = [F.col("lang")]
    for name, floor in zip(BANDED, floors, strict=True):
        low, high = F.col(name)[0], F.col(name)[1]
        room = F.greatest((high - low) * width, F.lit(floor))
        out += [low.alias(f"{name}_low"), high.alias(f"{name}_high"), room.alias(f"{name}_room")]
    return quartiles.select(*out)


def judge_quality(docs: DataFrame, vocab: str | None = None, id_column: str = "doc_id",
                  text_column: str = "text", lang_column: str | None = "lang",
                  least_words: int = 50, most_repeated: int = 50, width: float = 2.0,
                  full_tokens: int = 500) -> DataFrame:
    """One row per input row: counts, fertility measures, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` percent of
    the words in repeated three-word windows.  ``kept``: not base_failed, and all three measures
    inside their language's band, whose room is widened by ``sqrt(full_tokens / n_tokens)`` for
    texts of fewer tokens; entropy is levelled by length first.  Empty and null texts have no words and fail.  Null ids and
    repeated rows are judged like any other; ties in a band keep the row; an empty table gives an
    empty result; columns beyond id, text and language are not read.
    """
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    found = stored(measures(docs, vocab, id_column, text_column, lang_column), "quality")
    found = levelled(found.withColumn("base_failed", failed))
    judged = found.join(sent(bands(found, width), "bands"), "lang", "left")
    wider = F.greatest(F.lit(1.0), F.sqrt(
        F.lit(float(full_tokens)) / F.greatest(F.col("n_tokens"), F.lit(1))))
    inside = F.lit(True)
    for m in BANDED:
        room = F.col(f"{m}_room") * wider
        inside = inside & F.coalesce(F.col(m).between(
            F.col(f"{m}_low") - room, F.col(f"{m}_high") + room), F.lit(True))
    return judged.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *MEASURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
