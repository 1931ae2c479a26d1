"""Token ids of whole texts, with the ids of frequent words kept per worker process.

The vocabulary drops white space and never joins across it, so a text's ids are the ids of its
words one after another.  It also parts letters from the punctuation after them, so a word of
letters with ASCII punctuation behind is its stem and that tail.  Unknown stems of letters are
encoded joined by spaces and parted at the ids that end a word, others separated by the vocabulary's
end marker.  Arrow splits the texts of a group and finds its distinct words; each of these is looked
up once, and their ids are gathered for all words at once.  The memory of known words is bounded; it
changes speed, not results.  A vocabulary without these properties encodes whole texts.
"""

from __future__ import annotations

import json
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

MARK = "<|endoftext|>"
END_ID = 2
WORD_END = "</w>"
TAIL = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def parts_words(tokenizer: Tokenizer) -> bool:
    """Whether the ids of a text are those of its words, and of their stems and tails, one after
    another: lower case, white space dropped, letters apart from punctuation, marked word ends."""
    rules = json.loads(tokenizer.to_str())
    normal, split = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    names = [x["type"] for x in normal.get("normalizers", [])]
    first = (split.get("pretokenizers") or [{}])[0]
    return (names == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed"
            and "\\p{L}]+" in first.get("pattern", {}).get("Regex", "")
            and rules["model"].get("end_of_word_suffix") == WORD_END
            and tokenizer.token_to_id(MARK) is not None)


class WordEncoder:
    """Encodes UTF-8 texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, most_words: int = 350_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = parts_words(self.tokenizer)
        # composed lower-case letters need no normalising and no splitting beyond white space
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.tokenizer.token_to_id(MARK)
        vocab = self.tokenizer.get_vocab()
        self.most_ids = max(vocab.values()) + 1
        self.ends_word = np.zeros(self.most_ids, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.most = most_words
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {b"": b""}

    def _direct(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _learn_letters(self, stems: list[bytes]) -> None:
        """Stems of letters only: each has exactly one id that ends a word, its last."""
        for i in range(0, len(stems), 400):
            part = stems[i:i + 400]
            ids = np.asarray(self.plain.encode_batch_fast(
                [b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                self._learn_stems(part, self.plain)
                continue
            raw, begin = ids.tobytes(), 0
            for stem, end in zip(part, (4 * ends).tolist(), strict=True):
                self.stems[stem] = raw[begin:end]
                begin = end

    def _learn_stems(self, stems: list[bytes], tokenizer: Tokenizer) -> None:
        for i in range(0, len(stems), 2000):
            part = stems[i:i + 2000]
            joined = MARK.join(w.decode("utf-8", "replace") for w in part)
            ids = np.asarray(
                tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            raw, begin = ids.tobytes(), 0
            for stem, end in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                self.stems[stem] = raw[4 * begin:4 * end]
                begin = end + 1

    def _learn(self, words: list[bytes]) -> None:
        if len(self.stems) > self.most:
            self.stems = {b"": b""}
        known, stems = self.known, self.stems
        parted, plain, other = [], set(), set()
        for word in words:
            stem = word.rstrip(TAIL)
            tail = word[len(stem):]
            if stem.isalpha():
                stem = stem.lower()
                if stem in stems and tail in stems:      # most words: a known stem and a known tail
                    known[word] = stems[stem] + stems[tail]
                    continue
                plain.add(stem)
            else:
                text = normalize("NFC", stem.decode("utf-8", "replace")).lower()
                # a last sigma is the one letter whose lower case depends on its neighbours
                if text.isalpha() and "\u03c2" not in text:
                    stem = text.encode()
                    plain.add(stem)
                else:
                    stem, tail = word, b""
                    other.add(word)
            if tail:
                other.add(tail)
            parted.append((word, stem, tail))
        self._learn_letters(list(plain.difference(stems)))
        self._learn_stems(list(other.difference(stems)), self.tokenizer)
        for word, stem, tail in parted:
            known[word] = stems[stem] + stems[tail] if tail else stems[stem]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; a text that holds a marker in its own words is encoded directly."""
        whole = [not self.by_words or b"<|" in t for t in texts]
        held = pa.array([b"" if w else t for t, w in zip(texts, whole, strict=True)], pa.binary())
        split = pc.ascii_split_whitespace(held.view(pa.string()))
        coded = split.flatten().dictionary_encode()
        # as one text that is split again, since words hold no spaces
        named = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.view(pa.binary()))
        words = pc.binary_join(named, b" ")[0].as_py().split(b" ")
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = words
        self._learn(new)
        each = list(map(self.known.__getitem__, words))
        # ids of the distinct words one after another, then gathered word by word; a text has no
        # more ids than bytes, so narrow numbers do for all but giant texts
        kind = np.int32 if sum(map(len, texts)) < 1 << 29 else np.int64
        flat = np.frombuffer(b"".join(each), "<u4")
        sizes = np.fromiter(map(len, each), kind, len(each)) // 4
        begins = np.cumsum(sizes, dtype=kind) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n, dtype=kind)
        place = np.repeat(begins[at] - (ends - n), n)
        place += np.arange(len(place), dtype=kind)
        ids = flat[place]
        del place
        raw = memoryview(ids.tobytes())
        cuts = (4 * np.concatenate([[0], ends])[split.offsets.to_numpy()].astype(np.int64)).tolist()
        return [self._direct(t) if w else bytes(raw[a:b])
                for t, w, a, b in zip(texts, whole, cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, used again by its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded_batches(batches, path: str, most_bytes: int = 1_000_000):
    """(document id, id bytes with the end id) for each row of Arrow batches (doc_id, text)."""
    end = np.asarray([END_ID], "<u4").tobytes()
    enc = encoder(path)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        group: list[bytes] = []
        first, size = 0, 0
        for i in range(len(ids)):
            group.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1])
            if size >= most_bytes or i == len(ids) - 1:
                for k, got in enumerate(enc.encode_many(group)):
                    yield ids[first + k], got + end
                group, first, size = [], i + 1, 0
    pa.default_memory_pool().release_unused()
