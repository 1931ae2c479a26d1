"""Token ids from known stems and tails against the whole texts' ids."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from shelfcast.llm import tokens  # noqa: E402
from shelfcast.llm.common import vocabulary  # noqa: E402


def test_known_stems_and_tails_give_the_ids_of_whole_texts():
    enc = tokens.WordEncoder(vocabulary(), most_words=60)
    texts = ["Plain words, plain words.", "PLAIN? words; (plain) \t Größe, größe!", "", "  ", "xς ΣΣ, a1 a1. ...",
             "plain... words?! " * 5, " ".join(f"w{i}, Wort{chr(97 + i % 26)}." for i in range(90)), "plain words"]
    for group in (texts, texts[::-1], texts[2:4], texts):
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in group]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many([t.encode() for t in group])] == want


def test_words_with_known_stem_and_tail_wait_for_nothing():
    enc = tokens.WordEncoder(vocabulary())
    enc.encode_many([b"alpha, beta."])
    held = []
    enc._learn_letters = held.extend
    enc._learn_stems = lambda stems, tokenizer: held.extend(stems)
    enc.encode_many([b"Alpha. BETA, alpha beta"])
    assert not held and enc.known[b"Alpha."] == enc.stems[b"alpha"] + enc.stems[b"."]
