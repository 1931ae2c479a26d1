"""Byte context trees against a plain version that works each code length out from counts."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import log2

import numpy as np
import pytest

from shelfcast.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double, n long, gram long"
POOLS = {"xx": "kala mato pelu riso vanta".split(), "yy": "strg zwölf häuser brück nacht".split(),
         "zz": "она идёт домой снег вода".split()}


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(90):
        lang = ["xx", "yy", "zz"][i % 3]
        rows.append((i, " ".join(rng.choice(POOLS[lang]) for _ in range(rng.randrange(1, 30))), lang))
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "12 34 — !", "yy"), (103, "strg nacht", None),
             (None, "kala mato", "xx"), (104, "x", "zz"), (104, "x", "zz"), (105, "日本 " * 3, "xx"),
             (106, "kala mato " * 200_000, "xx"), (107, "häuser " * 60_000, None)]
    return rows


def plain_lengths(text: bytes, counts: Counter) -> int:
    """Sum of the rounded code lengths of a text's bytes; counts by (context, byte)."""
    followers: dict[bytes, Counter] = {}
    for (context, byte), n in counts.items():
        for k in range(5):
            followers.setdefault(context[4 - k:], Counter())[byte] += n
    total, padded, cost = 0, bytes(4) + text, {}
    for i in range(len(text)):
        context, byte = padded[i:i + 4], text[i]
        if (context, byte) not in cost:
            bits, gone = 0.0, set()
            for k in range(4, -1, -1):
                found = followers.get(context[4 - k:])
                if found is None:
                    continue
                left = {b: n for b, n in found.items() if b not in gone}
                whole = sum(left.values()) + len(left)
                if byte in left:
                    bits += log2(whole / left[byte])
                    break
                if left:
                    bits += log2(whole / len(left))
                gone |= set(found)
            else:
                bits += log2(256 - len(gone))
            cost[context, byte] = round(bits * li.UNIT)
        total += cost[context, byte]
    return total


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "q", 0.5, 7, 8) for r in corpus()], SCHEMA).repartition(3)


def plain(rows):
    counts = {}
    for i, text, lang in rows:
        if not held(i) and lang is not None and text:
            padded = bytes(4) + text.encode()
            counts.setdefault(lang, Counter()).update(
                (padded[j:j + 4], padded[j + 4]) for j in range(len(text.encode())))
    return counts


def test_languages_equal_a_plain_coder(spark, docs):
    rows = corpus()
    counts = plain(rows)
    want = []
    for i, text, _ in rows:
        data = (text or "").encode()
        if not any(map(str.isalpha, text or "")):
            want.append((i, held(i), "und", 0.0, 0.0, len(data)))
            continue
        costs = {lang: plain_lengths(data, c) for lang, c in sorted(counts.items())}
        best = min(costs, key=costs.get)
        share = 1 / sum(2.0 ** max(-1000, (costs[best] - c) / li.UNIT) for c in costs.values())
        want.append((i, held(i), best, round(share, 9), costs[best] / li.UNIT, len(data)))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.bits, r.n_bytes)
           for r in li.languages(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    right = [(r[2] == {i: lang for i, _, lang in rows}[r[0]]) for r in got if r[1] and r[0] and r[0] < 90]
    assert len(right) > 10 and np.mean(right) > 0.9


def test_code_lengths_are_a_distribution(spark, docs):
    train = docs.filter("lang is not null and text is not null").select("lang", "text")
    model = li.learn(train)
    for context in (b"\0\0\0\0", b"kala", b"zzzz", "ö".encode() + b"lf"):
        base = int.from_bytes(context, "big") << 8
        for tree in model.known.trees:
            bits = li.code_lengths(np.arange(base, base + 256), tree) / li.UNIT
            assert 0.5 < np.exp2(-bits).sum() < 1.001


def test_fewer_nodes_and_no_rows(spark, docs):
    full = {r.doc_id: r.lang_pred for r in li.languages(docs).collect()}
    small = li.languages(docs, most_nodes=400).collect()
    train = docs.filter(~li.held_out(docs.doc_id) & docs.lang.isNotNull() & docs.text.isNotNull())
    model = li.learn(train.select("lang", "text"), most_nodes=400)
    assert 0 < sum(len(o.nodes) for t in model.known.trees for o in t) <= 400
    assert np.mean([full[r.doc_id] == r.lang_pred for r in small]) > 0.9
    assert li.languages(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang is null")
    assert {(r.lang_pred, r.score) for r in li.languages(unlabelled).collect()} == {("und", 0.0)}


def test_the_split_of_rows_changes_nothing(spark, docs):
    two = sorted(map(tuple, li.languages(docs.coalesce(1)).collect()), key=repr)
    assert two == sorted(map(tuple, li.languages(docs.repartition(7)).collect()), key=repr)
