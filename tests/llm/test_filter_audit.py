"""The audit of filters against applying each order to the documents."""

from __future__ import annotations

import random
import re
import tracemalloc
from itertools import permutations

import pyarrow as pa
import pytest

from shelfcast.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string, good int, n long"


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        n = rng.choice([0, 5, 150, 199, 200, 260])
        words = [f"w{rng.randrange(rng.choice([20, 900]))}" for _ in range(n)]
        text = " ".join(w.upper() if rng.random() < rng.choice([0, 0.2]) else w for w in words)
        rows.append((i, text + rng.choice(["", "", " #", "|"]), rng.choice(["en", "fr", None])))
    rows += [(200 + i, rows[7][1], "en") for i in range(60)]              # a third are copies
    rows += [(7, rows[7][1], "fr"), (300, None, "en"), (301, "", None), (None, rows[7][1], "de"),
             (None, "alone with no id", "de"), (None, "alone with no id", "de"),
             (302, "É" * 97 + "AAA", "xx"), (303, "É" * 96 + "AAA", "xx"), (304, "a\x85b\x1cc d " * 70, "xx"),
             (305, "word and more " * 200_000, "xx")]
    return rows


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (4, None, None), (7, 1, None), (205, None, 1), (None, 1, 1),
          (302, 1, 1)] + [(i, i % 2, i % 3 == 0) for i in range(10, 120)]


def plain(rows):
    import re
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [j for j, t, _ in rows if (t or "") == text]
        smaller = any(j is not None and (i is None or j < i) for j in ids)
        docs.append((lang or "", i in good, i in toxic, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}))
    out = []
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[3][f]]
                left = [d for d in left if not d[3][f]]
                steps.append((part, order, step, len(left), len(gone),
                              sum(d[3][f] for d in here) - len(gone),
                              sum(d[3][f] and sum(d[3].values()) == 1 for d in here),
                              sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        total = {f: sum(s[4] for s in steps if s[9] == f) for f in "ABCDE"}
        out += [(*s[:9], total[s[9]]) for s in steps]
    return sorted(out)


def test_audit_equals_every_order_applied(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "p", 1, "d", 1, 5) for r in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, q, None if t is None else int(t), 0, 1) for i, q, t in LABELS],
                                   "doc_id long, quality int, toxic int, mask int, good int")
    got = sorted(map(tuple, fa.filter_interactions(docs, labels).collect()))
    assert got == plain(rows)
    assert fa.filter_interactions(docs.limit(0), labels).count() == 0
    unlabelled = fa.filter_interactions(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(got) and not any(r.good_lost or r.toxic_lost for r in unlabelled)


def test_walk_over_any_number_of_filters():
    rng = random.Random(1)
    for k in (1, 2, 3, 6):
        cells = [(m, (rng.randrange(9), rng.randrange(9))) for m in rng.sample(range(1 << k), min(1 << k, 9))]
        states = fa.survivors(cells, k)
        for chosen in range(1 << k):
            assert states[chosen] == tuple(sum(c[j] for m, c in cells if not m & chosen) for j in range(2))
    assert len(fa.audit_part([(0, (3, 0, 0)), (5, (2, 1, 1))], "XYZ")) == 18


def whole_mask(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    points = len(text.decode())
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
             100 * len(re.findall(rb"[A-Z]", text)) > 3 * points, bool(re.search(rb"[#$%&*|]", text)))
    return sum(fail << i for i, fail in enumerate(fails))


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 1 << 18])
def test_pieces_part_no_word(piece, monkeypatch):
    monkeypatch.setattr(fa, "PIECE", piece)
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "a", " a ", "#", "É" * 97 + "AAA", "É" * 96 + "AAA", "one " * 199, "one " * 200 + "|"]
    texts += ["".join(rng.choice(["ab", "É", " ", "\t\x0b", "\x85", "Q", "w%d" % rng.randrange(400)])
                      for _ in range(rng.randrange(900))) for _ in range(60)]
    for text in map(str.encode, texts):
        assert b"".join(fa.pieces(text)) == text
        assert fa.text_mask(text) == whole_mask(text)


def test_memory_of_a_batch_is_that_of_a_piece():
    text = b"word and more " * 100_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(["en"] * 12), pa.array([text] * 12, pa.binary())],
                                       ["doc_id", "part", "text"])
    list(fa.measure([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        (found,) = fa.measure([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.column(2).to_pylist() == [2] * 12 and len(set(found.column(3).to_pylist())) == 1
    assert peak < 8_000_000         # the texts alone are 16.8 MB


def test_batches_of_the_session_are_as_before(spark):
    from shelfcast.llm.common import BATCH_BYTES, stored
    before = spark.conf.get(BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])
    rows = spark.range(40, numPartitions=1).selectExpr("repeat('x', 100000) AS text").mapInArrow(sizes, "n long")
    counts = [r.n for r in stored(rows, "batches", "1m").collect()]
    assert sum(counts) == 40 and max(counts) < 20
    assert spark.conf.get(BATCH_BYTES) == before
