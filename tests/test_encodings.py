"""Encodings told apart by byte pairs: held-out texts, short and odd data."""

import random

import numpy as np

from sparkquire.plans import other_queries
from sparkquire.sources import encodings, readers

SF = "/root/testdata/sf0.001"


def chinese(rng, n):
    return "".join(rng.choices("的一是不了人我在有他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她里后小么心多天而能好都然沒日于起還發成事只作當想看文無開手十用主行方又如前所本見經頭面公同三己老从動兩長", k=n))


def test_held_out_texts(spark):
    rng = random.Random(1)
    texts = [chinese(rng, rng.randint(20, 200)) for _ in range(120)] + ["Les élèves étaient très fatigués, où çà ? Größe, Äpfel, über. " * rng.randint(1, 4) for _ in range(120)]
    found = encodings.learn(spark.createDataFrame([(t,) for t in texts[::2]] + [(None,), ("",)], "text string"))
    right = {}
    for t in texts[1::2]:
        for name in ("gb18030", "big5", "utf-16-le", "utf-16-be", "cp1252"):
            data = t.encode(name, "ignore")
            if len(data) >= 40 and not (data.isascii() and 0 not in data):  # plain ASCII is all of them
                right.setdefault(name, []).append(found(data) == name)
    assert set(right) == {"gb18030", "big5", "utf-16-le", "utf-16-be", "cp1252"} and all(sum(x) >= 0.95 * len(x) for x in right.values())


def test_odd_data(spark):
    none = encodings.learn(spark.createDataFrame([], "text string"))
    assert none(b"") is None and none(b"x") is None and none(b"\xff\xfe\xfd") in encodings.ENCODINGS
    assert readers.detect_encoding(b"\xff\xff\xff", none) in encodings.ENCODINGS and readers.detect_encoding("é".encode(), none) == "utf-8"


def test_pairs_over_slices(monkeypatch):
    data = bytes(random.Random(2).choices(range(256), k=1000))
    whole = encodings._pairs(data)
    monkeypatch.setattr(encodings, "SLICE_BYTES", 7)
    assert (encodings._pairs(data) == whole).all() and whole.sum() == 999 and np.count_nonzero(encodings._pairs(b"a")) == 0


def test_documents_in_seven_encodings(spark):
    """What carries a mark, or decodes strictly, is read right; of the rest (UTF-16 without a mark, Windows) nearly all are."""
    rows = other_queries.q_encoding_detect(spark, SF).collect()
    assert len(rows) == 200
    for kind in ("utf-8", "utf-8-sig", "utf-16"):
        mine = [r for r in rows if r.written == kind]
        assert mine and all(r.same for r in mine)
    rest = [r for r in rows if r.encoding in ("utf-16-le", "utf-16-be", "cp1252", "big5", "shift_jis")]
    assert len(rest) > 20 and sum(r.written == r.encoding and r.same for r in rest) >= 0.95 * len(rest)


def test_short_texts_are_counted_together(spark, monkeypatch):
    """No text is held against all pairs on its own, and the tables are the same."""
    texts = [f"text {i} of a few words, 第{i}章" for i in range(40)] + ["", None]
    whole = {name: sum(encodings._pairs((t or "").encode(name, "ignore")) for t in texts) for name in encodings.ENCODINGS}
    told = encodings.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert all((told.tables[name] == encodings.Likelihoods(whole).tables[name]).all() for name in whole)
    data = texts[3].encode()
    want = encodings._pairs(data)
    monkeypatch.setattr(encodings, "_pairs", None)
    at, n = encodings._seen(data)
    assert (n == want[at]).all() and n.sum() == want.sum() and encodings._seen(b"a")[0].size == 0
