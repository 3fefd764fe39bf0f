"""Quality, toxicity, language: held-out accuracy, and every odd input."""

import itertools
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkquire.llm import bytetext, language_id, learning, quality, queries, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, extra int"
LABELS = "doc_id long, quality int, toxic int"
ODD = [(1, None, "en", None, 1), (2, "", None, "s", None), (2, "", None, "s", None), (None, "the words are here", "en", None, None), (4, "   \n\t ", "fr", "s", 2), (5, "x" * 300_000, "en", "s", 3), (6, "12 34 ... !!", None, None, None), (7, "Ünïcödé \U0001f600 ‍", "de", None, None)]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_held_out_follows_crc32(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 7, 123456789)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", learning.held_out(df.doc_id, 5, 0).alias("h")).collect()}
    assert got.pop(None) is False
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


@needs_data
def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op1_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == (r.predicted == 1) for r in rows)


@needs_data
def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.op10_toxicity(spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 700 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.01  # some labels are wrong
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9


@needs_data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.99


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_have_a_result(spark, empty):
    docs = spark.createDataFrame([] if empty else ODD, DOCS).withColumnRenamed("extra", "score")
    labels = spark.createDataFrame([] if empty else [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, None), (None, 1, 1), (5, 0, 0)], LABELS)
    for out in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        rows = out.collect()
        assert len(rows) == (0 if empty else len(ODD)) and all(0 <= r.score <= 1 for r in rows)
        assert {"doc_id", "text", "lang", "source", "held_out", "score", "predicted"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = language_id.predict_language(docs).collect()
    assert len(rows) == (0 if empty else len(ODD))
    if not empty:
        assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 4, 6)} == {"und"}
        assert all(r.score == 0 for r in rows if r.lang_pred == "und")


def test_no_labels_mean_no_rejection(spark):
    docs, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], LABELS)
    assert all(r.score == 0.5 and r.predicted == 1 for r in quality.score_quality(docs, none).collect())
    assert all(r.score == 0.5 and r.predicted == 0 for r in toxicity.score_toxicity(docs, none).collect())


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit_trees(x, y, trees=20, depth=3)
    assert np.mean((model.score(x) > 0.5) == y) > 0.9

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def test_statistics_by_hand():
    x = dict(zip(quality.NAMES, quality.statistics(pa.array(["Ab ab ab!!\nzz\nzz", None]))[0]))
    assert x["share_upper"] == pytest.approx(1 / 16) and x["share_exclamation"] == pytest.approx(2 / 16)
    assert x["word_repeats_last"] == pytest.approx(2 / 5) and x["repeated_lines"] == pytest.approx(1 / 3)
    assert not quality.statistics(pa.array([None, ""])).any()


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9):
        code = language_id.codewords(k)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(k, dtype=bool)]
        assert apart.min() >= (1 if k == 2 else 2 ** (k - 2) if k <= 6 else 8)
        assert (np.abs(code.sum(axis=0)) < k).all()


def test_chain_shows_later_models_earlier_probabilities():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (400, 6)).astype(np.float32)
    first = x[:, 0] > 0
    y = np.stack([first, first & (x[:, 1] > 0)], axis=1).astype(np.int8)
    w = toxicity.fit_chain(x, y, np.arange(400) % 4)
    assert [len(v) for v in w] == [7, 8] and w[1][6] != 0


def test_shown_probabilities_are_out_of_fold(monkeypatch):
    rng = np.random.default_rng(6)
    x, fold = rng.integers(0, 2, (200, 5)).astype(np.float32), np.arange(200) % 4
    y = np.stack([rng.integers(0, 2, 200), rng.integers(0, 2, 200)], axis=1).astype(np.int8)
    fits, plain = [], learning.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda a, b, **k: fits.append((a.copy(), b.copy())) or plain(a, b, **k))
    toxicity.fit_chain(x, y, fold)
    shown = fits[-1][0][:, 5]  # what the last model sees of the first category
    for f in range(4):
        w = plain(x[fold != f], y[fold != f, 0].astype(float), steps=120)
        assert np.allclose(shown[fold == f], 1 / (1 + np.exp(-(x[fold == f] @ w[:-1] + w[-1]))), atol=1e-5)
    assert len(fits) == 6 and all(len(a) == 150 for a, _ in fits[1:5])


def test_kinds_split_positive_rows_by_their_words():
    x = np.zeros((90, 4), np.float32)
    x[:30, 0] = x[30:60, 2] = x[60:, 3] = 1
    y, centres = toxicity.kinds_of(x, np.arange(90) < 60, 2)
    assert y[60:].sum() == 0 and (y[:60].sum(axis=1) == 1).all() and len({tuple(r) for r in y[:30]}) == 1 and (y[0] != y[30]).any()
    again, _ = toxicity.kinds_of(x[::-1], np.arange(90) >= 30, 2, like=centres)
    assert (again[::-1] == y).all()
    assert not toxicity.kinds_of(x, np.arange(90) < 10, 2)[0].any()


def _tokens(text, letters):
    return ["".join(w) for ok, w in itertools.groupby(text or "", letters) if ok]


def test_chain_scores_equal_a_plain_walk(spark):
    """Features, models and decoding of the whole operator against loops over words."""
    rng = np.random.default_rng(8)
    words = ["good", "plain", "awful", "rotten", "Rottenness", "sun", "moon", "tree", "Ünder"]
    texts = [" ".join(rng.choice(words[4:] if i % 3 else words[:7], rng.integers(1, 30))) for i in range(240)] + ["", None, "rotten!" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("awful" in (t or "") or "rotten" in (t or ""))) for i, t in enumerate(texts[:200])], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(~learning.held_out(labels.doc_id, 5, 0)))
    assert len(model.vocabulary.features)
    letter = lambda c: ("a" <= c.lower() <= "z" and c.isascii()) or not c.isascii()

    def hashed(b):
        return int(bytetext.SpanHashes(np.frombuffer(b, np.uint8))(np.array([0]), np.array([len(b)]))[0])

    def score(text):
        counts = dict.fromkeys(model.vocabulary.features.tolist(), 0)
        for w in _tokens(text, letter):
            b = w.encode()
            for f in [hashed(b)] + [hashed(b[:k]) + k for k in toxicity.BEGINNINGS if len(b) > k]:
                if f in counts:
                    counts[f] += 1
        x, p = [round(16 * math.log1p(counts[f])) / 16 for f in sorted(counts)], []
        for w in model.weights:
            p.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(x + p, w)) - w[-1])))
        return p[-1]

    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(score(t), abs=1e-4) and got[i].predicted == int(got[i].score > 0.5)


def test_named_categories_are_the_chain(spark):
    docs = spark.createDataFrame([(i, f"bad words {i}" if i % 2 else f"fine words {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)], "doc_id long, insult int, toxic int")
    out = toxicity.score_toxicity(docs, labels, categories=("insult", "toxic"))
    assert out.columns == ["doc_id", "text", "held_out", "p_insult", "score", "predicted"]
    assert all(r.predicted == r.doc_id % 2 for r in out.collect())


def test_quality_scores_equal_loops(spark):
    """Statistics by loops over characters, trees by a walk, over odd texts."""
    texts = [r[1] for r in ODD] + ["One two two. Two\nthree\r\nthree\n\nThree $$$", "A!\tb?  C\x0bd\x01", "Ça va\n" * 7]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(len(t or "") > 12)) for i, t in enumerate(texts * 4)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~learning.held_out(labels.doc_id, 5, 0)).withColumnRenamed("quality", "label"))

    def numbers(text):
        b = (text or "").encode()
        fold = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        kind = lambda c: quality.BYTE_CLASS[c]
        words = [bytes(w) for ok, w in itertools.groupby(b, lambda c: c not in b" \t\n\r\x0b\x0c") if ok]
        lines = [bytes(w) for ok, w in itertools.groupby(b, lambda c: c not in b"\n\r") if ok]
        n, m, mean = max(len(words), 1), max(len(lines), 1), sum(map(len, words)) / max(len(words), 1)
        low = [fold(w) for w in words]
        return [sum(kind(c) == k for c in b) / max(len(b), 1) for k in range(10)] + [
            math.log1p(len(b)), math.log1p(len(words)), mean, math.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - mean**2)),
            sum(a == c for a, c in zip(low, low[1:])) / n, len(set(low)) / n, sum(kind(w[-1]) >= 6 for w in words) / n, sum(kind(w[0]) == 1 for w in words) / n,
            math.log1p(len(b) / m), 1 - len(set(map(fold, lines))) / m if lines else 0,
        ]

    def score(text):
        x, total = numbers(text), model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(quality.statistics(pa.array(texts)), [numbers(t) for t in texts])
    for r in quality.score_quality(docs, labels).collect():
        assert r.score == pytest.approx(score(r.text), abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_long_texts_in_parts_give_the_same(monkeypatch):
    rng = np.random.default_rng(9)
    words = np.array(["Alpha", "beta", "beta", "Gamma.", "delta!", "eps\n", "zeta\n"])
    texts = pa.array([" ".join(rng.choice(words, n)) for n in (3000, 5, 0, 1200)] + [None, "x" * 9000, "tail end"])
    def everything():  # noqa: E306
        v = toxicity.Vocabulary(np.unique(np.concatenate([h for *_, h in toxicity._features(texts)]))[:40])
        sets = {}
        for first, x, row, sizes in bytetext.shingle_sets(texts, 3):
            for r in range(len(sizes)):
                sets[first + r] = x[row == r].tolist()
        return quality.statistics(texts), v.counts(texts), sets

    whole = everything()
    monkeypatch.setattr(bytetext, "PIECE_BYTES", 2000)
    parts = everything()
    assert sum(p.more for p in bytetext.pieces(texts)) > 5
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all() and whole[2] == parts[2]


def test_language_scores_equal_loops(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "le chien et le chat", "THE DOG", "die KATZE", "12 !!", None, "", "é"]
    langs = ["en", "de", "fr", "en", "de", "en", "fr", None, "fr"]
    docs = spark.createDataFrame([(i, texts[i % 9], langs[i % 9]) for i in range(120)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where(~learning.held_out(docs.doc_id, 3, 1)))
    assert model.languages == ["de", "en", "fr"]

    def predict(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        b = text.lower().encode()
        margin, n = np.zeros(model.code.shape[1]), 0
        for w, k in zip(model.weights, language_id.ORDERS):
            for i in range(len(b) - k + 1):
                code = b[i]
                for c in b[i + 1 : i + k]:
                    code = code * 257 + c + 1
                margin += w[(code * 0x9E3779B97F4A7C15 % 2**64) >> 48]
                n += 1
        margin /= max(n, 1)
        loss = [sum(t * math.log1p(math.exp(-language_id.SHARPNESS * m * c)) for t, m, c in zip(model.trust, margin, code)) for code in model.code]
        e = [math.exp(min(loss) - x) for x in loss]
        return model.languages[int(np.argmin(loss))], max(e) / sum(e)

    for r in language_id.predict_language(docs).collect():
        lang, score = predict(texts[r.doc_id % 9])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-5)


def test_language_sample_is_bounded_when_half_the_rows_share_a_text(spark):
    docs = spark.range(40_000).selectExpr("'en' as lang", "if(id % 2 = 0, 'one and the same text', concat('text number ', id)) as text")
    rows = language_id.training_sample(docs, 500).collect()
    assert 350 <= len(rows) <= 700 and len({r.text for r in rows}) == len(rows)


def test_training_sample_is_one_row_an_id(spark):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('t', id) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, label int")
    assert sorted(r.doc_id for r in learning.labelled_sample(docs, labels, 100, "s").collect()) == [0, 1, 2]


def test_a_column_named_like_a_result_stays_out_of_scorers(spark):
    docs = spark.createDataFrame([(i, f"words {i}", -7.0) for i in range(10)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    rows = docs.where(quality.quality_scorer(docs, labels)(docs.text) >= 0).collect()
    assert len(rows) == 10 and all(r.score == -7 for r in rows)


@pytest.mark.parametrize("size", [7, 100, 4000])
def test_language_grams_over_cuts_are_counted(monkeypatch, size):
    rng = np.random.default_rng(size)
    texts = pa.array(["".join(rng.choice(list("abcé 你\n"), n)) for n in (3000, 5, 0, 1200)] + [None, "x" * 9000, "tail end"])

    def grams():
        found = [[[] for _ in language_id.ORDERS] for _ in texts]
        for first, own, orders in language_id._grams(texts):
            for k, at in enumerate(orders):
                for r, (a, b) in enumerate(zip(own[:-1], own[1:])):
                    found[first + r][k] += [x for x in at[a:b].tolist() if x < language_id.BUCKETS]
        return found

    whole = grams()
    for text, per_order in zip(texts.to_pylist(), whole):
        assert [len(x) for x in per_order] == [max(0, len((text or "").encode()) - n + 1) for n in language_id.ORDERS]
    monkeypatch.setattr(language_id, "SLICE_BYTES", size)
    assert grams() == whole


def test_a_word_repeated_a_thousand_times_is_the_same_to_fit_and_score():
    texts = pa.array(["bad " * 1000, "bad good", None])
    v = toxicity.Vocabulary(np.unique(np.concatenate([h for *_, h in toxicity._features(texts)])))
    (made,) = toxicity._training_rows(v, ["c0"])(iter([pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), texts, pa.array([1, 0, 0])], ["fold", "text", "c0"])]))
    shown = np.frombuffer(b"".join(made["x"].to_pylist()), np.uint8).reshape(3, -1)
    assert (shown == v.strengths(texts)).all() and shown.max() == round(16 * math.log1p(1000))
