"""Language of whole texts by error-correcting output codes over byte n-grams.

Each language has a codeword of bits; a binary n-gram classifier (pooled log-odds of the
languages with that bit set against the others) predicts each bit.  The codeword of least
loss, bits weighted by how well they do on the training sample, names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back, pieces
from .learning import held_out
from ..storage import cut

SAMPLE_ROWS = 2_000
ORDERS = (2, 3)
BUCKETS = 1 << 16
#: A longer text comes in parts of so many bytes, cut anywhere; the n-grams over a cut are counted with the part behind it.
SLICE_BYTES = 400_000
ANYWHERE = np.ones(256, bool)
#: Sharpness of a bit's margin, and the gap of the two best scores below which a text is ambiguous.
SHARPNESS, GAP = 8.0, 0.2
MOST_EXHAUSTIVE = 6


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """classes x bits of -1 and 1.  Up to MOST_EXHAUSTIVE classes: every split in two, once;
    beyond: the best separated of many random codes of 15 log2(classes) bits."""
    if classes <= MOST_EXHAUSTIVE:
        bits = [[1 if c == 0 or (m >> (c - 1)) & 1 else -1 for c in range(classes)] for m in range(2 ** max(0, classes - 1) - 1)]
        return np.array(bits, np.int8).reshape(len(bits), classes).T
    rng, best, apart = np.random.Generator(np.random.PCG64(seed)), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, int(np.ceil(15 * np.log2(classes)))))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        gap = int((code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(classes, dtype=bool)].min())
        if gap > apart:
            best, apart = code, gap
    return best


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first row, offsets, bucket of the n-gram at each byte for each of ORDERS) of pieces of
    the lower-cased texts; BUCKETS where an n-gram would run over its text's end.  A later part of a text begins
    with the last bytes of the one before, from which only n-grams that reach into it count."""
    tail, back = np.zeros(0, np.uint8), max(ORDERS) - 1
    for p in pieces(pc.utf8_lower(column.cast(pa.large_string())), ANYWHERE, SLICE_BYTES):
        own, part, held = p.offsets, p.body, 0
        if p.part:
            part, held = np.concatenate([tail, part]), len(tail)
            own = np.array([0, len(part)])
        if p.more:
            tail = part[-back:]
        left = np.repeat(own[1:], np.diff(own)) - np.arange(len(part))
        code, found = part.astype(np.uint64), []
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                nxt = np.zeros(len(part), np.uint64)
                nxt[: max(0, len(part) - n + 1)] = part[n - 1 :]
                code = code * np.uint64(257) + nxt + np.uint64(1)
            if n in ORDERS:
                bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
                bucket[left < n] = BUCKETS
                bucket[: max(0, held - n + 1)] = BUCKETS
                found.append(bucket)
        yield p.first, own, found


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # len(ORDERS) x (BUCKETS + 1) x bits
    trust: np.ndarray  # of each bit

    def margins(self, column: pa.Array) -> np.ndarray:
        """Mean log-odds of each bit over a text's n-grams; 0 for a text without any."""
        bits = self.code.shape[1]
        out, count = np.zeros((len(column), bits)), np.zeros(len(column))
        if not bits:
            return out
        for first, own, found in _grams(column):
            some = np.flatnonzero(np.diff(own))
            for w, at in zip(self.weights, found):
                if len(some):
                    out[first + some] += np.add.reduceat(w[at], own[:-1][some], axis=0)
                    count[first + some] += np.add.reduceat(at < BUCKETS, own[:-1][some])
        return out / np.maximum(count, 1)[:, None]

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        loss = np.stack([(np.logaddexp(0, -SHARPNESS * margins * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return e / e.sum(axis=1, keepdims=True)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch["lang"].to_pylist(), object)
        for first, own, found in _grams(batch["text"]):
            of = np.repeat(lang[first : first + len(own) - 1], np.diff(own))
            for x in set(lang[first : first + len(own) - 1]):
                mine = of == x
                counts = np.stack([np.bincount(at[mine], minlength=BUCKETS + 1)[:BUCKETS] for at in found])
                sums[x] = sums.get(x, 0) + counts
    give_back()
    for x, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], ["lang", "counts"])


def training_sample(docs: DataFrame, bound: int) -> DataFrame:
    """(lang, text), checkpointed: about ``bound`` different texts of each language at most, chosen by
    a hash of the text.  A text counts once for a language however often it is repeated."""
    docs = docs.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    totals = {r.lang: r.n for r in docs.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    share = F.lit(0)
    for x in sorted(totals):
        share = F.when(F.col("lang") == x, min(1_000_000, int(1_000_000 * bound / max(totals[x], 1)) + 1)).otherwise(share)
    # copies of a chosen text are one row before they are shuffled
    return cut(docs.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text"))


def fit(docs: DataFrame, bound: int = SAMPLE_ROWS) -> Codes:
    """docs: lang, text, rows of a null lang or text left out (see ``training_sample``)."""
    languages = sorted(r.lang for r in docs.where("lang is not null and text is not null").select("lang").distinct().collect())
    sample = training_sample(docs, bound)
    counts = {x: np.zeros((len(ORDERS), BUCKETS)) for x in languages}
    for r in sample.mapInArrow(_count_rows, "lang string, counts binary").toLocalIterator():
        counts[r.lang] += np.frombuffer(r.counts, np.int64).reshape(len(ORDERS), BUCKETS)
    code = codewords(len(languages))
    weights = np.zeros((len(ORDERS), BUCKETS + 1, code.shape[1]), np.float32)
    if code.shape[1]:
        rates = np.stack([(c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * BUCKETS) for c in counts.values()])
        for b in range(code.shape[1]):
            on, off = rates[code[:, b] > 0].mean(axis=0), rates[code[:, b] < 0].mean(axis=0)
            weights[:, :BUCKETS, b] = np.log(on / off)
    model = Codes(languages, code, weights, np.ones(code.shape[1]))
    if code.shape[1]:
        model.trust = _trust(sample, model)
    return model


def _trust(sample: DataFrame, model: Codes) -> np.ndarray:
    """Each bit's weight: the log-odds of its being right on the sample, scaled to a mean of 1."""
    bits = model.code.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = model.code[[model.languages.index(x) for x in batch["lang"].to_pylist()]]
            right = ((model.margins(batch["text"]) * truth) > 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits)), pa.array(right.astype(np.int64)), pa.array(np.full(bits, len(batch)))], ["bit", "hits", "n"])

    rows = sample.mapInArrow(run, "bit long, hits long, n long").groupBy("bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    out = np.ones(bits)
    for r in rows:
        p = (r.hits + 1) / (r.n + 2)
        out[r.bit] = max(np.log(p / (1 - p)), 0.01)
    return out * bits / out.sum()


def predict_language(docs: DataFrame, folds: int = 3, fold: int = 1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row.

    Held-out ids (crc32 of the id as text, modulo ``folds``, is ``fold``) and null languages are
    never learnt from; a null id is not held out.  A text that is null or has no letter is
    ``und`` with score 0; so is every text if no language can be learnt.  score is the best
    codeword's share; ambiguous: the second comes within GAP of it.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), folds, fold).alias("held_out"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(base.where("not held_out").select("lang", "text")))
    base = base.select("doc_id", "held_out", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False))
            if model.languages:
                p = np.sort(q := model.probabilities(model.margins(batch["text"])), axis=1)
                best, score = q.argmax(axis=1), np.where(letters, p[:, -1], 0.0)
                gap = p[:, -1] - p[:, -2] if p.shape[1] > 1 else np.ones(len(p))
                names = [model.languages[b] if a else "und" for a, b in zip(letters, best)]
            else:
                names, score, gap = ["und"] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score), pa.array(letters & (gap < GAP))], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
        give_back()

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
