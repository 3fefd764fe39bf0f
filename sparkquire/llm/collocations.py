"""Collocations of several words, from generalised suffix automata of bounded depth.

A task's texts are dealt into shards.  A shard's automaton covers all substrings of up to ``most`` words of its
pieces, language by language: an end position belongs to one node for each length, made from the node that is
one word shorter by the word before it (the suffix link), so levels are built by sorting pairs of numbers, without a
step a word.  A node's count is the size of its endpos set; nodes of one endpos set are one state, from which all
its substrings are enumerated with one count.

Counts are reduced globally in two passes.  The first one counts hashes of single words and pairs; those that are
frequent are put in a bit set.  The second one counts phrases by their words, exactly, but only those whose words and
pairs may be frequent.  A collision of hashes lets a phrase through to the exact count, no more.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut, release
from .bytetext import LOWER, SpanHashes, give_back, mix, pieces, word_spans
from .sieve import Sieve

#: Bytes of text of one automaton: temporaries take about 50 bytes for each.  Counts of a task's shards meet before they are shuffled.
SHARD_BYTES = 2 << 20
#: Hash parts of a language whose best rows are found before those of the whole language.
RANK_PARTS = 256
#: A phrase never runs over one of these.
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(b".,;:!?\n\v\f\r")] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[list(b" \t")] = True
_HORNER = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Shard:
    """Words of some texts: number of each in ``words``, its language, how many words back its piece
    goes (itself included, ``most`` at the furthest), and whether it counts as an end (else it is only context)."""

    words: pa.Array
    word: np.ndarray
    lang: np.ndarray
    depth: np.ndarray
    ends: np.ndarray


def _shards(lang: pa.Array, text: pa.Array, most: int, size: int) -> Iterator[tuple[list[str], Shard]]:
    """All words of the texts.  A text longer than a shard goes on with the last words of the part before as context."""
    names = lang.dictionary_encode()
    of = np.asarray(names.indices, np.int64)
    none = tail = np.zeros(0, np.uint8)
    for p in pieces(text, between=IS_GAP, most=size):
        body, offsets, held = p.body, p.offsets, 0
        if p.part:
            body, held, tail = np.concatenate([tail, body]), len(tail), none if not p.more else tail
            offsets = np.array([0, len(body)])
        starts, ends, counts = word_spans(body, offsets, IS_GAP)
        if not len(starts):
            continue
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        letters = LOWER[body[~IS_GAP[body]]]
        spelt = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        seen = np.concatenate([[0], np.cumsum(IS_BREAK[body], dtype=np.int32)])
        new = np.ones(len(starts), bool)
        new[1:] = seen[starts[1:]] > seen[ends[:-1]]
        first = np.cumsum(counts) - counts
        new[first[counts > 0]] = True
        place = np.arange(len(starts))
        depth = np.minimum(place - np.maximum.accumulate(np.where(new, place, 0)) + 1, most)
        row = np.repeat(np.arange(p.rows), counts) + p.first
        if p.more:
            after = np.append(new[1:], seen[-1] > seen[ends[-1]])  # whether a piece ends behind a word
            tail = np.concatenate([np.append(body[starts[i] : ends[i]], ord("." if after[i] else " ")).astype(np.uint8) for i in range(max(0, len(starts) - most + 1), len(starts))])
        yield names.dictionary.to_pylist(), Shard(spelt.dictionary, np.asarray(spelt.indices, np.int64), of[row], depth, starts >= held)


@dataclass
class States:
    """One row a state: an end position, the lengths of its shortest and longest substring, the size of its endpos set."""

    end: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray


def automaton(shard: Shard, most: int) -> States:
    """The states of the shard's suffix automaton up to depth ``most``."""
    size, found = len(shard.words), []
    node, up = shard.lang, None  # the root of each language
    for k in range(1, most + 1):
        at = np.flatnonzero(shard.ends & (shard.depth >= k))
        if not len(at):
            break
        keys, end, inverse, count = np.unique(node[at] * size + shard.word[at - k + 1], return_index=True, return_inverse=True, return_counts=True)
        link, short = keys // size, np.full(len(keys), k)
        if up is not None:
            same = count == up["count"][link]  # one endpos set with the suffix
            short[same] = up["short"][link[same]]
            up["longest"][link[same]] = False
        up = {"count": count, "short": short, "end": at[end], "longest": np.ones(len(keys), bool), "k": k}
        found.append(up)
        node = np.full(len(shard.word), -1)
        node[at] = inverse
    if not found:
        return States(*(np.zeros(0, np.int64) for _ in range(4)))
    pick = lambda name: np.concatenate([u[name][u["longest"]] for u in found])
    return States(pick("end"), pick("short"), np.concatenate([np.full(int(u["longest"].sum()), u["k"]) for u in found]), pick("count"))


def _word_hashes(words: pa.Array) -> np.ndarray:
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return SpanHashes(np.frombuffer(data, np.uint8))(at[:-1], at[1:])


def _hashes(shard: Shard, langs: list[str], own: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """The hash of language and words of the substring of ``length`` words up to each end, the same in all shards."""
    root = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    x = root[shard.lang[end]]
    for j in range(length - 1, -1, -1):
        x = x * _HORNER + own[shard.word[end - j]]
    return mix(x + np.uint64(length)).view(np.int64)


def _pair_counts(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n): hashes of single words and pairs with their counts in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, shard in _shards(batch["lang"], batch["text"], 2, size):
                own, states = _word_hashes(shard.words), automaton(shard, 2)
                for k in (1, 2):
                    on = np.flatnonzero((states.shortest <= k) & (k <= states.longest))
                    yield pa.RecordBatch.from_arrays([pa.array(_hashes(shard, langs, own, states.end[on], k)), pa.array(states.count[on])], ["key", "n"])
        give_back()

    return run


def _phrase_counts(sieve: Sieve, most: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, k, n) of a shard's substrings whose words and pairs pass, and all words' number as k = 0."""

    def rows(langs: list[str], shard: Shard) -> Iterator[pa.RecordBatch]:
        own, states, n = _word_hashes(shard.words), automaton(shard, most), len(shard.word)
        names = pa.array(langs, pa.string())
        total = np.bincount(shard.lang[shard.ends], minlength=len(langs))
        yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(langs)), pa.array([0] * len(langs), pa.int32()), pa.array(total)], ["lang", "phrase", "k", "n"])
        pair = np.flatnonzero(shard.depth >= 2)
        passes = np.zeros(n, bool)
        passes[pair] = sieve.passes(_hashes(shard, langs, own, pair, 2))
        place = np.arange(n)
        chain = place - np.maximum.accumulate(np.where(passes, -1, place))  # pairs on end that pass, up to each place
        text = shard.words.cast(pa.large_string())
        for k in range(1, most + 1):
            on = np.flatnonzero((states.shortest <= k) & (k <= states.longest))
            end = states.end[on]
            good = sieve.passes(_hashes(shard, langs, own, end, 1)) if k == 1 else chain[end] >= k - 1
            on, end = on[good], end[good]
            if len(on):
                said = [text.take(pa.array(shard.word[end - j])) for j in range(k - 1, -1, -1)]
                phrase = said[0] if k == 1 else pc.binary_join_element_wise(*said, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(shard.lang[end])), phrase.cast(pa.string()), pa.array(np.full(len(on), k, np.int32)), pa.array(states.count[on])], ["lang", "phrase", "k", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, shard in _shards(batch["lang"], batch["text"], most, size):
                yield from rows(langs, shard)
        give_back()

    return run


def _dropped(spark: SparkSession) -> None:
    """Drops shuffles that no frame refers to.  The JVM learns a moment later which frames Python has dropped, so its
    collection comes after that."""
    release(spark)
    time.sleep(1)
    release(spark)


def phrase_counts(docs: DataFrame, most: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, k, n), checkpointed: every phrase of k = 1 to ``most`` words that occurs ``least`` times or more
    in a language, overlaps included, and as phrase '' with k = 0 the number of the language's words.

    A-Z count as a-z.  ``.,;:!?`` and the line ends \\n \\v \\f \\r part texts into pieces, space and tab part a piece into words;
    words are joined by one space.  A null text is empty, a null language ``und``."""
    if most < 2:
        raise ValueError("a phrase has two words at least")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    pairs = rows.mapInArrow(_pair_counts(SHARD_BYTES), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    sieve = Sieve(cut(pairs.where(F.col("n") >= least).select("key")))
    del pairs
    _dropped(docs.sparkSession)  # the first pass's shuffle isn't kept beside the second's
    found = rows.mapInArrow(_phrase_counts(sieve, most, SHARD_BYTES), "lang string, phrase string, k int, n long")
    return cut(found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0)))


def _cuts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, cut, l, r): each phrase of two words or more at each of its cuts."""
    rows = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    rows = rows.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    for side, name in (("first", "l"), ("rest", "r")):
        part = counts.where("k >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(name))
        rows = rows.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase")
    return rows


def collocations(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words.

    a is the phrase's count, l and r those of its two parts at the cut of the lowest score (of equal ones the first),
    score = floor(1000000 a a / (l r)) in exact integers; n the number of the language's words.  A phrase is left out
    if a longer one that holds it has ``share`` per cent of its count or more: the phrases one word longer suffice, as any in
    between occurs at least as often; each gives its count to its suffix link and, mirrored, to its prefix.
    Rank by score and count, both descending, then the phrase's bytes.  Counts follow ``phrase_counts``; no words, no rows.
    """
    counts = phrase_counts(docs, most, least, text, lang)
    _dropped(docs.sparkSession)
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    scored = _cuts(counts).withColumn("_top", F.lit(1_000_000).cast("decimal(7,0)") * a * a).withColumn("_base", l * r).withColumn("score", F.expr("_top div _base"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = counts.where("k >= 3").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - k)"), F.expr("substring_index(phrase, ' ', k - 1)"))).alias("phrase"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rows = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rows = rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # each part's best first, so that no task orders all of a language's phrases
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("k = 0").select("lang", "n")
    return rows.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
