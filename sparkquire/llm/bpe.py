"""Byte-level BPE with a lexicon of frequent words as a minimal acyclic transducer.

Words are counted over all documents; the most frequent ones and their token ids are compiled
into an automaton whose states share suffixes and whose arcs carry numbers that add up to a
word's place in a table of ids.  The automaton is one file of flat arrays, written to the shared
folder and fetched by each executor, that every worker maps into memory.  A word that it lacks is
merged exactly by the ranks, so the lexicon decides speed, never results.

The words of a text are worked through in runs; one word is merged as a whole, with some 150 bytes
of memory for each of its bytes, as exact merging needs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back
from ..storage import cut, modest_batches, shared_dir, store

LEXICON_WORDS = 65_536
LEXICON_BYTES = 32  # the longest word in the lexicon
CACHED_BYTES = 16 << 20  # of words and ids that a task keeps, each with 200 for its place
TEXTS_AT_ONCE = 128
WORDS_AT_ONCE = 200_000
LONG_TEXT = 2_000_000
COUNTED_WORDS = 300_000
SHORT_WORD = 64  # bytes up to which words are merged together
PAIR_FACTOR, NO_RANK = 0x9E3779B1, (1 << 31) - 1

#: Fixed values of the byte-level split: contractions, letters, numbers, others, white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The same for texts in which \w, \d and \s of the quicker module mean the same: those without ODD.
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile(r"[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """Vocabulary, merge ranks and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or odd or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        of_char = {c: b for b, c in byte_characters().items()}
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_char[c] for c in token)
        self.special = {}
        for t in spec.get("added_tokens") or []:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} strips or wants word bounds")
            self.special[t["content"]] = t["id"]
            known = all(c in of_char for c in t["content"])
            self.bytes_of[t["id"]] = bytes(of_char[c] for c in t["content"]) if known else t["content"].encode()
        self.of_byte = [vocab[c] for _, c in sorted(byte_characters().items())]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.table = None
        self.special_split = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the least rank first, and of equal ranks the leftmost."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        merges, none = self.merges, (len(self.merges), 0)
        while len(ids) > 1:
            found = [merges.get(p, none) for p in zip(ids, ids[1:])]
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs: n log n for words of any length."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merges[a, b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := merges.get((ids[i], ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[j]]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Open addressing over pair keys, a fifth of it filled at most: keys (or -1), ranks and merged ids."""
        slots = 1 << max(4, (5 * len(self.merges)).bit_length())
        keys, ranks, merged = np.full(slots, -1), np.full(slots, NO_RANK, np.int32), np.zeros(slots, np.int32)
        for (a, b), (rank, to) in self.merges.items():
            k = (a << 20) | b
            at = ((k * PAIR_FACTOR) >> 20) & (slots - 1)
            while keys[at] >= 0:
                at = (at + 1) & (slots - 1)
            keys[at], ranks[at], merged[at] = k, rank, to
        return keys, ranks, merged

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if none) and merged id of each pair of ids."""
        if self.table is None:
            self.table = self._pair_table()
        keys, ranks, merged = self.table
        key = (a << 20) | b
        at = ((key * PAIR_FACTOR) >> 20) & (len(keys) - 1)
        seeking = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(seeking):
            at[seeking] = (at[seeking] + 1) & (len(keys) - 1)
            seeking = seeking[(keys[at[seeking]] != key[seeking]) & (keys[at[seeking]] >= 0)]
        return ranks[at], merged[at]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many short words at once: all ids, and where each word's begin (n + 1).  In
        each round every unfinished word merges its leftmost pair of least rank."""
        length = np.array([len(w) for w in words], np.int64)
        ids = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        rank, to = np.full(len(ids), NO_RANK), np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], to[inner] = self.pairs(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < NO_RANK, size)
            if not live.all():
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                ids, word, rank, to = ids[live], word[live], rank[live], to[live]
                size, least = size[least < NO_RANK], least[least < NO_RANK]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            ids[at] = to[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = NO_RANK
            at = at - np.arange(len(at))  # one element goes before each later place
            ids, word, rank, to = ids[keep], word[keep], rank[keep], to[keep]
            fresh = np.concatenate([at, at[at > 0] - 1])
            fresh = fresh[fresh + 1 < len(ids)]
            rank[fresh] = NO_RANK
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], to[fresh] = self.pairs(ids[fresh], ids[fresh + 1])
        ids, word = np.concatenate([*done_ids, ids]), np.concatenate([*done_words, word])
        order = np.argsort(word, kind="stable")
        return ids[order].astype("<u4"), np.searchsorted(word[order], np.arange(len(words) + 1))

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in runs; a special token is a word of its own."""
        parts, at = [], 0
        if self.special_split:
            for m in self.special_split.finditer(text):
                parts += [(text[at : m.start()], False), (m[0], True)]
                at = m.end()
        parts.append((text[at:] if at else text, False))
        for part, special in parts:
            if special:
                yield [part]
            elif part:
                pattern = SPLIT if ODD.search(part) else PLAIN_SPLIT
                if len(part) < LONG_TEXT:
                    yield pattern.findall(part)
                else:
                    found = (m[0] for m in pattern.finditer(part))
                    while run := list(islice(found, WORDS_AT_ONCE)):
                        yield run

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the ids put together; ids that the vocabulary lacks are left out."""
        table = self.bytes_of
        try:
            return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        except KeyError:
            return b"".join(table.get(i, b"") for i in ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Transducer:
    """A minimal acyclic automaton of words with their ids, on flat arrays.

    Arcs are sorted by state and byte (``keys`` = state * 256 + byte).  ``outputs`` of the arcs on a
    word's path, plus 1 for each final state passed on the way, add up to its number in
    byte order; ``offsets`` and ``ids`` hold the ids by that number.
    """

    FIELDS = ("keys", "targets", "outputs", "final", "offsets", "ids")
    TYPES = ("<u8", "<u4", "<u4", "<u1", "<u4", "<u4")

    def __init__(self, arrays: list[np.ndarray]):
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = arrays
        self.bytes = memoryview(self.ids).cast("B")  # of the mapped file: nothing is copied

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Transducer:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, arcs) of minimal states

        def freeze(node: list) -> int:
            """The minimal state of a finished node [final, {byte: state}]."""
            key = (node[0], tuple(node[1].items()))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, last = [[False, {}]], b""
        for word in words:
            common = len(os.path.commonprefix([word, last]))
            while len(path) > common + 1:
                state = freeze(path.pop())
                path[-1][1][last[len(path) - 1]] = state
            for _ in word[common:]:
                path.append([False, {}])
            path[-1][0], last = True, word
        while len(path) > 1:
            state = freeze(path.pop())
            path[-1][1][last[len(path) - 1]] = state
        root = freeze(path[0])
        size = [0] * len(states)  # targets are frozen before their sources
        keys, targets, outputs = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for byte, target in arcs:
                keys.append(((len(states) - 1 - s) if s != root else 0, byte))
                targets.append(target)
                outputs.append(n - int(final))
                n += size[target]
            size[s] = n
        # the root is frozen last, so that turning the numbers round makes it state 0
        turn = lambda s: len(states) - 1 - s
        flat = np.array([s * 256 + b for s, b in keys], "<u8")
        order = np.argsort(flat, kind="stable")
        lists = [entries[w] for w in words]
        return cls([
            flat[order],
            np.array([turn(t) for t in targets], "<u4")[order],
            np.array(outputs, "<u4")[order],
            np.array([int(f) for f, _ in reversed(states)], "<u1"),
            np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("<u4"),
            np.array(list(chain.from_iterable(lists)), "<u4"),
        ])

    def save(self, folder: str) -> str:
        """Writes the arrays behind their lengths to a folder of any store; the file is named by its content."""
        arrays = [np.ascontiguousarray(getattr(self, f), t) for f, t in zip(self.FIELDS, self.TYPES)]
        body = np.array([len(a) for a in arrays], "<u8").tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)
        uri = f"{folder}/lexicon-{hashlib.sha256(body).hexdigest()[:24]}.bin"
        system, path = store(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as file:
            file.write(body)
        return uri

    @classmethod
    def map(cls, path: str) -> Transducer:
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, arrays = raw[: 8 * len(cls.FIELDS)].view("<u8"), 8 * len(cls.FIELDS), []
        for n, t in zip(sizes.tolist(), cls.TYPES):
            nbytes = n * np.dtype(t).itemsize
            arrays.append(raw[at : at + nbytes].view(t))
            at += nbytes + -nbytes % 8
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words walk the arcs together, a byte at a step."""
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(words) or not len(self.keys):
            return np.full(len(words), -1)
        length = np.array([len(w) for w in words])
        joined, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length
        alive = np.arange(len(words))
        alive = alive[length <= LEXICON_BYTES]
        lost = np.ones(len(words), bool)
        step = 0
        while len(alive):
            ended = length[alive] == step
            lost[alive[ended]] = self.final[state[alive[ended]]] == 0
            alive = alive[~ended]
            if not len(alive):
                break
            key = (state[alive] * 256 + joined[begin[alive] + step]).astype(np.uint64)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            number[alive] += self.outputs[arc] + self.final[state[alive]]
            state[alive] = self.targets[arc]
            step += 1
        return np.where(lost, -1, number)


class Encoder:
    """Words to ids by cache, then lexicon, then exact merging."""

    def __init__(self, model: Tokenizer, lexicon: Transducer | None = None):
        self.model, self.lexicon = model, lexicon
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def learn(self, words: Iterable[str]) -> None:
        """Puts the words that the cache lacks into it."""
        if self.cached > CACHED_BYTES:
            self.forget()
        new = list(set(words).difference(self.cache))
        data = [w.encode("utf-8", "replace") for w in new]
        found = self.lexicon.find(data) if self.lexicon is not None else np.full(len(new), -1)
        for k in [k for k, w in enumerate(new) if w in self.model.special]:
            self.cache[new[k]] = np.array([self.model.special[new[k]]], "<u4").tobytes()
            found[k] = -2
        hit, miss = np.flatnonzero(found >= 0), np.flatnonzero(found == -1)
        if len(hit):
            at = found[hit]
            body, a, b = self.lexicon.bytes, (self.lexicon.offsets[at].astype(np.int64) * 4).tolist(), (self.lexicon.offsets[at + 1].astype(np.int64) * 4).tolist()
            self.cache.update(zip([new[k] for k in hit.tolist()], [bytes(body[x:y]) for x, y in zip(a, b)]))
        short = [k for k in miss.tolist() if len(data[k]) <= SHORT_WORD]
        if short:
            ids, at = self.model.merge_many([data[k] for k in short])
            body, at = ids.tobytes(), (at * 4).tolist()
            self.cache.update(zip([new[k] for k in short], [body[x:y] for x, y in zip(at, at[1:])]))
        for k in miss.tolist():
            if len(data[k]) > SHORT_WORD:
                self.cache[new[k]] = np.array(self.model.merge(data[k]), "<u4").tobytes()
        self.cached += sum(map(len, data)) + sum(len(self.cache[w]) for w in new) + 200 * len(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held: list[list[list[str]]] = []
        waiting = 0

        def flush():
            self.learn(w for runs in held for run in runs for w in run)
            get = self.cache.__getitem__
            out.extend(b"".join(map(get, chain.from_iterable(runs))) for runs in held)
            held.clear()

        for text in texts:
            if len(text) >= LONG_TEXT:
                flush()
                parts = []
                for run in self.model.words(text):
                    self.learn(run)
                    parts.append(b"".join(map(self.cache.__getitem__, run)))
                out.append(b"".join(parts))
                waiting = 0
                continue
            held.append(list(self.model.words(text)))
            waiting += sum(map(len, held[-1]))
            if waiting > WORDS_AT_ONCE:
                flush()
                waiting = 0
        flush()
        return out


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(name: str, lexicon: str | None) -> Encoder:
    """One encoder a worker process, on the mapped lexicon file; both names are of files that Spark ships."""
    key = (name, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer(SparkFiles.get(name)), Transducer.map(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[key]


def ship(spark, uri: str) -> str:
    """Has every executor fetch a file from the driver or a store; its name there.  Again with the same uri does nothing."""
    modest_batches(spark)
    spark.sparkContext.addFile(uri)
    return os.path.basename(uri)


def _word_counts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = tokenizer(SparkFiles.get(name)), Counter()

        def rows():
            kept = [(b, n) for w, n in counts.items() if len(b := w.encode("utf-8", "replace")) <= LEXICON_BYTES and w not in model.special]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for a in range(0, len(batch), TEXTS_AT_ONCE):
                for text in batch["text"].slice(a, TEXTS_AT_ONCE).to_pylist():
                    for words in model.words(text or ""):
                        counts.update(words)
                if len(counts) > COUNTED_WORDS:
                    yield rows()
        yield rows()
        give_back()

    return run


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS, text: str = "text") -> str:
    """Counts the words of all texts, compiles the most frequent (``size`` at most) and ships
    the file to every executor; its name there.

    Counts are grouped by magnitude (steps of 2 %), and the lexicon takes the largest magnitudes that
    fit: the driver gets one row for each magnitude and ``size`` words, and no sort runs.
    """
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_word_counts(ship(docs.sparkSession, path)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1").select("word", F.floor(F.ln("n") * 50).cast("int").alias("magnitude")))
    least, taken = None, 0
    for r in sorted(counts.groupBy("magnitude").count().collect(), reverse=True):  # at most 50 ln(words) rows
        taken += r["count"]
        if taken > size:
            break
        least = r.magnitude
    model = tokenizer(path)
    frequent = [] if least is None else [bytes(r.word) for r in counts.where(F.col("magnitude") >= least).select("word").collect()]
    made = Transducer.build({w: model.merge(w) for w in frequent})
    return ship(docs.sparkSession, made.save(shared_dir(docs.sparkSession)))


def encode_decode(docs: DataFrame, path: str, lexicon: str | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, ids (binary: little-endian unsigned 32-bit) and decoded (the
    text that the ids give).  A null text is empty: no ids, and decoded is empty too."""
    keep = [c for c in keep if c not in ("ids", "decoded")]
    rows, name = docs.select(*keep, F.col(text).alias(" text")), ship(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, lexicon)
        for batch in batches:
            for a in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.slice(a, TEXTS_AT_ONCE)
                ids = coder.encode([x or "" for x in part[" text"].to_pylist()])
                decoded = [coder.model.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*keep, "ids", "decoded"])
        coder.forget()
        give_back()

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kinds}ids binary, decoded string")


def digests(coded: DataFrame, doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns ``keep`` of ``encode_decode``'s rows."""
    return coded.select(F.col(doc_id), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *(keep or []))
