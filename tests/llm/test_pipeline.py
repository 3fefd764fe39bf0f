"""The pipeline as a whole against plain loops over a small table, and its stages on odd rows."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquire.llm import learning, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, predicted int"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi ome".split()
pytestmark = pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic, poor, copied, nearly copied, contaminated, empty, null, repeated and clean documents."""
    rng = random.Random(1)
    rows, labels = [], []
    line = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate((14, 30, 6))]
    for i in range(240):
        text = line(rng.randint(20, 120))
        if i % 6 == 1:
            text += " vile scum and vile filth " + line(5)
        if i % 6 == 2:
            text = "".join(rng.choice("$#%&!@*7") for _ in range(rng.randint(50, 300)))
        labels.append((i, int(i % 6 != 2), int(i % 6 == 1)))
        rows.append([i, text])
    for i in range(240, 300):  # without labels
        kind, base = i % 5, rows[rng.choice([k for k in range(0, 240, 6)])][1]
        rows.append([i, (base, base + " tail", line(30) + " " + items[i % 3][1].upper() + " " + line(9), line(60), base.upper())[kind]])
    rows += [[300, None], [301, ""], [302, "  "], [303, "one two"], [303, line(40)], [None, line(40)], [0, rows[0][1]], [304, line(50) + " filth vile scum vile"]]
    out = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", "s", len(t or ""), -7.0, 9) for i, t in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def words8(text):
    return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def one_of_each(rows):
    def sets(text):
        w = words8(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    shingles, root = [sets(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(shingles):
        for j in range(i):
            if a and shingles[j] and 100 * len(a & shingles[j]) >= 80 * len(a | shingles[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if shingles[i] else ("none", i), []).append(r)
    return groups


def brute_clean(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = split(text)
    for _, t in items:
        item = split(t)
        n = min(10, len(item))
        if n and {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} & {tuple(item[j : j + n]) for j in range(len(item) - n + 1)}:
            return False
    return True


def test_run_equals_loops(spark, folder):
    from tokenizers import Tokenizer

    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    known = lambda c, n: labels.where(~learning.held_out(labels.doc_id, 5, 0)).select("doc_id", F.col(c).alias(n))
    chain = toxicity.fit(docs.select("doc_id", "text"), known("toxic", "toxic"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = chain.probabilities(pa.array([t for _, t in rows]))[:, -1] > 0.5
    assert {d for (d, _), b in zip(rows, bad) if b} >= {1, 7, 304} and bad.sum() <= 42
    rows = [r for r, b in zip(rows, bad) if not b]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    trees = quality.fit(left, known("quality", "label"))
    good = trees.score(quality.statistics(pa.array([t for _, t in rows]))) >= 0.3
    rows = [r for r, g in zip(rows, good) if g]
    assert not {d for d, _ in rows} & {2, 8, 14}
    groups, items = one_of_each(rows), [tuple(r) for r in items.collect()]
    lib = Tokenizer.from_file(queries.TOKENIZER)
    out = corpus_pipeline.run(spark, folder).collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)

    def digest(row):
        ids = lib.encode(row[1] or "", add_special_tokens=False).ids
        return row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    want = Counter()
    for name, group in groups.items():
        # one of the least id; if several texts share it, any one of them
        best = min(group, key=lambda r: (r[0] is not None, r[0] or 0))
        assert len({r for r in group if r[0] == best[0]}) == 1
        if brute_clean(best[1], items):
            want[digest(best)] += 1
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r.score == -7 and r.predicted == 9 for r in rows)


def test_empty_tables_pass_through(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
