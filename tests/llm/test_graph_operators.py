"""Vectors, urls, archives, the pipeline."""

import base64
import hashlib
import io
import os
import random
import struct
import zipfile

import numpy as np
import pytest

import corpus_pipeline
from sparkquire.llm import embedding_join, url_filter, warc_zip

VECTORS = "vec_id long, embedding array<float>, n_links int"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema)


def brute_links(rows, t):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, n = list(range(len(good))), [0] * len(good)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(good):
        for j, (_, b) in enumerate(good[:i]):
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (v, _) in enumerate(good):
        least[top(i)] = min(least.get(top(i), v), v)
    return {v: (n[i], least[top(i)]) for i, (v, _) in enumerate(good)}


def test_cosine_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embedding_join, "LEAF_ROWS", 4)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 10))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=10) * rng.choice([0, 0.05, 0.12, 0.3])).astype(np.float32).tolist()) for i in range(160)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, [2 * x for x in rows[0][1]]), (310, [-x for x in rows[0][1]]), (320, rows[0][1][:9])]
    odd = [(400, None), (401, []), (402, [0.0] * 10), (403, [float("nan")] + [1.0] * 9), (404, [float("inf")] + [1.0] * 9), (405, [None] + [1.0] * 9), (406, [1e-30] * 10)]
    want = brute_links(rows + odd, 0.95)
    got = {r.vec_id: r for r in embedding_join.cosine_components(vectors(spark, rows + odd), 0.95).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, r in got.items():
        assert (r.n_links, r.component_id) == want.get(i, (0, i)), i
        assert r.kept == (r.component_id == i)


def test_cosine_of_doubles_and_of_no_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (3, [0.0, 1.0])]
    got = {r.vec_id: r.component_id for r in embedding_join.cosine_components(vectors(spark, rows, "vec_id long, embedding array<double>, x int"), 0.95).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert embedding_join.cosine_components(vectors(spark, []), 0.95).collect() == []
    with pytest.raises(ValueError):
        embedding_join.cosine_components(vectors(spark, []), 1.0)


# urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_urls_and_rules(spark):
    urls = ["https://WWW.Example.com/en/1?x#y", "http://example.com/en/", "http://a.example.com/en", "http://b.net/es/1", "http://b.net/ES/1", "net/es/", None, "", "x://", "http://com", "http://notexample.com/en/", "http://a?b://c/d"]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)] + [(None, "http://b.net/es/", "", 1)], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("a.example.com", "/en", "com/", "allow")
    assert got[3] == ("b.net", "/es/1", "net/es/", "block")
    assert got[4] == ("b.net", "/ES/1", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("", "", None, "allow") and got[9] == ("com", "", None, "allow")
    assert got[10][2] == "com/" and got[11][:2] == ("a", "")
    assert got[None][3] == "block"


def test_aliases_take_a_block_unless_one_is_allowed(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    turn = "<META http-equiv=refresh content='0; url={}'>"
    rows = [
        (1, "http://a.org/1", link.format("http://b.net/es/1")), (2, "http://a.org/2#top", turn.format("/1")), (3, "http://a.org/3", link.format("2")), (4, "http://b.net/es/1", ""),
        (5, "http://c.org/1", link.format("http://x.com/1")), (6, "http://c.org/2", link.format("http://c.org/1")), (7, "http://c.org/3", turn.format("http://d.net/es/2")), (8, "http://c.org/2", link.format("http://c.org/3")),
        (9, "http://e.org/1", link.format("http://e.org/1")), (10, "http://a.org/2", None), (11, "http://x.com/1", link.format("http://b.net/es/1")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages.where("page_id < 5 or page_id = 10"), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 10: "block"}
    got = {r.page_id: r.verdict for r in url_filter.judge(pages.where("page_id between 5 and 9"), RULES).collect()}
    assert got == {5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}  # x.com/1 is allowed outright
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, RULES).collect()}[4] == "block"  # its own rule stands
    extra = spark.createDataFrame([("http://e.org/1", "http://z.net/es/"), (None, "http://z.net/es/")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages.where("page_id = 9"), RULES, redirects=extra).collect()} == {9: "block"}
    assert url_filter.judge(pages.limit(0), RULES).collect() == []


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", '<link rel="canonical" href="/2">')], "page_id long, url string, html string")
    plan = url_filter.judge(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# archives

PAGES = "page_id long, url string, html string, payload_bytes int"


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2\r\nX: y", "same"), (9, None, "same"), (3, "http://a/4", "same"), (None, "http://a/5", "same"), (7, "http://a", ""), (8, "", None), (10, "http://b", "é" * 70_000), (11, "http://c", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "alone"), (None, "v", "alone")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], PAGES)
    packages = warc_zip.write_archives(pages, f"file://{tmp_path}/w", member_bytes=500)
    out = warc_zip.read_archives(packages, span_bytes=300).collect()
    assert len(out) == len(rows)
    want = []
    for i, u, h in rows:
        body = (h or "").encode()
        least = min((a for a, _, b in rows if (b or "") == (h or "") and a is not None), default=None)
        revisit = least is not None and i != least
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", least if revisit else None, None if revisit else h or ""))
    key = lambda r: str(tuple(r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in out), key=key) == sorted(want, key=key)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab", 0), (2, "v", "ab", 0), (3, "w", "abcd", 0), (4, "x", "abcd", 0)], PAGES)
    out = warc_zip.read_archives(warc_zip.write_archives(pages, str(tmp_path / "w"), min_bytes=3)).collect()
    assert {r.page_id: r.refers_to for r in out} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages_make_no_packages(spark, tmp_path):
    assert warc_zip.read_archives(warc_zip.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))).collect() == []


def test_directory_reader(tmp_path):
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        for i in range(3):
            with z.open(zipfile.ZipInfo(f"m{i}"), "w", force_zip64=i == 1) as f:
                f.write(bytes([65 + i]) * (i * 10))
    data = path.read_bytes()
    for name, at, n in warc_zip.members(io.BytesIO(data), len(data)):
        i = int(name[1])
        assert data[at : at + n] == bytes([65 + i]) * (i * 10)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    data = path.read_bytes()
    with pytest.raises(ValueError, match="compressed"):
        list(warc_zip.members(io.BytesIO(data), len(data)))
    with pytest.raises(ValueError, match="end of central directory"):
        list(warc_zip.members(io.BytesIO(data[:-30]), len(data) - 30))


def test_zip64_end_record():
    body, name = b"stored", b"n"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(body), len(body), 1, 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    full = 0xFFFFFFFF
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full, full, 1, len(extra), 0, 0, 0, 0, full) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)
    data = local + central + end64 + locator + end
    assert [(n, data[a : a + k]) for n, a, k in warc_zip.members(io.BytesIO(data), len(data))] == [("n", body)]


# the pipeline

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages_keep_their_word(spark):
    from tests.llm.test_text_operators import brute_components, brute_hits, library

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and all(before[i] == t for i, t in after.items())
        if name == "toxicity":
            assert sum(labels[i].toxic == 0 for i in before.keys() - after.keys() if i in labels) <= 2
        elif name == "quality classifier":
            gone = [labels[i].quality for i in before.keys() - after.keys() if i in labels]
            assert np.mean(gone) < 0.05
        elif name == "n-gram Jaccard join":
            least = {d: c for d, _, c in brute_components(list(before.items()), 80, 5)}
            assert set(after) == {d for d, c in least.items() if d == c}
        else:
            hit = {k[0] for k in brute_hits(list(before.items()), items) if k[5]}
            assert hit and set(after) == before.keys() - hit
        docs, before = spark.createDataFrame(rows, docs.schema), after
    lib = library()
    coded = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert coded.keys() == before.keys()
    for i in random.Random(1).sample(sorted(before), 60):
        assert np.frombuffer(coded[i].ids, "<u4").tolist() == lib.encode(before[i], add_special_tokens=False).ids
        assert coded[i].decoded_sha256 == hashlib.sha256(before[i].encode()).hexdigest()


def test_near_copy_stage_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (6, text + " end", "en", "s", 1), (None, text, "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 5), (False, 7), (False, 8), (True, None)]


def test_links_by_words_of_rel_outside_comments(spark):
    """Which tags name an alias, and that a block reaches a page through one."""
    tags = {
        '<link rel="alternate canonical" href="http://x.net/fr/a">': True, "<LINK HREF='http://x.net/fr/a' REL='canonical'>": True, "<link rel=canonical href=http://x.net/fr/a>": True,
        '<link rel="canonical-x" href="http://x.net/fr/a">': False, '<!-- <link rel="canonical" href="http://x.net/fr/a"> -->': False, "<script>'<link rel=\"canonical\" href=\"http://x.net/fr/a\">'</script>": False,
        '<meta http-equiv="refresh" content="0; url=http://x.net/fr/a">': True, '<link data-rel="canonical" href="http://x.net/fr/a">': False,
    }
    pages = spark.createDataFrame([(i, f"http://site{i}.org/", f"<html>{t}</html>") for i, t in enumerate(tags)], "page_id long, url string, html string")
    from sparkquire.llm import queries, url_filter

    got = {r.page_id: r.verdict for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert got == {i: "block" if named else "allow" for i, named in enumerate(tags.values())}
