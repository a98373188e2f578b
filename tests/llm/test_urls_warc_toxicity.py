import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs as pafs

from lumenframe.llm import toxicity, urlfilter, warc
from lumenframe.llm.common import Workspace

PAGES = "page_id long, url string, html string, rule string, digest int"


def write_pages(spark, path, rows):
    spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES).repartition(2).write.parquet(f"{path}/pages.parquet")


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_against_plain_rules(spark, tmp_path):
    urls = [None, "", "example.com/en/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en", "http://xexample.com/en/1"]
    urls += ["http://b.net/es/1", "http://net/fr/", "http://b.net/fr", "https://a.net?x=/es/", "http://ÄÉ.net/fr/ü", "http://a..com/", "x://y://z.com/", "http://a.com#/en/", "http://www.example.com/en/en/"]
    rng = random.Random(2)
    urls += [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{i}" for i in range(300)]
    rows = [(i if i else None, u, "h") for i, u in enumerate([*urls, urls[5]])]
    write_pages(spark, tmp_path, rows)
    got = sorted((tuple(r) for r in urlfilter.op7(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *plain_verdict(u)) for i, u, _ in rows), key=str)


def test_cascade_is_exact_and_has_levels(spark):
    every = [f"k{i}" for i in range(3000)]
    listed = every[::3]
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    others = [k for k in every if k not in set(listed)]
    c = urlfilter.Cascade(frame(listed), frame(others), 0)
    assert len(c.levels) > 2
    from pyspark.sql import functions as F

    assert sorted(r.key for r in frame(every).where(c.has(F.col("key"))).collect()) == sorted(listed)


def test_warc_round_trip_is_deterministic(spark, tmp_path):
    rng = random.Random(5)
    big = "é" * 700
    rows = [(i, f"http://x.com/{i}", "".join(rng.choices("abc\r\n", k=rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100, "http://a b\n", big), (101, None, big), (7, "u", big), (101, "v", big), (None, "w", big), (200, "s", "short"), (201, "s", "short"), (202, "n", None), (203, "e", "")]
    write_pages(spark, tmp_path, rows)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    manifests = []
    for k in range(2):
        out = f"file://{tmp_path}/out{k}"
        ws = Workspace(spark, "t")
        manifests.append(sorted(tuple(r) for r in warc.write(pages, out, ws, shard_bytes=20_000, roll_bytes=4_000).collect()))
    assert manifests[0] == manifests[1] and len(manifests[0]) > 4
    back = warc.read(spark, out).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        dup = h == big and i != 101
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if dup else "response", 101 if dup else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == sorted(want, key=str)
    texts = {r.page_id: bytes(r.payload).decode() for r in back if r.record_type == "response"}
    assert all(texts[i] == h for i, _, h in rows[:60])
    fs, root = pafs.FileSystem.from_uri(out)
    left = {f.base_name for f in fs.get_file_info(pafs.FileSelector(root))}
    assert left == {m[0] for m in manifests[0]} | {"manifest.jsonl"}


def test_damaged_archives_are_refused(spark, tmp_path):
    write_pages(spark, tmp_path, [(1, "u", "x" * 2000)])
    out = f"file://{tmp_path}/out"
    m = warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet"), out, Workspace(spark, "t")).first()
    path = tmp_path / "out" / m.file
    raw = path.read_bytes()
    path.write_bytes(raw[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read(spark, out).collect()


def test_empty_pages(spark, tmp_path):
    write_pages(spark, tmp_path, [])
    assert urlfilter.op7(spark, str(tmp_path)).count() == 0
    assert warc.op10(spark, str(tmp_path)).count() == 0


def test_long_hosts_are_judged_like_others(spark):
    ws = Workspace(spark, "t")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    urls = ["http://" + "a." * 20_000 + "example.com/en/x", "http://" + "b" * 200_000, "x://NET/fr/" + "y" * 100_000, None, "no"]
    got = urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules, ws).collect()
    assert {(r.rule, r.verdict) for r in got if r.url in urls[:3]} == {("example.com/en/", "block"), (None, "allow"), ("net/fr/", "block")}
    assert all(r.rule is None and r.verdict == "allow" and r.host == "" for r in got if r.url in (None, "no"))


def test_one_key_is_parted_among_shards(spark):
    rows = [(None, "http://a.b/", f"{i} " * 300) for i in range(300)] + [(7, "http://a.b/", "same " * 300)] * 300
    ws = Workspace(spark, "t")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    m = warc.write(pages, f"{ws.root}/archive", ws, shard_bytes=40_000).collect()
    assert len({r.file.split("-")[1] for r in m}) >= 8 and max(r.records for r in m) <= 120
    back = warc.read(spark, f"{ws.root}/archive").collect()
    assert len(back) == 600 and all(r.record_type == "response" for r in back)


def toxic_corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        words = [word() for _ in range(rng.randint(10, 60))]
        if toxic:
            words += rng.choices(["vilex", "nastyum", "grimozz" + word()], k=3)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_finds_held_out_rows(spark, tmp_path):
    rows = toxic_corpus()
    docs = [(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", None), (None, "vilex vilex", "en"), (0, rows[0][1], "en")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(0, 1, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op1(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out for i, _ in held)
    assert np.mean([by[i].predicted == y for i, y in held]) > 0.97
    assert by[None].predicted == 1 and by[900].predicted == by[901].predicted == 0
    used = {e.doc_id for r in got for e in r.evidence}
    assert used and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in used)


def plain_scores(ex, bags):
    """Unit TF-IDF vectors over every term as dictionaries, weights counted anew from the examples."""
    n, pos = len(ex), sum(y for _, y, _ in ex)
    df, tox = Counter(), Counter()
    for _, y, words in ex:
        for t in toxicity.terms(words):
            df[t] += 1
            tox[t] += y

    def weight(t):
        cells = [(tox[t], df[t], pos), (df[t] - tox[t], df[t], n - pos), (pos - tox[t], n - df[t], pos), (n - pos - df[t] + tox[t], n - df[t], n - pos)]
        g = sum(2 * o * math.log(o * n / (r * c)) for o, r, c in cells if o)
        return math.log(1 + n / df[t]) * math.sqrt(1 + max(0, g))

    out = []
    for words in bags:
        v = {t: (1 + math.log(c)) * weight(t) for t, c in toxicity.terms(words).items() if t in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return out


def test_nearest_equals_brute_force():
    rng = random.Random(1)
    names = [f"w{i}x{i % 4}" for i in range(90)]
    ex = [(i, int(i % 3 == 0), {**{w: rng.randint(1, 4) for w in rng.sample(names, 6)}, **({"badly": 1} if i % 3 == 0 else {})}) for i in range(700)]
    x = toxicity.Index(ex)
    vectors = dict(zip((e[0] for e in ex), plain_scores(ex, [e[2] for e in ex]), strict=True))
    asked = [e[2] for e in ex[::37]] + [{"badly": 2, "w1x1": 1, "unheard": 3}, {"w2": 1}]
    for words, own in zip(asked, plain_scores(ex, asked), strict=True):
        every = sorted(((sum(q * vectors[int(i)].get(t, 0) for t, q in own.items()), -n) for n, i in enumerate(x.ids)), reverse=True)
        want = [(s, -n) for s, n in every if s > 1e-12][: x.k]
        (got,) = x.nearest([x.vector(words)])
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-6)
        assert len(got) == len(want) and {n for s, n in got if s > want[-1][0] + 1e-6} >= {n for s, n in want if s > want[-1][0] + 2e-6}


def test_batches_keep_double_precision():
    """Common terms go through a product in single precision, which may choose candidates but not order them."""
    rng = random.Random(7)
    names = [f"v{i}x" for i in range(60)]
    ex = [(i, i % 2, {w: rng.randint(1, 9) for w in rng.sample(names, 30)} | {f"own{i}": 1, f"pair{i // 2}": 2}) for i in range(500)]
    x = toxicity.Index(ex)
    assert x.dense.shape[1] >= 60
    bags = [e[2] for e in ex] + [{}, {"unheard": 2}]
    known = toxicity.Words(x)
    vectors = x.vectors(bags, known)
    assert len(known) == len({w for b in bags for w in b}) and [len(t) for t, _ in vectors[-2:]] == [0, 0]
    whole = np.zeros((x.blocks * toxicity.BLOCK, len(x.terms)))
    whole[:, x.column >= 0] = x.dense[:, x.column[x.column >= 0]]
    for t in range(len(x.terms)):
        p = slice(x.first[x.entry[t]], x.first[x.entry[t + 1]])
        whole[x.place[p], t] = x.value[p]
    for (t, w), got in zip(vectors, x.nearest(vectors), strict=True):
        every = whole[:, t] @ w
        want = np.sort(every[every > 0])[::-1][: x.k]
        assert np.allclose([s for s, _ in got], want, rtol=0, atol=1e-13)
        assert np.allclose([s for s, _ in got], every[[n for _, n in got]], rtol=0, atol=1e-13)


def test_no_term_is_left_out_and_long_texts_score():
    ex = [(i, i % 2, {f"one{i}": 1, "shared": 1}) for i in range(40)]
    x = toxicity.Index(ex)
    assert set(x.terms) == {t for _, _, w in ex for t in toxicity.terms(w)}
    assert x.nearest([x.vector({"one7": 1})])[0][0][1] == int(np.flatnonzero(x.ids == 7)[0])
    ((score, evidence),) = x.score([Counter(f"one{i % 5000}" for i in range(1_000_000))])
    assert 0 <= score <= 1 and len(evidence) == 3


def test_toxicity_without_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r)[:4] for r in toxicity.op1(spark, str(tmp_path)).collect()] == [(1, False, 0.0, 0)]
