import random
import zlib

from tidemark.llm import licenses as li
from tidemark.llm import linededup as ld
from tidemark.llm import sharding as sh


def test_shards(spark):
    rng = random.Random(1)
    rows = [(rng.choice([i, 5]), "é" * rng.randint(0, 30)) for i in range(500)] + [(600, None), (None, "x")] + [(7, "same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS part", "3 AS shard").repartition(5)
    got = sh.place(df, shards=16).collect()
    assert len(got) == len(rows)
    sizes = {}
    for k in range(16):
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        sizes[k] = sum(r.size for r in own)
    assert sum(sizes.values()) == sum(len((t or "").encode()) + 1 for _, t in rows) and max(sizes.values()) - min(sizes.values()) <= 2 * 61
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in line]
    assert ids == sorted(ids)  # contiguous in the order of ids
    assert sorted((r.doc_id or 0, r.text_crc32) for r in got) == sorted((k or 0, zlib.crc32((t or "").encode())) for k, t in rows)
    kept = sh.place(df, keep=["text", "part"]).collect()
    assert sorted((r.doc_id or 0, r.shard, r.slot) for r in kept) == sorted((r.doc_id or 0, r.shard, r.slot) for r in got)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.part == 2 for r in kept)
    assert sh.place(df.limit(0)).collect() == []
    assert [(r.shard, r.slot) for r in sh.place(df.limit(1)).collect()] == [(8, 0)]


def test_lines(spark):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(30)] + ["", "  ", "\tpadded "]
    rows = []
    for i in range(300):
        k = rng.randint(0, 5)
        own = [rng.choice(lines[: rng.choice([5, 33])]) + rng.choice(["", " ", "\r"]) for _ in range(k)]
        rows.append((rng.choice([i, 3, None]), "\n".join(own) if k else rng.choice([None, ""]), rng.choice([None, *map(str, range(12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS line", "2 AS lines", "3 AS k")
    sites: dict = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r") and s is not None:
                sites.setdefault(x.strip(" \t\r"), set()).add(s)
    for least in (3, 8, 12):
        bad = {x for x, s in sites.items() if len(s) >= least}
        want = []
        for k, t, _ in rows:
            all_ = t.split("\n") if t else []
            kept = [x for x in all_ if x.strip(" \t\r") not in bad]
            want.append((k, len(all_), len(all_) - len(kept), "\n".join(kept)))
        assert sorted(map(tuple, ld.remove(df, min_sites=least).collect()), key=repr) == sorted(want, key=repr)
        assert sorted(map(tuple, ld.remove(df, min_sites=least, shipped=0).collect()), key=repr) == sorted(want, key=repr)  # by a join
    assert ld.remove(df.limit(0)).collect() == []


def test_long_texts_of_lines_and_sizes(spark):
    rows = [(i, "\n".join(["all have this", *(f"{i} {j}" for j in range(40_000))]), str(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.n_lines, r.n_removed) for r in ld.remove(df).collect()} == {(40_001, 1)}
    assert {r.size for r in sh.place(df).collect()} == {len(t.encode()) + 1 for _, t, _ in rows}


def test_many_sites(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('common', char(10), 'own ', id) AS text", "cast(id % 1500 AS string) AS source")
    for least, removed in ((1000, 1), (1500, 1), (1501, 0), (2500, 0)):
        assert ld.remove(df, min_sites=least).where(f"n_removed <> {removed}").count() == 0


def test_licenses(spark):
    filler = "lorem ipsum dolor " * 200
    mit = li.TEMPLATES["mit"]
    most = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    rows = [
        (1, filler + mit + filler), (2, "under the MIT-License. and Apache license"), (3, filler + most), (4, filler + " ".join(mit.split()[::2])),
        (5, None), (6, ""), (7, "GENERAL PUBLIC license general public mit license license"), (8, li.TEMPLATES["apache"] + filler * 5 + li.TEMPLATES["gpl"]),
        (9, filler + "This work is\nlicensed under CC BY-NC 4.0.### " + filler), (10, "licensed under CC BY NC"), (11, filler * 60 + li.TEMPLATES["gpl/notice"] + ". " + filler * 60),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS places", "2 AS blocks")
    got = {r.doc_id: r for r in li.scan(df).collect()}
    found = {k: {b.template for b in r.blocks} for k, r in got.items()}
    assert found[1] == {"mit"} and found[3] == {"mit"} and found[4] == set() and found[8] == {"apache", "gpl", "apache/notice"} and found[5] == found[6] == set()
    assert "cc-by-nc/notice" in found[9] and found[10] == set() and found[11] == {"gpl/notice"} and got[11].n_words > 70_000
    assert [(p.first, p.label) for p in got[2].places] == [(2, "mit"), (5, "apache")] and got[5].n_words == 0
    assert [(p.first, p.label) for p in got[7].places] == [(0, "gpl"), (5, "mit")]
    assert li.scan(df.limit(0)).collect() == []


def test_license_join_matches_brute_force(monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    for _ in range(200):
        templates = {str(k): " ".join(rng.sample(vocabulary, rng.randint(2, 12))) for k in range(4)}
        frequency = {w.encode(): rng.randint(0, 9) for w in vocabulary}
        t, whole = rng.choice([0.5, 0.8, 1.0]), rng.choice([0, 5])
        monkeypatch.setattr(li, "WHOLE", whole)
        block = [rng.choice(vocabulary).encode() for _ in range(rng.randint(0, 30))]
        want = {}
        for k, text in templates.items():
            s = {w.encode() for w in text.split()}
            if len(s & set(block)) >= (t * len(s) - 1e-9 if len(s) >= whole else len(s)):
                want[k] = len(s & set(block)) / len(s)
        assert li.Index.of(templates, frequency, t).matches(block) == want


def test_templates_are_met_in_the_documents(spark):
    """The query's own table has notices: each is found, with its label."""
    d = "/root/testdata/sf0.01"
    got = li.op7_license_templates(spark, d).where("n_blocks > 0").collect()
    assert len(got) >= 15 and {r.labels for r in got} >= {"apache", "cc-by-nc", "gpl", "mit"} and {r.score for r in got} == {1.0}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert all("CC BY-NC" in texts[r.doc_id] for r in got if r.labels == "cc-by-nc")
