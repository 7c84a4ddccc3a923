"""Operators over a whole corpus, against brute force."""

import gc
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import ODD
from pyspark.sql import functions as F

import corpus_pipeline
from chronoroll.llm import components, packing, secret_scan, sharding, shingle_join, suffix_dedup
from chronoroll.llm.common import Stash

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def classes(docs):
    """Smallest id reachable by links, over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    where, up = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def strip(docs, length=100):
    """(bytes, removed, spans, digest) by every string of the length in order."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        hit = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                hit[k : k + length] = 1
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[hit[:-1] == 0])
        out[i] = len(raw), int(hit.sum()), int((np.diff(np.append(0, hit)) == 1).sum()), kept
    return out


def variants(n, words, rng, edits):
    """Near copies: a chain in which each differs from the one before."""
    out = [list(words)]
    for _ in range(n - 1):
        w = list(out[-1])
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    common = " ".join(words(60))
    texts = list(ODD) + variants(40, words(80), rng, 1) + variants(12, words(60), rng, 3) + [" ".join(words(5)) for _ in range(10)]
    texts += [f"{' '.join(words(rng.randrange(5, 60)))} {common} {' '.join(words(rng.randrange(5, 60)))}" for _ in range(30)]
    texts += [texts[20]] * 25 + ["One TWO three", "one two THREE", "x y", f"{common} {common}", common, common + " é" * 70]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_shingle_join(spark, table, seed, monkeypatch):
    if seed == 2:  # small groups and few queries a task, so that all ways are taken
        monkeypatch.setattr(shingle_join, "GROUP", 4)
        monkeypatch.setattr(shingle_join, "QUERIES", 5)
        monkeypatch.setattr(shingle_join, "FREQUENT", 3)
        monkeypatch.setattr(shingle_join, "CROWDED", 0.5)
    texts = corpus(seed)
    report = []
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.join(spark, table(texts), report=report).collect()}
    assert got == classes(list(enumerate(texts)))
    (asked, opened), (again, late) = report
    assert 0 < opened < asked and late <= again


def test_shingle_join_on_the_tables_and_on_nothing(spark, table):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.op8_shingle_join(spark, DATA).collect()}
    assert got == classes([(r.doc_id, r.text) for r in docs.collect()])
    assert shingle_join.join(spark, table([])).count() == 0


def test_prefixes_share_a_token():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > 0.12], rng.integers(0, 1 << 63, rng.integers(0, 5)).astype(np.uint64)))
        if not len(b) or not shingle_join.similar(a, b, 80):
            continue
        late = np.sort(rng.choice(a, len(a) // 2, replace=False)) if len(a) > 1 else np.zeros(0, np.uint64)
        assert set(shingle_join.prefix(a, late)) & set(shingle_join.prefix(b, late))


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.comp for r in components.components(df, Stash(spark, "t")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert components.components(df.where("false"), Stash(spark, "t")).count() == 0


def test_later_strings():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.choice([4, 6, 40])
        segments = [(rng.randint(0, 3), 200 * k, bytes(rng.choice(b"ab") for _ in range(rng.randint(length, length + 40)))) for k in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            segments.append((9, 7, segments[0][2]))
        got = {(d, s + k) for d, s, n in suffix_dedup.later_strings(segments, length) for k in range(n)}
        at = defaultdict(set)
        for d, s, raw in segments:
            for k in range(len(raw) - length + 1):
                at[raw[k : k + length]].add((d, s + k))
        assert got == {x for v in at.values() for x in v if x != min(v)}


def test_common_prefixes_are_those_of_neighbours():
    rng = random.Random(6)
    for _ in range(100):
        text = np.array([rng.choice([0, 1, 2, 3]) if k % 9 else 0 for k in range(rng.randint(2, 120))] + [0])
        order, inverse = suffix_dedup.suffix_array(text, 6)
        got = suffix_dedup.common_prefixes(text, order, inverse, 6)
        for k in range(1, len(order)):
            a, b = (text[o:].tolist() for o in order[k - 1 : k + 1])
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            if 0 not in a[: n + 1] and 0 not in b[: n + 1]:  # beyond a break nothing is asked for
                assert got[k] == (n if n < 6 else -1)


@pytest.mark.parametrize("seed", [3])
def test_suffix_dedup(spark, table, seed):
    texts = corpus(seed) + ["abc" * 200, "é" * 300, "q" * 99, "q" * 100, "q" * 101]
    out = suffix_dedup.dedup(spark, table(texts)).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in out}
    assert got == strip(list(enumerate(texts)))
    assert suffix_dedup.dedup(spark, table([])).count() == 0


def test_suffix_dedup_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10_suffix_dedup(spark, DATA).collect()}
    assert got == {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in strip([(r.doc_id, r.text) for r in docs.collect()]).items()}


def test_sharding(spark, table):
    texts = corpus(5) + ODD
    sources = [None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{k % 5}" for k in range(len(texts))]
    docs = table(texts, sources=sources, ids=[None if k == 3 else k // 2 for k in range(len(texts))])
    rows = sharding.interleave(spark, docs, shards=7).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert Counter((r["size"], r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert [tuple(r) for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == [tuple(r) for r in sorted(sharding.interleave(spark, docs.repartition(9), shards=7).collect(), key=lambda r: (r.shard, r.slot))]
    assert sharding.interleave(spark, table([])).count() == 0


def plain_order(rows, seed=sharding.SEED):
    """(source, id) of rows by a plain sort: each source shuffled by hash, then all by fractional rank."""
    number = lambda *parts: int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:15], 16)
    by, alike = defaultdict(list), defaultdict(list)
    for i, source in rows:
        by["-" if source is None else f"+{source}"].append(i)
    for source, ids in by.items():
        alike[len(ids)].append((number(seed, source), source))
    phase = {source: (k + 0.5) / len(same) for same in alike.values() for k, (_, source) in enumerate(sorted(same))}
    out = []
    for source, ids in by.items():
        out += [((k + 1 - phase[source]) / len(ids), source, i) for k, i in enumerate(sorted(ids, key=lambda i: number(seed, i)))]
    return [i for _, _, i in sorted(out)]


def test_small_sources_lie_in_all_shards(spark, table):
    n, shards = 2400, 24
    sources = ["big"] * n + [f"only{k}" for k in range(n)] + [f"pair{k // 2}" for k in range(n)] + [None] * 7
    docs = table(["t"] * len(sources), sources=sources)
    rows = sorted(sharding.interleave(spark, docs, shards=shards).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in rows] == plain_order(list(enumerate(sources)))
    for kind in ("big", "only", "pair"):
        own = Counter(r.shard for r in rows if (sources[r.doc_id] or "").startswith(kind))
        assert all(abs(own[k] - n / shards) <= 2 for k in range(shards))


def test_every_shard_has_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    per = sharding.op9_sharding(spark, "/root/testdata/sf0.01").join(docs, "doc_id").groupBy("source", "shard").count()
    for r in per.groupBy("source").agg(F.min("count").alias("a"), F.max("count").alias("b"), F.count("shard").alias("n")).collect():
        assert r.n == 24 and r.b - r.a <= 2


def test_queries_against_duckdb(spark):
    import duckdb

    from chronoroll.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, DATA), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.select(*names).fetchall())), name


@pytest.mark.parametrize("block", [1, 250_000])
def test_hot_anchors_are_split_exactly(spark, table, monkeypatch, block):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = text(160), text(120)
    texts = [text(rng.randrange(0, 40)) + passage + text(rng.randrange(0, 40)) for _ in range(60)]
    texts += [text(9) + passage[:100] + "x" * rng.randrange(0, 9) + other for _ in range(20)] + [texts[0], texts[3] + texts[3], passage + passage, passage[30:]]
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "WIDTHS", (16, 4, 1) if block > 1 else (5, 1))
    sizes = []
    own = suffix_dedup.in_blocks
    monkeypatch.setattr(suffix_dedup, "in_blocks", lambda s, n: (sizes.append(s.groupBy("key").count().agg(F.max("count")).first()[0]), own(s, n))[1])
    out = suffix_dedup.dedup(spark, table(texts)).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in out} == strip(list(enumerate(texts)))
    assert len(sizes) > 2 and max(x or 0 for x in sizes) <= 3


def test_one_passage_in_thousands_of_surroundings(spark, table, monkeypatch):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = text(300)
    texts = [text(60) + passage + text(60) for _ in range(3000)]
    monkeypatch.setattr(suffix_dedup, "HOT", 500)
    sizes = []
    own = suffix_dedup.in_blocks
    monkeypatch.setattr(suffix_dedup, "in_blocks", lambda s, n: (sizes.append(s.groupBy("key").count().agg(F.max("count")).first()[0]), own(s, n))[1])
    out = suffix_dedup.dedup(spark, table(texts)).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in out} == strip(list(enumerate(texts)))
    assert max(x or 0 for x in sizes) <= 500


def test_rows_are_documents_whatever_their_ids(spark, table):
    texts = corpus(7)[:60]
    ids = [None if k % 9 == 4 else k // 3 for k in range(len(texts))]
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is None, ids[k] or 0))
    of = {}  # smallest id of the rows that links reach
    rank = {k: n for n, k in enumerate(order)}
    found = classes([(rank[k], texts[k]) for k in range(len(texts))])
    for k in range(len(texts)):
        n, first = found[rank[k]]
        of[k] = (ids[k], n, ids[order[first]])
    for kind in ("long", "string"):
        docs = table(texts, ids=ids)
        want = sorted(of.values(), key=repr)
        if kind == "string":
            docs = docs.withColumn("doc_id", F.format_string("k%03d", "doc_id"))
            docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != "knull", F.col("doc_id")))
            name = lambda i: None if i is None else f"k{i:03d}"
            want = sorted(((name(a), n, name(b)) for a, n, b in of.values()), key=repr)
        assert sorted(map(tuple, shingle_join.join(spark, docs).collect()), key=repr) == want
        out = suffix_dedup.dedup(spark, docs).collect()
        assert len(out) == len(texts) and all(s.end <= r.n_bytes for r in out for s in r.removed)
        assert sum(len(r.kept) for r in out) + sum(s.end - s.start for r in out for s in r.removed) == sum(len((t or "").encode()) for t in texts)
    long = "".join(chr(97 + k * k % 23) + str(k) for k in range(90))
    out = suffix_dedup.dedup(spark, table([long, "y" * 50, long, "z" + long], ids=[1, 1, 1, None])).collect()
    assert sorted((repr(r.doc_id), bytes(r.kept).decode()) for r in out) == [("1", ""), ("1", long), ("1", "y" * 50), ("None", "z")]


def test_joins_with_hot_keys(spark):
    from chronoroll.llm.common import spread_join

    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(4)
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("w")).where("c > 1 OR k % 2 = 0")
    plain = left.join(right, "k")
    for rows in (9000, 10**9):  # in the second no key is hot
        got = spread_join(left, right, ["k"], rows)
        assert sorted(map(tuple, got.select("k", "v", "c", "w").collect())) == sorted(map(tuple, plain.select("k", "v", "c", "w").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        dealt = spread_join(left, right, ["k"], 9000).withColumn("at", F.spark_partition_id())
        assert max(r["count"] for r in dealt.where("k = 7").groupBy("at").count().collect()) < 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hubs_of_links(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 0)
    links = spark.range(1, 400).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(900, 950).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = {r.node: r.comp for r in components.components(links, Stash(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(1, 400), 0), **dict.fromkeys(range(901, 951), 900)}


def test_frequent_tokens_are_bounded(spark):
    counts = spark.range(3, 2000).select((F.col("id") * 7919 - 5000).alias("token"), F.col("id").alias("c"))
    every = shingle_join.frequent_tokens(counts, 2, 10**6)
    assert len(every) == 1997 and (np.diff(every.astype(object)) > 0).all()
    some = shingle_join.frequent_tokens(counts, 2, 300)
    assert 0 < len(some) <= 300 and set(some.view(np.int64).tolist()) == {k * 7919 - 5000 for k in range(2000 - len(some), 2000)}
    assert len(shingle_join.frequent_tokens(counts.where("false"), 2, 10)) == 0


def test_the_bound_never_shuts_a_group_that_holds_a_link():
    rng = np.random.default_rng(5)
    shut = 0
    for _ in range(500):
        group = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(rng.integers(1, 5))]
        query = np.unique(np.append(group[0][rng.random(len(group[0])) > 0.15], rng.integers(0, 60, rng.integers(0, 6)).astype(np.uint64)))
        if len(query):
            most = shingle_join.largest(query, np.unique(np.concatenate(group)), 80)
            assert all(len(m) <= most for m in group if shingle_join.similar(query, m, 80))
            shut += not most
    assert shut > 20


def test_only_tables_of_the_stash_are_dropped(spark):
    stash = Stash(spark, "t")
    kept = [stash.put(spark.range(k + 1)).where("id >= 0") for k in range(5)]  # the tables themselves are named no more
    gc.collect()
    others = [spark.range(1).select("id") for _ in range(300)]
    stash.drop(*others)
    assert [df.count() for df in kept] == [1, 2, 3, 4, 5]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from chronoroll.llm.common import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_dir(session)


def test_extra_columns_do_not_clash(spark, table):
    docs = table(corpus(6)[:40]).withColumn("print", F.lit(1)).withColumn("token", F.lit(2)).withColumn("doc", F.lit(3)).withColumn("start", F.lit(4)).withColumn("id", F.lit("x")).withColumn("n", F.lit(5)).withColumn("score", F.lit(6)).withColumn("slice", F.lit(7))
    for make in (shingle_join.join, suffix_dedup.dedup, sharding.interleave, packing.pack):
        assert make(spark, docs).select("doc_id").distinct().count() == 40


def test_pipeline_by_stages(spark):
    """Each stage on what its predecessor kept, against brute force on the same rows."""
    docs = corpus_pipeline.documents(spark, DATA)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    stash, kept = Stash(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stash.put(stage(spark, before, DATA))
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    known = [r for r in labels.values()]
    assert np.mean([(r.doc_id in ids["quality_classifier"]) == (r.quality == 1) for r in known]) > 0.95
    quality = [(r.doc_id, r.text) for r in kept["quality_classifier"]]
    assert ids["ngram_jaccard_join"] == {i for i, (_, c) in classes(quality).items() if i == c}
    near = [(r.doc_id, r.text) for r in kept["ngram_jaccard_join"]]
    texts = {i: v[3].decode(errors="replace").replace("�", "") for i, v in strip(near).items()}
    got = {r.doc_id: r.text for r in kept["suffix_array_dedup"]}
    assert got == {i: t for i, t in texts.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    for r in kept["secret_scans"]:
        spans = secret_scan.base_spans(got[r.doc_id])
        assert not secret_scan.base_spans(r.text) and (spans or r.text == got[r.doc_id]) and r.n_chars == len(r.text)
    assert ids["best_fit_packing"] == ids["secret_scans"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept["best_fit_packing"])


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = corpus_pipeline.documents(spark, DATA).limit(60).selectExpr("*", "'a' AS row", "'b' AS id", "'c' AS whole", "'d' AS kept", "1 AS n", "2 AS score", "3 AS removed", "4 AS uncut")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {tuple(r) for r in out.select("row", "id", "whole", "kept", "n").collect()} == {("a", "b", "c", "d", 1)}
        docs = out


def test_pipeline_on_odd_rows(spark, table):
    docs = table(ODD * 2, langs=[None] * (2 * len(ODD)), sources=[None] * (2 * len(ODD)))
    for rows in (docs, table([])):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, DATA)
        rows.collect()


def test_pipeline_takes_rows_with_null_and_repeated_ids_one_by_one(spark):
    base = corpus_pipeline.documents(spark, DATA)
    stays = {r.doc_id for r in corpus_pipeline.quality(spark, base, DATA).collect()}
    rows = base.where("text IS NOT NULL").orderBy("doc_id").collect()
    a, b, c = [r for r in rows if r.doc_id in stays and len(r.text.split()) > 30][:3]
    junk = next(r for r in rows if r.doc_id not in stays)
    row = lambda i, t: (i, t, "en", "s", len(t or ""))
    make = lambda *rows: spark.createDataFrame(rows, base.schema)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    want = lambda *rows: sorted(rows, key=repr)
    docs = make(row(None, a.text), row(None, junk.text), row(-7, b.text), row(-7, junk.text))
    kept = corpus_pipeline.quality(spark, base.unionByName(docs), DATA)
    assert texts(kept.where("doc_id IS NULL OR doc_id < 0")) == want((None, a.text), (-7, b.text)) and kept.where("doc_id >= 0").count() == len(stays)
    docs = make(row(None, a.text), row(None, b.text), row(7, b.text), row(7, b.text), row(7, c.text), row(8, c.text), row(9, None))
    assert texts(corpus_pipeline.near_duplicates(spark, docs, DATA)) == want((None, a.text), (7, b.text), (7, c.text), (9, None))
    long = "".join(chr(97 + k * k % 23) + str(k) for k in range(90))
    docs = make(row(None, "x" + long), row(7, long), row(7, long), row(8, "other " + long + " end"), row(8, None), row(9, " "), row(10, ""))
    out = corpus_pipeline.passages(spark, docs, DATA)
    assert texts(out) == want((7, long), (8, "other  end"), (8, None), (9, " "), (10, ""), (None, "x"))
    assert {r.text: r.n_chars for r in out.collect()} == {t: len(t or "") for t in (long, "other  end", None, " ", "", "x")}
