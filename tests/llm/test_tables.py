"""Search, url filters, mixing, shards, the registered queries and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from common import SCHEMA, WORDS, documents, empty, rows
from pyspark.sql import functions as F
from test_dedup import brute_components
from test_texts import toxic_rows
from tokenizers import Tokenizer

import __spark_entry__
from kvlake.llm import hamming, mixing, sharding, url_filter
from kvlake.llm.store import saved


def test_top_k(spark):
    r = random.Random(3)
    codes = [(i, r.getrandbits(64) - (1 << 63)) for i in range(60)] + [(100 + i, 5) for i in range(15)] + [(200, None), (201, 4)]
    asked = [c for c in codes if c[0] % 20 == 0]
    got = defaultdict(list)
    for x in hamming.top_k(spark.createDataFrame(asked, "query_id long, code long"), spark.createDataFrame(codes, "id long, code long"), k=5, code_block=20, query_block=2).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["distance"], x["id"]))
    for q, code in asked:
        want = sorted(((code ^ c) & (1 << 64) - 1).bit_count() * 1000 + i for i, c in codes if c is not None)[:5] if code is not None else []
        assert [d * 1000 + i for d, i in got[q]] == want
    clash = spark.createDataFrame(codes, "id long, code long").withColumns({n: F.lit(1) for n in ("n", "q", "qb", "cb", "rank", "distance")})
    again = hamming.top_k(clash.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), clash, k=5)
    assert {(x["query_id"], x["rank"], x["id"], x["distance"]) for x in again.collect()} == {(q, n + 1, i, d) for q, found in got.items() for n, (d, i) in enumerate(found)}
    few = spark.createDataFrame(codes[:3], "id long, code long")
    assert hamming.top_k(few.withColumnRenamed("id", "query_id"), few, k=5).count() == 9
    assert hamming.top_k(few.withColumnRenamed("id", "query_id").limit(0), few.limit(0)).count() == 0


def test_search_verifies_a_small_share():
    """Of a block of random codes, a query verifies about a tenth; the answers are exact."""
    r = np.random.default_rng(6)
    codes = r.integers(0, 2**64, 1 << 16, dtype=np.uint64)
    index = hamming.Index(codes, np.arange(len(codes)), 64, 4)
    for q in r.integers(0, 2**64, 20, dtype=np.uint64):
        ids, far = index.search(q, 10)
        d = np.bitwise_count(codes ^ q)
        assert ids.tolist() == np.lexsort((np.arange(len(codes)), d))[:10].tolist() and far.tolist() == sorted(d.tolist())[:10]
    assert index.verified < 0.2 * 20 * len(codes)


def test_codes(spark):
    vectors = [([1.0] * 64,), ([-1.0] * 63 + [2.0],), ([0.0] * 64,), ([1.0] * 3,), (None,)]
    df = spark.createDataFrame(vectors, "v array<float>").select(hamming.sign_code("v", 64))
    assert [r[0] for r in df.collect()] == [-1, -(1 << 63), 0, None, None]


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.net/en/private"), ("allow", "org"), ("block", "a.org/x/"), ("block", "dup.com/"), ("allow", "dup.com/")]


def brute_rule(host, path):
    fits = []
    for verdict, rule in RULES:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((h.count("."), len(slash + p), verdict == "block", verdict, rule))
    return max(fits)[3:] if fits else ("allow", None)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://net", "https://net/", "HTTP://WWW.Example.NET/en/1?q#f", "https://example.net/en/privateer", "https://x.a.org/x/y", "https://org?q=/x/",
            "https://nonet/", "x://dup.com/a://b", "https://é.net/ü", "https://a.org:80/x/", "https://example.net#/en/", "https://example.net/en"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*urls, urls[5]])], "page_id int, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, RULES).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["verdict"], got[i]["rule"]) == (host, path, *brute_rule(host, path)), u
    assert (got[6]["host"], got[6]["path"], got[9]["host"], got[9]["path"], got[14]["path"]) == ("www.example.net", "/en/1", "org", "", "")
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
    for limit in ({"max_rules": 2}, {"max_bytes": 100}):
        with pytest.raises(ValueError):
            url_filter.judge_urls(df, RULES, **limit)
    clash = url_filter.judge_urls(df.withColumns({"host": F.lit(1), "verdict": F.lit(2)}), RULES)
    assert {r["page_id"]: r["verdict"] for r in clash.collect()} == {i: r["verdict"] for i, r in got.items()}


def test_targets():
    assert mixing.targets([10, 10, 10], [1.0, 2.0, 3.0]) == [5.0, 10.0, 15.0]
    got = mixing.targets([1, 100, 100], [3.0, 1.0, 2.0])
    assert got[0] == 3.0 and abs(sum(got) - 201) < 1e-9 and abs(got[2] - 2 * got[1]) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1.0, 2.0]) == [0.0, 0.0]


def test_mixing(spark):
    r = random.Random(1)
    data = [(i, " ".join(["w"] * r.randint(0, 30)), None, [None, "b", "a", "ä"][min(3, i % 5)], None) for i in range(1500)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("size", F.lit("mine"))
    got = mixing.mix(df).select("doc_id", "mix.*").collect()
    assert len(got) == 1500
    names, source = ["a", "b", "ä", None], {i: s for i, _, _, s, _ in data}
    sizes = [sum(len(WORDS.findall(t)) for _, t, _, s, _ in data if s == n) for n in names]
    goal = mixing.targets(sizes, [1.0, 2.0, 3.0, 1.0])
    taken = Counter()
    for x in got:
        n = names.index(source[x["doc_id"]])
        assert (x["source_size"], x["target"]) == (sizes[n], goal[n])
        assert x["taken"] == len(x["shards"]) * x["size"] <= 3 * x["size"]
        taken[n] += x["taken"]
    assert all(abs(taken[n] - goal[n]) <= 31 for n in range(4))
    again = {r["doc_id"]: r["mix"]["shards"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["shards"] for x in got}
    out = mixing.mixed_rows(df)
    assert out.columns[:6] == df.columns
    rows_out = [(x["doc_id"], x["size"], x["mix_shard"], x["mix_order"]) for x in out.collect()]
    assert Counter((i, s) for i, _, s, _ in rows_out) == Counter((x["doc_id"], s) for x in got for s in x["shards"])
    # shuffled in fact: rows lie by shard and hash, and a shard's first rows are of all sources
    assert rows_out == sorted(rows_out, key=lambda x: x[2:]) and {x[1] for x in rows_out} == {"mine"}
    assert len({source[i] for i, _, s, _ in rows_out[:40]}) == 4 and [i for i, *_ in rows_out] != sorted(i for i, *_ in rows_out)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(documents(spark)).count() == len(rows())


def test_repeated_rows_are_drawn_together(spark):
    df = spark.createDataFrame([(i % 50, "w " * 3, None, f"s{i % 3}", None) for i in range(600)], SCHEMA)
    taken = {}
    for x in mixing.mix(df).collect():
        assert taken.setdefault((x["doc_id"], x["source"]), x["mix"]["shards"]) == x["mix"]["shards"]


def test_splitting_tree_shares_all_draws():
    leaf = mixing.split_tree(np.array([1000, 10, 0, 57]), 7, 3)
    assert leaf.sum(axis=0).tolist() == [1000, 10, 0, 57] and leaf.min() >= 0 and np.ptp(leaf.sum(axis=1)) <= 3


def test_hilbert_index_is_a_curve(spark):
    bits = 3
    cells = spark.range(1 << 3 * bits).select(*[F.expr(f"cast(shiftright(id, {bits * d}) & {(1 << bits) - 1} as int)").alias(f"d{d}") for d in range(3)])
    got = cells.select("*", sharding.hilbert_index([F.col("d0"), F.col("d1"), F.col("d2")], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(1 << 3 * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in zip(got, got[1:], strict=False))


def test_shards_follow_the_curve(spark):
    """Shard and slot are the places in the order of curve, text, size and id; curve values follow from quantiles."""
    df = spark.createDataFrame([(i * 7 % 400, "t" * (i % 50) + str(i % 9), None, f"s{i % 3}", None) for i in range(400)], SCHEMA)
    got = sharding.hilbert_shards(df).collect()
    order = sorted(got, key=lambda r: (r["curve"], r["text_crc32"], r["size"], r["doc_id"]))
    assert [(r["shard"], r["slot"]) for r in order] == [(s, n) for s in range(16) for n in range(25)]


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: i if i else 1 << 60, lambda i: i % 2])
def test_no_cell_or_range_is_hot(spark, ids):
    """One source, one size and an outlier or repeated ids: cells of unique ids stay even, and ranges split what is in one cell."""
    n = 6400
    df = spark.createDataFrame([(ids(i), "text", None, "one", None) for i in range(n)], SCHEMA)
    got = sharding.hilbert_shards(df)
    if ids(2) != ids(0):
        cells = sorted(r["count"] for r in got.groupBy("curve").count().collect())
        assert cells[-1] <= 2 * n / 64 + 2
    parts = [r["count"] for r in df.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(8, "doc_id", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) <= 2 * n / 8 and got.groupBy("shard").count().filter(f"count <> {n // 16}").isEmpty()


def test_written_shards_can_be_pruned(spark, tmp_path):
    r = random.Random(2)
    data = [(i, "x" * int(r.lognormvariate(5, 1)), "en", f"src{r.randrange(8)}", None) for i in range(4000)]
    df = spark.createDataFrame([(*x[:4], len(x[1])) for x in data], SCHEMA).withColumn("row", F.lit("own"))
    sharding.write_shards(df, str(tmp_path / "out"), shards=64)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(x[:4] for x in back.select("doc_id", "text", "lang", "source").collect()) == sorted(x[:4] for x in data)
    files = sharding.file_ranges(back, "doc_id", "source", "n_chars").collect()
    assert len(files) >= 64 and sum(f["rows"] for f in files) == 4000
    for name, low, high in (("doc_id", 500, 600), ("source", "src3", "src3"), ("n_chars", 1000, 10**9)):
        met = [f for f in files if f[f"{name}_min"] <= high and f[f"{name}_max"] >= low]
        assert len(met) <= 0.5 * len(files), name


@pytest.mark.parametrize("n", [0, 5, 500])
def test_shards(spark, n):
    df = documents(spark) if n == 0 else spark.createDataFrame([(i, "t" * (i % 50), None, f"s{i % 3}", None) for i in range(n)], SCHEMA)
    got = sharding.hilbert_shards(df.withColumns({"curve": F.lit(1), "place": F.lit("x"), "n": F.lit(2)})).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sharding.hilbert_shards(empty(spark)).count() == 0


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    """Every stage and the whole run against plain Python, over planted toxic documents, copies and personal data."""
    toxic = toxic_rows(700)
    data = [(i, f"{t} mail me{i}@example.com", "en", f"s{i % 3}") for i, t, _ in toxic]
    data += [(5000 + i, f"{t} mail me{i}@example.com", "en", "s1") for i, t, bad in toxic[:60] if not bad]
    data += [(8000 + i, t and f"{t} 10.0.0.{i}", lang, source) for i, t, lang, source, _ in rows()[:-2]]
    docs = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in data], SCHEMA).withColumn("extra", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, bad) for i, _, bad in toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    bad = {i for i, _, y in toxic if y}
    kept, folder = docs, str(tmp_path)
    texts_of = lambda df: {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts_of(kept)
        kept, _ = saved(stage(spark, kept, folder))
        assert kept.columns == docs.columns, name
        after = texts_of(kept)
        if name == "toxicity":
            clean = {i for i, _, y in toxic if not y}  # of the labelled kind; others are of another vocabulary
            assert len(bad & set(after)) <= 0.05 * len(bad) and len(clean - set(after)) <= 0.02 * len(clean)
        if name == "near_dedup":
            assert set(after) == {i for i, _, _, own in brute_components(list(before.items())) if own}
            assert not any(i + 5000 in after for i in after)
        if name == "pii":
            assert set(after) == set(before) and kept.filter(F.length("text") != F.col("n_chars")).isEmpty()
            for i, t in before.items():
                assert t is None or ("@example.com" not in after[i] and f"10.0.0.{i - 8000}" not in after[i])
                assert t is None or i < 5000 or after[i].startswith(t.rsplit(" ", 1)[0][:20])
        if name == "mixing":
            assert set(after) <= set(before) and max(r["count"] for r in kept.groupBy("doc_id").count().collect()) <= 3
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in ((r[0], r[1]) for r in kept.select("doc_id", "text").collect()):
        tokens = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        n = len(tokens)
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes()))] += 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_pipeline_without_labels_of_both_classes(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r[0] for r in corpus_pipeline.drop_toxic(spark, documents(spark), str(tmp_path)).select("doc_id").collect()} == {r[0] for r in rows()}
