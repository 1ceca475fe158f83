"""Operators against brute force on the smallest tables and on awkward hand-made rows."""

import array
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import exact, lines, mixing, neighbours, packing, queries, repeats, sharding, simhash, toxicity, warc
from shelfwise.llm.components import components

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, offset string, fingerprint int"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def awkward_rows():
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 5, 1, "x", "y", 1),
        (1, "one two three four five six seven eight", "en", "a", 5, 1, "x", "y", 1),
        (2, "one two three four five six seven eight", "en", "b", 5, 2, "x", "y", 2),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 1, "x", "y", 1),
        (None, "text without an id", "en", "a", 3, 1, "x", "y", 1),
        (None, "text without an id", "en", "a", 3, 1, "x", "y", 1),
        (5, LONG, "en", None, 1, 1, "x", "y", 1),
        (6, LONG + "end", "en", "c", 1, 1, "x", "y", 1),
        (7, " \t\n\r ", "en", "", 1, 1, "x", "y", 1),
        (8, "a" * 5000, "en", "c", 1, 1, "x", "y", 1),
        (9, "emoji \U0001f600 and   blanks   <|endoftext|> x", "en", "c", 1, 1, "x", "y", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], AWKWARD)


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


# ---- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text, n=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def check_simhash(pairs, got):
    pairs = sorted(pairs.items())
    prints = [plain_fingerprint(t) for _, t in pairs]
    near = [(i, j) for i in range(len(pairs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = roots_of(len(pairs), near)
    assert got == {pairs[i][0]: (f"{prints[i]:016x}", pairs[roots[i]][0]) for i in range(len(pairs))}


def test_simhash_equals_brute_force(spark, small, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, small).collect()}
    check_simhash(documents, got)


def test_simhash_tiles_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {centre}
    while len(prints) < 120:
        prints.add(centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False)))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "TILE", 16)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df, 4, 7).collect()]
    at = {p: i for i, p in enumerate(prints)}
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    brute = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert roots_of(len(prints), [(at[a], at[b]) for a, b in links]) == roots_of(len(prints), brute)


def test_simhash_awkward(awkward, empty):
    rows = simhash.simhash_groups(awkward).collect()
    assert len(rows) == 12 and set(rows[0].asDict()) == {*awkward.columns, "component_id", "is_kept"}
    by_text = {r["text"]: r for r in rows}
    assert by_text[None]["fingerprint"] == "0" * 16 and by_text[None]["component_id"] == 3 == by_text[""]["component_id"]
    assert by_text["text without an id"]["component_id"] is None
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    found = kept.collect()
    assert len(found) == len({r["fingerprint"] for r in rows}) or len(found) < 12
    assert Counter(r["doc_id"] for r in found)[1] == 1 and Counter(r["doc_id"] for r in found)[None] == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(500, 560)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 500 for i in range(500, 560)}, 1000: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeated byte strings -------------------------------------------------------------


def plain_repeats(texts, length):
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]) if raw else b""
        spans = int((np.diff(np.r_[False, gone[:-1], False].astype(int)) == 1).sum())
        out.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, small, documents):
    found = queries.op2_repeats(spark, small).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == dict(zip(documents, plain_repeats(documents.values(), 400)))
    assert sum(v[1] for v in got.values()) > 0


def test_repeats_at_every_kind_of_edge(spark):
    rng = np.random.default_rng(2)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    shared, other = noise(90), noise(60)
    texts = ["", "short"]
    for length in range(38, 52):
        a = int(rng.integers(0, 40))
        texts.append(noise(int(rng.integers(0, 50))) + shared[a : a + length] + noise(int(rng.integers(0, 50))))
    texts += [noise(30) + other + noise(5) + other + noise(3), "ab" * 100, "x" * 70, noise(50) + "x" * 41]
    texts += [shared + other, other + shared, noise(200), shared[:45] + "é" + shared[45:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = repeats.without_repeats(df, length=40, gram=8, steps=(16, 4, 1), with_text=True).collect()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(found, key=lambda r: r["doc_id"])]
    assert got == plain_repeats(texts, 40)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)


def test_repeats_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 100)
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdef"), 900))
    texts = [base, base[37:500] + "Q" + base[500:], "zz" + base[300:380], base[100:139]]
    spots = []
    for raw in (t.encode() for t in texts):
        for first, last, place, grams in repeats.Sampler(40, 8).anchors(raw):
            assert ((place >= first) & (place >= last) & (place + 8 <= first + 40)).all()
            spots.append(sum(last - first + 1))
    assert sum(spots) == sum(max(0, len(t) - 39) for t in texts)


def test_repeats_awkward(awkward, empty):
    rows = repeats.without_repeats(awkward).collect()
    assert len(rows) == 12
    assert {r["n_bytes"] for r in rows if r["text"] in (None, "")} == {0}
    assert repeats.without_repeats(empty).count() == 0


# ---- archives --------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1500
    odd = 'line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n' + "é" * 700
    rows = [
        (1, "http://www.A.example/x?q=1#f", big, 7), (2, "https://b.example:8080", big, 7), (3, None, "small", 7), (4, "http://b.example/", "small", 7),
        (5, "no address\r\nInjected: yes", odd, 7), (6, "http://b.example/", odd, 7), (None, "http://c.example/", big, 7), (7, "u", None, 7), (7, "u", None, 7),
        (2, "https://b.example:8080", big, 7),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, run int")
    found = warc.captures(spark, pages, str(tmp_path / "w"), records_per_file=2).collect()
    assert len(found) == len(rows)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert got == Counter(
        {
            (1, "revisit", 2, 1500): 1, (2, "response", None, 1500): 2, (None, "revisit", 2, 1500): 1, (3, "response", None, 5): 1,
            (4, "response", None, 5): 1, (5, "revisit", 6, len(odd.encode())): 1, (6, "response", None, len(odd.encode())): 1, (7, "response", None, 0): 2,
        }
    )
    digest = {r["page_id"]: r["payload_digest"] for r in found}
    assert digest[5] == hashlib.sha1(odd.encode()).hexdigest() and digest[7] == hashlib.sha1(b"").hexdigest()
    ordered = sorted(found, key=lambda r: (r["index_part"], r["index_row"]))
    keys = [(r["url_key"], r["captured"]) for r in ordered]
    assert keys == sorted(keys) and "example,a)/x?q=1" in {k for k, _ in keys}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures(spark, none, str(tmp_path / "e")).count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    # Very long payloads beside short ones, and columns named like those of records, entries and the index.
    rows = [(i, f"http://a.example/{i}", "é" * (30_000 if i % 7 == 0 else i), "x", 1, "y", 2, b"z") for i in range(60)]
    rows.append((60, "http://a.example/60", "long " * 400_000, "x", 1, "y", 2, b"z"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value string, id int, content string, index_part int, digest binary")
    path = tmp_path / "cut"
    found = {r["page_id"]: r for r in warc.captures(spark, pages, str(path), records_per_file=10, file_bytes=200_000).collect()}
    assert {i: r["payload_bytes"] for i, r in found.items()} == {r[0]: len(r[2].encode()) for r in rows}
    assert {i: r["record_type"] for i, r in found.items() if r["record_type"] == "revisit"} == {7 * i: "revisit" for i in range(8)}
    assert all(found[i]["payload_digest"] == hashlib.sha1(r[2].encode()).hexdigest() for i, r in enumerate(rows))
    sizes = Counter({f.name: f.stat().st_size for f in path.glob("*.txt")})
    held = Counter(r["file"].rsplit("/", 1)[1] for r in found.values())
    assert max(held.values()) <= 10 and all(n <= 200_000 or held[f] == 1 for f, n in sizes.items())


def test_loser_tree():
    rng = np.random.default_rng(4)
    for k in range(9):
        runs = [sorted((int(x), i) for x in rng.integers(0, 50, rng.integers(0, 30))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# ---- sharding --------------------------------------------------------------------------


def check_shards(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    n = [counts[s] for s in range(shards)]
    assert max(n) - min(n) <= 1 and sum(n) == len(rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        text = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sharding.even_shards(docs).collect()
    check_shards(rows, 8)
    where = defaultdict(set)
    for r in rows:
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    again = {r["doc_id"]: r["shard"] for r in sharding.even_shards(docs.repartition(3)).collect()}
    assert len(again) == len(rows)


# Fewest parts that all groups can lie in, by hand: 90 of 100 rows don't fit in seven shards; three groups of
# 40 fill eight shards of 15; of thirty pairs four shards of eight rows and four of seven hold 28 whole.
@pytest.mark.parametrize(
    "copies, fewest", [([90, 5, 4, 1], 11), ([40] * 3, 10), ([103], 8), ([1] * 20, 20), ([13] * 8, 8), ([2] * 30, 32)]
)
def test_shards_of_large_groups(spark, copies, fewest):
    rows = [(i * 1000 + j, f"text {i}") for i, n in enumerate(copies) for j in range(n)]
    found = sharding.even_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(found, 8)
    assert len({(r["text"], r["shard"]) for r in found}) == fewest


def test_shards_of_a_hot_group_beside_many_pairs(spark):
    texts = ["hot"] * 10_000
    for i in range(2_000):
        texts += [f"text {i}"] * (2 + i % 2)
    texts += [f"free {i}" for i in range(30_000 - len(texts))]
    found = sharding.even_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check_shards(found, 8)
    where = defaultdict(set)
    for r in found:
        where[r["text"]].add(r["shard"])
    assert len(where["hot"]) == 3
    assert all(len(s) == 1 for text, s in where.items() if text != "hot")


def test_shards_awkward(awkward, empty):
    check_shards(sharding.even_shards(awkward).collect(), 8)
    assert sharding.even_shards(empty).count() == 0


# ---- toxicity --------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op5_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = found.where("held_out").select("score", "predicted", "toxic").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in found.limit(50).collect())
    toxic, clean = ([r for r in rows if r["toxic"] == t] for t in (1, 0))
    above = sum((a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in toxic for b in clean)
    assert above / (len(toxic) * len(clean)) > 0.95
    assert sum(r["predicted"] for r in toxic) > 0.6 * len(toxic) and sum(r["predicted"] for r in clean) < 0.01 * len(clean)


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(i, 0, int(i in (2, 5))) for i in range(1, 9)] + [(None, 0, 1), (4, 0, None), (3, 0, 7)], "doc_id long, quality int, toxic int")
    docs = awkward.withColumn("score", F.lit("clash"))
    rows = toxicity.toxicity(spark, docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.toxicity(spark, empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(spark, awkward, labels.where("false")).collect()} == {0.0}
    assert len({r["score"] for r in toxicity.toxicity(spark, awkward, labels.where("toxic = 0")).collect()}) == 1
    assert toxicity.without_toxic(awkward, awkward, labels).columns == awkward.columns


# ---- exact copies ----------------------------------------------------------------------


def test_exact_awkward(awkward, empty):
    rows = exact.exact_groups(awkward).collect()
    sizes = {r["text"]: r["group_size"] for r in rows}
    assert sizes["one two three four five six seven eight"] == 3 and sizes[None] == sizes[""] == 2
    kept = [r["doc_id"] for r in rows if r["kept"]]
    assert sorted(kept, key=lambda x: -1 if x is None else x) == [None, 2, 4, 5, 6, 7, 8, 9]
    assert all(r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows)
    assert exact.exact_groups(empty).count() == 0 and exact.without_copies(awkward).columns == awkward.columns


def test_exact_spreads_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i // 4}") for i in range(6000)]
    settings = {
        "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = exact.exact_groups(docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert len(found) == 6000
    for r in found:
        ids = groups[r["text"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), r["doc_id"] == max(ids))
    hot = Counter(r["task"] for r in found if r["text"] == "the same text")
    assert len(hot) > 16 and max(hot.values()) < 2000 / 4


def test_exact_with_a_digest_that_many_texts_share(awkward):
    plain = exact.exact_groups(awkward)
    weak = exact.exact_groups(awkward, digest=lambda t: F.length(t) % 3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, weak.collect()))


# ---- nearest neighbours ----------------------------------------------------------------


def test_neighbours_recall_and_order(spark):
    folder = "/root/testdata/sf0.1"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, vectors = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    found = defaultdict(list)
    for r in sorted(queries.op7_neighbours(spark, folder).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        got = found[ids[q]]
        assert [g[0] for g in got] == list(range(1, 11)) and got == sorted(got)
        at = {i: k for k, i in enumerate(ids)}
        assert all(abs(s - d[at[v]]) < 1e-12 and v != ids[q] for _, s, v in got)
        d[q] = np.inf
        true = {int(ids[i]) for i in np.lexsort((ids, d))[:10]}
        hits, total = hits + len(true & {g[2] for g in got}), total + 10
    assert hits / total >= 0.9


def test_neighbours_awkward(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]),
        (6, []), (None, [1.0, 0.0]), (7, [1.0, 0.5]), (100, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 4.0]), (300, [2.0]),
    ]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found)
    assert got == [
        (0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 0.5), (0, 3, 7, 0.5),
        (100, 1, 0, 0.0), (100, 2, 0, 0.0), (100, 3, 7, 0.5), (200, 1, 8, 1.0),
    ]
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


# ---- mixing ----------------------------------------------------------------------------


def test_mixing_near_targets_and_rerun(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = mixing.mixture(docs).collect()
    by = defaultdict(int)
    for r in first:
        by[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = {r["source"]: r["target"] for r in first}
    assert all(abs(by[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in first)) < 1e-6
    again = mixing.mixture(docs.repartition(5)).collect()
    assert {r["doc_id"]: r["taken"] for r in first} == {r["doc_id"]: r["taken"] for r in again}
    placed, order = mixing.mix(docs)
    steps = sorted(order.select("finish", "before_words", "words").collect(), key=lambda r: r["before_words"])
    assert all(a["finish"] <= b["finish"] and a["before_words"] + a["words"] == b["before_words"] for a, b in zip(steps, steps[1:]))


def test_mixing_awkward(awkward, empty):
    rows = mixing.mixture(awkward).collect()
    assert len(rows) == 12 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if not (r["text"] or "").strip()} == {0}
    assert mixing.mixture(empty).count() == 0
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns and out.count() > 0


# ---- lines -----------------------------------------------------------------------------


def plain_lines(documents, size=8):
    places, sets = [], {}
    for d, t in sorted(documents.items()):
        for i, line in enumerate(t.split("\n")):
            if line.strip(" "):
                places.append((d, i, line))
                if line not in sets:
                    sets[line] = {line[k : k + size] for k in range(len(line) - size + 1)} or {line}
    return places, sets


def test_lines_equal_brute_force(spark, small, documents):
    places, sets = plain_lines(documents)
    texts = list(sets)
    index = defaultdict(set)
    for i, t in enumerate(texts):
        for s in sets[t]:
            index[s].add(i)
    links = set()
    for i, t in enumerate(texts):
        shared = Counter(j for s in sets[t] for j in index[s] if j < i)
        links |= {(i, j) for j, n in shared.items() if n >= 0.8 * (len(sets[t]) + len(sets[texts[j]]) - n)}
    roots = dict(zip(texts, roots_of(len(texts), links)))
    seen, gone = set(), defaultdict(set)
    for d, i, line in places:
        if roots[line] in seen:
            gone[d].add(i)
        seen.add(roots[line])
    got = {r["doc_id"]: r for r in queries.op9_lines(spark, small).collect()}
    wrong = [d for d, t in documents.items() if got[d]["n_removed"] != len(gone[d])]
    assert len(wrong) <= 0.01 * len(documents)
    for d, t in documents.items():
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert d in wrong or got[d]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    assert sum(map(len, gone.values())) > 0


def test_lines_awkward(spark, awkward, empty):
    rows = lines.without_similar_lines(awkward, with_text=True).collect()
    assert len(rows) == 12 and {r["n_lines"] for r in rows if not r["text"]} == {1}
    assert sum(r["n_removed"] for r in rows if (r["text"] or "").startswith("one")) == 2
    assert lines.without_similar_lines(empty).count() == 0
    near = "the quick brown fox jumps over the lazy dog and then sleeps for a very long time under the old tree"
    df = spark.createDataFrame([(1, near), (2, near.replace("quick", "quiet")), (3, "a\nb\na"), (4, near[:50])], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in lines.without_similar_lines(df, with_text=True).collect()}
    assert got == {1: near, 2: "", 3: "a\nb", 4: near[:50]}


def test_blank_lines_of_crlf_texts_stay(spark):
    text = "one line of a text\r\n\r\nanother that differs\r\n\r\n\t\r\n\t\r\nthe last of them"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lines.without_similar_lines(docs, with_text=True).collect()}
    assert rows[1]["kept_text"] == text and rows[2]["kept_text"] == "\r\n\r\n\t\r\n\t\r"


@pytest.mark.parametrize("tile", [1024, 5])
def test_families_of_near_lines_keep_every_link(spark, monkeypatch, tile):
    monkeypatch.setattr(lines, "TILE", tile)
    rng = np.random.default_rng(5)
    base = list("".join(rng.choice(list("abcdefghij "), 200)))
    family = []
    for i in range(60):
        copy = base.copy()
        for p in rng.choice(200, rng.integers(0, 3), replace=False):
            copy[p] = "#"
        family.append("".join(copy))
    family = sorted(set(family))
    df = spark.createDataFrame(list(enumerate(family)), "lid long, line string")
    roots = {r["lid"]: r["root"] for r in lines.similar_lines(df, 8, 0.8, 12, 5).collect()}
    sets = [set(lines.shingles(t, 8).tolist()) for t in family]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert [roots.get(i, i) for i in range(len(sets))] == roots_of(len(sets), near)


def test_near_roots_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(lines, "CHARACTERS", 400)
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefghij "), 80))
    family = ["", "abc", "abc"] + [base[: rng.integers(60, 81)] + "".join(rng.choice(list("xy"), rng.integers(0, 4))) for _ in range(40)]
    roots = np.arange(100, 100 + len(family)) // 2 * 2
    a, b = lines._near_roots(roots, family, 8, 0.8)
    sets = [set(lines.shingles(t, 8).tolist()) for t in family]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    same = [(i, j) for i in range(len(sets)) for j in range(i) if roots[i] == roots[j]]
    place = {int(r): i for i, r in reversed(list(enumerate(roots)))}
    assert roots_of(len(sets), same + [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]) == roots_of(len(sets), same + near)


def test_signatures_borrow_from_the_next_bin():
    for line in ("", "ab", "abcdefgh", "abcdefghi", "the quick brown fox jumps over the lazy dog" * 3):
        got = lines.signatures([line], 8, 60)[0]
        codes = lines.shingles(line, 8) if line else np.zeros(1, np.uint64)
        least = {}
        for c in map(int, codes):
            slot = (c >> 40) % 60 if len(line) >= 8 else 0
            least[slot] = min(c, least.get(slot, c))
        for i in range(60):
            away = next(d for d in range(60) if (i + d) % 60 in least)
            assert int(got[i]) == (least[(i + away) % 60] + away * 0xBF58476D1CE4E5B9) % (1 << 64)


# ---- packing ---------------------------------------------------------------------------


def check_packing(rows, texts, length=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= length
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r["length"] for r in rows) / (length * len(sequences))


def test_packing_equals_the_tokenizer(spark, documents, small):
    filled = check_packing(queries.op10_packing(spark, small).collect(), documents)
    assert filled > 0.95


def test_packing_ids_of_more_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert check_packing(queries.op10_packing(spark, folder).collect(), texts) > 0.97


def test_packing_awkward(spark, awkward, empty):
    rows = packing.pack(awkward, keep=["text", "offset"], with_ids=True, **queries.tokenizer()).collect()
    unique = {i: t for i, t in ((r[0], r[1]) for r in awkward_rows()) if i not in (1, None)}
    assert all(np.frombuffer(r["ids"], "<u4").size == r["length"] for r in rows)
    alone = awkward.where("doc_id > 1")
    check_packing(packing.pack(alone, **queries.tokenizer()).collect(), unique)
    assert packing.pack(empty, **queries.tokenizer()).count() == 0


def test_long_ids_beside_a_null_keep_every_digit(spark):
    ids = [2**60 + 1, 2**60 + 3, None]
    docs = spark.createDataFrame([(i, f"text {i} ", i) for i in ids], "doc_id long, text string, other long").coalesce(1)
    packed = packing.pack(docs, keep=["other"], **queries.tokenizer()).collect()
    found = [packed, repeats.without_repeats(docs, keep=["doc_id", "other"]).collect(), lines.without_similar_lines(docs, keep=["doc_id", "other"]).collect()]
    for rows in found:
        assert {(r["doc_id"], r["other"]) for r in rows} == {(i, i) for i in ids}


def test_dot_product_limits():
    rng = np.random.default_rng(6)
    sizes, loss = rng.integers(1, 200, 500), rng.integers(0, 150, 500)
    loss = np.minimum(sizes, loss)
    bins, offsets = packing.dot_product_bins(sizes, loss, (400, 3, 250))
    for b in range(bins.max() + 1):
        own = bins == b
        assert 0 < own.sum() <= 3 and sizes[own].sum() <= 400 and loss[own].sum() <= 250
        assert sorted(offsets[own]) == np.r_[0, np.cumsum(sizes[own][np.argsort(offsets[own])])[:-1]].tolist()
    with pytest.raises(ValueError):
        packing.dot_product_bins(np.array([500]), np.array([1]), (400, 3, 250))


def test_encoder_on_odd_texts():
    encoder = packing.Encoder(**{"path": queries.tokenizer()["tokenizer"], "pattern": queries.tokenizer()["pattern"]})
    for text in ("", "a" * 3000, " " * 500 + "x", "don't  stop\n\n  now ", "你好 ½²", "<|endoftext|>", "éè —“q”", "x\x1cy\x85z­"):
        assert array.array("I", encoder.ids(text)) == array.array("I", encoder.slow.encode(text, add_special_tokens=False).ids)


def test_buckets_in_pieces_keep_all_company(monkeypatch):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(58)
    part = (keys >> np.uint64(63)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rows = [(int(part[i]), keys[i : i + 1].tobytes(), np.array([i], np.int64).tobytes()) for i in order]
    rows.append((2, np.array([7 << 61], np.uint64).tobytes(), np.array([900], np.int64).tobytes()))
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 33])], names=["part", "keys", "lids"]) for i in range(0, len(rows), 33)]
    for piece in (1, 20, 10_000):
        monkeypatch.setattr(lines, "PIECE", piece)
        found = pa.Table.from_batches(list(lines._buckets(iter(batches)))).to_pylist()
        got, pivots = defaultdict(list), defaultdict(set)
        for r in found:
            got[r["key"]].append(r["lid"])
            pivots[r["key"]].add(r["pivot"])
        wanted = defaultdict(list)
        for i, k in enumerate(keys.view(np.int64).tolist()):
            wanted[k].append(i)
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in wanted.items() if len(v) > 1}
        assert all(len(v) == 1 and v <= set(got[k]) for k, v in pivots.items())


def test_repeats_hand_on_bounded_batches():
    """A batch of anchors opens into many strings; a task never holds those of all of them."""
    n, length, gram = 1000, 40, 8
    columns = {"xid": range(n), "gram": [7] * n, "at": [32] * n, "windows": [33] * n, "weight": [1] * n}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()} | {
        "bytes": pa.array([bytes(72)] * n), "alive": pa.nulls(n)})
    made = list(repeats._node_rows(length, gram, 1, None)(iter([batch])))
    assert sum(b.num_rows for b in made) == 33 * n
    assert max(b.num_rows for b in made) <= 33 * repeats.IN_ROWS
