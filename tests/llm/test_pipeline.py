"""The pipeline against the same steps in plain Python, given the classifier's decisions."""

from collections import Counter

import xxhash

import corpus_pipeline
from shelfwise.llm import queries


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(texts):
    """Smallest id that each document reaches over links of at most four bits."""
    prints = {d: plain_fingerprint(t) for d, t in sorted(texts.items())}
    group = {}
    for start in prints:
        if start not in group:
            todo = [start]
            group[start] = start
            while todo:
                here = prints[todo.pop()]
                for d, p in prints.items():
                    if d not in group and (p ^ here).bit_count() <= 4:
                        group[d] = start
                        todo.append(d)
    return group


def test_stages_keep_what_they_should(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, small)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        seen[name] = given.collect()
    every = docs.collect()
    scores = {r["doc_id"]: r["predicted"] for r in queries.op5_toxicity(spark, small).collect()}
    assert sorted(r["doc_id"] for r in seen["toxicity"]) == sorted(d for d, p in scores.items() if not p)
    last = {}
    for r in seen["toxicity"]:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(last.values())
    texts = {r["doc_id"]: r["text"] for r in seen["exact_dedup"]}
    assert sorted(r["doc_id"] for r in seen["simhash"]) == sorted(set(near_groups(texts).values()))
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(copies) <= {r["doc_id"] for r in seen["simhash"]} and max(copies.values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, given, small)
    starts = Counter(r["doc_id"] for r in packed.where("start = 0").collect())
    assert starts == copies
    assert len(every) == docs.count()


def test_run_has_the_rows_of_its_stages(spark, small):
    whole = corpus_pipeline.run(spark, small)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(whole.columns)
    assert whole.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_awkward_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, "a b c d e", "en", None, 1, 1.0), (1, "a b c d e", "en", None, 1, 1.0), (None, None, None, None, None, None), (2, "", "en", "s", 0, None)]
    for given in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, small)
            assert given.columns == [c.split()[0] for c in schema.split(", ")]
        corpus_pipeline.STAGES[-1][1](spark, given, small).collect()
