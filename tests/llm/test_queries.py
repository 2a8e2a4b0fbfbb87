"""The registered queries and the pipeline on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest
from test_llm import AWKWARD, components, docs_of, plain_removal, plain_shingles, small_words

import corpus_pipeline
from brookmill.llm.common import giving_back
from brookmill.llm.oracles import ORACLES
from brookmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cursor = con.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, cursor.fetchall()))
    elif name != "op6_decontamination":
        assert rows


def stage_outputs(spark, sf_dir, folder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        outputs.append(docs)
    return outputs


def test_pipeline_matches_brute_force(spark, sf_dir, tmp_path):
    start, language, near, cut, clean, packed = stage_outputs(spark, sf_dir, tmp_path)
    for kept in (language, near, cut, clean):
        assert sorted(kept.columns) == sorted(start.columns)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    start, language, near, cut, clean = map(texts, (start, language, near, cut, clean))
    # language: nothing that is ordinary text goes, and texts stay as they are
    assert language.items() <= start.items() and len(language) >= 0.98 * len(start)
    # near duplicates: the smallest id of each component
    ids = sorted(language)
    sets = [plain_shingles(language[i]) for i in ids]
    near_pairs = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = components(len(ids), near_pairs)
    assert near == {ids[i]: language[ids[i]] for i in range(len(ids)) if roots[i] == i}
    # repeats: what is left of each text, apart from characters that a run only partly covers
    ids = sorted(near)
    for i, (n_bytes, n_removed, n_spans, _) in zip(ids, plain_removal([near[i] for i in ids], corpus_pipeline.REPEAT_BYTES)):
        left = len(cut[i].encode())
        assert n_bytes - n_removed <= left <= n_bytes - n_removed + 6 * n_spans
    # leaks: texts with a whole item go, and others stay
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {i for i, t in cut.items() if any(x in plain(t) for x in items)} == set(cut) - set(clean)
    assert clean.items() <= cut.items()
    # packing: every kept document once, within the capacity, without gaps
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(clean)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


def test_stages_take_awkward_tables(spark, sf_dir):
    """Null and repeated ids, null and empty texts, long texts, repeated rows, clashing columns, empty tables."""
    prose = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 300 and 900").select("text").limit(12).collect()]
    texts = prose + [prose[0], prose[1], prose[1], *AWKWARD, " ".join(small_words(5, 40_000, 3000))]
    ids = [*range(12), 50, None, None, *([7] * len(AWKWARD)), None]
    docs = docs_of(spark, texts, ids).withColumnsRenamed({"fp": "mark", "batch": "_row"}).unionByName(docs_of(spark, [prose[2]], [2]).withColumnsRenamed({"fp": "mark", "batch": "_row"}))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir).collect()
        empty = stage(spark, docs.limit(0), sf_dir)  # drops what the call before kept
        assert empty.count() == 0, name
        if name != "best_fit_packing":
            assert sorted(empty.columns) == sorted(corpus_pipeline.COLUMNS)
        kept = [(r["doc_id"], r["text"]) for r in got] if name != "best_fit_packing" else []
        if name == "language_id":
            assert kept.count((None, prose[1])) == 2 and kept.count((2, prose[2])) == 2 and not any(t is None or not any(map(str.isalpha, t)) for _, t in kept)
        if name == "simhash_near_dedup":  # the smallest id of each group, null last, one row
            assert kept.count((0, prose[0])) == 1 and kept.count((1, prose[1])) == 1 and kept.count((2, prose[2])) == 1
            assert not any(i is None for i, t in kept if t in prose) and sum(t == "a" for _, t in kept) == 1
            assert sum(t is None or not t.strip() for _, t in kept) == 1
        if name in ("suffix_array_dedup", "best_fit_packing"):
            assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in got} if not kept else kept) >= len(texts) + 1
        if name == "benchmark_decontamination":
            assert len(kept) == len(texts) + 1


def test_stages_write_few_files(spark, tmp_path):
    """Every written file starts processes in the executor; a table has a file a core, whatever the partitions."""
    texts = [f"w{i % 40} " * 60 + " ".join(f"u{i * 7 + j * j}" for j in range(90)) for i in range(150)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:30] + [t + " end" for t in texts[:30]])], "doc_id long, text string, lang string, source string, n_chars long").repartition(16).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in").repartition(16)
    confs = {"spark.sql.shuffle.partitions": str(2 * spark.sparkContext.defaultParallelism), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        stages = dict(corpus_pipeline.STAGES)
        for name, plain in (("simhash_near_dedup", corpus_pipeline.near_duplicates), ("suffix_array_dedup", corpus_pipeline.repeated_passages)):
            stages[name](spark, docs, "").write.parquet(out := f"{tmp_path}/{name}")
            paths = [Path(p.removeprefix("file://")) for p in corpus_pipeline._in_use[spark.sparkContext.applicationId]]
            assert paths
            most = [len(list(p.glob("part-*"))) for p in [*paths, Path(out)] if "/slices-" not in str(p)]
            assert max(most) <= spark.sparkContext.defaultParallelism, most
            rows = sorted(map(tuple, spark.read.parquet(out).select(*corpus_pipeline.COLUMNS).collect()))
            assert rows == sorted(map(tuple, plain(spark, docs, "").select(*corpus_pipeline.COLUMNS).collect()))
            assert rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stages_take_small_batches(spark, tmp_path):
    """A stage's Python tasks get batches of bounded bytes, its rows don't depend on them, and a size that the session sets stays."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = [f"w{i % 40} " * 60 + " ".join(f"u{i * 7 + j * j}" for j in range(90)) for i in range(150)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:30] + [t + " end" for t in texts[:30]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/in")
    docs, stages, found = spark.read.parquet(f"{tmp_path}/in"), dict(corpus_pipeline.STAGES), {}
    try:
        for size in (None, "2000"):
            spark.conf.unset(conf)
            if size:
                spark.conf.set(conf, size)
            for name in ("language_id", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"):
                result = sorted(map(str, stages[name](spark, docs, "").drop("sequence_id", "offset").collect()))
                assert result and found.setdefault(name, result) == result, name
                assert spark.conf.get(conf) == (size or str(4 << 20))
    finally:
        spark.conf.unset(conf)


def test_tasks_give_memory_back():
    """What a task has freed leaves the Python worker, which waits for the next one."""

    def resident() -> int:
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def run(batches):
        pieces = [b"x" * size for size in range(50_000, 54_000)]  # 200 MB that the C library keeps for itself
        yield resident()
        batches.append(pieces.pop())  # so that its end is in use

    kept = []
    inside, *_ = giving_back(run)(kept)
    assert inside - resident() > 150
