"""Null and repeated ids, empty tables, and results held against plain arithmetic."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_llm import AWKWARD, docs_of, plain_fingerprint, small_words
from tokenizers import Tokenizer

from brookmill.llm import jaccard_dedup, language_id, quality, simhash, token_files


def test_simhash_of_null_and_repeated_ids(spark):
    texts = ["one two three four", "one two three four", "one two three four", "other words are here now", "other words are here now", None, "", "lonely text of its own"]
    ids = [9, 4, 4, None, None, 12, None, None]
    got = sorted(map(repr, (tuple(r) for r in simhash.simhash_groups(docs_of(spark, texts, ids)).collect())))
    smallest = {}
    for i, t in zip(ids, texts):
        fp = plain_fingerprint(t)
        smallest[fp] = min((x for x in (smallest.get(fp), i) if x is not None), default=None)
    assert got == sorted(repr((i, f"{plain_fingerprint(t):016x}", smallest[plain_fingerprint(t)])) for i, t in zip(ids, texts))
    assert simhash.simhash_groups(docs_of(spark, texts, ids).limit(0)).count() == 0


def test_language_labels_scores_and_bounds(spark):
    """From the fitted centroids on, every label, score and rejection follows by plain arithmetic."""
    r = random.Random(4)
    texts = ["".join(r.choice(a) for _ in range(r.randrange(20, 900))) for a in ("abcdé ñ,.", "mnopqr sst.", "abcdé ñ,.", "mnopqr sst.", "xyzwvu kjh ") for _ in range(60)] + ["123", None, ""]
    langs = [("xx", "yy", "xx", "yy", None)[i // 60] if i < 300 else "xx" for i in range(len(texts))]
    docs = docs_of(spark, texts, None, langs)
    learned = [i for i, lang in enumerate(langs) if lang and texts[i] is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    idf, names, matrix, bounds = language_id.fit(docs.where(F.col("doc_id").isin(learned)).select("doc_id", "text", "lang"))
    got = {row["doc_id"]: row for row in language_id.predict_language(docs).collect()}
    rejected = 0
    for i, text in enumerate(texts):
        row = got[i]
        if text is None or not any(map(str.isalpha, text)):
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        counts = language_id.trigram_counts([text])
        x = np.log1p(counts[0].astype(float)) * idf
        x /= math.sqrt(sum(v * v for v in x.tolist()))
        cosines = [sum(a * b for a, b in zip(x.tolist(), c.tolist())) for c in matrix]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert row["lang_pred"] == names[best] and math.isclose(row["score"], min(max(cosines[best], 0), 1), abs_tol=1e-5)
        bound = bounds[language_id.size_class(counts)[0]]
        assert row["rejected"] == (cosines[best] < bound) or abs(cosines[best] - bound) < 1e-5
        rejected += row["rejected"]
    assert rejected >= 55  # the texts in letters of no language, but for very short ones


def rated_texts(n):
    """Texts of grade 0, 1 and 2 with words of their own."""
    kinds = [["bad", "junk", "spam"], ["rude", "nasty", "mean"], ["clear", "useful", "sound"]]
    r = random.Random(5)
    return [(" ".join([*small_words(i, 12, 30), *r.choices(kinds[i % 3], k=3)]), i % 3) for i in range(n)]


def test_quality_of_awkward_tables(spark):
    rows = rated_texts(240)
    docs = docs_of(spark, [t for t, _ in rows] + AWKWARD + [rows[0][0]] * 2, [*range(240), *([None] * len(AWKWARD)), 0, 0])
    marks = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)] + [(0, 0), (0, 0), (None, 2), (1, None), (999, 1)], "doc_id long, grade int")
    got = quality.judge_quality(docs, marks).collect()
    assert len(got) == 240 + len(AWKWARD) + 2 and sum(r["doc_id"] is None for r in got) == len(AWKWARD)
    assert len({(r["expected_grade"], r["tail_prob"], r["kept"]) for r in got if r["doc_id"] == 0}) == 1
    assert quality.judge_quality(docs.limit(0), marks).count() == 0
    unrated = quality.judge_quality(docs, marks.limit(0)).collect()
    assert len({(r["expected_grade"], r["tail_prob"]) for r in unrated if r["doc_id"] is not None}) == 1


def test_quality_follows_from_the_weights(spark):
    """Scores by plain sums over the different features of a text; texts of each grade are told apart."""
    rows = rated_texts(300)
    docs = docs_of(spark, [t for t, _ in rows] + [None, " \n"])
    marks = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "doc_id long, grade int")
    weights, thresholds, least = quality.fit(docs.where("text is not null").select("doc_id", "text"), marks, 3)
    got = {r["doc_id"]: r for r in quality.judge_quality(docs, marks).collect()}
    for i, (text, _) in enumerate(rows):
        score = sum(weights[k] for k in {*quality.features([text])[1].tolist()})
        above = [1 - 1 / (1 + math.exp(-(t - score))) for t in thresholds]
        assert math.isclose(got[i]["expected_grade"], sum(above), abs_tol=1e-9) and math.isclose(got[i]["tail_prob"], above[-1], abs_tol=1e-9)
        assert got[i]["kept"] == (got[i]["tail_prob"] >= least) or abs(got[i]["tail_prob"] - least) < 1e-9
    assert (got[300]["expected_grade"], got[301]["kept"]) == (0, False)
    means = [np.mean([got[i]["expected_grade"] for i, (_, g) in enumerate(rows) if g == k]) for k in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.3


def test_one_round_of_the_fit():
    """Stochastic gradients against a loop over dictionaries."""
    r = random.Random(6)
    rows = [(np.array(sorted(r.sample(range(20), 4))), r.randrange(3)) for _ in range(50)]
    weights, thresholds = quality.sgd_round(rows, np.zeros(20), np.array([-0.5, 0.5]), 0.3)
    w, t = collections.defaultdict(float), [-0.5, 0.5]
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for x, grade in rows:
        step, s = 0.3 / 2, sum(w[k] for k in x.tolist())
        upper = logistic(t[grade] - s) if grade < 2 else 1.0
        lower = logistic(t[grade - 1] - s) if grade else 0.0
        for k in x.tolist():
            w[k] = w[k] * (1 - quality.DECAY) + step * (upper + lower - 1)
        p = max(upper - lower, 1e-9)
        if grade < 2:
            t[grade] += step * min(upper * (1 - upper) / p, 1)
        if grade:
            t[grade - 1] -= step * min(lower * (1 - lower) / p, 1)
        t[1] = max(t[1], t[0] + quality.LEAST_GAP)
    assert np.allclose(weights, [w[k] for k in range(20)]) and np.allclose(thresholds, t)


def test_token_files_of_null_and_repeated_ids(spark):
    """A null id comes first, rows of one id in the order of their texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(5, "five"), (None, "none b"), (2, "two b"), (2, "two a"), (None, None), (2, "two a"), (-1, "")]
    got = token_files.token_file_index(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), path).collect()
    expected, start = [], 0
    for i, text in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert token_files.token_file_index(docs_of(spark, []), path).count() == 0


def test_quality_learns_from_every_rating(spark):
    """A word that only ratings past any sample hold tells grades apart, and the bound counts all top-grade texts."""
    n = 9000
    ids = spark.range(n).withColumn("chance", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    far = {r["id"] for r in ids.where("chance > 0.7").collect()}  # a draw of 6000 a grade by this hash leaves these out
    r = random.Random(8)
    grades = [0 if i % 50 == 0 else 1 if i % 50 == 1 else 2 for i in range(n)]
    texts = [" ".join([*r.choices(["plain", "even", "level", "common", "usual", "daily"], k=4), *(["splendid"] if i in far and g == 2 else [])]) for i, g in enumerate(grades)]
    marks = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    got = quality.judge_quality(docs_of(spark, [*texts, "plain even", "plain even splendid"]), marks).orderBy("doc_id").collect()
    assert got[n + 1]["tail_prob"] > got[n]["tail_prob"]
    top = sorted((row["tail_prob"] for row, g in zip(got, grades) if g == 2), reverse=True)
    least = min(row["tail_prob"] for row in got[:n] if row["kept"])
    need = math.ceil(quality.KEEP_SHARE * len(top))
    assert sum(p >= least for p in top) >= need and math.isclose(least, top[need - 1], abs_tol=1e-8)


def test_near_duplicates_start_from_fingerprints(spark, monkeypatch):
    """SimHash links near copies by itself; pairs of like fingerprints and unlike shingles aren't linked."""
    long = small_words(3, 6000, 3000)
    line = " ".join(small_words(4, 11, 3000) * 300)
    texts = [" ".join(long), " ".join([*long[:3000], "changed", *long[3001:]]), f"{line} " + " ".join(small_words(5, 40, 3000)), f"{line} " + " ".join(small_words(6, 40, 3000)), "short text"]
    fps = [simhash.fingerprint(t) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and (fps[2] ^ fps[3]).bit_count() <= 2
    docs = docs_of(spark, texts)
    want = [0, 0, 2, 3, 4]
    assert [r["component_id"] for r in jaccard_dedup.jaccard_groups(docs).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(jaccard_dedup, "_meeting", lambda rows: spark.createDataFrame([], jaccard_dedup._MET))
    assert [r["component_id"] for r in jaccard_dedup.jaccard_groups(docs).orderBy("doc_id").collect()] == want


def test_language_sends_a_carried_text_once(spark):
    texts, langs = ["abc abc de", None, "mno pqr st", "123"], ["xx", "yy", "yy", None]
    got = language_id.predict_language(docs_of(spark, texts, None, langs), carry=("lang", "text"))
    assert [(r["lang"], r["text"]) for r in got.orderBy("doc_id").collect()] == list(zip(langs, texts))
    sent = re.search(r"MapInArrow \w+\((.*?)\)", got._jdf.queryExecution().optimizedPlan().toString())[1]
    assert "_text#" in sent and not re.search(r"\btext#", sent)


def test_language_learns_from_every_text(spark):
    """Centroids and bounds equal plain spherical k-means and quantiles over all texts of a language, also of more than some hundreds."""
    r = random.Random(6)
    texts, langs = [], []
    for lang, alphabet, n in (("xx", "abcdé ñ,.", 1500), ("yy", "mnopqr sst.", 40)):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(20, 200))) for _ in range(n)]
        langs += [lang] * n
    idf, names, matrix, bounds = language_id.fit(docs_of(spark, texts, None, langs).repartition(3))
    counts = language_id.trigram_counts(texts)
    x = language_id.tf_idf(counts, idf)
    for lang in ("xx", "yy"):
        own = x[np.array(langs) == lang].astype(float)
        chosen = [int((own @ own.mean(axis=0)).argmax())]
        while len(chosen) < language_id.CENTROIDS:
            chosen.append(int((own @ own[chosen].T).max(axis=1).argmin()))
        want = own[chosen]
        for _ in range(language_id.ROUNDS):
            near = (own @ want.T).argmax(axis=1)
            want = np.stack([own[near == i].sum(axis=0) if (near == i).any() else want[i] for i in range(len(want))])
            want /= np.linalg.norm(want, axis=1)[:, None]
        got = np.array([c for c, name in zip(matrix, names) if name == lang])
        assert len(got) == len(want) and (got @ want.T).max(axis=1).min() > 0.9999 and (want @ got.T).max(axis=1).min() > 0.9999
    best, size = (x @ matrix.T).max(axis=1), language_id.size_class(counts)
    for k in np.flatnonzero(np.bincount(size, minlength=13) >= language_id.LEAST_CLASS):
        assert math.isclose(bounds[k], language_id.REJECT_SHARE * np.quantile(best[size == k], language_id.LOW_QUANTILE), abs_tol=2e-5)
