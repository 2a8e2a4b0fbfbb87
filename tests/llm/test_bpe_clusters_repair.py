"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from test_llm import plain_removal
from tokenizers import Tokenizer

from brookmill.llm import bpe, clustering, hashing
from brookmill.llm import conversation_repair as talk
from brookmill.llm.jaccard_dedup import one_of_each
from brookmill.llm.language_model import score_texts
from brookmill.llm.packing import pack
from brookmill.llm.substring_dedup import remove_repeats
from brookmill.llm.token_files import token_file_index

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [
    "a", "b", "s", "'", "'s", "'re", "'ll", " ", "\t", "\n", "\x1c", "\x85", " ", " ", "Σ", "ς", "İ", "é", "é", "́", "ß", "中", "ก", "١", "²", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>",
    "<", "|", ">", "՘", "Ɤ", "\U0001f600", "​", "᠎", "_", "1", "9", "-", "!!", "\x00", "﻿", "A", "ẞ", "Å", "ﬁ", "가", "가", "\U00010d50", "</w>",
]


# --- 11 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same_as(library, coder, texts):
    ids, ends = coder.encode(texts)
    for text, a, b in zip(texts, ends, ends[1:]):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids[a:b].tolist() == expected, text
        assert coder.decode(ids[a:b]) == library.decode(expected, skip_special_tokens=False)


def test_random_texts(library):
    rng = random.Random(1)
    same_as(library, bpe.BytePairs(PATH), ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + [None, "", " "])


def test_long_words(library):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (500, 1025, 5000)]
    same_as(library, bpe.BytePairs(PATH), words + [x * n for n in (400, 3000) for x in ("a", "ab", "thin", "!", "-=", "é")])


def test_words_of_one_hash(library):
    """Thue-Morse strings, which collide under every polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    same_as(library, bpe.BytePairs(PATH), [word[:1024], word[:1024].translate(str.maketrans("ab", "ba")), word, word.translate(str.maketrans("ab", "ba"))])


def test_merging_by_rank_equals_rounds(monkeypatch, library):
    monkeypatch.setattr(bpe, "LONG", 8)
    rng = random.Random(3)
    same_as(library, bpe.BytePairs(PATH), ["".join(rng.choice("aehintr") for _ in range(rng.randint(1, 60))) for _ in range(1000)])


def test_merges_one_at_a_time():
    """A vocabulary in which a merge's result begins a pair of lower rank: the leftmost place goes first."""
    vocab = {t: i for i, t in enumerate(["a", "b", "ab", "aba", "abab"])}
    merges = bpe.Merges(vocab, [["ab", "a"], ["a", "b"], ["ab", "ab"]])

    def plain(symbols):
        ranks = {(2, 0): (0, 3), (0, 1): (1, 2), (2, 2): (2, 4)}
        while True:
            found = [(*ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
            if not found:
                return symbols
            _, made, i = min(found, key=lambda f: (f[0], f[2]))
            symbols = symbols[:i] + [made] + symbols[i + 2 :]

    words = [list(w) for n in range(1, 9) for w in itertools.product((0, 1), repeat=n)]
    ids, counts = merges.rounds(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(w) for w in words]
    assert [merges.by_rank(np.array(w, np.int32)).tolist() for w in words] == [plain(w) for w in words]


def test_kept_words_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    coder, rng = bpe.BytePairs(PATH), random.Random(4)
    for _ in range(20):
        same_as(library, coder, ["".join(rng.choice("aehintr ") for _ in range(80)) + "<|endoftext|>" for _ in range(5)])
    assert len(coder.places) < 200


def test_encode_and_decode_tables(spark, library):
    texts = ["Hello  World's <|endoftext|>", None, "", " \n", "x" * 50_000, "word " * 30_000, "same", "same"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "b", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    rows = bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in rows) == sorted(
        (i == 3, i if i != 3 else None, np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False)) for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))
    )
    assert bpe.decode_ids(bpe.encode_texts(docs.limit(0), PATH), PATH).count() == 0
    assert bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).first()["decoded"] == ""


# --- 12 -----------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, c in last if c == i) for i in range(len(centroids))]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last)]


def clusters_of(spark, rows):
    df = spark.createDataFrame([(i, e, "x", 0) for i, e in rows], "vec_id long, embedding array<float>, cluster string, place int")
    return sorted(map(tuple, clustering.cluster_vectors(df).collect()), key=repr)


def test_clusters_with_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(120)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None), (301, None), (302, []), (303, [1.0] * 63), (304, [1.0] * 65)]
    rows += [(305, [None] + [1.0] * 63), (306, [math.nan] + [1.0] * 63), (307, [math.inf] + [1.0] * 63), (308, [0.0] * 64), (309, [-0.0] * 64), (310, [3000.5] * 64)]
    assert clusters_of(spark, rows) == sorted(plain_clusters(rows), key=repr)


def test_few_or_no_vectors(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert clusters_of(spark, rows) == sorted(plain_clusters(rows), key=repr)
    assert clusters_of(spark, []) == [] == clusters_of(spark, [(1, None)])


def test_huge_components_are_refused(spark):
    with pytest.raises(Exception, match="a component beyond"):
        clusters_of(spark, [(1, [1e30] * 64)])


def test_candidates_hold_the_nearest_and_prune():
    rng = np.random.default_rng(6)
    centroids = rng.integers(-1000, 1000, (8, 16))
    tried = pruned = 0
    for spread in (0, 3, 100, 2000):
        points = centroids[rng.integers(0, 8, 40)][:, None] + rng.integers(-spread, spread + 1, (40, 20, 16))
        which = clustering.candidates(points.min(1), points.max(1), centroids)
        for box, chosen in zip(points, which):
            d = ((box[:, None] - centroids) ** 2).sum(2)
            assert all(chosen[j] for row in d for j in np.flatnonzero(row == row.min()))
        if spread <= 100:
            tried, pruned = tried + which.size, pruned + (~which).sum()
    assert pruned > 0.8 * tried


def test_exact_beyond_double_precision():
    rng = np.random.default_rng(7)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (8, 64))
    best, distance = clustering.nearest_of(x, c)
    plain = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c)) for v in x]
    assert list(zip(distance.tolist(), best.tolist())) == plain


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        places = clustering.hilbert_places(points, bits)
        assert sorted(places) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(places)], axis=0)).sum(1) == 1).all()


# --- 13 -----------------------------------------------------------------------------------


def plain_audit(symbols):
    """(cost, audit) over all edits, by trying them from the end."""
    following = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    asked = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(symbols) and state in ("", "a") else []
        if inserts < 3:
            cost, audit = best(i, asked[state], inserts + 1)
            ways.append((cost + 2, "I" + audit))
        if i < len(symbols):
            role, cut, gone = symbols[i]
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit))
            if not gone:
                cost, audit = best(i + 1, asked[state], 0)
                ways.append((cost + 2 + cut, "R" + audit))
                if role in following[state]:
                    cost, audit = best(i + 1, role, 0)
                    ways.append((cost + cut, "K" + audit))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def plain_repair(rows):
    """The contract's row for the rows of one conversation, before damage."""
    left = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64].encode(), r[2][:64].encode(), r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in left if t is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    symbols, seen = [], set()
    for _, role, text in left:
        said = text.strip("\t\n\x0b\x0c\r ")
        cut = bool(said) and said[-1] not in ".!?"
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if cut else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        symbols.append((role[:1], int(cut), fault in ("blank", "duplicate")))
    out["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    out["cost"], out["audit"] = plain_audit(tuple(symbols)) if len(symbols) <= 200 else (None, None)
    return out, left


def repaired_digest(left, audit):
    state, i, out = "", 0, []
    asked = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for x in audit:
        role, text = ("", "") if x == "I" else left[i][1:]
        i += x != "I"
        if x != "D":
            role = role if x == "K" else asked[state]
            state = role[:1]
            out.append(f"{role}:{text}")
    assert i == len(left)
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def talks(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "cut off", " ", "", None, "a?", "b.", "c. \n", "d.\x0b", "e. ", "same."]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "User"]
    rows = []
    for c in conversations:
        for t in range(rng.randint(0, longest)):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 5])
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {t}."))
    return rows


def repaired(spark, rows, **limits):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    got = talk.conversation_digests(talk.repair_conversations(talk.damaged(df), **limits)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: r.asDict() for r in got}


def held_to_plain(got, rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(got) == set(groups)
    for conv, group in groups.items():
        expected, left = plain_repair(group)
        row = got[conv]
        for name, value in expected.items():
            assert value is None or row[name] == value, (conv, name)
        assert row["repaired_sha256"] == repaired_digest(left, row["audit"])


def test_many_conversations(spark):
    rows = talks(8, [*range(300), None, -5], 12)
    rows += rows[:20]
    held_to_plain(repaired(spark, rows), rows)


def test_conversation_over_many_fragments_and_ranges(spark):
    """One conversation holds most rows; fragments of five rows."""
    rows = talks(9, range(6), 20) + talks(10, [3] * 8, 20) + talks(11, [None] * 5, 12)
    held_to_plain(repaired(spark, rows, fragment_rows=5), rows)
    held_to_plain(repaired(spark, rows, fragment_bytes=20), rows)


def test_long_conversation_equals_its_fragments(spark):
    rows = [(1, t, ("user", "assistant", "tool")[t % 3 if t % 7 else 2], f"{t % 500}{'.' if t % 5 else ''}") for t in range(5000)]
    whole, parts = repaired(spark, rows), repaired(spark, rows, fragment_rows=64)
    assert whole == parts and whole[1]["duplicate"] > 3000
    held_to_plain(whole, rows)


def test_nothing_left_and_nothing_there(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(gone, 0, "user", "Hi.")])[gone] == {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    assert repaired(spark, []) == {}


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_000_000)]
    held_to_plain(repaired(spark, rows), rows)


def test_tables_against_all_edits():
    rng = random.Random(12)
    lots = [[rng.choice([0, 1, 2, 2, 3, 4, 5, 4, 6, 7, 8]) for _ in range(rng.randint(0, 30))] for _ in range(1500)]
    got = talk.repair([(np.array(s, np.uint8), ["r"] * len(s), ["t"] * len(s)) for s in lots])
    for symbols, g in zip(lots, got):
        assert (g.cost, g.audit) == plain_audit(tuple(("suao"[s // 2], s % 2, False) if s < talk.MUST_GO else ("o", 0, True) for s in symbols))


# --- hashes -----------------------------------------------------------------------------------


def thue_morse(length):
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_field_hash_equals_plain_arithmetic():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    prime = (1 << 61) - 1
    starts = rng.integers(0, 2000, 50)
    ends = starts + rng.integers(0, 900, 50)
    got = hashing.stretch_hashes(hashing.prefix_sums(data), starts, ends)
    plain = [sum(int(hashing._TABLE[x]) * pow(hashing._BASE, i, prime) for i, x in enumerate(data[a:b].tolist())) % prime for a, b in zip(starts, ends)]
    assert got.tolist() == plain
    a, b = rng.integers(0, prime, 500, np.uint64), rng.integers(0, prime, 500, np.uint64)
    assert hashing.times(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b)]


@pytest.mark.parametrize("length", [64, 200, 400, 1024, 4096])
def test_thue_morse_words_have_hashes_of_their_own(length):
    pair = [w[:length].encode() for w in thue_morse(length)]
    data = np.frombuffer(b"".join(pair), np.uint8)
    starts, ends = np.array([0, length]), np.array([length, 2 * length])
    assert len(set(hashing.piece_hashes(data, starts, ends).tolist())) == 2
    assert len(set(hashing.stretch_hashes(hashing.prefix_sums(data), starts, ends).tolist())) == 2


def test_piece_hashes_depend_on_the_bytes_alone():
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 255, 256, 257, 300]))) for _ in range(3000)]
    seen = {}
    for order in (pieces, pieces[::-1]):
        data, ends = np.frombuffer(b"".join(order), np.uint8), np.cumsum([len(p) for p in order])
        for piece, h in zip(order, hashing.piece_hashes(data, ends - [len(p) for p in order], ends).tolist()):
            assert seen.setdefault(piece, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("length", [1024, 4096])
def test_operators_tell_thue_morse_words_apart(spark, library, length):
    a, b = thue_morse(length)
    zlib_of = lambda ids: zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    docs = spark.createDataFrame([(1, a), (3, b)], "doc_id long, text string").repartition(1)
    for name, query in (("word_bpe_49k.json", lambda p: pack(docs, p, 8192)), ("byte_bpe_50k.json", lambda p: token_file_index(docs, p))):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        assert {r["doc_id"]: r["ids_crc32"] for r in query(path).collect()} == {i: zlib_of(plain.encode(t, add_special_tokens=False).ids) for i, t in ((1, a), (3, b))}
    held, learned = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 7 == 2) == h) for h in (True, False))
    scores = {r["doc_id"]: r["n_known"] for r in score_texts(spark.createDataFrame([(learned, a), (held, b)], "doc_id long, text string")).collect()}
    assert scores == {learned: 2, held: 1}  # the end, but not the word
    both = spark.createDataFrame([(1, a + " w x y z", "en", "s", 1), (2, b + " w x y z", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").repartition(1)
    assert one_of_each(both).count() == 2
    cut = remove_repeats(docs, length=400).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in cut} == {i: tuple(p[:2]) for i, p in zip((1, 3), plain_removal([a, b], 400))}
