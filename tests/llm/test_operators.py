"""Each operator against brute force, on odd documents, empty and real tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavelens.llm import ann, bitplane, bpe, langid, minhash, mixing, quality, wordkit
from wavelens.llm import exact_dedup as exact_module
from wavelens.llm._common import Scratch
from wavelens.llm.bpe_codec import decode, encode_decode
from wavelens.llm.components import connected_components
from wavelens.llm.exact_dedup import deduplicated, exact_dedup
from wavelens.llm.minhash import near_duplicates
from wavelens.llm.substring_dedup import remove_repeats
from wavelens.llm.token_counts import token_counts

from . import brute
from .conftest import LONG, texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 1 ----------------------------------------------------------------------
@pytest.mark.parametrize("block", [4096, 16])
@pytest.mark.parametrize("table", ["odd", "real"])
def test_exact_dedup(spark, request, table, block):
    docs = request.getfixturevalue(table)
    groups = defaultdict(list)
    for i, t in texts_of(docs):
        groups[brute.normal(t)].append((-len(t or ""), i is None, i, t))
    got = exact_dedup(spark, docs, block=block).collect()
    assert len(got) == docs.count()
    assert sum(r.kept for r in got) == len(groups)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    for norm, rows in groups.items():
        best = min(rows, key=lambda x: x[:3])
        for row in rows:
            r = by[row[2], sha(norm)]
            assert (r.keep_id, r.group_size) == (best[2], len(rows))
    kept = sorted(x.text or "" for x in deduplicated(spark, docs).collect())
    assert kept == sorted(min(rows, key=lambda x: x[:3])[3] or "" for rows in groups.values())


def test_exact_dedup_hot_blocks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("x" * 100)).otherwise(F.concat(F.lit("y"), "id")).alias("text"))
    got = exact_dedup(spark, docs, block=32).groupBy("group_size").count().collect()
    assert {(r.group_size, r["count"]) for r in got} == {(2000, 2000), (1, 1000)}


def test_exact_dedup_long_and_extreme(spark):
    """Texts of 256 blocks that share most of them, and the smallest doc_id."""
    base = "".join(f"{i:08d}" for i in range(256 * 512))
    rows = [(-(1 << 63), base), (5, base), (6, base[:-1] + "x"), (7, "y" + base[1:]), (None, base), ((1 << 63) - 1, "a b"), (-(1 << 63), "ab"), (3, "a b")]
    rows += [(100 + i, base[: 4096 * 100] + f"{i % 3}") for i in range(40)]
    got = exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute.normal(t)].append((-len(t), i is None, i))
    for norm, members in groups.items():
        own = [r for r in got if r.text_sha256 == sha(norm)]
        assert {(r.keep_id, r.group_size, len(own)) for r in own} == {(min(members)[2], len(members), len(members))}


def test_names_with_clashing_hashes(spark, monkeypatch):
    """Three hashes for many contents: names are equal just where contents are."""
    docs = spark.range(300).select(F.col("id").alias("row"), (F.col("id") % 40).cast("string").cast("binary").alias("block"))
    few = lambda *k: F.pmod(F.xxhash64(*k), F.lit(3))
    for most in (1000, 5):
        monkeypatch.setattr(exact_module, "CLASHES", most)
        names = {r.row: (r.h, r.r) for r in exact_module.name_keys(Scratch(spark, "t"), docs, ["block"], few).collect()}
        assert len(names) == 300 and len(set(names.values())) == 40
        assert all(names[i] == names[i % 40] for i in range(300))


# -- 2 ----------------------------------------------------------------------
@pytest.mark.parametrize("table", ["odd", "real"])
def test_codec(spark, request, table, library):
    docs = request.getfixturevalue(table)
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded, r.ids_sha256, r.decoded_sha256) for r in encode_decode(spark, docs, outputs=("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")).collect())
    want = Counter()
    for i, t in texts_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        again = library.decode(ids, skip_special_tokens=False)
        want[i, tuple(ids), len(ids), again, sha(",".join(map(str, ids))), sha(again)] += 1
    assert got == want


def test_decode(spark, odd):
    both = encode_decode(spark, odd)
    assert Counter(r.decoded for r in decode(spark, both).collect()) == Counter(t or "" for _, t in texts_of(odd))


def test_tree_concatenation(library):
    rng = random.Random(4)
    for leaf in (4, 16, 64):
        codec = bpe.Codec(PATH, leaf)
        for _ in range(150):
            text = "".join(rng.choice(["a", "b", "ab", "the", "ing", "er", "aaaa", "tion", "é", "7", "日"]) for _ in range(rng.randint(1, 200)))
            assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(spark, odd):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.codec("word_bpe_49k.json")
    with pytest.raises(ValueError, match="byte-level"):
        encode_decode(spark, odd, path="word_bpe_49k.json")


def test_batches_of_pieces(library):
    rng, codec = random.Random(5), bpe.codec("byte_bpe_50k.json")
    parts = [*"ab1 \n\t\r\x0b\x1c\x85é!'", "  ", "\n\n", "<|endoftext|>", "日本", "'ll", " word", " foo\nbar"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    ids, n = codec.encode_batch(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# -- 3 ----------------------------------------------------------------------
@pytest.mark.parametrize("table", ["odd", "real"])
def test_near_duplicates(spark, request, table):
    docs = request.getfixturevalue(table)
    want = brute.components(texts_of(docs))
    got = near_duplicates(spark, docs).collect()
    assert len(got) == docs.count()
    assert Counter(r.n_shingles for r in got) == Counter(len(brute.shingles(t)) for _, t in texts_of(docs))
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)


def test_near_duplicates_large_group(spark):
    """Copies of one text with a few words changed each, more than pivots settle at once."""
    rng, base = random.Random(6), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(0, 60, 6), rng.choice([0, 1, 1, 2])):
            w[j] = f"z{i}"
        rows.append((1000 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(spark, docs).collect()} == want


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 5000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[: max(1, 3 * n // 4)], rng.integers(0, 1 << 63, n // 4).astype(np.uint64)]))
        x = np.unique(x)
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        a, b = minhash.sketch(x, 1024), minhash.sketch(y, 1024)
        assert (a != np.iinfo(np.uint64).max).all()
        assert abs((a == b).mean() - truth) < 0.07


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(8, 40)] + [(50, 51), (3, 50), (60, 60)]
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(Scratch(spark, "t"), links).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, **{i: 7 for i in range(7, 40)}, 3: 3, 50: 3, 51: 3}


# -- 4 ----------------------------------------------------------------------
@pytest.mark.parametrize("table", ["odd", "real"])
def test_remove_repeats(spark, request, table):
    docs = request.getfixturevalue(table)
    rows = texts_of(docs)
    # Rows that repeat an id come by the hash of their text: none of those here share a window.
    want = brute.kept_words(rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in remove_repeats(spark, docs, with_text=True).collect())
    expected = Counter()
    for d in rows:
        n, text = len(brute.WORD.findall(d[1] or "")), " ".join(want[d])
        expected[d[0], n, n - len(want[d]), sha(text), text] += 1
    assert got == expected


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_remove_repeats_full_rows(spark, parts):
    """Copies of a whole row count as one document, in one slice or in several,
    and a null id is not the largest one."""
    rows, last = [], (1 << 63) - 1
    for n in (30, 300):
        text = " ".join(f"v{n}.{i}" for i in range(n))
        rows += [(n, text), (n, text), (n + 1, "x " + text), (last, text + " y"), (None, text + " y"), (None, text + " y")]
    rows += [(last, " ".join(f"u{i}" for i in range(25))), (None, " ".join(f"u{i}" for i in range(25)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.coalesce(1) if parts == 1 else docs.repartition(parts)
    got = Counter((r.doc_id, r.n_words, r.kept_text) for r in remove_repeats(spark, docs, with_text=True).collect())
    want = brute.kept_words(rows)
    assert got == Counter((d[0], len(d[1].split()), " ".join(want[d])) for d in rows)


def test_common_passages_take_other_ways(spark, monkeypatch):
    """With a low bar for common grams the result is the same."""
    from wavelens.llm import substring_dedup

    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(40)]
    for i in range(60):
        own = [f"o{rng.randint(0, 50)}" for _ in range(30)]
        rows.append((i, " ".join(own[:15] + passage + own[15:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.kept_words(rows)
    real_common = substring_dedup.common_grams
    seen = []
    monkeypatch.setattr(substring_dedup, "common_grams", lambda src, gram: seen.append(real_common(src, gram, 1e-4, 10)) or seen[-1])
    got = {r.doc_id: r.kept_text for r in remove_repeats(spark, docs, with_text=True).collect()}
    assert len(seen[0]) >= 30
    assert got == {d[0]: " ".join(want[d]) for d in rows}


# -- 5 ----------------------------------------------------------------------
@pytest.mark.parametrize("table", ["odd", "real"])
def test_mix(spark, request, table):
    docs = request.getfixturevalue(table)
    got, again = mixing.mix(spark, docs).collect(), mixing.mix(spark, docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.position or 0)
    assert {(r.doc_id, r.turn) for r in got} == {(r.doc_id, r.turn) for r in again}
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights, target, free, left = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names), sum(sizes.values())
    while free:  # stop those over their limit, share the rest again
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= 3 * sizes[s]}
        if not over:
            target |= {s: weights[s] * level for s in free}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    assert sorted(r.turn for r in got) == list(range(1, len(got) + 1))
    ordered = sorted(got, key=lambda r: r.turn)
    assert [r.position for r in ordered] == sorted((r.position for r in got), key=lambda x: (x is None, x or 0))
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def test_training_order(spark, real, none):
    plan = {r.doc_id: r for r in mixing.mix(spark, real).collect()}
    rows = mixing.training_order(spark, real).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    texts = {r.doc_id: r.text for r in real.collect()}
    assert all(r.text == texts[r.doc_id] for r in rows)
    first = {r.doc_id: k for k, r in reversed(list(enumerate(rows)))}
    at = [plan[i].position for i in sorted(first, key=first.get)]
    assert at == sorted(at)
    words = defaultdict(int)
    for r in mixing.training_order(spark, real, trim=True).collect():
        words[r.doc_id] += len(brute.WORD.findall(r.text))
    assert words == {i: r.taken for i, r in plan.items() if r.taken}
    assert mixing.training_order(spark, none).count() == 0


def test_schedule_is_inverted(spark):
    for slope in (0.0, 0.5, -0.5, 1.0, -1.0):
        for t in (0.0, 0.1, 0.5, 0.99, 1.0):
            share = t + slope * (t * t - t)
            got = spark.range(1).select(mixing._position(F.lit(share), F.lit(slope))).first()[0]
            assert got == pytest.approx(t, abs=1e-6)


# -- 6 ----------------------------------------------------------------------
def test_language(spark, real, odd):
    got = {r.doc_id: r for r in langid.identify(spark, real).collect()}
    truth = {r.doc_id: r.lang for r in real.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    out = langid.identify(spark, odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    for i in (3, 4, 5, -7):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    learned = {r.lang for r in odd.collect() if r.lang and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert {r.lang_pred for r in out} <= learned | {"und"}


def plain_words(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def plain_grams(word, n):
    s = word if n == 1 else "^" + word + "$"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def test_language_against_plain_model(spark, odd):
    """Fit and prediction, one word and one n-gram at a time; equal scores go to the first language."""
    extra = [(200 + i, t, lang, "s") for i, (t, lang) in enumerate([("½ ² Ⅷ", "en"), ("½ x ² Ⅷ٣", "de"), ("der die das haus", "de"), ("das haus am see", "de"), ("le chat est noir", "fr"), ("la maison noire", "fr"), ("hausboot", None), ("noirceur hauser", "xx"), ("хорошо", "ru"), ("хор", None)])]
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()] + [r[:3] for r in extra]
    docs = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([r[:3] for r in extra], "doc_id long, text string, lang string"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    learn = [(t, lang) for i, t, lang in rows if i is not None and not held(i) and t is not None and lang is not None]
    langs = sorted({lang for _, lang in learn})
    counts = [defaultdict(Counter) for _ in range(6)]
    for t, lang in learn:
        for w in plain_words(t):
            counts[0][w][lang] += 1
            for n in range(1, 6):
                for g in plain_grams(w, n):
                    counts[n][g][lang] += 1
    totals = [Counter() for _ in counts]
    for table, total in zip(counts, totals, strict=True):
        for by in table.values():
            total.update(by)

    def logs(n, item):
        return np.array([np.log((counts[n][item][x] + 0.5) / (max(1, totals[n][x]) + 0.5 * len(counts[n]))) for x in langs])

    def worth(word):
        if word in counts[0]:
            return logs(0, word)
        for n in range(5, 0, -1):
            known = [logs(n, g) for g in plain_grams(word, n) if g in counts[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    want = Counter()
    for i, t, _ in rows:
        words = plain_words(t or "")
        if not words:
            want[i, held(i), "und", 0.0] += 1
            continue
        total = sum(map(worth, words))
        want[i, held(i), langs[int(np.argmax(np.round(total, 4)))], round(float(1 / np.exp(total - total.max()).sum()), 2)] += 1
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 2)) for r in langid.identify(spark, docs).collect())
    assert got == want
    assert ("und", 0.0) in {(r[2], r[3]) for r in got if r[0] == 200}


def test_language_backs_off():
    model = langid.Model(["a", "b"], [("a", 0, "known", 10), ("b", 5, "^long", 5), ("a", 2, "zz", 5), ("b", 1, "q", 5)], {})
    assert model.backed_off("longer").argmax() == 1
    assert model.backed_off("xzzx").argmax() == 0
    assert model.backed_off("q").argmax() == 1
    assert (model.backed_off("é") == 0).all()


# -- 7, 8 ---------------------------------------------------------------------
@pytest.mark.parametrize("table", ["odd", "real"])
def test_token_counts(spark, request, table, library):
    docs = request.getfixturevalue(table)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(spark, docs).collect())
    want = Counter()
    for i, t in texts_of(docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, odd, library, bits):
    got = bitplane.token_files(spark, odd, bits=bits, chunk=64, segment=1000).collect()
    want, start = [], 0
    hashes = {r.text: r.h for r in odd.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for i, t in sorted(texts_of(odd), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]], (x[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(s, i, n, c) for i, s, n, c in want]


@pytest.mark.parametrize("bits", [False, True])
def test_segment_round_trip(bits):
    rng = np.random.default_rng(2)
    ids, sizes = rng.integers(0, 1 << 32, 1000).astype("<u4"), np.array([0, 1, 400, 599])
    s = bitplane.Segment(bitplane.write_segment(ids, np.arange(4), np.ones(4, bool), sizes, 64, bits))
    assert (s.ids(0, 1000) == ids).all() and (s.ids(63, 130) == ids[63:130]).all() and len(s.ids(5, 5)) == 0
    assert s.sizes.tolist() == sizes.tolist() and s.doc_ids.tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        bitplane.Segment(b"x" * 100)


# -- 9 ----------------------------------------------------------------------
def brute_nearest(rows, k=20):
    """rows: (id, vector); ties to the smaller id."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            near = sorted((-np.cumsum(q * v)[-1], j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same = [float(x) for x in rows[0][1]]
    rows += [(1000 + i, same) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 64), (2060, [float("nan")] * 64), (2080, [None] * 64), (2100, [1.0, 2.0]), (2101, [1.0, 1.0]), (None, same)]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, dim int")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in ann.nearest(spark, docs).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == want


def test_nearest_of_all_lengths(spark):
    """Vectors of lengths 1e-3 to 1e12 and near ties: factor one misses nothing."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (1500, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[:60] = x[0] + rng.normal(0, 1e-7, (60, 16))
    x[100:160] *= 10.0 ** rng.integers(-3, 13, (60, 1))
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(spark, docs).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == brute_nearest(rows)


def test_tree_prunes():
    """Factor one is exact and leaves vectors out; FASTER keeps 0.9 of the neighbours and visits fewer."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (40, 8)) * 5
    x = (centers[rng.integers(0, 40, 6000)] + rng.normal(0, 0.1, (6000, 8))).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    again = ann.Tree.unpacked(ann.Tree(np.arange(6000), x).packed())
    q = np.arange(0, 6000, 30)
    dots = x[q].astype(float) @ x.T.astype(float)
    dots[np.arange(len(q)), q] = -np.inf
    truth = [set(np.argsort(-d, kind="stable")[:10]) for d in dots]
    seen = []
    for factor, least in ((1.0, 1.0), (ann.FASTER, 0.9)):
        place, _ = again.search(q, x[q], 10, factor)
        assert np.mean([len(set(again.ids[p]) & t) / 10 for p, t in zip(place, truth, strict=True)]) >= least
        seen.append(again.seen)
    assert seen[1] < seen[0] < len(q) * 6000


# -- 10 ---------------------------------------------------------------------
def test_quality(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(spark, docs, labels).join(labels, "doc_id").collect()
    clean, bad = [r.kept for r in rows if r.quality and not r.toxic], [r.kept for r in rows if not r.quality]
    assert np.mean(clean) >= 0.98 and np.mean(bad) <= 0.3
    some = spark.createDataFrame([(1, 1, 0), (2, 1, None), (13, 1, 0), (13, 0, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(spark, odd, some).collect()
    assert len(out) == odd.count()
    assert all(not r.kept and r.perplexity is None for r in out if r.doc_id in (3, 4))
    nothing = quality.classify(spark, odd, some.limit(0)).collect()
    assert all(r.kept == (r.n_bytes > 0) for r in nothing)


def test_quality_small_language(spark):
    """A language with few trusted documents is judged by their quantile, one
    with none by that of all."""
    plain, letters = "the cat sat on the mat and the dog ran ", np.random.default_rng(5)
    mixed = lambda: "".join(letters.choice(list("qwxzjkv "), 300))
    rows = [(i, plain * (2 + i % 7), "a") for i in range(60)] + [(100 + i, mixed(), "b") for i in range(3)] + [(200, mixed(), "c"), (201, plain * 4, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[2] != "c"], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(spark, docs, labels, quantile=0.9).collect()}
    assert all(out[i].kept for i in (100, 101, 102))
    assert out[100].threshold > out[0].threshold
    assert not out[200].kept and out[200].threshold < out[100].threshold


def _fold(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r.f for r in df.select("doc_id", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(5)), F.lit(quality.FOLDS)).alias("f")).collect()}


def _quality_table(real):
    """Real texts, Japanese ones, random characters of its script, and odd rows."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang) for r in real.where("length(text) < 3000").orderBy("doc_id").limit(40).collect()]
    parts = ["これは", "日本語", "の", "文章", "です", "。", "学校", "で", "読む", "本", "を", "書いた", "、", "私は"]
    rows += [(1000 + i, "".join(rng.choice(parts) for _ in range(60)), "ja") for i in range(30)]
    rows += [(2000, "".join(chr(rng.randint(0xAC00, 0xD7A3)) for _ in range(80)) + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(80)), "ja")]
    rows += [(3000, "", "ja"), (3001, None, None), (None, "no id at all", "en"), (3002, "x", "en"), (3003, "a\x00b", "fr")]
    return rows, [r[0] for r in rows if r[0] is not None and r[0] < 2000]


def test_quality_against_plain_model(spark, real, monkeypatch):
    """Perplexities, thresholds and what is kept, against one n-gram at a time."""
    rows, good = _quality_table(real)
    fold = _fold(spark, {r[0] for r in rows})
    models = [brute.KneserNey([t or "" for i, t, _ in rows if i in good and fold[i] != f], quality.ORDER) for f in range(quality.FOLDS)]
    nats = {i: models[fold[i]].nats(t or "") for i, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(2000, 0, 0), (3002, 1, 1)], "doc_id long, quality int, toxic int")
    for step in (quality.STEP, 100):
        monkeypatch.setattr(quality, "STEP", step)
        monkeypatch.setattr(quality, "TOGETHER", 50 * step)
        got = {r.doc_id: r for r in quality.classify(spark, docs, labels, quantile=0.9).collect()}
        assert len(got) == len(rows)
        size = {i: len((t or "").encode()) for i, t, _ in rows}
        cuts = {}
        for lang in {r[2] for r in rows}:
            own = [i for i, _, x in rows if x == lang and i in good]
            own = own or good
            mean = sum(nats[i] for i in own) / sum(size[i] for i in own)
            smooth = lambda i, m=mean: (nats[i] + quality.PRIOR * m) / (size[i] + quality.PRIOR)
            cuts[lang] = sorted(map(smooth, own))[int(np.ceil(0.9 * len(own))) - 1]
            for i in (r[0] for r in rows if r[2] == lang):
                r = got[i]
                assert (r.n_bytes, r.perplexity is None) == (size[i], size[i] == 0)
                if size[i]:
                    assert np.log(r.perplexity) == pytest.approx(smooth(i), abs=2 / quality.FINE), (i, lang, size[i], nats[i], mean, len(own))
                    assert r.kept == (np.log(r.perplexity) < np.log(r.threshold))
                assert r.kept or i not in own or smooth(i) > cuts[lang] - 0.01
        assert all(np.log(got[i].threshold) == pytest.approx(cuts[lang], abs=4 / quality.FINE) for i, _, lang in rows if lang in ("en", "ja", "de"))
        assert not got[2000].kept and not got[3000].kept and not got[3001].kept


def test_kneser_ney_sums_to_one(real):
    """The plain model's shares of all bytes add up to one after any context."""
    model = brute.KneserNey([r.text for r in real.where("length(text) < 3000").limit(20).collect()], 4)
    for context in (b"", b"\0\0\0", b"the", b"zqx", "é".encode()):
        assert sum(model.p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


# -- all --------------------------------------------------------------------
def test_empty_tables(spark, none):
    assert exact_dedup(spark, none).count() == deduplicated(spark, none).count() == 0
    assert encode_decode(spark, none).count() == 0
    assert near_duplicates(spark, none).count() == 0
    assert remove_repeats(spark, none).count() == 0
    assert mixing.mix(spark, none).count() == 0
    assert langid.identify(spark, none).count() == 0
    assert token_counts(spark, none).count() == 0
    assert bitplane.token_files(spark, none).count() == 0
    assert ann.nearest(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quality.classify(spark, none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words():
    texts = ["", " a  bc\t", "déjà vu\x0bx", "\x1cy z", LONG[:100], "one"]
    w = wordkit.words(pa.array(texts, pa.large_string()))
    assert w.count.tolist() == [len(brute.WORD.findall(t)) for t in texts]
    h = wordkit.hashes(w)
    flat = [x for t in texts for x in brute.WORD.findall(t)]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len(set(flat))
