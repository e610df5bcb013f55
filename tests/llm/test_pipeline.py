"""Each stage of the pipeline against a plain version on its own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavelens.llm._common import Scratch
from wavelens.llm.mixing import mix

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, SF), name)
        seen.append((name, docs.collect(), out.collect(), docs))
        assert name == "bpe" or out.columns == columns
        docs = out
    stages = {name: (a, b, df) for name, a, b, df in seen}

    before, after, _ = stages["quality"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality and not labels[r.doc_id].toxic]
    assert set(kept) <= {r.doc_id for r in before} and sum(i in kept for i in clean) >= 0.97 * len(clean)

    before, after, _ = stages["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[brute.normal(r.text)].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(min(g)[1] for g in groups.values())

    before, after, _ = stages["near_dedup"]
    reach = brute.components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in reach.items() if i == c)

    before, after, frame = stages["mix"]
    plan = {r.doc_id: r for r in mix(spark, frame).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)
    words, last = Counter(), Counter()
    for r in after:
        words[r.source] += plan[r.doc_id].size
        last[r.source] = max(last[r.source], plan[r.doc_id].size)
    for s, n in words.items():  # whole texts: over the target by less than one document
        target = next(r.target for r in plan.values() if r.source == s)
        assert target - 1 <= n < target + last[s] + 1

    before, after, _ = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after) == want


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Every stage on its own over nulls, repeats, long texts and clashing names."""
    spark.createDataFrame([(i, 1, 0) for i in (1, 6, 8, 13, 14, 16)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, before = str(tmp_path), odd.collect()
    got = {name: stage(spark, odd, sf).collect() for name, stage in corpus_pipeline.STAGES}
    rows = Counter(map(tuple, before))
    for name in ("quality", "exact_dedup", "near_dedup", "mix"):
        assert got[name] and tuple(got[name][0].__fields__) == tuple(odd.columns)
        if name != "mix":
            assert not Counter(map(tuple, got[name])) - rows
    assert all(r.text and r.text.strip("") for r in got["quality"]) and {1, 6, 13} <= {r.doc_id for r in got["quality"]}
    assert len(got["exact_dedup"]) == len({brute.normal(r.text) for r in before})
    reach = brute.components([(r.doc_id, r.text) for r in before])
    assert Counter(r.doc_id for r in got["near_dedup"]) == Counter(r.doc_id for r in before if r.doc_id is None or reach[r.doc_id] == r.doc_id)
    assert not Counter((r.doc_id, r.text) for r in got["mix"]).keys() - {(r.doc_id, r.text) for r in before}
    assert len(got["bpe"]) == len(before)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_rows_of_an_id_are_judged_one_by_one(spark, real, tmp_path):
    good = real.where("length(text) between 500 and 3000").orderBy("doc_id").limit(30)
    junk = "\x01\x7f~^%$ zqxj" * 60
    docs = good.unionByName(good.orderBy("doc_id").limit(3).selectExpr("doc_id", f"'{junk}' AS text", "lang", "source", "n_chars"))
    # A label holds for all rows of its id, so those of repeated ids have none.
    twice = [r.doc_id for r in good.orderBy("doc_id").limit(3).collect()]
    good.where(~good.doc_id.isin(twice)).selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()
    assert junk not in {r.text for r in kept} and len(kept) >= 25


def test_sql_of_queries(spark):
    """The registered SQL on the small tables."""
    import duckdb

    from wavelens.llm import queries

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF).toPandas()
        want = db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        by = sorted(got.columns)
        plain = lambda df: sorted((tuple(None if v != v else v for v in r) for r in df[by].astype(object).values.tolist()), key=repr)  # noqa: B023, E731
        for a, b in zip(plain(got), plain(want), strict=True):
            assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), name
