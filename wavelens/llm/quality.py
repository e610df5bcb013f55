"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is of the texts' UTF-8 bytes, ORDER in a row, so no two characters of
any script are merged and its tables grow with the trusted text. Documents are
dealt to folds by their id; a fold's model is counted from the trusted documents
of the other folds, so that trusted and other documents alike are scored by a
model that has not seen them.

Counts are sharded by n-gram; every order's shares and back-off weights come
from sums by context, its probabilities from a join with the next lower order.
For scoring, blocks of documents send each distinct n-gram once to the bucket of
its context, where the model's entries of that context are; its log probability
goes back to the block and is summed by document. A document is kept up to a
quantile of its language's trusted perplexities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordkit
from ._common import Scratch, dealt, growing, id_filter, in_filter, join_unique, partitions, ship
from .blobs import pack, unpack

#: Bytes of an n-gram, folds, quantile of trusted documents that is kept, and grains of log
#: perplexity per unit.
ORDER, FOLDS, QUANTILE, GRAINS = 6, 2, 0.999, 2000
#: Bytes of average text that every document counts with, so that a few odd ones don't decide a short text.
PRIOR = 400
#: Bytes of text of a block and of what is taken at once, parts of a nat that a log probability is
#: rounded to, model entries of a bucket, about, and n-grams that a task counts before it gives them out.
TOGETHER, STEP, FINE, ENTRIES, HELD = 16 << 20, 1 << 19, 512, 2_000_000, 2_000_000
_U = np.uint64
_FOLD = 8 * ORDER
#: Contexts of two bytes, by which buckets are found.
_PAIRS = 1 << 16


def _mask(size: int) -> int:
    return (1 << 8 * size) - 1


def grams(data: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """The n-gram that ends at each byte from low to high (zeros before a text's
    start); at: bounds of the texts."""
    out = data[low:high].astype(np.int64)
    heads = at[np.searchsorted(at, low - ORDER, "right") : np.searchsorted(at, high, "left")] - low
    for j in range(1, ORDER):
        lag = np.zeros(high - low, np.int64)
        first = max(low, j)
        lag[first - low :] = data[first - j : high - j]
        for i in range(j):
            near = heads + i
            lag[near[(near >= 0) & (near < high - low)]] = 0
        out |= lag << (8 * j)
    return out


def _keyed(data: np.ndarray, at: np.ndarray, folds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Fold and n-gram of every byte, some MB at a time."""
    for low in range(0, len(data), STEP):
        high = min(len(data), low + STEP)
        fold = np.repeat(folds.astype(np.int64), np.diff(np.clip(at, low, high)))
        yield low, high, grams(data, at, low, high) | fold << _FOLD


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where each starts."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], np.flatnonzero(first)


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of distinct keys and their counts as one."""
    both = np.concatenate([keys, more])
    order = np.argsort(both)
    out, places = _runs(both[order])
    return out, np.add.reduceat(np.concatenate([counts, more_counts])[order], places) if len(out) else counts


# -- counts ---------------------------------------------------------------
def _trusted(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(wanted, batch.column("place").to_numpy()))).select(["doc_id", "text"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's n-grams; rows of a fold count for all other folds."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def given() -> pa.RecordBatch:
        return pa.record_batch([pa.array((keys >> _FOLD).astype(np.int32)), pa.array(keys & _mask(ORDER)), pa.array(counts)], names=["own", "gram", "n"])

    for batch in batches:
        for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
            data, at = wordkit.raw(texts)
            for _, _, found in _keyed(data, at, part.column("fold").to_numpy()):
                k, places = _runs(np.sort(found))
                keys, counts = _added(keys, counts, k, np.diff(np.append(places, len(found))))
                if len(keys) > HELD:
                    yield given()
                    keys, counts = keys[:0], counts[:0]
    yield given()


def discounts(have: dict[int, int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many n-grams have 1 to 4. One that
    has no n-grams to be estimated from is that of the count below, moved by as
    much as the counts differ, within the bounds of 0 and the count."""
    n = [have.get(k, 0) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out: list[float] = []
    for k in (1, 2, 3):
        value = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else (out[-1] if out else y)
        out.append(min(max(value, 0.05), k - 0.05))
    return out[0], out[1], out[2]


@dataclass
class Model:
    """orders: for 1 to ORDER (fold, gram, p, weight), the interpolated probability
    of the last byte after the context (the others) and the context's back-off
    weight, as written tables; low: p of all pairs of bytes, by fold; splits: in
    how many parts the entries of a two-byte context are; buckets of all."""

    orders: list[DataFrame]
    low: np.ndarray
    splits: np.ndarray
    buckets: int


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def train(spark: SparkSession, trusted: DataFrame, scratch: Scratch) -> Model:
    """The models of trusted (fold, text), all of which count: fold f's model is
    of the rows of other folds."""
    own = trusted.select("fold", "text").mapInArrow(_counted, "own int, gram long, n long")
    others = F.explode(F.filter(F.array(*(F.lit(f) for f in range(FOLDS))), lambda f: f != F.col("own"))).alias("fold")
    levels = [scratch.write(own.select(others, "gram", "n").groupBy("fold", "gram").agg(F.sum("n").alias("n")), "counts")]
    scratch.release()
    for order in range(ORDER - 1, 0, -1):
        # Lower orders count the different bytes before an n-gram.
        lower = F.col("gram").bitwiseAND(_mask(order)).alias("gram")
        levels.append(scratch.write(levels[-1].groupBy("fold", lower).agg(F.count("*").alias("n")), "counts"))
    levels, orders = levels[::-1], []
    few = _united([level.where("n <= 4").select(F.lit(order).alias("order"), "fold", "n") for order, level in enumerate(levels, 1)])
    few = few.groupBy("order", "fold", "n").count().collect()  # 4 a fold and order
    for order, level in enumerate(levels, 1):
        by_fold = [discounts({x.n: x["count"] for x in few if (x.order, x.fold) == (order, f)}) for f in range(FOLDS)]
        discount = F.lit(0.0)
        for f, d in enumerate(by_fold):
            discount = F.when(F.col("fold") == f, F.element_at(F.array(*map(F.lit, d)), F.least(F.col("n"), F.lit(3)).cast("int"))).otherwise(discount)
        same = Window.partitionBy("fold", "context")
        total = F.sum("n").over(same)
        shares = level.withColumn("context", F.shiftright("gram", 8)).withColumn("spared", discount)
        shares = shares.select("fold", "gram", "context", ((F.col("n") - F.col("spared")) / total).alias("share"), (F.sum("spared").over(same) / total).alias("weight"))
        if order == 1:
            p = shares.withColumn("below", F.lit(1 / 256))
        else:
            below = orders[-1].select("fold", F.col("gram").alias("lower"), F.col("p").alias("below"))
            p = shares.withColumn("lower", F.col("gram").bitwiseAND(_mask(order - 1))).join(growing(below), ["fold", "lower"])
        orders.append(scratch.write(p.select("fold", "gram", (F.col("share") + F.col("weight") * F.col("below")).cast("float").alias("p"), F.col("weight").cast("float").alias("weight")), "order"))
    for level in levels:
        scratch.drop(level)
    # Bytes alone and pairs of bytes are 256 and 256 * 256 a fold at most.
    one, alone = np.full((FOLDS, 256), 1 / 256), orders[0].collect()
    for x in alone:
        one[x.fold] = x.weight / 256
    for x in alone:
        one[x.fold, x.gram] = x.p
    low, pairs = np.repeat(one[:, None, :], 256, 1), orders[1].collect()
    for x in pairs:
        low[x.fold, x.gram >> 8] = x.weight * one[x.fold]
    for x in pairs:
        low[x.fold, x.gram >> 8, x.gram & 255] = x.p
    sizes = np.zeros(_PAIRS, np.int64)
    by_pair = _united([df.select(F.shiftright("gram", 8).bitwiseAND(_PAIRS - 1).alias("pair")) for df in orders[3:]]).groupBy("pair").count()
    for x in by_pair.collect():  # 256 * 256 at most
        sizes[x.pair] = x["count"]
    buckets = max(partitions(spark), -(-2 * int(sizes.sum()) // ENTRIES))
    splits = np.maximum(1, -(-sizes * buckets // max(1, int(sizes.sum()))))
    return Model(orders, low.reshape(FOLDS, _PAIRS), splits, buckets)


# -- lookups ----------------------------------------------------------------
def _bucket(pair: np.ndarray, before: np.ndarray, splits: np.ndarray, buckets: int) -> np.ndarray:
    """Of a context: its last two bytes, and the byte before them where they are
    so frequent that their entries are split."""
    part = wordkit.mix(before.astype(_U)) % splits[pair].astype(_U)
    return (wordkit.mix(pair.astype(_U) | part << _U(16)) % _U(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    bounds = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield int(bucket[a]), [c[order[a:b]] for c in columns]


_LOOKUPS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


def _entry(order: int, is_weight: bool, fold: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """One number for a table's key: probabilities by n-gram, weights by context."""
    return ((2 * order + is_weight) * FOLDS + fold.astype(np.int64)) << _FOLD | gram


def _shards(order: int, splits: np.ndarray, buckets: int):
    """Entries of one order, packed by bucket. Those of order 3 belong to all
    parts of their context, which is two bytes; the others to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def given() -> pa.RecordBatch:
            fold, gram, p, weight = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            context = gram >> 8
            contexts, first = np.unique(_entry(order, True, fold, context), return_index=True)
            keys = np.concatenate([_entry(order, False, fold, gram), contexts])
            values = np.concatenate([p, weight[first]])
            context = np.concatenate([context, context[first]])
            pair, before = context & (_PAIRS - 1), context >> 16 & 255
            if order == 3:
                many = splits[pair]
                part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                keys, values, pair = (np.repeat(c, many) for c in (keys, values, pair))
                bucket = (wordkit.mix(pair.astype(_U) | part.astype(_U) << _U(16)) % _U(buckets)).astype(np.int64)
            else:
                bucket = _bucket(pair, before, splits, buckets)
            rows = [(b, -1, pack([k, v.view("<u4")])) for b, (k, v) in _by_bucket(bucket, keys, values)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LOOKUPS, strict=True)], schema=_LOOKUPS)

        for batch in batches:
            if len(batch):
                held.append(tuple(batch.column(c).to_numpy() for c in ("fold", "gram", "p", "weight")))
                n += len(batch)
            if n > HELD:
                yield given()
                n = 0
        if held:
            yield given()

    return run


def probabilities(keys: np.ndarray, table: np.ndarray, values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of n-grams (fold and ORDER bytes): that of the longest end of the n-gram
    which the sorted table has, times the weights of the contexts above it."""
    fold, gram = keys >> _FOLD, keys & _mask(ORDER)
    out, scale, left = np.zeros(len(keys)), np.ones(len(keys)), np.arange(len(keys))

    def found(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return table[at] == wanted, at

    for order in range(ORDER, 2, -1):
        hit, at = found(_entry(order, False, fold[left], gram[left] & _mask(order)))
        out[left[hit]] = scale[left[hit]] * values[at[hit]]
        left = left[~hit]
        hit, at = found(_entry(order, True, fold[left], gram[left] >> 8 & _mask(order - 1)))
        scale[left[hit]] *= values[at[hit]]
    out[left] = scale[left] * low[fold[left], gram[left] & (_PAIRS - 1)]
    return out


def _looked_up(low):
    """Rows of a bucket in turn: the model's entries (block -1), then each
    block's n-grams, for which the log probabilities go back."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("worth", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, entries, table, values = None, [], np.zeros(0, np.int64), np.zeros(0, "<f4")
        for batch in batches:
            out = []
            for b, block, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "blob")), strict=True):
                if b != bucket:
                    bucket, entries, table, values = b, [], np.zeros(0, np.int64), np.zeros(0, "<f4")
                if block < 0:
                    entries.append(unpack(blob))
                    continue
                if entries:
                    table, first = np.unique(np.concatenate([k for k, _ in entries]), return_index=True)
                    values, entries = np.concatenate([v.view("<f4") for _, v in entries])[first], []
                keys = np.cumsum(unpack(blob)[0])
                nats = -np.log(np.maximum(probabilities(keys, table, values, low.value), 1e-25))
                out.append((block, b, pack([np.round(nats * FINE).astype("<i4")])))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


# -- documents --------------------------------------------------------------
def _distinct(data: np.ndarray, at: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """All keys of a block in ascending order."""
    out = np.zeros(0, np.int64)
    parts, n = [out], 0
    for _, high, keys in _keyed(data, at, folds):
        parts.append(_runs(np.sort(keys))[0])
        n += len(parts[-1])
        if n > HELD // 2 or high == len(data):  # few keys are held twice
            out = _runs(np.sort(np.concatenate([out, *parts])))[0]
            parts, n = [], 0
    return out


def _sums(data: np.ndarray, at: np.ndarray, folds: np.ndarray, keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of the values of the keys of each text's bytes."""
    out = np.zeros(len(at) - 1, np.int64)
    for low, high, found in _keyed(data, at, folds):
        order = np.argsort(found)
        own, places = _runs(found[order])
        worth = np.empty(len(found), np.int64)
        worth[order] = np.repeat(value[np.searchsorted(keys, own)], np.diff(np.append(places, len(found))))
        out += np.diff(np.concatenate([[0], np.cumsum(worth)])[np.clip(at, low, high) - low])
    return out


def _places(keys: np.ndarray, splits: np.ndarray, buckets: int) -> np.ndarray:
    gram = keys & _mask(ORDER)
    return _bucket(gram >> 8 & (_PAIRS - 1), gram >> 24 & 255, splits, buckets)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks, compressed."""
    for batch in batches:
        for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
            data, at = wordkit.raw(texts)
            ids, langs = part.column("doc_id"), part.column("lang")
            known = [c.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8) for c in (ids, langs)]
            names, ends = wordkit.raw(wordkit.as_texts(langs))
            docs = pack([ids.fill_null(0).to_numpy(), *known, part.column("fold").to_numpy().astype(np.uint8), names, np.diff(ends).astype(np.int32), part.column("h").to_numpy(), np.diff(at), data])
            yield pa.record_batch([pa.array([docs], pa.binary())], names=["docs"])


def _pieces(model):
    """A block's distinct n-grams by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, buckets = model.value
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                _, _, _, folds, _, _, _, lengths, data = unpack(blob.as_py())
                keys = _distinct(data, np.concatenate([[0], np.cumsum(lengths)]), folds)
                rows = [(b, block, pack([np.diff(k, prepend=0)])) for b, (k,) in _by_bucket(_places(keys, splits, buckets), keys)]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LOOKUPS, strict=True)], schema=_LOOKUPS)

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, buckets = model.value
        for batch in batches:
            for blob, worth in zip(batch.column("docs"), batch.column("worth"), strict=True):
                ids, known, spoken, folds, names, sizes, h, lengths, data = unpack(blob.as_py())
                at = np.concatenate([[0], np.cumsum(lengths)])
                keys = _distinct(data, at, folds)
                # What came back is in the order of buckets, then of keys.
                parts = sorted(worth.as_py() or [], key=lambda x: x["bucket"])
                value = np.empty(len(keys), np.int64)
                if len(keys):
                    value[np.argsort(_places(keys, splits, buckets), kind="stable")] = np.concatenate([unpack(x["worth"])[0] for x in parts])
                nats = _sums(data, at, folds, keys, value)
                ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                lang = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(names)).cast(pa.string())
                lang = pa.array([x if k else None for x, k in zip(lang.to_pylist(), spoken.tolist(), strict=True)], pa.string())
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=known == 0), lang, pa.array(h), pa.array(lengths, pa.int64()), pa.array(nats)], names=["doc_id", "lang", "h", "n_bytes", "nats"])

    return run


def scores(spark: SparkSession, src: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """doc_id, lang, h, n_bytes and nats (in parts of 1 / FINE) of each row of
    src (doc_id, lang, h, fold, text). Blocks stay where they were written: their
    table is bucketed by block, and what is shuffled are n-grams and values."""
    sent = spark.sparkContext.broadcast((model.splits, model.buckets))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = src.mapInArrow(_blocks, "docs binary").withColumn("block", F.monotonically_increasing_id())
    blocks = scratch.write_bucketed(blocks, "block", max(partitions(spark), -(-2 * size // TOGETHER)), "blocks")
    lookups = blocks.select("block", "docs").mapInArrow(_pieces(sent), "bucket int, block long, blob binary")
    for order, df in enumerate(model.orders[2:], 3):
        lookups = lookups.unionByName(df.mapInArrow(_shards(order, model.splits, model.buckets), "bucket int, block long, blob binary"))
    found = dealt(lookups, "block").mapInArrow(_looked_up(spark.sparkContext.broadcast(model.low)), "block long, bucket int, worth binary")
    # A block has at most one row for each bucket.
    worth = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "worth")).alias("worth"))
    both = blocks.select("block", "docs").join(growing(worth), "block", "left").select("docs", "worth")
    scored = scratch.write(both.mapInArrow(_scored(sent), "doc_id long, lang string, h long, n_bytes long, nats long"), "scores")
    for df in (blocks, *model.orders):
        scratch.drop(df)
    return scored


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per input row: doc_id, lang, n_bytes, perplexity (per byte of the
    text in UTF-8, null for empty texts), threshold, kept and text_hash
    (xxhash64 of the text).

    Trusted are the documents that `labels` (doc_id, quality, toxic) calls of
    quality 1 and not toxic; all of them are counted, and each is scored by the
    model of the folds it isn't in, as all documents are. Perplexities are
    smoothed by PRIOR bytes of the language's mean. The threshold is the quantile
    of the trusted documents of the language (null is one too; only a language
    without any takes that of all languages), in steps of 1 / GRAINS of log
    perplexity, so that it comes from counts and is the same in every run.
    Null and empty texts are not kept. Without any trusted document all others
    are kept. Rows that repeat a doc_id share its label; equal rows have equal
    results; an empty table gives an empty result; other columns are not read."""
    ship(spark)
    scratch = Scratch(spark, "quality")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    src = src.withColumns({"h": F.xxhash64("text"), "fold": F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(5)), F.lit(FOLDS)).cast("int")})
    by = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    trusted = scratch.write(by.where("q = 1 and t = 0 and doc_id is not null").select("doc_id"), "trusted")
    place, wanted, _ = id_filter(spark, trusted)
    likely = src.where("doc_id is not null").withColumn("place", place).select("doc_id", "text", "place").mapInArrow(_trusted(wanted), "doc_id long, text string")
    sure = likely.join(growing(trusted), "doc_id", "left_semi")
    model = train(spark, sure.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int")), scratch)
    scratch.release()
    scored = scores(spark, src, model, scratch)
    scratch.release()
    return judged(scratch, scored, trusted, quantile)


def judged(scratch: Scratch, scored: DataFrame, trusted: DataFrame, quantile: float) -> DataFrame:
    """Thresholds of the languages, and who passes them."""
    scored = scored.withColumn("language", F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n")))
    good = scored.where("n_bytes > 0").join(growing(trusted), "doc_id", "left_semi")
    mean = F.sum("nats") / F.sum("n_bytes") / FINE
    all_mean = good.agg(mean).first()[0] or 0.0
    sizes = scored.groupBy("language").agg(F.count("*").alias("weight"))
    means = scratch.write(sizes.join(good.groupBy("language").agg(mean.alias("mean")), "language", "left").select("language", "weight", F.coalesce("mean", F.lit(all_mean)).alias("mean")), "means")
    total = scored.count()
    smooth = (F.col("nats") / FINE + PRIOR * F.col("mean")) / (F.col("n_bytes") + PRIOR)
    own = join_unique(good, means, ["language"], "weight", total)
    bins = own.groupBy("language", F.floor(smooth * GRAINS).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = scratch.write(bins, "bins")
    both = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("language", F.lit("")))
    upto, everything = F.sum("n").over(Window.partitionBy("language").orderBy("bin")), F.sum("n").over(Window.partitionBy("language"))
    rows = both.withColumn("upto", upto).withColumn("all", everything).where(F.col("upto") >= quantile * F.col("all"))
    cuts = scratch.write(rows.groupBy("language").agg(((F.min("bin") + 1) / GRAINS).alias("cut")), "cuts")
    overall = cuts.where("language = ''").first()
    overall = overall.cut if overall else float("inf")
    plan = scratch.write(means.join(cuts, "language", "left").select("language", "weight", "mean", F.coalesce("cut", F.lit(overall)).alias("cut")), "plan")
    out = join_unique(scored, plan, ["language"], "weight", total).withColumn("log", F.when(F.col("n_bytes") > 0, smooth))
    return out.select("doc_id", "lang", "n_bytes", F.exp("log").alias("perplexity"), F.exp("cut").alias("threshold"), F.coalesce(F.col("log") < F.col("cut"), F.lit(False)).alias("kept"), F.col("h").alias("text_hash"))
