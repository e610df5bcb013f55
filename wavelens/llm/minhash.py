"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles. The sketch has T coordinates
(bins). In each of the first T rounds every shingle is thrown into a hashed bin
with a hashed value; rounds come one after the other and a bin keeps what the
earliest round put there, the smallest value of it; round T + b throws all into
bin b, so that every bin fills. Two sketches agree in a coordinate with the
probability of the sets' similarity, and the number of agreeing coordinates is
concentrated around it. Bands of coordinates are bucketed; documents that share
a bucket are candidates, and links are confirmed on the full sets.

No bucket emits all its pairs: its members are tried against its smallest
document. Buckets that then hold several components are not settled; documents
that they connect form groups, and a task takes one block of a group's documents
against another one and links them exactly: rare shingles first, a document of n
shingles has one of its first n - ceil(0.75 n) + 1 in common with any document
that it links, and documents of one component need no further trial."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkit
from ._common import FILTER_BITS, Scratch, growing, id_filter, in_filter, join_unique
from .components import connected_components

#: Words of a shingle, similarity of a link in percent, bands and coordinates of a band. A pair
#: at exactly the limit is no candidate with a probability of (1 - 0.75^5)^48 = 2.2e-6.
SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 48, 5
#: Documents of a block of an unsettled group.
BLOCK = 2_000
_U = np.uint64
_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, 4096, dtype=_U)


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes (at least one)."""
    out = np.full(t, np.iinfo(np.uint64).max, _U)
    n, done, step = len(shingles), 0, max(1, min(t, 2048 // max(1, len(shingles))))
    with np.errstate(over="ignore"):
        while done < 2 * t:
            rounds = np.arange(done, min(2 * t, done + step), dtype=_U)
            v = wordkit.mix(shingles[None, :] + _SEEDS[rounds % _U(4096)][:, None] + rounds[:, None])
            where = ((v >> _U(32)) * _U(t)) >> _U(32)
            forced = rounds >= _U(t)
            if forced.any():
                where[forced] = (rounds[forced] - _U(t))[:, None]
            np.minimum.at(out, where.reshape(-1).astype(np.int64), ((rounds[:, None] << _U(32)) | (v & _U(0xFFFFFFFF))).reshape(-1))
            done += len(rounds)
            if out.max() != np.iinfo(np.uint64).max:
                break
    return out


def band_keys(s: np.ndarray, bands: int) -> np.ndarray:
    rows = wordkit.mix(s).reshape(bands, -1)
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        for k in range(rows.shape[1]):
            out = wordkit.mix(out ^ rows[:, k])
    return out


def _sketches(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text"))):
                w = wordkit.words(texts, lower=True)
                sets = wordkit.shingles(w, wordkit.hashes(w), size)
                n = np.array([len(x) for x in sets])
                d1, d2, keys = [], [], []
                for x in sets:
                    with np.errstate(over="ignore"):
                        # Two sums over independent functions name the set.
                        d1.append(wordkit.mix(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
                        d2.append(wordkit.mix(x + _U(0x14057B7EF767814F)).sum(dtype=_U))
                    keys.append(band_keys(sketch(x, bands * rows), bands) if len(x) else np.zeros(0, _U))
                signed = lambda v: np.array(v, _U).view(np.int64)
                flat = np.concatenate([np.zeros(0, _U), *keys]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(d1)), pa.array(signed(d2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return run


def _sets(size: int, wanted):
    """Shingles of the documents whose place is set in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(wanted, batch.column("place").to_numpy())))
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text"))):
                w = wordkit.words(texts, lower=True)
                sets = wordkit.shingles(w, wordkit.hashes(w), size)
                yield pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def _shingles_of(spark: SparkSession, src: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the needed documents, and of few others: a filter of
    their hashed ids goes to the scan, so that no text is shuffled."""
    place, sent, bits = id_filter(spark, need)
    found = src.where("doc_id is not null").withColumn("place", place).mapInArrow(_sets(size, sent), "doc_id long, shingles binary").where("length(shingles) > 0")
    return found.join(growing(need), "doc_id", "left_semi") if bits == FILTER_BITS else found


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column("sa"), batch.column("sb"), []
            last, x = None, None
            for i in range(len(batch)):
                if last is None or not a[i].as_buffer().equals(last):
                    last = a[i].as_buffer()
                    x = np.frombuffer(last, _U)
                y = np.frombuffer(b[i].as_buffer(), _U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id
    that links reach, itself included) and kept (doc_id = component_id).

    Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than
    `size` words has its whole sequence as its one shingle; null, empty and blank
    texts have no shingle and stay alone. Two sets link when 100 * intersection
    >= percent * union; sets are compared by 64-bit hashes of their shingles.
    Rows that repeat a doc_id count as one node (each text links it). A null
    doc_id is a node of its own kind (component null, kept). An empty table gives
    an empty result; other columns are not read."""
    scratch = Scratch(spark, "near")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = scratch.write(src.mapInArrow(_sketches(size, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "sketches")
    total = made.count()
    # Equal sets: one of them, the smallest doc_id, stands for all.
    known = made.where("n > 0 and doc_id is not null")
    key = ["n", "d1", "d2"]
    same = scratch.write(known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("bands").alias("bands")), "same")
    placed = same.select("rep", F.explode("bands").alias("h"))
    buckets = scratch.write(placed.groupBy("h").agg(F.count("*").alias("weight"), F.min("rep").alias("low")).where("weight > 1"), "buckets")
    members = scratch.write(join_unique(placed, buckets.withColumn("size", F.col("weight")), ["h"], "weight", max(1, total * bands)), "members")
    pairs = scratch.write(members.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    scratch.release()
    component = None
    if pairs.head(1):
        need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = scratch.write(_shingles_of(spark, src, need, size), "sets")
        both = pairs.join(growing(sets.toDF("b", "sb")), "b").join(growing(sets.toDF("a", "sa")), "a").select("a", "b", "sa", "sb")
        links = scratch.write(both.mapInArrow(_verified(percent), "a long, b long"), "links")
        scratch.release()
        component = connected_components(scratch, links)
        more = _settled(scratch, members, component, sets, percent)
        if more is not None:
            component = connected_components(scratch, links.unionByName(more))
    # Every row: its set's representative, that one's component.
    best = same.select(*key, "rep", "weight")
    if component is not None:
        best = best.join(component, F.col("rep") == F.col("node"), "left").select(*key, "rep", "weight", F.coalesce("component", "rep").alias("component"))
    else:
        best = best.withColumn("component", F.col("rep"))
    best = scratch.write(_closed(scratch, known, best, key), "classes")
    out = join_unique(known.select("doc_id", *key), best.select(*key, "component", "weight"), key, "weight", total)
    rest = made.where("n = 0 or doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component"), "n")
    out = out.select("doc_id", "component", "n").unionByName(rest)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _settled(scratch: Scratch, members: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components of buckets that pivots did not settle."""
    several = members.where("size > 2")
    label = F.coalesce("component", "rep").alias("component")
    now = several.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", "low", label)
    state = now.groupBy("h").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("weight")).where("c1 < c2").select("h", "weight")
    state = scratch.write(state, "open")
    if not state.head(1):
        return None
    open_members = scratch.write(join_unique(now, state, ["h"], "weight", several.count()), "unsettled")
    groups = connected_components(scratch, open_members.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    docs = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    sizes = docs.groupBy("g").agg(F.count("*").alias("weight"))
    docs = join_unique(docs, sizes.withColumn("blocks", F.ceil(F.col("weight") / BLOCK).cast("long")), ["g"], "weight", docs.count())
    docs = docs.join(component.toDF("doc_id", "c"), "doc_id", "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    # Each document goes to the tasks of its block with every block of the group, itself included.
    docs = docs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    docs = docs.select("doc_id", "g", F.coalesce("c", "doc_id").alias("c"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    found = docs.join(growing(sets), "doc_id").groupBy("g", "x", "y").applyInArrow(_grouped(percent), "a long, b long")
    return scratch.write(found, "links")


def _grouped(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, labels = table.column("doc_id").to_pylist(), table.column("c").to_pylist()
        sets = [np.frombuffer(x, _U) for x in table.column("shingles").to_pylist()]
        order = np.argsort(ids, kind="stable").tolist()
        distinct, counts = np.unique(np.concatenate(sets), return_counts=True)
        place = np.empty(len(distinct), np.int64)
        place[np.lexsort((distinct, counts))] = np.arange(len(distinct))  # rare ones first
        parent = {c: c for c in labels}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        holders: dict[int, list[int]] = {}
        links: list[tuple[int, int]] = []
        for i in order:
            x = sets[i]
            first = np.sort(place[np.searchsorted(distinct, x)])[: len(x) - -(-percent * len(x) // 100) + 1].tolist()
            tried = set()
            for shingle in first:
                for j in holders.get(shingle, ()):
                    if j in tried or find(labels[i]) == find(labels[j]):
                        continue
                    tried.add(j)
                    y = sets[j]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        links.append((ids[i], ids[j]))
                        parent[find(labels[i])] = find(labels[j])
                holders.setdefault(shingle, []).append(i)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _closed(scratch: Scratch, known: DataFrame, best: DataFrame, key: list[str]) -> DataFrame:
    """Rows that repeat a doc_id with other texts join that id's components."""
    twice = known.groupBy("doc_id").agg(F.count_distinct(*key).alias("k")).where("k > 1").select("doc_id")
    twice = scratch.write(known.join(twice, "doc_id", "left_semi").join(best, key).select("doc_id", "component").distinct(), "twice")
    if not twice.head(1):
        return best
    low = twice.groupBy("doc_id").agg(F.min("component").alias("low"))
    links = twice.join(low, "doc_id").select(F.col("component").alias("a"), F.col("low").alias("b")).union(twice.select("component", "doc_id"))
    joined = connected_components(scratch, links)
    return best.join(joined.toDF("component", "to"), "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
