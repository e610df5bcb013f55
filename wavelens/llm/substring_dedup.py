"""Removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest hash among
its runs of `gram` words; consecutive windows that share it travel as one packed
string (a super-k-mer) to the minimiser's bucket, where windows are sorted and
each one's first occurrence is found exactly. What is not the first is given
back to the documents as ranges, and the words that they cover go.

Runs of words that make up a large share of the corpus are ranked after all
others as minimisers. Windows with anything else in them then go to that, and
windows within such common passages alone make equal strings, of which each
block of documents sends one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkit
from ._common import Scratch, dealt, growing, partitions
from .blobs import pack, unpack

#: Words of a window and of a minimiser, and windows of a packed string at most.
WINDOW, GRAM, LONGEST = 20, 4, 256
#: Share of all grams from which a gram is common (so at most 1 / share are, 8 MB of hashes), its least
#: count, and the size of the summary that a task keeps of its grams.
COMMON, COMMON_LEAST, SUMMARY = 1e-6, 500, 200_000
#: Bytes of packed strings in a bucket, about, of those of it that are sorted together, and of text
#: that is dealt out together.
BUCKET, SORTED, TOGETHER = 48 << 20, 4 << 20, 6 << 20
_U = np.uint64
_LATE = _U(1 << 63)


def _grams(w: wordkit.Words, gram: int) -> np.ndarray:
    """Hash of the run at each word, below the late half; runs over a text's end too."""
    h = np.concatenate([wordkit.hashes(w), np.zeros(gram - 1, _U)])
    return wordkit.runs(h, gram) >> _U(1)


def _common(gram: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, _U), np.zeros(0, np.int64), 0
        for batch in batches:
            for _, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
                w = wordkit.words(texts)
                whole = np.flatnonzero(w.doc[: max(0, len(w.doc) - gram + 1)] == w.doc[gram - 1 :]) if len(w.doc) >= gram else []
                k, c = np.unique(_grams(w, gram)[whole], return_counts=True)
                total += len(whole)
                k, c = k[c > 1], c[c > 1]
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, c]), len(keys)).astype(np.int64)
                if len(keys) > SUMMARY:
                    top = np.sort(np.argpartition(counts, -SUMMARY // 2)[-SUMMARY // 2 :])
                    keys, counts = keys[top], counts[top]
        many = counts >= max(2, share * total)
        yield pa.record_batch([pa.array(keys[many].view(np.int64)), pa.array(counts[many])], names=["gram", "n"])
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], names=["gram", "n"])

    return run


def common_grams(src: DataFrame, gram: int = GRAM, share: float = COMMON, least: int = COMMON_LEAST) -> np.ndarray:
    """Sorted hashes of the grams with at least `share` of all (1 / share of them at most)."""
    found = src.select("text").mapInArrow(_common(gram, share), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = found.where("gram = -1").select(F.max("n")).first()[0] or 0
    rows = found.where("gram >= 0").where(F.col("n") >= max(least, share * total)).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(_U))


def super_kmers(w: wordkit.Words, common: np.ndarray, window: int = WINDOW, gram: int = GRAM, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows."""
    n = len(w.doc) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    g = _grams(w, gram)
    if len(common):
        at = np.minimum(np.searchsorted(common, g), len(common) - 1)
        g = np.where(common[at] == g, g | _LATE, g)
    span, have, low = window - gram + 1, 1, g
    while have < span:  # the smallest of ever more grams from each on
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    low, valid = low[:n], w.doc[:n] == w.doc[window - 1 :]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (w.doc[1:n] != w.doc[: n - 1])
    starts = np.flatnonzero(first)
    upto = np.cumsum(valid)
    size = np.diff(np.append(upto[starts] - 1, upto[-1]))
    parts = -(-size // longest)
    if (parts > 1).any():
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, size = np.repeat(starts, parts) + k * longest, np.minimum(np.repeat(size, parts) - k * longest, longest)
    return starts, size, low[starts]


def _spaced(w: wordkit.Words) -> tuple[bytes, np.ndarray]:
    """All words, a space after each, and where each starts (and the end)."""
    length = w.end - w.start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    inside = ~wordkit._SPACE[w.data]
    out[np.arange(inside.sum()) + np.repeat(np.arange(len(length)), length)] = w.data[inside]
    return out.tobytes(), at


def _dealt(buckets: int, common, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = common.value
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
                doc, th = (part.column(c).to_numpy() for c in ("doc", "th"))
                order = np.lexsort((th, doc))
                doc, th, texts = doc[order], th[order], texts.take(pa.array(order))
                w = wordkit.words(texts)
                starts, size, low = super_kmers(w, hot, window, gram)
                flat, at = _spaced(w)
                own, begin = w.doc[starts], starts - w.first()[:-1][w.doc[starts]]
                hashed = wordkit.mix(low)
                bucket, fine = (hashed % _U(buckets)).astype(np.int64), ((hashed >> _U(40)) & _U(255)).astype(np.uint8)
                order = np.argsort(bucket, kind="stable")
                bucket, fine, own, begin, size = bucket[order], fine[order], own[order], begin[order], size[order]
                low, high = at[starts[order]].tolist(), at[starts[order] + size + window - 1].tolist()
                rows, ends = [], np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)).tolist()
                a = 0
                for b in ends if len(bucket) else ():
                    seen: dict[bytes, int] = {}
                    keep, again = [], []
                    for i in range(a, b):
                        j = seen.setdefault(flat[low[i] : high[i]], i)
                        if j == i:
                            keep.append(i)
                        elif (doc[own[i]], th[own[i]], begin[i]) != (doc[own[j]], th[own[j]], begin[j]):
                            again.append(i)
                    sent = [x for i in (keep, again) for x in (doc[own[i]], th[own[i]], begin[i].astype(np.int32), size[i].astype(np.int32))]
                    lengths = np.fromiter(map(len, seen), np.int32, len(seen))
                    rows.append((int(bucket[a]), pack([b"".join(seen), lengths, fine[keep], *sent])))
                    a = b
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    return run


def repeated_windows(flat: bytes, doc: np.ndarray, th: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """For each window of the packed strings (in ascending order of doc, th,
    begin), whether an equal one comes earlier. Windows are sorted by a hash of
    exact word numbers; equal hashes are compared word by word."""
    data = np.frombuffer(flat, np.uint8)
    ends = np.flatnonzero(data == 0x20) + 1
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])
    word = tokens.dictionary_encode().indices.to_numpy()
    # Words of each string: its windows and window - 1 more.
    heads = np.cumsum(size + window - 1) - (size + window - 1)
    place = np.repeat(heads - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key = wordkit.runs(wordkit.mix(word.astype(_U)), window)[place]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    p, q = order[~head], leader[~head]
    equal = np.ones(len(p), bool)
    for k in range(window):
        equal &= word[place[p] + k] == word[place[q] + k]
    repeat = np.zeros(len(key), bool)
    kmer = np.repeat(np.arange(len(size)), size)
    at = begin[kmer] + np.arange(len(kmer)) - np.repeat(np.cumsum(size) - size, size)
    same = (doc[kmer[p]] == doc[kmer[q]]) & (th[kmer[p]] == th[kmer[q]]) & (at[p] == at[q])
    repeat[p[equal & ~same]] = True
    if not equal.all():  # two windows share a hash: settle those by content
        for h in np.unique(key[p[~equal]]):
            seen: dict[tuple, int] = {}
            for i in order[np.searchsorted(sorted_key, h, "left") : np.searchsorted(sorted_key, h, "right")].tolist():
                j = seen.setdefault(tuple(word[place[i] : place[i] + window].tolist()), i)
                repeat[i] = (doc[kmer[i]], th[kmer[i]], at[i]) != (doc[kmer[j]], th[kmer[j]], at[j])
    return repeat


def _found(window: int):
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Strings whose minimisers share some bits are sorted together, a few
        MB at a time."""
        strings, tables = [], [[] for _ in range(10)]
        for blob in blobs:
            text, *cols = unpack(blob)
            for into, x in zip(tables, cols, strict=True):
                into.append(x)
            strings.append(text.tobytes())
        length, fine, doc, th, begin, size, *again = map(np.concatenate, tables)
        yield batch_of(again)
        flat, ends = b"".join(strings), np.cumsum(length.astype(np.int64))
        strings.clear()
        order = np.lexsort((begin, th, doc, fine))
        places = np.searchsorted(fine[order], np.arange(257))
        upto = np.concatenate([[0], np.cumsum(length[order].astype(np.int64))])[places]
        k = 0
        while k < 256:
            j = max(k + 1, int(np.searchsorted(upto, upto[k] + SORTED, "right")) - 1)
            own = order[places[k] : places[j]]
            if len(own):
                yield part(flat, (ends - length)[own], ends[own], doc[own], th[own], begin[own].astype(np.int64), size[own].astype(np.int64))
            k = j

    def part(flat: bytes, low: np.ndarray, high: np.ndarray, doc: np.ndarray, th: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((begin, th, doc))
        doc, th, begin, size = doc[order], th[order], begin[order], size[order]
        text = b"".join([flat[a:b] for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True)])
        repeat = repeated_windows(text, doc, th, begin, size, window)
        kmer = np.repeat(np.arange(len(size)), size)
        first = repeat.copy()
        first[1:] &= ~repeat[:-1] | (kmer[1:] != kmer[:-1])
        starts, upto = np.flatnonzero(first), np.cumsum(repeat)
        n = np.diff(np.append(upto[starts] - 1, upto[-1]))
        own = kmer[starts]
        return batch_of([doc[own], th[own], begin[own] + starts - (np.cumsum(size) - size)[own], n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if held and b != last:  # sorted by bucket
                    yield from bucket(held)
                    held = []
                held.append(blob)
                last = b
        if held:
            yield from bucket(held)

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
                w = wordkit.words(texts)
                flat, at = _spaced(w)
                first, ranges = w.first(), part.column("ranges")
                lists = ranges.fill_null([]) if ranges.null_count else ranges
                n = np.diff(lists.offsets.to_numpy())
                values = lists.flatten()
                base = np.repeat(first[:-1], n)
                start, size = (values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                cover = np.zeros(len(w.doc) + 1, np.int64)
                np.add.at(cover, base + start, 1)
                np.add.at(cover, base + start + size + window - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                bytes_kept = np.frombuffer(flat, np.uint8)[np.repeat(~gone, np.diff(at))].tobytes()
                ends = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(at)))])[first]
                kept = [bytes_kept[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cols = {"doc_id": part.column("doc_id"), "n_words": pa.array(w.count), "n_removed": pa.array(np.diff(removed[first])), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
                if with_text:
                    cols["kept_text"] = pa.array([k.decode() for k in kept], pa.string())
                yield pa.record_batch(list(cols.values()), names=list(cols))

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space) and, if asked for, kept_text.

    Words `[^\\x20\\x09-\\x0D]+`, unchanged. Each word goes that lies in a window
    whose word sequence also starts earlier: in a smaller doc_id, or earlier in
    the same document; windows are judged on the input. Null and empty texts have
    no words. Null doc_ids come after all others. Rows that repeat a doc_id come
    by the hash of their text; full repeats of a row count as one document, with
    one result for each. An empty table gives an empty result; other columns are
    not read."""
    scratch = Scratch(spark, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Null ids come after the largest one: their text hashes have a bit that others lack.
    th = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.when(F.col("doc_id").isNull(), 1 << 62).otherwise(0)
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), th.alias("th")]
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-3 * size // BUCKET))
    common = spark.sparkContext.broadcast(common_grams(src, gram))
    sent = src.select(*key, "text").mapInArrow(_dealt(buckets, common, window, gram), "bucket int, blob binary")
    ranges = dealt(sent).mapInArrow(_found(window), "doc long, th long, start int, n int")
    ranges = scratch.write(ranges, "ranges")
    own = ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))  # as many as the document has words, at most
    both = src.select("doc_id", *key, "text").join(growing(own), ["doc", "th"], "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(_kept(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
