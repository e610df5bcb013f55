"""Language identification, words first.

A word that the model knows adds its log frequency in each language. For any
other word the longest character n-grams that the model knows anything of are
used, then ever shorter ones down to single letters. The model is fitted on a
sample of bounded size and keeps every word and n-gram of it."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkit
from ._common import Scratch, ship

#: Bytes of text that the model is fitted on, about: a hashed sample of the documents, of each language the
#: same share of it. The longest n-gram.
FIT_BYTES, LONGEST = 24 << 20, 5
UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+")
#: Words outside the model that a worker remembers.
_REMEMBERED = 300_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # The pattern also takes numbers that aren't decimal digits.
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split(" ") if w]


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word between its bounds (single letters without them)."""
    s = word if n == 1 else f"^{word}$"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, item, n): size 0 for words, else that of the n-grams."""
    for batch in batches:
        for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), 8 << 20):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(part.column("lang").to_pylist(), texts.to_pylist(), strict=True):
                words[lang].update(words_of(text))
            out: tuple[list, ...] = ([], [], [], [])
            for lang, found in words.items():
                tables = [found, *(Counter() for _ in range(LONGEST))]
                for word, n in found.items():
                    for size in range(1, LONGEST + 1):
                        for gram in grams_of(word, size):
                            tables[size][gram] += n
                for size, table in enumerate(tables):
                    out[0].extend([lang] * len(table))
                    out[1].extend([size] * len(table))
                    out[2].extend(table.keys())
                    out[3].extend(table.values())
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["lang", "size", "item", "n"])


class Model:
    """Log frequencies by language of words (size 0) and n-grams."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = langs
        place = {lang: k for k, lang in enumerate(langs)}
        counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, size, item, n in rows:
            counts[size].setdefault(item, np.zeros(len(langs)))[place[lang]] = n
        self.items: list[dict[str, int]] = []
        self.scores: list[np.ndarray] = []
        for size, table in enumerate(counts):
            all_n = np.array([max(1, totals.get((lang, size), 0)) for lang in langs], float)
            matrix = np.array(list(table.values())).reshape(len(table), len(langs))
            self.items.append({item: k for k, item in enumerate(table)})
            self.scores.append(np.log((matrix + 0.5) / (all_n + 0.5 * max(1, len(table)))).astype(np.float32))

    def backed_off(self, word: str) -> np.ndarray:
        for size in range(LONGEST, 0, -1):
            known = [k for g in grams_of(word, size) if (k := self.items[size].get(g)) is not None]
            if known:
                return self.scores[size][known].mean(0)
        return np.zeros(len(self.langs), np.float32)


def fit(spark: SparkSession, rows: DataFrame, fit_bytes: int = FIT_BYTES) -> Model:
    """The model of rows (doc_id, text, lang). Languages share `fit_bytes` of text
    equally; one with more is sampled by a hash of doc_id to about its share, one
    with less is taken whole. Every word and n-gram of the sample is kept, so the
    model's size is bounded by fit_bytes, however many rows and languages."""
    scratch = Scratch(spark, "lang")
    sizes = {x.lang: x.n or 0 for x in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return Model([], [], {})
    each = fit_bytes / len(sizes)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / max(1, n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts = chosen.select("lang", "text").mapInArrow(_counts, "lang string, size int, item string, n long")
    counts = scratch.write(counts.groupBy("lang", "size", "item").agg(F.sum("n").alias("n")), "counts")
    totals = {(x.lang, x["size"]): x.n for x in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    found = counts.select("lang", "size", "item", "n").toArrow()
    return Model(sorted(sizes), list(zip(*(found.column(c).to_pylist() for c in found.column_names), strict=True)), totals)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        known, base, extra, langs = m.items[0], m.scores[0], {}, len(m.langs)
        rows = np.zeros((1024, langs), np.float32)
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), 8 << 20):
                best, score = [], []
                for text in texts.to_pylist():
                    found = Counter(words_of(text))
                    if not found or not langs:
                        best.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    at = [known.get(w, -1) for w in found]
                    n = np.fromiter(found.values(), np.float64, len(found))
                    place = np.array(at)
                    total = n[place >= 0] @ base[place[place >= 0]] if (place >= 0).any() else np.zeros(langs)
                    others = [(w, c) for w, c, k in zip(found, found.values(), at, strict=True) if k < 0]
                    if others:
                        if len(extra) > _REMEMBERED:
                            extra.clear()
                        where = []
                        for w, _ in others:
                            k = extra.get(w)
                            if k is None:
                                k = extra[w] = len(extra)
                                if k >= len(rows):
                                    rows = np.concatenate([rows, np.zeros_like(rows)])
                                rows[k] = m.backed_off(w)
                            where.append(k)
                        total = total + np.array([c for _, c in others], float) @ rows[where]
                    top = int(total.argmax())
                    best.append(m.langs[top])
                    score.append(float(1.0 / np.exp(total - total[top]).sum()))
                yield pa.record_batch([part.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (share of the best language, 0 to 1) of every
    whole text; `und` with score 0 for null texts, texts without a letter and a
    model without languages. Ties go to the first language by code point.
    Repeated rows give repeated results; other columns are not read."""
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_predicted(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the model may not learn from the document (null: it may not either)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from the texts and non-null
    languages of the documents that are not held out (crc32 of doc_id as text,
    modulo 3, is not 1; a null doc_id teaches nothing), then predict all."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(spark, src.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null"))
    out = predict(spark, src, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
