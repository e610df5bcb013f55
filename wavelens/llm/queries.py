"""The registered queries of this subpackage, and their SQL where SQL can say
the same. Each reads its whole table and returns one row per document (or per
query and rank)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table
from .ann import nearest
from .bitplane import token_files
from .bpe_codec import encode_decode
from .exact_dedup import exact_dedup
from .langid import identify
from .minhash import near_duplicates
from .mixing import mix
from .quality import classify
from .substring_dedup import remove_repeats
from .token_counts import token_counts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark, read_table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), "turn")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, read_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, read_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_near_duplicates, op4_substring_dedup, op5_mix_sources, op6_language_id, op7_token_counts, op8_token_files, op9_nearest_neighbours, op10_quality, pipeline)}

_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
        FROM n WINDOW w AS (PARTITION BY s ORDER BY cp DESC, doc_id)""",
    "op3_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        same AS (SELECT min(doc_id) OVER (PARTITION BY k) AS rep, doc_id FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id)),
        r AS (SELECT s.* FROM s JOIN (SELECT DISTINCT rep FROM same) ON doc_id = rep),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, doc_id FROM same UNION SELECT doc_id, rep FROM same),
        t(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.d WHERE t.c < e.b)
        SELECT d AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, min(c) = d AS kept
        FROM t LEFT JOIN n ON n.doc_id = d GROUP BY d""",
    "op4_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(20) t(j)),
        p AS (SELECT doc_id, list(p ORDER BY p) AS p, count(*) AS n FROM c GROUP BY doc_id),
        x AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM w),
        y AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.i GROUP BY x.doc_id)
        SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN p USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op5_mix_sources": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, ('0x' || substr(md5(doc_id || ':11'), 1, 8))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        o AS (SELECT *, sum(z) OVER () - coalesce(sum(3 * z) OVER a, 0) AS ls, sum(w) OVER () - coalesce(sum(w) OVER a, 0) AS lw FROM s WINDOW a AS (ORDER BY 3 * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, 3 * z * lw <= ls * w AS stopped FROM o),
        t AS (SELECT source, z, [0.0::DOUBLE, 0.5::DOUBLE, -0.5::DOUBLE][w] AS slope, CASE WHEN stopped THEN (3 * z)::DOUBLE ELSE w * (sum(z) OVER () - coalesce(sum(3 * z) FILTER (stopped) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT stopped) OVER ())::DOUBLE END AS target FROM c),
        p AS (SELECT doc_id, h, size, z, slope, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - size AS start, least(floor(target + 0.5)::BIGINT, 3 * z) AS budget FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE (budget // z * size + least(size, greatest(0, budget - budget // z * z - start))) END::BIGINT AS taken, start::DOUBLE / greatest(budget, 1)::DOUBLE AS share FROM p),
        r AS (SELECT *, CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN share ELSE 2 * share / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END END AS pt FROM q)
        SELECT doc_id, size::BIGINT AS size, z AS source_size, target, taken, round(pt, 9) AS position, row_number() OVER (ORDER BY pt NULLS LAST, h, doc_id) AS turn
        FROM r""",
    "op9_nearest_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
