"""One query per operator, over whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .spm import encode_decode

    found = encode_decode(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), ("ids_le", "decoded", "aligned", "n_ids"))
    return found.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "aligned")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_dedup

    return line_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(spark, table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exactdedup import exact_dedup

    return exact_dedup(spark, table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(spark, table(spark, sf_dir, "documents"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filteraudit import filter_interactions

    return filter_interactions(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import similar_documents

    return similar_documents(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language_id, op3_warc, op4_near_dedup, op5_sentencepiece, op6_line_dedup, op7_benchmark_decontamination,
        op8_sharding, op9_exact_dedup, op10_quality_classifier, op11_source_divergence, op12_filter_interactions, op13_simhash,
    )
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, TRUE AS resolved
        FROM (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages
        )
    """,
    # pairs that share a shingle, their intersections counted; then what each document reaches over the links
    "op4_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    # words are parted by white space of ASCII only: the tables have no other, nor scripts without blanks
    "op6_line_dedup": r"""
        WITH d AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20]+') AS w, regexp_extract_all(text, '[\x09-\x0D\x1C-\x20]*[^\x09-\x0D\x1C-\x20]+') AS p
            FROM documents
        ), k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        later AS (SELECT doc_id, i FROM (SELECT *, min(struct_pack(d := doc_id, b := i)) OVER (PARTITION BY key) AS first FROM k) WHERE struct_pack(d := doc_id, b := i) > first),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM later),
        kept AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM gone)),
        cut AS (SELECT doc_id, string_agg(piece, '' ORDER BY j) AS text FROM kept ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_removed,
               CASE WHEN n IS NULL THEN d.text ELSE coalesce(cut.text, '') || substr(d.text, length(array_to_string(p, '')) + 1) END AS text
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cut USING (doc_id)
    """,
    "op7_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        dw AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
        ),
        hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw USING (n, key)),
        place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN place USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # every group and language has every kept term, with a count of 0 or more
    "op11_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT doc_id, lang, source,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM d
        ),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
        vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        p AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                   1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) + v) AS p
            FROM g JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN c USING (lang, source, term)
        ),
        q AS (
            SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN vocabulary USING (lang)
        ),
        pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    # the filters a to e are the bits of m; each order's steps are summed from the counts by mask
    "op12_filter_interactions": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), m AS (
            SELECT part, doc_id, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
                   + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                   + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS m FROM d
        ), l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        n AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
            WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ),
        s AS (
            SELECT part, filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS past
            FROM (SELECT DISTINCT part FROM n), o, (SELECT unnest(range(1, 6)) AS step)
        ),
        y AS (
            SELECT s.part, filter_order, step, s.bit,
                   sum(CASE WHEN m & (p | s.bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & p = 0 AND m & s.bit > 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN m & p > 0 AND m & s.bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = s.bit THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN m & p = 0 AND m & s.bit > 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN m & p = 0 AND m & s.bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM (SELECT *, CAST(past AS INT) AS p FROM s) s JOIN n ON n.part = s.part GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM y
    """,
}
