"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm import bytebpe, collocations, embeddings, linededup, media, mixing, packing, quality, search, simhash, toxicity, urlfilter, warc

#: Rules of the URL filter: verdict, and host with path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_read(spark, sf_dir, "pages"), least_bytes=1000)


def op3_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(_read(spark, sf_dir, "pages"), RULES)


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_read(spark, sf_dir, "documents"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=20)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=10, top=2000, subsumed=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_warc_normaliser,
        op3_url_filter_cascade,
        op4_cube_mixing,
        op5_toxicity_grammar,
        op6_quality_discriminant,
        op7_line_dedup,
        op8_cross_polytope,
        op9_media_chunks,
        op10_best_fit_packing,
        op11_ranked_search,
        op12_byte_bpe,
        op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN d.page_id < m.last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id < m.last THEN m.last END AS refers_to
        FROM d LEFT JOIN m ON d.payload_bytes >= 1000 AND d.payload_digest = m.payload_digest
    """,
    "op3_url_filter_cascade": """
        WITH r(verdict, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT p.page_id, rule_host || rule_path AS rule, verdict,
                     row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
              FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT p.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.nth = 1
    """,
    "op11_ranked_search": r"""
        WITH docs AS (SELECT row_number() OVER () AS id, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        terms AS (SELECT id, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        tf AS (SELECT id, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        lengths AS (SELECT id, sum(tf)::BIGINT AS n FROM tf GROUP BY id),
        total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
        asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
        w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
        points AS (SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS points
                   FROM tf JOIN w USING (term) JOIN lengths USING (id), total),
        scored AS (SELECT item_id, id, doc_id, sum(points)::BIGINT AS score FROM asked JOIN points USING (term) GROUP BY ALL),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        grams AS (SELECT lang, unnest([1, 2, 3]) AS k, w, i FROM starts),
        f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, w FROM c),
        scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score, cut
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cut], ' ')
                   JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cut + 1:], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_ AS (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3),
        over_ AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL),
        kept AS (SELECT lowest.* FROM lowest LEFT JOIN over_ o ON o.lang = lowest.lang AND o.phrase = lowest.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * lowest.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
    """,
}
