"""Registered queries on lookups, audits, seeds and parameter sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.functions import headers as H
from loopweave.operators import agreement, audit, lookups, matrix, orfs, sensitivity, tracks
from loopweave.plans import adapters as A
from loopweave.plans.more_queries import _DIST, _panel_distances
from loopweave.plans.queries import _NEAR, _near, _orf_sql, SUMMARY, query, rounded


def _ari_sql(source: str, by: str, x: str, y: str, prefix: str = "z") -> str:
    """CTEs that end in ``{prefix}(by, n, ari, nmi)`` for rows of ``source``."""
    p = prefix
    return f"""{p}c AS (SELECT {by}, {x} AS x, {y} AS y, count(*) AS c FROM {source} GROUP BY ALL),
    {p}a AS (SELECT {by}, sum(m * (m - 1) / 2.0) AS s FROM (SELECT {by}, x, sum(c) AS m FROM {p}c GROUP BY ALL) GROUP BY ALL),
    {p}b AS (SELECT {by}, sum(m * (m - 1) / 2.0) AS s FROM (SELECT {by}, y, sum(c) AS m FROM {p}c GROUP BY ALL) GROUP BY ALL),
    {p}t AS (SELECT {by}, sum(c * (c - 1) / 2.0) AS cells, CAST(sum(c) AS DOUBLE) AS n FROM {p}c GROUP BY ALL),
    {p}e AS (SELECT {by}, c, CAST(sum(c) OVER (PARTITION BY {by}) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY {by}, x) AS DOUBLE) AS cx, CAST(sum(c) OVER (PARTITION BY {by}, y) AS DOUBLE) AS cy FROM {p}c),
    {p}m AS (SELECT {by}, sum(c / n * ln(c * n / (cx * cy))) AS mi, sum(-c / n * ln(cx / n)) AS hx, sum(-c / n * ln(cy / n)) AS hy FROM {p}e GROUP BY ALL),
    {p} AS (SELECT {by}, n, CASE WHEN abs(({p}a.s + {p}b.s) / 2 - {p}a.s * {p}b.s / nullif(n * (n - 1) / 2, 0)) > 1e-9 * n THEN (cells - {p}a.s * {p}b.s / (n * (n - 1) / 2)) / (({p}a.s + {p}b.s) / 2 - {p}a.s * {p}b.s / (n * (n - 1) / 2)) ELSE 1.0 END AS ari,
        CASE WHEN (hx + hy) / 2 < 1e-15 THEN 1.0 ELSE greatest(0.0, mi) / ((hx + hy) / 2) END AS nmi FROM {p}t JOIN {p}a USING ({by}) JOIN {p}b USING ({by}) JOIN {p}m USING ({by}))"""


_SEEDS = """asg AS (SELECT l_orderkey, l_linenumber, 1 AS seed, l_returnflag || l_linestatus AS label FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 2, l_returnflag FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3, CAST(CAST(floor(l_quantity) AS INTEGER) % 3 AS VARCHAR) FROM lineitem)"""


def _seeds(spark, sf_dir):
    """Three labellings of order lines, as if by three seeds."""
    rows = A.read(spark, sf_dir, "lineitem")
    labels = (F.concat("l_returnflag", "l_linestatus"), F.col("l_returnflag"), (F.floor("l_quantity").cast("int") % 3).cast("string"))
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("seed"), v.alias("label")) for k, v in enumerate(labels))))
    return rows.select("l_orderkey", "l_linenumber", each.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query(f"""WITH {_SEEDS}, both_ AS (SELECT CAST(a.seed * 10 + b.seed AS INTEGER) AS sp, a.label AS la, b.label AS lb FROM asg a JOIN asg b USING (l_orderkey, l_linenumber) WHERE a.seed < b.seed), {_ari_sql('both_', 'sp', 'la', 'lb')}
    SELECT count(*) AS pairs, round(avg(ari), 6) + 0.0 AS ari_mean, round(stddev_samp(ari), 6) + 0.0 AS ari_sd, round(min(ari), 6) + 0.0 AS ari_min FROM z""")
def M7_seed_ari(spark, sf_dir):
    return rounded(agreement.seed_agreement(_seeds(spark, sf_dir), ["l_orderkey", "l_linenumber"]))


@query(f"""WITH core AS (SELECT event_id, event_type AS label FROM events WHERE event_id % 10 <> 0), again AS (SELECT event_id, CASE WHEN value < 20 THEN 'click' ELSE event_type END AS label FROM events WHERE event_id % 7 <> 0),
    j AS (SELECT 1 AS g, c.label AS lc, a.label AS la, c.event_id AS ic, a.event_id AS ia FROM core c FULL OUTER JOIN again a ON a.event_id = c.event_id), mm AS (SELECT * FROM j WHERE ic IS NOT NULL AND ia IS NOT NULL), {_ari_sql('mm', 'g', 'lc', 'la')}
    SELECT count(ia) AS n_again, count(ic) AS n_core, count(*) FILTER (WHERE ic IS NOT NULL AND ia IS NOT NULL) AS n_matched, count(*) FILTER (WHERE ic IS NULL OR ia IS NULL) AS n_unmatched,
        round(avg(CASE WHEN lc = la THEN 1.0 ELSE 0.0 END) FILTER (WHERE ic IS NOT NULL AND ia IS NOT NULL), 6) AS exact, (SELECT round(ari, 6) + 0.0 FROM z) AS ari, (SELECT round(nmi, 6) + 0.0 FROM z) AS nmi FROM j""")
def M8_reproduction(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events")
    core = rows.where("event_id % 10 <> 0").select("event_id", F.col("event_type").alias("label"))
    again = rows.where("event_id % 7 <> 0").select("event_id", F.when(F.col("value") < 20, "click").otherwise(F.col("event_type")).alias("label"))
    return rounded(agreement.reproduction(core, again, ["event_id"]))


@query(f"""WITH ks AS (SELECT unnest([1, 2, 3, 5, 8]) AS k), asg AS (SELECT k, c_custkey AS name, (c_custkey * 7 + c_nationkey) % k AS label, c_mktsegment AS known FROM customer, ks WHERE k >= 2), {_ari_sql('asg', 'k', 'known', 'label')}
    SELECT k, round(ari, 6) + 0.0 AS ari, round(nmi, 6) + 0.0 AS nmi FROM z""")
def M9_k_scan(spark, sf_dir):
    rows = A.read(spark, sf_dir, "customer")
    each = rows.select(F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 8)))).alias("k"), F.col("c_custkey").alias("name"), "c_nationkey")
    asg = each.select("k", "name", ((F.col("name") * 7 + F.col("c_nationkey")) % F.col("k")).alias("label"))
    return rounded(agreement.k_scan(asg, rows.select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("label")), rows.count()))


_RUNS_OF = """runs AS (SELECT l_returnflag AS geometry, CAST(l_linenumber AS INTEGER) AS k, CAST(floor(l_discount * 100) AS INTEGER) AS seed, CAST(avg(l_quantity) AS DOUBLE) AS silhouette, CAST(max(l_tax) AS DOUBLE) AS davies_bouldin FROM lineitem GROUP BY ALL),
    su AS (SELECT geometry, k, count(*) AS n_seeds, avg(silhouette) AS silhouette_mean, stddev_samp(silhouette) AS silhouette_sd, avg(davies_bouldin) AS davies_bouldin_mean, stddev_samp(davies_bouldin) AS davies_bouldin_sd FROM runs GROUP BY ALL)"""


def _over_seeds(spark, sf_dir):
    rows = A.read(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("geometry"), F.col("l_linenumber").cast("int").alias("k"), F.floor(F.col("l_discount") * 100).cast("int").alias("seed")]
    runs = rows.groupBy(*keys).agg(F.avg("l_quantity").cast("double").alias("silhouette"), F.max("l_tax").cast("double").alias("davies_bouldin"))
    return agreement.over_seeds(runs, ["geometry", "k"], ["silhouette", "davies_bouldin"])


@query(f"WITH {_RUNS_OF} SELECT geometry, k, n_seeds, round(silhouette_mean, 6) AS silhouette_mean, round(silhouette_sd, 6) + 0.0 AS silhouette_sd, round(davies_bouldin_mean, 6) AS davies_bouldin_mean, round(davies_bouldin_sd, 6) + 0.0 AS davies_bouldin_sd FROM su")
def A17_seed_aggregation(spark, sf_dir):
    return rounded(_over_seeds(spark, sf_dir))


@query(f"""WITH {_RUNS_OF}, x AS (SELECT geometry, k, 'silhouette_mean' AS criterion, 'max' AS direction, round(silhouette_mean, 9) AS value, -round(silhouette_mean, 9) AS s FROM su UNION ALL SELECT geometry, k, 'davies_bouldin_mean', 'min', round(davies_bouldin_mean, 9), round(davies_bouldin_mean, 9) FROM su)
    SELECT geometry, criterion, direction, k AS best_k, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY geometry, criterion ORDER BY s, k) AS r FROM x) WHERE r = 1""")
def A17_best_k(spark, sf_dir):
    rows = _over_seeds(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("silhouette_mean", "davies_bouldin_mean")})
    return rounded(agreement.best_k(rows, {"silhouette_mean": "max", "davies_bouldin_mean": "min"}))


@query("""WITH ct AS (SELECT l_returnflag AS x, CAST(l_linenumber AS INTEGER) % 3 AS y, count(*) AS n FROM lineitem GROUP BY ALL), best AS (SELECT a.y AS ya, n.y AS yn, r.y AS yr, a.n + n.n + r.n AS total FROM ct a, ct n, ct r
        WHERE a.x = 'A' AND n.x = 'N' AND r.x = 'R' AND a.y <> n.y AND n.y <> r.y AND a.y <> r.y ORDER BY total DESC LIMIT 1)
    SELECT unnest(['A', 'N', 'R']) AS x, unnest([ya, yn, yr]) AS y FROM best""")
def C8_optimal_mapping(spark, sf_dir):
    rows = A.read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber").cast("int") % 3).alias("part"))
    return agreement.optimal_mapping(agreement.contingency(rows, "l_returnflag", "part"))


def _sampled_sql(cosine: bool) -> str:
    d = "1 - list_dot_product(p.vec, q.vec) / (sqrt(list_dot_product(p.vec, p.vec)) * sqrt(list_dot_product(q.vec, q.vec)))" if cosine else "list_distance(p.vec, q.vec)"
    return f"""WITH {A.POINTS}, s AS (SELECT * FROM v ORDER BY md5(CAST(id AS VARCHAR) || '|0') LIMIT 300), pr AS (SELECT p.id, p.label, q.label AS other, avg({d}) AS d FROM s p, s q WHERE p.id <> q.id GROUP BY ALL),
        o AS (SELECT id, max(d) FILTER (WHERE label = other) AS own, min(d) FILTER (WHERE label <> other) AS rest FROM pr GROUP BY id) SELECT count(*) AS n, round(avg(coalesce((rest - own) / nullif(greatest(rest, own), 0), 0.0)), 6) + 0.0 AS silhouette FROM o"""


@query(_sampled_sql(False))
def M4_silhouette_sampled(spark, sf_dir):
    return rounded(agreement.silhouette_sampled(A.points(spark, sf_dir), 300))


@query(_sampled_sql(True))
def M4_cosine_silhouette_sampled(spark, sf_dir):
    return rounded(agreement.silhouette_sampled(A.points(spark, sf_dir), 300, cosine=True))


@query("""SELECT DISTINCT * FROM (VALUES (3, 250, 50, 8), (4, 250, 50, 8), (5, 250, 50, 8), (4, 200, 50, 8), (4, 300, 50, 8), (4, 250, 100, 8), (4, 250, 50, 6), (4, 250, 50, 7), (4, 250, 50, 9), (4, 250, 50, 10)) AS g(k, "window", step, clusters)""")
def G9_parameter_grid(spark, sf_dir):
    base = {"k": 4, "window": 250, "step": 50, "clusters": 8}
    return sensitivity.parameter_grid(spark, base, {"k": [3, 4, 5], "window": [200, 250, 300], "step": [50, 100], "clusters": [6, 7, 8, 9, 10]})


#: Tracks under settings: every window, every second one, and labels of few kinds.
_CONFIGS = f"""{A.TRACKS.replace("t AS (", "t0 AS (", 1)}, t AS (SELECT 'all/' || name AS name, label, start FROM t0 UNION ALL SELECT 'step20/' || name, label, start FROM t0 WHERE start % 20 = 0 UNION ALL SELECT 'few/' || name, left(label, 1), start FROM t0 UNION ALL SELECT 'step30/' || name, label, start FROM t0 WHERE start % 30 = 0), {SUMMARY},
    sc AS (SELECT split_part(name, '/', 1) AS config, split_part(name, '/', 2) AS name, round((1 - dominant_frac) + entropy_bits / log2(5) + switch_rate, 9) AS score FROM m),
    rk AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY score DESC, name) AS r FROM sc), tp AS (SELECT config, list(name) AS top FROM rk WHERE r <= 10 GROUP BY config)"""


def _config_scores(spark, sf_dir):
    rows = A.tracks(spark, sf_dir).select("name", "start", "label")
    ways = {"all": rows, "step20": rows.where("start % 20 = 0"), "few": rows.withColumn("label", F.left("label", F.lit(1))), "step30": rows.where("start % 30 = 0")}
    each = [df.withColumn("name", F.concat(F.lit(f"{c}/"), "name")) for c, df in ways.items()]
    every = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    scored = tracks.complexity(tracks.mosaic_summary(every), 5)
    part = lambda i: F.split_part("name", F.lit("/"), F.lit(i))
    return scored.select(part(1).alias("config"), part(2).alias("name"), F.round("score", 9).alias("score"))


@query(f"""WITH {_CONFIGS}, sh AS (SELECT s.config, s.score AS x, b.score AS y FROM sc s JOIN sc b ON b.name = s.name AND b.config = 'all'),
    ra AS (SELECT config, rank() OVER (PARTITION BY config ORDER BY x) + (count(*) OVER (PARTITION BY config, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY config ORDER BY y) + (count(*) OVER (PARTITION BY config, y) - 1) / 2.0 AS ry FROM sh),
    rho AS (SELECT config, corr(rx, ry) AS spearman FROM ra GROUP BY config), pl AS (SELECT config, min_by(score, r) AS score_rank1, max_by(score, r) AS score_rank_n FROM rk WHERE r <= 10 GROUP BY config)
    SELECT pl.config, round(score_rank1, 6) AS score_rank1, round(score_rank_n, 6) AS score_rank_n, CAST(len(list_intersect(tp.top, b.top)) AS INTEGER) AS overlap, round(len(list_intersect(tp.top, b.top)) / CAST(len(list_distinct(list_concat(tp.top, b.top))) AS DOUBLE), 6) AS jaccard, round(spearman, 6) + 0.0 AS spearman
    FROM pl JOIN tp ON tp.config = pl.config JOIN tp b ON b.config = 'all' JOIN rho ON rho.config = pl.config""")
def R7_parameter_sensitivity(spark, sf_dir):
    return rounded(sensitivity.against_baseline(_config_scores(spark, sf_dir), "all", 10))


@query(f"WITH {_CONFIGS} SELECT x.config AS a, y.config AS b, round(len(list_intersect(x.top, y.top)) / CAST(len(list_distinct(list_concat(x.top, y.top))) AS DOUBLE), 6) AS jaccard FROM tp x, tp y")
def U5_overlap_matrix(spark, sf_dir):
    return rounded(sensitivity.overlap_matrix(_config_scores(spark, sf_dir), 10))


@query(f"""WITH {A.TRACKS}, {SUMMARY}, s9 AS (SELECT name, round((1 - dominant_frac) + entropy_bits / log2(5) + switch_rate, 9) AS score FROM m)
    SELECT name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank FROM s9""")
def W7_T2_global_rank(spark, sf_dir):
    scored = tracks.complexity(tracks.mosaic_summary(A.tracks(spark, sf_dir).select("name", "start", "label")), 5).select("name", F.round("score", 9).alias("score"))
    return rounded(tracks.global_rank(scored, "score", "name"))


@query(f"""WITH {A.TRACKS}, {SUMMARY}, tp AS (SELECT name FROM m ORDER BY switches DESC, name LIMIT 10) SELECT m.name, switches, CASE WHEN m.name IN (SELECT name FROM tp) THEN 'top' ELSE 'other' END AS grp FROM m""")
def J11_T5_top_switches(spark, sf_dir):
    rows = tracks.mosaic_summary(A.tracks(spark, sf_dir).select("name", "start", "label")).select("name", "switches")
    return lookups.in_group(rows, rows.orderBy(F.desc("switches"), "name").limit(10), "name")


@query(f"""WITH {A.TRACKS}, {SUMMARY} SELECT m.name, switches, c_mktsegment AS cluster FROM m LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) c ON c.name = m.name""")
def J3_cluster_labels(spark, sf_dir):
    rows = tracks.mosaic_summary(A.tracks(spark, sf_dir).select("name", "start", "label")).select("name", "switches")
    clusters = A.read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("cluster"))
    return rows.join(clusters, "name", "left")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.n AS n_record, l.n AS n_orf, source, toxic FROM (SELECT doc_id, n_chars AS n, source FROM documents WHERE doc_id % 5 <> 1) d
    FULL OUTER JOIN (SELECT doc_id, quality AS n, toxic FROM labels) l ON l.doc_id = d.doc_id""")
def J6_outer_with_suffixes(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents").where("doc_id % 5 <> 1").select("doc_id", F.col("n_chars").alias("n"), "source")
    return lookups.suffixed(docs, A.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("n"), "toxic"), ["doc_id"], ("_record", "_orf"), "full_outer")


@query("""SELECT a.user_id, a.n AS n_euclidean, b.n AS n_spherical FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON b.user_id = a.user_id""")
def J7_inner_suffixed(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events")
    one = lambda kind: rows.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return lookups.suffixed(one("click"), one("purchase"), ["user_id"], ("_euclidean", "_spherical"))


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)}, f AS (SELECT name, strand, start0, end0, wrap, md5(name || strand || start0) AS seq FROM orf WHERE aa_len % 2 = 0) SELECT orf.strand, count(*) AS n_rows, count(f.seq) AS n_found, count(*) - count(f.seq) AS n_missed
    FROM orf LEFT JOIN f ON f.name = orf.name AND f.strand = orf.strand AND f.start0 = orf.start0 AND f.end0 = orf.end0 AND f.wrap = orf.wrap GROUP BY orf.strand""")
def J8_composite_lookup(spark, sf_dir):
    found = orfs.predict_orfs(A.genomes(spark, sf_dir), 10)
    keys = ["name", "strand", "start0", "end0", "wrap"]
    table = found.where("aa_len % 2 = 0").select(*keys, F.md5(F.concat("name", "strand", F.col("start0").cast("string")).cast("binary")).alias("seq"))
    return lookups.misses(lookups.by_keys(found.select(*keys), table, keys), ["strand"])


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '.' || (o_orderkey % 3) AS name FROM orders), r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) || '.1' ELSE CAST(doc_id AS VARCHAR) END AS id, n_chars FROM documents),
    al AS (SELECT id AS alias, n_chars FROM r UNION SELECT split_part(id, '.', 1), n_chars FROM r)
    SELECT o_orderkey, CASE WHEN f.alias IS NOT NULL THEN 'name' WHEN c.alias IS NOT NULL THEN 'without version' ELSE 'missing' END AS via, coalesce(f.n_chars, c.n_chars) AS n_chars FROM x LEFT JOIN al f ON f.alias = x.name LEFT JOIN al c ON c.alias = split_part(x.name, '.', 1)""")
def J9_alias_lookup(spark, sf_dir):
    rows = A.read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 3).cast("string")).alias("name"))
    docs = A.read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("d"))
    index = lookups.alias_index(docs, F.array(F.when(F.col("doc_id") % 2 == 0, F.concat("d", F.lit(".1"))).otherwise(F.col("d"))), ["doc_id"])
    return lookups.by_alias(rows, "name", index, ["n_chars"]).drop("name")


@query("""WITH x AS (SELECT page_id, 'gb|' || (page_id * 3) || '|' || page_id || ' of ' || url AS v FROM pages), p AS (SELECT page_id, string_split(v, '|') AS parts, v FROM x), c AS (SELECT page_id, list_concat([trim(v), string_split(trim(v), ' ')[1]], list_concat(parts, [parts[len(parts)], parts[1]])) AS c FROM p),
    e AS (SELECT page_id, trim(unnest(c)) AS cand, generate_subscripts(c, 1) AS i FROM c), h AS (SELECT page_id, min_by(cand, i) AS match FROM e JOIN (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d ON d.id = e.cand GROUP BY page_id)
    SELECT x.page_id, h.match, doc.source FROM x LEFT JOIN h ON h.page_id = x.page_id LEFT JOIN documents doc ON CAST(doc.doc_id AS VARCHAR) = h.match""")
def J10_first_candidate(spark, sf_dir):
    page = F.col("page_id").cast("string")
    value = F.concat(F.lit("gb|"), (F.col("page_id") * 3).cast("string"), F.lit("|"), page, F.lit(" of "), "url")
    docs = A.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    rows = A.read(spark, sf_dir, "pages").select("page_id", value.alias("value"))
    return lookups.first_candidate(rows, H.id_candidates(F.col("value")), docs, "id").drop("value")


@query("""WITH nn AS (SELECT page_id, CAST(page_id * 2 AS VARCHAR) AS nearest FROM pages), h AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents)
    SELECT page_id, nearest, coalesce(lang, '') AS lang, coalesce(n_chars, '') AS n_chars FROM nn LEFT JOIN h ON h.id = nn.nearest""")
def J15_header_join(spark, sf_dir):
    rows = A.read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") * 2).cast("string").alias("nearest"))
    return lookups.with_blanks(rows, A.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "n_chars"), "nearest", "id")


@query("""SELECT user_id, 'left' AS only_in FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12) UNION ALL
    SELECT user_id, 'right' FROM (SELECT c_custkey AS user_id FROM customer WHERE c_nationkey < 12 EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')""")
def U3_one_sided(spark, sf_dir):
    bought = A.read(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id")
    return lookups.one_sided(bought, A.read(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("""WITH x AS (SELECT page_id, [trim(split_part(url, '/', 3)), CAST(page_id AS VARCHAR) || '.' || (page_id % 4), ' '] AS ids FROM pages), y AS (SELECT page_id, list_filter(ids, lambda p: trim(p) <> '') AS ids FROM x)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(ids, list_transform(ids, lambda p: split_part(p, '.', 1))))), ' ') AS keys FROM y""")
def P21_accession_keys(spark, sf_dir):
    named = F.concat_ws(".", F.col("page_id").cast("string"), (F.col("page_id") % 4).cast("string"))
    keys = lookups.accession_keys(F.array(F.split_part("url", F.lit("/"), F.lit(3)), named, F.lit(" ")))
    return A.read(spark, sf_dir, "pages").select("page_id", F.array_join(keys, " ").alias("keys"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(nullif(lang, 'en'), '')) <> '' THEN lang ELSE trim(source) END AS organism, 'note=' || lang || ';' || n_chars || ' | organism=' || source AS qualifiers FROM documents""")
def P23_organism_text(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents")
    held = F.map_from_arrays(F.array(F.lit("organism"), F.lit("note")), F.array(F.array("source"), F.array(F.col("lang"), F.col("n_chars").cast("string"))))
    return docs.select("doc_id", audit.organism(F.nullif("lang", F.lit("en")), held).alias("organism"), audit.qualifier_text(held).alias("qualifiers"))


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)} SELECT name, 'orf' || row_number() OVER (PARTITION BY name ORDER BY start0, end0, CASE WHEN strand = '+' THEN 1 ELSE -1 END, nt_len) AS orf_id, CASE WHEN strand = '+' THEN 1 ELSE -1 END AS strand,
    CAST(start0 AS INTEGER) AS start0, CAST(end0 AS INTEGER) AS end0, CAST(nt_len AS INTEGER) AS nt_len, CAST(aa_len AS INTEGER) AS aa_len, wrap FROM orf""")
def P12_W9_orf_table(spark, sf_dir):
    found = orfs.predict_orfs(A.genomes(spark, sf_dir), 10).select("name", "strand", "start0", "end0", "nt_len", "aa_len", F.initcap(F.col("wrap").cast("string")).alias("wrapped"))
    return orfs.orf_table(found).select("name", "orf_id", "strand", "start0", "end0", "nt_len", "aa_len", "wrap")


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)} SELECT name, strand, CAST(start0 AS INTEGER) AS start0, CAST(end0 AS INTEGER) AS end0, CAST(aa_len AS INTEGER) AS aa_len FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY aa_len DESC, start0, strand, end0) AS r FROM orf) WHERE r = 1""")
def W6_longest_protein(spark, sf_dir):
    return orfs.longest_by_protein(orfs.predict_orfs(A.genomes(spark, sf_dir), 10)).select("name", "strand", "start0", "end0", "aa_len")


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)} SELECT name, strand, CAST(start0 AS INTEGER) AS start0, CAST(end0 AS INTEGER) AS end0, CAST(row_number() OVER (PARTITION BY name ORDER BY aa_len DESC, strand, start0, end0) AS INTEGER) AS nth FROM orf""")
def T3_orf_order(spark, sf_dir):
    return orfs.ordered(orfs.predict_orfs(A.genomes(spark, sf_dir), 10)).select("name", "strand", "start0", "end0", "nth")


@query(f"WITH {_NEAR} SELECT name, median(dist) AS median FROM nd WHERE dist IS NOT NULL GROUP BY name ORDER BY median, name LIMIT 20")
def A19_T4_median_distance(spark, sf_dir):
    return orfs.median_distances(_near(spark, sf_dir), 20)


_FEATURES = """ft AS (SELECT conv_id AS name, CASE role WHEN 'system' THEN 'source' ELSE 'cds' END AS type, length(text) AS length,
    text || CASE turn % 4 WHEN 0 THEN ' ORF 3' WHEN 1 THEN ' putative Polyprotein' WHEN 2 THEN ' coat protein and capsid' ELSE '' END AS text FROM conversations)"""


@query(f"""WITH {_FEATURES}, sc AS (SELECT *, length / 10000.0 + CASE WHEN regexp_matches(lower(text), '\\borf\\s*3\\b|\\borf3\\b') THEN 100 ELSE 0 END + CASE WHEN contains(lower(text), 'polyprotein') THEN 50 ELSE 0 END
        + 5 * list_sum([CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END FOR w IN ['reverse transcriptase', 'rnase h', 'movement protein', 'capsid', 'coat protein', 'aspartic protease']]) AS score FROM ft WHERE upper(type) = 'CDS')
    SELECT name, length, md5(text) AS text_md5, round(score, 6) AS score, CASE WHEN score >= 50 THEN 'annotation' ELSE 'longest' END AS basis FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, length DESC, text) AS r FROM sc) WHERE r = 1""")
def O4_annotated_orf(spark, sf_dir):
    rows = A.read(spark, sf_dir, "conversations")
    marks = F.get(F.array(*map(F.lit, (" ORF 3", " putative Polyprotein", " coat protein and capsid", ""))), (F.col("turn") % 4).cast("int"))
    kind = F.when(F.col("role") == "system", "source").otherwise("cds")
    features = rows.select(F.col("conv_id").alias("name"), kind.alias("type"), F.length("text").cast("long").alias("length"), F.concat("text", marks).alias("text"))
    return rounded(audit.annotated_orf(features).select("name", "length", F.md5(F.col("text").cast("binary")).alias("text_md5"), "score", "basis"))


_ARCS = f"""{A.GENOMES}, {_orf_sql(False)}, rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY aa_len DESC, nt_len DESC, start0, strand, end0) AS r FROM orf),
    ar AS (SELECT p.name, p.n, p.start0 AS sp, p.nt_len AS lp, q.start0 AS sq, CASE WHEN q.start0 < CASE WHEN q.end0 = 0 THEN q.n ELSE q.end0 END THEN CASE WHEN q.end0 = 0 THEN q.n ELSE q.end0 END - q.start0 ELSE q.n - q.start0 + q.end0 END AS lq, p.strand = q.strand AS same FROM rk p JOIN rk q ON q.name = p.name AND p.r = 1 AND q.r = 2)"""


def _arcs(spark, sf_dir):
    """Each name's two longest frames, as if one were predicted and the other annotated."""
    seqs = A.genomes(spark, sf_dir)
    best = orfs.longest_orfs(orfs.predict_orfs(seqs, 10), 2).join(seqs.select("name", F.length("seq").alias("n")), "name")
    one = lambda k: best.where(F.col("rank") == k)
    end = F.when(F.col("end0") == 0, F.col("n")).otherwise(F.col("end0"))
    p = one(1).select("name", F.col("n").alias("genome_len"), F.col("start0").alias("start_predicted"), F.least("nt_len", "n").alias("size_predicted"), F.col("strand").alias("sp"))
    q = one(2).select("name", F.col("start0").alias("start_annotated"), audit.arc_size(F.col("start0"), end, F.col("n")).alias("size_annotated"), F.col("strand").alias("sq"))
    return p.join(q, "name").withColumn("same_strand", F.col("sp") == F.col("sq"))


@query(f"""WITH {_ARCS}, pp AS (SELECT name, (sp + i) % n AS x FROM (SELECT *, unnest(range(0, least(lp, n))) AS i FROM ar)), qq AS (SELECT name, (sq + i) % n AS x FROM (SELECT *, unnest(range(0, least(lq, n))) AS i FROM ar)),
    ov AS (SELECT pp.name, count(*) AS o FROM pp JOIN qq ON qq.name = pp.name AND qq.x = pp.x GROUP BY pp.name), r AS (SELECT ar.name, CAST(coalesce(o, 0) AS INTEGER) AS overlap, coalesce(o, 0) / CAST(least(lp, n) AS DOUBLE) AS of_predicted, coalesce(o, 0) / CAST(least(lq, n) AS DOUBLE) AS of_annotated,
        coalesce(o, 0) / CAST(least(lp, n) + least(lq, n) - coalesce(o, 0) AS DOUBLE) AS jaccard, same FROM ar LEFT JOIN ov ON ov.name = ar.name)
    SELECT name, overlap, round(of_predicted, 6) AS of_predicted, round(of_annotated, 6) AS of_annotated, round(jaccard, 6) AS jaccard, same AND of_predicted >= 0.8 AND of_annotated >= 0.8 AS consistent FROM r""")
def L12_interval_jaccard(spark, sf_dir):
    return rounded(audit.interval_agreement(_arcs(spark, sf_dir)).select("name", "overlap", "of_predicted", "of_annotated", "jaccard", "consistent"))


@query("""WITH p AS (SELECT page_id % 4 <> 0 AS available, CASE WHEN length(html) > 2000 THEN 'manual review required' ELSE 'included' END AS status, CASE WHEN page_id % 3 = 0 THEN NULL ELSE contains(url, 'com') END AS consistent FROM pages)
    SELECT count(*) AS n_expected, count(*) FILTER (WHERE available) AS n_available, count(*) FILTER (WHERE status = 'manual review required') AS n_review, count(*) FILTER (WHERE consistent) AS n_consistent, count(*) FILTER (WHERE NOT consistent) AS n_exceptions FROM p""")
def A20_audit_summary(spark, sf_dir):
    ok = F.when(F.col("page_id") % 3 != 0, F.contains("url", F.lit("com")))
    rows = A.read(spark, sf_dir, "pages").select(
        (F.col("page_id") % 4 != 0).alias("record_available"), F.when(F.length("html") > 2000, "manual review required").otherwise("included").alias("inclusion_status"),
        ok.alias("consistent"), F.when(ok, "consistent").when(~ok, "exception").alias("orf_status"),
    )
    return audit.audit_summary(rows)


@query("""WITH h AS (SELECT split_part(text, chr(10), 1) AS h FROM documents), f AS (SELECT list_filter(regexp_split_to_array(h, '\\s+'), lambda p: p <> '') AS toks, h FROM h),
    s AS (SELECT coalesce(toks[1], '') AS id, greatest(len(toks) - 1, 0) + 2 * CAST(regexp_matches(h, '[|;/\\[\\](){}]') AS INTEGER) + 2 * CAST(regexp_matches(lower(h), 'country|strain|isolate|host|location|collected|isolation|geo|region') AS INTEGER)
        + 2 * CAST(regexp_matches(h, '(^|[^\\p{L}\\p{N}_])[A-Z][a-z]{2,}\\s+[a-z]{2,}([^\\p{L}\\p{N}_]|$)') AS INTEGER) + CAST(regexp_matches(coalesce(toks[1], ''), '^[A-Z]{1,4}[0-9]{5,10}(\\.[0-9]+)?$') AS INTEGER) AS score FROM f),
    l AS (SELECT id, CASE WHEN score >= 6 THEN 'strong' WHEN score >= 2 THEN 'some' ELSE 'id_only' END AS level FROM s), t AS (SELECT count(*) AS total, count(DISTINCT id) AS n_ids FROM l)
    SELECT v.level, count(l.level) AS n, round(count(l.level) / CAST(max(total) AS DOUBLE), 6) AS frac, max(n_ids) AS n_ids, max(total - n_ids) AS n_repeated FROM (VALUES ('strong'), ('some'), ('id_only')) v(level) LEFT JOIN l ON l.level = v.level, t GROUP BY v.level""")
def A13_header_levels(spark, sf_dir):
    header = F.split_part("text", F.lit("\n"), F.lit(1))
    scored = A.read(spark, sf_dir, "documents").select(H.header_score(header).alias("h"))
    return rounded(audit.level_counts(scored.select(F.col("h.id").alias("id"), F.col("h.level").alias("level"))))


@query(f"WITH {_DIST} SELECT split_part(a || '|x', '|', 1) AS a, split_part(b || '|y', '|', 1) AS b, round(dist, 6) + 0.0 AS dist FROM m")
def P14_label_split(spark, sf_dir):
    m = matrix.mirrored(_panel_distances(spark, sf_dir)).where("a <> b")
    tipped = m.select(F.concat("a", F.lit("|x")).alias("a"), F.concat("b", F.lit("|y")).alias("b"), "dist")
    return rounded(lookups.before_separator(tipped, "|"))


@query("""SELECT CAST(row_number() OVER (ORDER BY n DESC, source) AS INTEGER) AS rank, source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def P25_report_columns(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return lookups.report(rows, ["source", "purity", "n"], [F.desc("n"), F.asc_nulls_last("source")])
