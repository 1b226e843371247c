"""Registered queries on headers, matrices, alignments, trees and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.functions import headers as H
from loopweave.functions import sequences as S
from loopweave.operators import agreement, alignment, kmers, mantel, matrix, orfs, randomised, stats, tracks, trees
from loopweave.plans import adapters as A
from loopweave.plans.queries import SUMMARY, _count, _kmer_sql, _orf_sql, query, rounded
from loopweave.sources.places import written


@query(f"""WITH {A.GENOMES}, x AS (SELECT name, seq, CAST(length(seq) AS INTEGER) AS n FROM g) SELECT name,
    md5(CASE WHEN n > 0 THEN substr(repeat(seq, CAST(25 // n + 2 AS INTEGER)), 7 % n + 1, 25) ELSE '' END) AS cyclic, md5(substr(seq || substr(seq, 1, 25), 8, 25)) AS extended FROM x""")
def P7_P8_fragments(spark, sf_dir):
    seq, start = F.col("seq"), F.lit(7)
    parts = {"cyclic": S.circular_fragment(seq, start, 25), "extended": S.circular_extension(seq, start, 25)}
    return A.genomes(spark, sf_dir).select("name", *(F.md5(v.cast("binary")).alias(k) for k, v in parts.items()))


@query("""WITH x AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z*]', '*', 'g')) AS s FROM documents), y AS (SELECT doc_id, nullif(regexp_replace(regexp_replace(s, '\\*$', ''), '[^ACDEFGHIKLMNPQRSTVWYBXZJUO-]', 'X', 'g'), '') AS protein FROM x)
    SELECT doc_id, CAST(length(protein) AS INTEGER) AS n, md5(protein) AS protein_md5 FROM y""")
def P9_sanitize_protein(spark, sf_dir):
    protein = S.sanitize_protein(F.regexp_replace("text", "[^A-Za-z*]", "*"))
    return A.read(spark, sf_dir, "documents").select("doc_id", F.length(protein).alias("n"), F.md5(protein.cast("binary")).alias("protein_md5"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS k, 'a=' || event_type || '=' AS v FROM events")
def P10_parse_orf_header(spark, sf_dir):
    text = F.concat(F.col("event_id").cast("string"), F.lit("|k=label| k = "), F.col("user_id").cast("string"), F.lit("|v=a="), "event_type", F.lit("=|no value"))
    rows = A.read(spark, sf_dir, "events").select("event_id", H.parse_header_fields(text).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("v")).alias("v"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '+' WHEN 1 THEN '-1' WHEN 2 THEN '+1' WHEN 3 THEN '2.5' WHEN 4 THEN 'none' ELSE '-' END AS s, CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE ' t ' END AS b FROM events)
    SELECT event_id, CAST(CASE WHEN s IN ('+', '+1', '2.5') THEN 1 WHEN s IN ('-', '-1') THEN -1 END AS INTEGER) AS strand, trim(lower(b)) IN ('true', '1', 'yes', 'y', 't') AS flag FROM x""")
def P11_normalize_strand(spark, sf_dir):
    k = F.col("event_id")
    s = F.get(F.array(*map(F.lit, ("+", "-1", "+1", "2.5", "none", "-"))), (k % 6).cast("int"))
    b = F.get(F.array(*map(F.lit, ("Yes", "no", " t "))), (k % 3).cast("int"))
    return A.read(spark, sf_dir, "events").select("event_id", H.strand_sign(s).alias("strand"), H.truthy(b).alias("flag"))


@query("SELECT page_id, split_part(split_part(page_id || '__dup1|' || url, '|', 1), '__dup', 1) AS accession FROM pages")
def P13_tip_to_accession(spark, sf_dir):
    tip = F.concat(F.col("page_id").cast("string"), F.lit("__dup1|"), "url")
    return A.read(spark, sf_dir, "pages").select("page_id", H.tip_to_accession(tip).alias("accession"))


@query("""WITH x AS (SELECT doc_id, split_part(text, chr(10), 1) AS h FROM documents), y AS (SELECT doc_id, trim(h) AS w, list_filter(string_split(trim(h), '|'), lambda p: p <> '') AS parts, list_filter(regexp_split_to_array(trim(h), '\\s+'), lambda p: p <> '') AS toks FROM x),
    z AS (SELECT doc_id, w, list_concat([w], list_concat(toks[1:1], CASE WHEN contains(w, '|') AND len(parts) > 0 THEN list_concat(parts, [parts[len(parts)], parts[1]]) ELSE [] END)) AS c FROM y),
    q AS (SELECT doc_id, p, min(i) AS i FROM (SELECT doc_id, trim(unnest(c)) AS p, generate_subscripts(c, 1) AS i FROM z WHERE w <> '') WHERE p <> '' GROUP BY doc_id, p)
    SELECT doc_id, count(*) AS n, md5(string_agg(p, '~' ORDER BY i)) AS candidates FROM q GROUP BY doc_id""")
def P16_normalize_candidates(spark, sf_dir):
    header = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rows = A.read(spark, sf_dir, "documents").select("doc_id", H.id_candidates(header).alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "~").cast("binary")).alias("candidates"))


_PLACES = "CASE conv_id % 5 WHEN 0 THEN ' isolate GH67 Ghana' WHEN 1 THEN ' Sri  Lanka strain' WHEN 2 THEN ' from Ivory Coast and TOGO' WHEN 3 THEN ' NIG5 Nigeria, CI152-09' ELSE '' END"


def _places(spark, sf_dir, before="text"):
    said = F.get(F.array(*map(F.lit, (" isolate GH67 Ghana", " Sri  Lanka strain", " from Ivory Coast and TOGO", " NIG5 Nigeria, CI152-09", ""))), (F.col("conv_id") % 5).cast("int"))
    return A.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.regexp_replace(before, r"[^\x00-\x7F]", "-"), said).alias("t"))


_COUNTRY_SQL = ["ghana", "togo", "nigeria", "sri\\s*lanka", "c[ôo]te\\s*d[''’]ivoire", "ivory\\s*coast", "ivoire"]
_COUNTRY_NAMES = ["Ghana", "Togo", "Nigeria", "Sri Lanka", "Cote d''Ivoire", "Cote d''Ivoire", "Cote d''Ivoire"]


@query(f"""WITH x AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '-', 'g') || {_PLACES} AS t FROM conversations), h AS (SELECT conv_id, turn, list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '(?i)(^|[^[:alnum:]_]){p}($|[^[:alnum:]_])') THEN '{n}' END" for p, n in zip(_COUNTRY_SQL, _COUNTRY_NAMES, strict=True))}], lambda c: c IS NOT NULL) AS c FROM x),
    e AS (SELECT conv_id, turn, unnest(c) AS p, generate_subscripts(c, 1) AS i FROM h), q AS (SELECT conv_id, turn, p, min(i) AS i FROM e GROUP BY ALL), s AS (SELECT conv_id, turn, string_agg(p, ';' ORDER BY i) AS country FROM q GROUP BY conv_id, turn)
    SELECT h.conv_id, h.turn, coalesce(country, '') AS country FROM h LEFT JOIN s ON s.conv_id = h.conv_id AND s.turn = h.turn""")
def P17_extract_country(spark, sf_dir):
    return _places(spark, sf_dir, "text").select("conv_id", "turn", H.country(F.col("t")).alias("country"))


@query(f"""WITH x AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '-', 'g') || {_PLACES} AS t FROM conversations),
    h AS (SELECT conv_id, turn, list_concat(regexp_extract_all(t, '(?i)\\bisolate\\s+([A-Za-z0-9_-]+)\\b', 1), list_concat(regexp_extract_all(t, '(?i)\\b(GH[A-Za-z0-9-]+)\\b', 1), list_concat(regexp_extract_all(t, '(?i)\\b(Gha[A-Za-z0-9-]+)\\b', 1),
          list_concat(regexp_extract_all(t, '(?i)\\b(CI[A-Za-z0-9-]+)\\b', 1), regexp_extract_all(t, '(?i)\\b(NIG[A-Za-z0-9-]+)\\b', 1))))) AS c FROM x),
    q AS (SELECT conv_id, turn, p, min(i) AS i FROM (SELECT conv_id, turn, unnest(c) AS p, generate_subscripts(c, 1) AS i FROM h) GROUP BY conv_id, turn, p), s AS (SELECT conv_id, turn, string_agg(p, ';' ORDER BY i) AS tags FROM q GROUP BY conv_id, turn)
    SELECT x.conv_id, x.turn, coalesce(tags, '') AS tags FROM x LEFT JOIN s ON s.conv_id = x.conv_id AND s.turn = x.turn""")
def P18_extract_isolate_tags(spark, sf_dir):
    return _places(spark, sf_dir).select("conv_id", "turn", H.isolate_tags(F.col("t")).alias("tags"))


@query("""WITH x AS (SELECT page_id, lower(url) AS u, lower(html) AS h, length(html) AS n FROM pages), f AS (SELECT page_id, contains(u, 'complete genome') OR contains(u, 'example.com') AS complete_genome, n BETWEEN 1000 AND 8000 AS expected_length, contains(u, '/en/') AS viral_organism,
        regexp_matches(h, '\\bendogenous\\b|\\bintegrated\\b|integration|endogenous viral element|\\beve\\b') AS eve_flag, regexp_matches(h, 'host[- ]flank|flanking host|theobroma cacao chromosome|host genomic|genomic scaffold') AS flank_flag,
        regexp_matches(h, 'chromosome|scaffold|whole genome shotgun|genomic contig|<table') AND NOT contains(u, '/en/') AS assembly_flag FROM x)
    SELECT *, CASE WHEN eve_flag OR flank_flag OR assembly_flag OR NOT expected_length OR NOT complete_genome OR NOT viral_organism THEN 'manual review required' ELSE 'included complete viral record' END AS inclusion_status FROM f""")
def P22_record_screen(spark, sf_dir):
    # Pages of one site stand for complete genomes, those in English for viruses, tables for scaffolds.
    url = F.lower("url")
    described = F.when(F.contains(url, F.lit("example.com")), F.lit("complete genome")).otherwise(url)
    named = F.when(F.contains(url, F.lit("/en/")), F.lit("a virus")).otherwise(F.lit(""))
    text = F.replace(F.lower("html"), F.lit("<table"), F.lit("scaffold"))
    flags = H.screen_flags(described, named, text, F.length("html"), 1000, 8000)
    return A.read(spark, sf_dir, "pages").select("page_id", flags.alias("f")).select("page_id", "f.*")


@query(f"""WITH {A.GENOMES}, b AS (SELECT name, '+' AS strand, seq || seq AS s FROM g UNION ALL SELECT name, '-', reverse(translate(seq || seq, 'ACGT', 'TGCA')) FROM g), c AS (SELECT strand, CAST(i % 3 AS INTEGER) AS frame, substr(s, CAST(i + 1 AS INTEGER), 3) AS codon FROM (SELECT strand, s, unnest(range(0, length(s) - 2)) AS i FROM b WHERE length(s) >= 3))
    SELECT strand, frame, codon, count(*) AS n FROM c GROUP BY ALL""")
def G5_codons(spark, sf_dir):
    seqs = A.genomes(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.concat("seq", "seq").alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.concat("seq", "seq")).alias("s"))))
    rows = seqs.select(both.alias("x")).select("x.strand", F.col("x.s").cast("binary").alias("s")).where(F.length("s") >= 3)
    each = rows.select("strand", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 3)).alias("i"))
    return each.groupBy("strand", (F.col("i") % 3).alias("frame"), F.substring("s", F.col("i") + 1, F.lit(3)).cast("string").alias("codon")).agg(F.count("*").alias("n"))


@query(f"WITH {A.PROTEINS} SELECT name, CAST(i AS INTEGER) AS col, substr(seq, CAST(i + 1 AS INTEGER), 1) AS res FROM (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM a)")
def G7_alignment_columns(spark, sf_dir):
    return alignment.columns_of(A.proteins(spark, sf_dir))


@query(f"""WITH {A.PROTEINS}, c AS (SELECT name, i, substr(seq, CAST(i + 1 AS INTEGER), 1) AS r FROM (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM a)),
    m AS (SELECT x.name AS a, y.name AS b, count(*) AS compared, sum(CASE WHEN x.r = y.r THEN 1 ELSE 0 END) AS same FROM c x JOIN c y ON x.i = y.i AND x.name < y.name WHERE x.r NOT IN ('-', '.', 'X', '?') AND y.r NOT IN ('-', '.', 'X', '?') GROUP BY 1, 2)
    SELECT x.name AS a, y.name AS b, CAST(coalesce(compared, 0) AS INTEGER) AS compared, round(1 - same / CAST(compared AS DOUBLE), 6) + 0.0 AS dist FROM a x JOIN a y ON x.name < y.name LEFT JOIN m ON m.a = x.name AND m.b = y.name""")
def A15_identity_distance(spark, sf_dir):
    return rounded(alignment.identity_distance(A.proteins(spark, sf_dir)))


@query(f"""WITH {A.PROTEINS}, c AS (SELECT name, i, substr(seq, CAST(i + 1 AS INTEGER), 1) AS r FROM (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM a)), k AS (SELECT i FROM c GROUP BY i HAVING avg(CASE WHEN r = '-' THEN 1.0 ELSE 0.0 END) <= 0.2),
    t AS (SELECT name, string_agg(r, '' ORDER BY c.i) AS seq FROM c JOIN k ON k.i = c.i GROUP BY name) SELECT a.name, coalesce(t.seq, '') AS seq FROM a LEFT JOIN t ON t.name = a.name""")
def A16_gap_trim(spark, sf_dir):
    return alignment.trim_gaps(A.proteins(spark, sf_dir), 0.2)


_DIST = f"""{A.PANEL}, {_kmer_sql('p', 4)}, n AS (SELECT name, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS norm FROM k GROUP BY name), d AS (SELECT x.name AS a, y.name AS b, sum(x.cnt * y.cnt) AS dot FROM k x JOIN k y ON x.kmer = y.kmer AND x.name < y.name GROUP BY 1, 2),
    u AS (SELECT x.name AS a, y.name AS b, round(1 - coalesce(CAST(dot AS DOUBLE), 0.0) / (x.norm * y.norm), 9) AS dist FROM n x JOIN n y ON x.name < y.name LEFT JOIN d ON d.a = x.name AND d.b = y.name),
    m AS (SELECT a, b, dist FROM u UNION ALL SELECT b, a, dist FROM u)"""


def _panel_distances(spark, sf_dir):
    counts = kmers.kmer_counts(A.panel(spark, sf_dir), 4)
    return kmers.cosine_distances(counts.select("name").distinct(), counts).withColumn("dist", F.round("dist", 9))


@query(f"WITH {_DIST} SELECT a, b, round(dist, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM m) WHERE r = 1")
def J13_nearest_neighbour(spark, sf_dir):
    return rounded(matrix.nearest_neighbour(matrix.mirrored(_panel_distances(spark, sf_dir))))


@query(f"""WITH {_DIST}, skew AS (SELECT a, b, CASE WHEN a < b THEN dist ELSE dist + 0.125 END AS dist FROM m) SELECT a, b, round(avg(dist) OVER (PARTITION BY least(a, b), greatest(a, b)), 6) + 0.0 AS dist FROM skew""")
def L6_symmetrize(spark, sf_dir):
    m = matrix.mirrored(_panel_distances(spark, sf_dir)).where("a <> b")
    return rounded(matrix.symmetrize(m.withColumn("dist", F.when(F.col("a") < F.col("b"), F.col("dist")).otherwise(F.col("dist") + 0.125))))


@query(f"""WITH {_DIST}, h AS (SELECT a, b, CASE WHEN a LIKE '%7' OR b LIKE '%7' THEN NULL ELSE dist END AS dist FROM m), e AS (SELECT a FROM h GROUP BY a HAVING count(dist) = 0),
    kk AS (SELECT * FROM h WHERE a NOT IN (SELECT a FROM e) AND b NOT IN (SELECT a FROM e)), ss AS (SELECT a FROM kk GROUP BY a HAVING count(dist) < count(*)) SELECT a, b, round(dist, 6) + 0.0 AS dist FROM kk WHERE a NOT IN (SELECT a FROM ss) AND b NOT IN (SELECT a FROM ss)""")
def L7_drop_incomplete(spark, sf_dir):
    m = matrix.mirrored(_panel_distances(spark, sf_dir)).where("a <> b")
    holes = F.col("a").endswith("7") | F.col("b").endswith("7")
    return rounded(matrix.drop_incomplete(m.withColumn("dist", F.when(~holes, F.col("dist")))))


_COMPOSITION = f"""cp AS (SELECT name, [{", ".join(f"{_count(b)} / CAST(length(seq) AS DOUBLE)" for b in "ACGT")}] AS vec FROM p WHERE length(seq) > 0)"""


def _composition(spark, sf_dir):
    rows = A.panel(spark, sf_dir).where(F.length("seq") > 0)
    return rows.select("name", F.array(*(S.base_count(F.col("seq"), b) / F.length("seq") for b in "ACGT")).alias("vec"))


@query(f"""WITH {_DIST}, {_COMPOSITION}, f AS (SELECT u.dist, list_distance(x.vec, y.vec) AS fit FROM u JOIN cp x ON x.name = u.a JOIN cp y ON y.name = u.b)
    SELECT round(sum((dist - fit) * (dist - fit)), 6) AS raw_stress, round(sqrt(sum((dist - fit) * (dist - fit)) / sum(dist * dist)), 6) AS stress1, round(corr(dist, fit), 6) AS pearson FROM f""")
def L11_stress(spark, sf_dir):
    return rounded(matrix.stress(_panel_distances(spark, sf_dir), _composition(spark, sf_dir)))


@query(f"""WITH {_DIST}, {_COMPOSITION}, f AS (SELECT u.dist AS x, round(list_distance(x.vec, y.vec), 9) AS y FROM u JOIN cp x ON x.name = u.a JOIN cp y ON y.name = u.b),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM f) SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM r""")
def J1_matrix_correlation(spark, sf_dir):
    return rounded(matrix.matrix_correlation(_panel_distances(spark, sf_dir), _composition_distances(spark, sf_dir)))


def _composition_distances(spark, sf_dir):
    cp = _composition(spark, sf_dir)
    pairs = cp.select(F.col("name").alias("a"), F.col("vec").alias("va")).join(cp.select(F.col("name").alias("b"), F.col("vec").alias("vb")), F.col("a") < F.col("b"))
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return pairs.select("a", "b", F.round(d, 9).alias("dist"))


@query(f"""WITH {_DIST}, l AS (SELECT DISTINCT a AS name, right(a, 1) IN ('0', '1', '2', '3', '4') AS label FROM m), x AS (SELECT m.a, la.label, lb.label AS other, avg(dist) AS d FROM m JOIN l la ON la.name = m.a JOIN l lb ON lb.name = m.b GROUP BY 1, 2, 3),
    y AS (SELECT a, label, max(d) FILTER (WHERE label = other) AS o, min(d) FILTER (WHERE label <> other) AS r FROM x GROUP BY a, label) SELECT a, label, round(coalesce((r - o) / nullif(greatest(r, o), 0), 0.0), 6) + 0.0 AS s FROM y""")
def M3_silhouette(spark, sf_dir):
    m = matrix.mirrored(_panel_distances(spark, sf_dir))
    labels = m.select("a").distinct().withColumn("label", F.substring("a", -1, 1).isin(*"01234"))
    return rounded(matrix.silhouette(m, labels))


#: The reference's weights of low purity, entropy and switches.
_SCHEMES = [
    ("equal", 1.0, 1.0, 1.0), ("no_switch", 1.0, 1.0, 0.0), ("no_entropy", 1.0, 0.0, 1.0), ("double_low_purity", 2.0, 1.0, 1.0), ("double_entropy", 1.0, 2.0, 1.0),
    ("double_switch", 1.0, 1.0, 2.0), ("half_low_purity", 0.5, 1.0, 1.0), ("half_entropy", 1.0, 0.5, 1.0), ("half_switch", 1.0, 1.0, 0.5),
]


@query(f"""WITH {A.TRACKS}, {SUMMARY}, c(config, wp, we, ws) AS (VALUES {", ".join(f"('{n}', {p}, {e}, {w})" for n, p, e, w in _SCHEMES)}), sc AS (SELECT config, m.name, round((1 - dominant_frac) * CAST(wp AS DOUBLE) + CAST(we AS DOUBLE) * (entropy_bits / log2(5)) + CAST(ws AS DOUBLE) * switch_rate, 9) AS score FROM m, c),
    t10 AS (SELECT config, list_sort(list(name)) AS top FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY score DESC, name) AS r FROM sc) WHERE r <= 10 GROUP BY config),
    sh AS (SELECT s.config, s.score AS x, b.score AS y FROM sc s JOIN sc b ON b.name = s.name AND b.config = 'equal'),
    ra AS (SELECT config, rank() OVER (PARTITION BY config ORDER BY x) + (count(*) OVER (PARTITION BY config, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY config ORDER BY y) + (count(*) OVER (PARTITION BY config, y) - 1) / 2.0 AS ry FROM sh),
    rho AS (SELECT config, corr(rx, ry) AS spearman FROM ra GROUP BY config)
    SELECT a.config AS scheme, CAST(len(list_intersect(a.top, b.top)) AS INTEGER) AS overlap, round(len(list_intersect(a.top, b.top)) / CAST(len(list_distinct(list_concat(a.top, b.top))) AS DOUBLE), 6) AS jaccard, round(spearman, 6) + 0.0 AS spearman
    FROM t10 a JOIN rho ON rho.config = a.config, t10 b WHERE b.config = 'equal'""")
def R6_weight_sensitivity(spark, sf_dir):
    parts = tracks.complexity(tracks.mosaic_summary(A.tracks(spark, sf_dir).select("name", "start", "label")), 5)
    return rounded(randomised.weight_sensitivity(parts, _SCHEMES, 10))


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)}, th AS (SELECT unnest([10, 20, 40]) AS least_aa) SELECT least_aa, count(aa_len) AS n_orfs, count(DISTINCT name) AS n_names, max(aa_len) AS max_aa FROM th LEFT JOIN orf ON aa_len >= least_aa GROUP BY least_aa""")
def R8_orf_length_sensitivity(spark, sf_dir):
    found = orfs.predict_orfs(A.genomes(spark, sf_dir), 10).select("name", F.col("aa_len").cast("long").alias("aa_len"))
    limits = spark.createDataFrame([(10,), (20,), (40,)], "least_aa int")
    rows = limits.join(found, F.col("aa_len") >= F.col("least_aa"), "left")
    return rows.groupBy("least_aa").agg(F.count("aa_len").alias("n_orfs"), F.count_distinct("name").alias("n_names"), F.max("aa_len").alias("max_aa"))


@query()
def R8_orf_length_permutations(spark, sf_dir):
    """Are switchpoints nearer to the ends of ORFs of some length than random places, for three least lengths?"""
    seqs, rows = A.genomes(spark, sf_dir), A.tracks(spark, sf_dir)
    lengths = seqs.select("name", F.length("seq").alias("genome_len"))
    points = tracks.switchpoints(rows.select("name", "start", "label")).select("name", "pos0").join(lengths, "name").where("pos0 < genome_len").select("name", "pos0")
    found = written(orfs.predict_orfs(seqs, 10), "orfs")
    return rounded(randomised.length_sensitivity(written(points, "points"), found, lengths, [10, 20, 40], [200], 2000))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def J2_missing_labels(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").join(A.read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT coalesce(d.source, l.source) AS source, CASE WHEN l.source IS NULL THEN 'left_only' WHEN d.source IS NULL THEN 'right_only' ELSE 'both' END AS indicator, coalesce(n, 0) AS n, coalesce(k, 0) AS k
    FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY source) d FULL OUTER JOIN (SELECT source, count(*) AS k FROM documents WHERE lang = 'es' GROUP BY source) l ON d.source = l.source""")
def J5_full_outer_indicator(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents")
    one = lambda lang, c: docs.where(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias(c))
    side = F.when(F.col("k").isNull(), "left_only").when(F.col("n").isNull(), "right_only").otherwise("both")
    return one("fr", "n").join(one("es", "k"), "source", "full_outer").select("source", side.alias("indicator"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))


@query(f"WITH {A.GENOMES}, {_orf_sql(False)} SELECT strand, length(lst) AS n FROM (SELECT strand, list(DISTINCT name) AS lst FROM orf GROUP BY strand) UNION ALL SELECT 'both', count(*) FROM (SELECT name FROM orf WHERE strand = '+' INTERSECT SELECT name FROM orf WHERE strand = '-')")
def U2_intersect_names(spark, sf_dir):
    found = orfs.predict_orfs(A.genomes(spark, sf_dir), 10).select("name", "strand")
    plus, minus = (found.where(F.col("strand") == s).select("name") for s in "+-")
    both = plus.intersect(minus).agg(F.lit("both").alias("strand"), F.count("*").alias("n"))
    return found.groupBy("strand").agg(F.count_distinct("name").alias("n")).unionByName(both)


@query()
def C3_agglomerative(spark, sf_dir):
    return trees.cluster(_panel_distances(spark, sf_dir), 4).select("name", "cluster")


@query()
def C4_scaling(spark, sf_dir):
    return rounded(trees.scaling(_panel_distances(spark, sf_dir)).select("name", "mds1", "mds2"))


@query()
def C5_neighbour_joining(spark, sf_dir):
    return rounded(trees.neighbour_joining(_panel_distances(spark, sf_dir)).select("node", "parent", "length"))


@query()
def C6_bootstrap_support(spark, sf_dir):
    return rounded(trees.bootstrap_support(A.proteins(spark, sf_dir), 1000))


@query()
def R1_mantel(spark, sf_dir):
    return rounded(mantel.mantel_pairs(_panel_distances(spark, sf_dir), _composition_distances(spark, sf_dir), 5000))


@query()
def R2_boundary_enrichment(spark, sf_dir):
    seqs, rows = A.genomes(spark, sf_dir), A.tracks(spark, sf_dir)
    lengths = seqs.select("name", F.length("seq").alias("genome_len"))
    points = tracks.switchpoints(rows.select("name", "start", "label")).select("name", "pos0").join(lengths, "name").where("pos0 < genome_len").select("name", "pos0")
    return rounded(randomised.boundary_enrichment(points, orfs.predict_orfs(seqs, 10), lengths, [50, 100, 200], 2000))


@query()
def R4_two_sample(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents").join(A.read(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), (F.col("toxic") == 1).alias("f"))
    return rounded(randomised.two_sample(rows, "f", "x", 10000))
