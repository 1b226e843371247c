"""The registered queries, each with its SQL where there is any.

Queries are named after what they compute, led by the operator's number in the
inventory.  Floats are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.functions import headers as H
from loopweave.functions import sequences as S
from loopweave.operators import agreement, kmers, orfs, stats, tracks, windows
from loopweave.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with doubles rounded, and no negative zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _count(base: str, seq: str = "seq") -> str:
    return f"CAST(length({seq}) - length(replace({seq}, '{base}', '')) AS INTEGER)"


def _entropy(seq: str) -> str:
    """Bits of a sequence's composition, rounded, as DuckDB computes them."""
    return f"round({_bits(seq)}, 6) + 0.0"


def _bits(seq: str) -> str:
    counts = "[" + ", ".join(f"length({seq}) - length(replace({seq}, '{b}', ''))" for b in "ACGT") + "]"
    total = f"CAST(length({seq}) AS DOUBLE)"
    return f"CASE WHEN length({seq}) > 0 THEN list_sum([CASE WHEN c > 0 THEN -(c / {total}) * log2(c / {total}) ELSE 0.0 END FOR c IN {counts}]) END"


SUMMARY = """s AS (
    SELECT name, count(*) AS n_windows, sum(turn) AS turns FROM (
        SELECT name, CASE WHEN coalesce(lag(label) OVER w, last_value(label) OVER (PARTITION BY name ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) <> label THEN 1 ELSE 0 END AS turn
        FROM t WINDOW w AS (PARTITION BY name ORDER BY start)) GROUP BY name),
    l AS (SELECT name, label, count(*) AS n FROM t GROUP BY name, label),
    d AS (SELECT name, label AS dominant_label, n AS top FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, label) AS r FROM l) WHERE r = 1),
    e AS (SELECT l.name, count(*) AS labels_seen, -sum((n / CAST(n_windows AS DOUBLE)) * log2(n / CAST(n_windows AS DOUBLE))) AS bits FROM l JOIN s ON l.name = s.name GROUP BY l.name),
    m AS (SELECT s.name, n_windows, dominant_label, top / CAST(n_windows AS DOUBLE) AS dominant_frac, greatest(0.0, bits) AS entropy_bits, labels_seen,
          CASE WHEN n_windows <= 1 THEN 0 ELSE turns END AS switches, CASE WHEN n_windows <= 1 THEN 0 ELSE n_windows END AS boundaries,
          CASE WHEN n_windows <= 1 THEN 0.0 ELSE turns / CAST(n_windows AS DOUBLE) END AS switch_rate
          FROM s JOIN d ON s.name = d.name JOIN e ON s.name = e.name)"""


@query(f"""WITH {A.TRACKS}, {SUMMARY}
    SELECT name, CAST(n_windows AS BIGINT) AS n_windows, dominant_label, round(dominant_frac, 6) AS dominant_frac, round(entropy_bits, 6) AS entropy_bits,
           CAST(labels_seen AS BIGINT) AS labels_seen, CAST(switches AS BIGINT) AS switches, CAST(boundaries AS BIGINT) AS boundaries, round(switch_rate, 6) AS switch_rate,
           round(entropy_bits / log2(5), 6) AS norm_entropy, round((1 - dominant_frac) + entropy_bits / log2(5) + switch_rate, 6) AS score, dominant_frac < 0.5 AS flag_low_purity
    FROM m ORDER BY score DESC, dominant_frac, switch_rate DESC, name""")
def A2_mosaic_complexity(spark, sf_dir):
    summary = tracks.mosaic_summary(A.tracks(spark, sf_dir).select("name", "start", "label"))
    return rounded(tracks.ranked(tracks.complexity(summary, 5)))


@query(f"""WITH {A.TRACKS}, {SUMMARY},
    x AS (SELECT (1 - dominant_frac) + entropy_bits / log2(5) + switch_rate AS v FROM m),
    r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k FROM x)
    SELECT round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS "max",
           round((SELECT v FROM r WHERE k = 10), 6) AS at_n, round((SELECT v FROM r WHERE k = 11), 6) AS after_n,
           round((SELECT v FROM r WHERE k = 10) - (SELECT v FROM r WHERE k = 11), 6) + 0.0 AS gap FROM x""")
def A11_score_distribution(spark, sf_dir):
    summary = tracks.mosaic_summary(A.tracks(spark, sf_dir).select("name", "start", "label"))
    return rounded(stats.score_distribution(tracks.complexity(summary, 5), "score", 10))


@query(f"""WITH {A.GENOMES}
    SELECT name, CAST(length(seq) AS INTEGER) AS length, {_count('A')} AS "A", {_count('C')} AS "C", {_count('G')} AS "G", {_count('T')} AS "T", {_count('N')} AS "N",
           {_entropy('seq')} AS entropy, CASE WHEN length(seq) > 0 THEN round({_count('N')} / CAST(length(seq) AS DOUBLE), 6) + 0.0 END AS n_frac,
           CASE WHEN length(seq) > 0 THEN round(({_count('G')} + {_count('C')}) / CAST(length(seq) AS DOUBLE), 6) + 0.0 END AS gc FROM g""")
def P1_genome_summary(spark, sf_dir):
    return rounded(windows.genome_summary(A.genomes(spark, sf_dir)))


@query(f"WITH {A.GENOMES} SELECT name, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM g")
def P3_reverse_complement(spark, sf_dir):
    rc = S.reverse_complement(F.col("seq"))
    return A.genomes(spark, sf_dir).select("name", rc.alias("rc"), F.md5(rc.cast("binary")).alias("rc_md5"))


@query("""WITH x AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGTURYSWKMBDHVN]', '', 'g') AS s FROM documents)
    SELECT doc_id, md5(reverse(translate(s, 'ACGTUNRYSWKMBDHV', 'TGCAANYRSWMKVHDB'))) AS rc_md5 FROM x""")
def P4_reverse_complement_full(spark, sf_dir):
    kept = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACGTURYSWKMBDHVN]", "")
    return A.read(spark, sf_dir, "documents").select("doc_id", F.md5(S.reverse_complement_full(kept).cast("binary")).alias("rc_md5"))


_CODE = "CASE codon " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in sorted(S.CODONS.items())) + " ELSE 'X' END"


@query(f"""WITH {A.PANEL}, c AS (SELECT name, i, substr(seq, CAST(3 * i + 1 AS INTEGER), 3) AS codon FROM p, LATERAL (SELECT unnest(range(0, length(seq) // 3)) AS i)),
    x AS (SELECT name, string_agg({_CODE}, '' ORDER BY i) AS aa FROM c GROUP BY name)
    SELECT p.name, regexp_replace(coalesce(aa, ''), '\\*$', '') AS aa FROM p LEFT JOIN x ON p.name = x.name""")
def P5_translate(spark, sf_dir):
    return A.panel(spark, sf_dir).select("name", S.translate_dna(F.col("seq")).alias("aa"))


@query(f"""WITH {A.GENOMES}, x AS (SELECT name, seq, length(seq) AS n, CAST(length(seq) // 2 AS INTEGER) AS b FROM g WHERE length(seq) > 0)
    SELECT name, md5(substr(seq, b + 1) || substr(seq, 1, b // 2)) AS wrapped, md5(substr(seq, b // 2 + 1, b - b // 2)) AS plain FROM x""")
def P6_slice_circular(spark, sf_dir):
    n = F.length("seq")
    half = F.floor(n / 2).cast("int")
    quarter = F.floor(half / 2).cast("int")
    rows = A.genomes(spark, sf_dir).where(n > 0)
    parts = {"wrapped": S.slice_circular(F.col("seq"), half, quarter, F.lit(True)), "plain": S.slice_circular(F.col("seq"), quarter, half, F.lit(False))}
    return rows.select("name", *(F.md5(v.cast("binary")).alias(k) for k, v in parts.items()))


@query(f"""WITH {A.GENOMES}, x AS (SELECT name, seq, CAST(length(seq) AS INTEGER) AS n FROM g WHERE length(seq) > 0),
    w AS (SELECT name, seq, n, CAST(unnest(range(0, n, 50)) AS INTEGER) AS start FROM x)
    SELECT name, start, start + 250 AS "end", CAST((start + 250) % n AS INTEGER) AS end_mod, start + 250 > n AS wrap, n AS genome_len, true AS circular_window,
           md5(substr(repeat(seq, CAST(250 // n + 2 AS INTEGER)), start + 1, 250)) AS fragment_md5 FROM w""")
def G3_sliding_windows(spark, sf_dir):
    rows = windows.sliding_windows(A.genomes(spark, sf_dir), 250, 50)
    return rows.withColumn("fragment_md5", F.md5(F.col("fragment").cast("binary"))).drop("fragment")


@query(f"""WITH {A.GENOMES}, x AS (SELECT name, seq, CAST(length(seq) AS INTEGER) AS n FROM g WHERE length(seq) > 0),
    w AS (SELECT name, CAST(unnest(range(0, greatest(1, n - 249), 50)) AS INTEGER) AS start, seq, n FROM x)
    SELECT name, start, start + 250 AS "end", least(start + 250, n) AS end_mod, false AS wrap, n AS genome_len, false AS circular_window, md5(substr(seq, start + 1, 250)) AS fragment_md5 FROM w""")
def G3_linear_windows(spark, sf_dir):
    rows = windows.sliding_windows(A.genomes(spark, sf_dir), 250, 50, circular=False)
    return rows.withColumn("fragment_md5", F.md5(F.col("fragment").cast("binary"))).drop("fragment")


_WINDOW_ENTROPY = f"""{A.GENOMES}, x AS (SELECT name, seq || substr(seq, 1, 250) AS s, CAST(length(seq) AS INTEGER) AS n FROM g WHERE length(seq) > 0),
    w AS (SELECT name, start, substr(s, start + 1, 250) AS f FROM (SELECT name, s, CAST(unnest(range(0, n, 50)) AS INTEGER) AS start FROM x)),
    en AS (SELECT name, start, {_bits('f')} AS entropy FROM w)"""


@query(f"WITH {_WINDOW_ENTROPY} SELECT name, start, round(entropy, 6) + 0.0 AS entropy FROM en")
def G4_entropy_windows(spark, sf_dir):
    return rounded(windows.entropy_windows(A.genomes(spark, sf_dir), 250, 50))


@query(f"""WITH {_WINDOW_ENTROPY} SELECT name, count(*) AS n_rows, count(entropy) AS n, round(avg(entropy), 6) + 0.0 AS mean, round(var_samp(entropy), 6) + 0.0 AS "var", round(stddev_samp(entropy), 6) + 0.0 AS sd
    FROM en GROUP BY name""")
def A9_entropy_stats(spark, sf_dir):
    rows = windows.entropy_windows(A.genomes(spark, sf_dir), 250, 50)
    return rounded(stats.group_stats(rows, "name", "entropy"))


_Q = ", ".join(f"quantile_cont(entropy, {q}) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "q99")))


@query(f"""WITH {_WINDOW_ENTROPY}, q AS (SELECT name, count(entropy) AS n, avg(entropy) AS mean, max(entropy) AS mx, {_Q} FROM en GROUP BY name HAVING count(entropy) >= 5)
    SELECT name, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('p05', 'p25', 'p50', 'p75', 'p95'))}, round(CASE WHEN n < 100 THEN p95 ELSE q99 END, 6) + 0.0 AS p99,
    round(p75 - p25, 6) + 0.0 AS iqr, round(p95 - p05, 6) + 0.0 AS spread, round(mx - p50, 6) + 0.0 AS max_minus_median, round(p95 - p50, 6) + 0.0 AS p95_excess, round(mean, 6) + 0.0 AS mean, round(mx, 6) + 0.0 AS "max" FROM q""")
def A10_tail_metrics(spark, sf_dir):
    rows = windows.entropy_windows(A.genomes(spark, sf_dir), 250, 50)
    return rounded(stats.tail_metrics(rows, "name", "entropy"))


def _kmer_sql(table: str, k: int, name: str = "k") -> str:
    return f"""{name} AS (SELECT name, kmer, count(*) AS cnt FROM (SELECT name, substr(seq, CAST(i AS INTEGER), {k}) AS kmer FROM (SELECT name, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {table} WHERE length(seq) >= {k})) GROUP BY name, kmer)"""


@query(f"WITH {A.GENOMES}, {_kmer_sql('g', 4)} SELECT name, kmer, cnt, round(cnt / CAST(sum(cnt) OVER (PARTITION BY name) AS DOUBLE), 6) AS freq FROM k")
def A1_kmer_freq(spark, sf_dir):
    return rounded(kmers.kmer_frequencies(kmers.kmer_counts(A.genomes(spark, sf_dir), 4)))


@query(f"WITH {A.GENOMES}, c AS (SELECT name, seq || substr(seq, 1, 2) AS seq FROM g WHERE length(seq) > 0), {_kmer_sql('c', 3)} SELECT name, kmer, cnt FROM k")
def G1_circular_kmers(spark, sf_dir):
    return kmers.kmer_counts(A.genomes(spark, sf_dir), 3, circular=True)


@query("WITH b AS (SELECT unnest(['A','C','G','T']) AS x) SELECT CAST(row_number() OVER (ORDER BY a.x || b.x || c.x || d.x) - 1 AS INTEGER) AS idx, a.x || b.x || c.x || d.x AS kmer FROM b a, b, b c, b d")
def G6_vocabulary(spark, sf_dir):
    return kmers.vocabulary(spark, 4)


_NORM = "n AS (SELECT name, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS norm FROM k GROUP BY name)"


@query(f"""WITH {A.PANEL}, {_kmer_sql('p', 4)}, {_NORM},
    d AS (SELECT x.name AS a, y.name AS b, sum(x.cnt * y.cnt) AS dot FROM k x JOIN k y ON x.kmer = y.kmer AND x.name < y.name GROUP BY 1, 2)
    SELECT x.name AS a, y.name AS b, CASE WHEN na.norm IS NOT NULL AND nb.norm IS NOT NULL THEN round(1 - coalesce(CAST(dot AS DOUBLE), 0.0) / (na.norm * nb.norm), 6) + 0.0 END AS dist
    FROM p x JOIN p y ON x.name < y.name LEFT JOIN n na ON na.name = x.name LEFT JOIN n nb ON nb.name = y.name LEFT JOIN d ON d.a = x.name AND d.b = y.name""")
def L1_cosine_distance(spark, sf_dir):
    panel = A.panel(spark, sf_dir)
    return rounded(kmers.cosine_distances(panel.select("name"), kmers.kmer_counts(panel, 4)))


@query(f"""WITH {A.PANEL}, {_kmer_sql('p', 4)}, f AS (SELECT name, kmer, cnt / CAST(sum(cnt) OVER (PARTITION BY name) AS DOUBLE) AS f FROM k),
    o AS (SELECT DISTINCT name FROM k), pr AS (SELECT x.name AS a, y.name AS b FROM o x JOIN o y ON x.name < y.name), voc AS (SELECT DISTINCT kmer FROM k),
    full_ AS (SELECT a, b, coalesce(fa.f, 0.0) AS pa, coalesce(fb.f, 0.0) AS pb FROM pr CROSS JOIN voc LEFT JOIN f fa ON fa.name = a AND fa.kmer = voc.kmer LEFT JOIN f fb ON fb.name = b AND fb.kmer = voc.kmer),
    j AS (SELECT a, b, sqrt(greatest(0.0, 0.5 * sum(CASE WHEN pa > 0 THEN pa * log2(2 * pa / (pa + pb)) ELSE 0.0 END + CASE WHEN pb > 0 THEN pb * log2(2 * pb / (pa + pb)) ELSE 0.0 END))) AS dist FROM full_ GROUP BY a, b)
    SELECT x.name AS a, y.name AS b, round(j.dist, 6) + 0.0 AS dist FROM p x JOIN p y ON x.name < y.name LEFT JOIN j ON j.a = x.name AND j.b = y.name""")
def L3_jensen_shannon(spark, sf_dir):
    panel = A.panel(spark, sf_dir)
    return rounded(kmers.jensen_shannon(panel.select("name"), kmers.kmer_counts(panel, 4)))


@query(f"""WITH {A.GENOMES}, {A.PANEL}, {_kmer_sql('g', 4, 'kg')}, {_kmer_sql('p', 4, 'kp')},
    ng AS (SELECT name, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS norm FROM kg GROUP BY name), np AS (SELECT name, sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) AS norm FROM kp GROUP BY name),
    d AS (SELECT x.name AS a, y.name AS b, sum(x.cnt * y.cnt) AS dot FROM kg x JOIN kp y ON x.kmer = y.kmer GROUP BY 1, 2),
    r AS (SELECT a, b, round(1 - dot / (ng.norm * np.norm), 12) AS dist FROM d JOIN ng ON ng.name = a JOIN np ON np.name = b)
    SELECT a AS query, b AS hit, round(dist, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM r) WHERE k = 1""")
def J14_nearest_reference(spark, sf_dir):
    found = kmers.nearest_reference(A.genomes(spark, sf_dir), A.panel(spark, sf_dir), 4)
    # Scaled before it is rounded, as the SQL does, for what lies half-way.
    return found.select("query", "hit", (F.round(F.col("dist") * 1e6) / 1e6 + 0.0).alias("dist"))


_RUNS = """r0 AS (SELECT *, CASE WHEN lag(label) OVER w <> label THEN 1 ELSE 0 END AS ch, CAST(row_number() OVER w - 1 AS INTEGER) AS idx FROM t WINDOW w AS (PARTITION BY name ORDER BY start)),
    r1 AS (SELECT *, sum(ch) OVER (PARTITION BY name ORDER BY start) AS run FROM r0),
    r2 AS (SELECT *, max(run) OVER (PARTITION BY name) AS last_run, first_value(label) OVER (PARTITION BY name ORDER BY start) AS fl,
           last_value(label) OVER (PARTITION BY name ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ll FROM r1),
    r3 AS (SELECT *, CASE WHEN run = 0 AND fl = ll AND last_run > 0 THEN last_run ELSE run END AS cr, CASE WHEN run = 0 AND fl = ll AND last_run > 0 THEN 1 ELSE 0 END AS late FROM r2),
    runs AS (SELECT name, cr, min(label) AS label, count(*) AS windows, arg_min(start, late * 100000000 + idx) AS first_start, arg_max(start, late * 100000000 + idx) AS last_start, arg_min(idx, late * 100000000 + idx) AS first_index FROM r3 GROUP BY name, cr),
    nx AS (SELECT *, count(*) OVER (PARTITION BY name) AS n_runs, coalesce(lead(label) OVER w, first_value(label) OVER w) AS nl, coalesce(lead(windows) OVER w, first_value(windows) OVER w) AS nw,
           coalesce(lead(first_start) OVER w, first_value(first_start) OVER w) AS ns, coalesce(lead(first_index) OVER w, first_value(first_index) OVER w) AS ni FROM runs WINDOW w AS (PARTITION BY name ORDER BY cr)),
    sp AS (SELECT name, ns AS pos0, label AS prev_label, nl AS new_label, windows AS prev_run_windows, nw AS new_run_windows, true AS circular_transition, ni AS new_run_start_window_index, last_start
           FROM nx WHERE n_runs > 1)"""


@query(f"WITH {A.TRACKS}, {_RUNS} SELECT name, pos0, prev_label, new_label, prev_run_windows, new_run_windows, circular_transition, new_run_start_window_index FROM sp WHERE prev_run_windows >= 2 AND new_run_windows >= 2")
def W3_switchpoints(spark, sf_dir):
    return tracks.switchpoints(A.tracks(spark, sf_dir).select("name", "start", "label"), least_run=2)


@query(f"""WITH {A.TRACKS}, {_RUNS}, gl AS (SELECT name, max(genome_len) AS n FROM t GROUP BY name)
    SELECT sp.name, CAST(floor((((last_start + 10) % n) + ((pos0 - (last_start + 10) % n) % n + n) % n / 2.0) % n) AS INTEGER) AS pos0, prev_label, new_label, prev_run_windows, new_run_windows, circular_transition, new_run_start_window_index
    FROM sp JOIN gl ON sp.name = gl.name""")
def W4_mid_switchpoints(spark, sf_dir):
    return tracks.switchpoints(A.tracks(spark, sf_dir), least_run=1, ends=True)


@query(f"WITH {A.TRACKS}, {_RUNS} SELECT prev_label, new_label, count(*) AS n FROM sp GROUP BY 1, 2")
def A6_transition_counts(spark, sf_dir):
    return tracks.transition_counts(tracks.switchpoints(A.tracks(spark, sf_dir).select("name", "start", "label")))


@query(f"""WITH {A.TRACKS}, {_RUNS}, gl AS (SELECT name, max(genome_len) AS genome_len FROM t GROUP BY name),
    x AS (SELECT name, least(prev_run_windows, new_run_windows) AS r, prev_label || '>' || new_label AS tr FROM sp)
    SELECT x.name, count(*) AS n_switchpoints, round(avg(r), 6) AS mean_run, round(median(r), 6) AS median_run, min(r) AS min_run, max(r) AS max_run, count(DISTINCT tr) AS transitions, genome_len,
           round(count(*) * 1000 / CAST(genome_len AS DOUBLE), 6) AS per_kb FROM x JOIN gl ON x.name = gl.name GROUP BY x.name, genome_len""")
def A7_switchpoint_summary(spark, sf_dir):
    rows = A.tracks(spark, sf_dir)
    lengths = rows.groupBy("name").agg(F.max("genome_len").alias("genome_len"))
    return rounded(tracks.switchpoint_summary(tracks.switchpoints(rows.select("name", "start", "label")), lengths))


@query(f"""WITH {A.TRACKS}, {_RUNS}, gl AS (SELECT name, max(genome_len) AS n FROM t GROUP BY name),
    b AS (SELECT CAST(least(greatest(floor(pos0 / CAST(n AS DOUBLE) * 20), 0), 19) AS INTEGER) AS bin FROM sp JOIN gl ON sp.name = gl.name), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
    SELECT CAST(r.bin AS INTEGER) AS bin, (r.bin + 0.5) / CAST(20 AS DOUBLE) AS bin_mid, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS density
    FROM (SELECT unnest(range(0, 20)) AS bin) r LEFT JOIN c ON c.bin = r.bin""")
def A8_position_histogram(spark, sf_dir):
    rows = A.tracks(spark, sf_dir)
    lengths = rows.groupBy("name").agg(F.max("genome_len").alias("genome_len"))
    return rounded(tracks.position_histogram(tracks.switchpoints(rows.select("name", "start", "label")), lengths, 20))


def _orf_sql(nested: bool) -> str:
    group = "" if nested else ", min(i) OVER (PARTITION BY name, strand, stop_i) AS first_i"
    keep = "" if nested else "AND i = first_i"
    return f"""both_ AS (SELECT name, length(seq) AS n, '+' AS strand, seq || seq AS scan FROM g WHERE length(seq) > 0 UNION ALL
        SELECT name, length(seq), '-', reverse(translate(seq || seq, 'ACGT', 'TGCA')) FROM g WHERE length(seq) > 0),
    c AS (SELECT name, n, strand, CAST(i AS INTEGER) AS i, substr(scan, CAST(i + 1 AS INTEGER), 3) AS codon FROM (SELECT *, unnest(range(0, length(scan) - 2)) AS i FROM both_ WHERE length(scan) >= 6)),
    st AS (SELECT *, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN i END) OVER (PARTITION BY name, strand, i % 3 ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop_i
           FROM c WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA')),
    ok AS (SELECT s.*, z.codon AS stop_codon FROM st s JOIN c z ON z.name = s.name AND z.strand = s.strand AND z.i = s.stop_i WHERE s.codon = 'ATG' AND s.i + 3 <= s.n AND stop_i - s.i <= s.n),
    o0 AS (SELECT *, stop_i + 3 AS e {group} FROM ok),
    orf AS (SELECT name, strand, i % 3 AS frame, CASE WHEN strand = '+' THEN i % n ELSE (n - e % n) % n END AS start0, CASE WHEN strand = '+' THEN e % n ELSE (n - i % n) % n END AS end0,
            e > n AS wrap, e - i AS nt_len, (e - i) // 3 - 1 AS aa_len, codon AS start_codon, stop_codon, i AS scan_start, n FROM o0 WHERE (e - i) // 3 - 1 >= 10 {keep})"""


_ORF_CELLS = """name, strand, CAST(frame AS INTEGER) AS frame, CAST(start0 AS INTEGER) AS start0, CAST(end0 AS INTEGER) AS end0, CAST(CASE WHEN strand = '+' THEN start0 ELSE end0 END AS INTEGER) AS span_start0,
    CAST(CASE WHEN strand = '+' THEN end0 ELSE start0 END AS INTEGER) AS span_end0, wrap, wrap OR (CASE WHEN strand = '+' THEN start0 >= end0 ELSE end0 >= start0 END) AS wrap_compat,
    CAST(nt_len AS INTEGER) AS nt_len, CAST(aa_len AS INTEGER) AS aa_len, start_codon, stop_codon, CAST(scan_start AS INTEGER) AS scan_start"""


@query(f"WITH {A.GENOMES}, {_orf_sql(False)} SELECT {_ORF_CELLS} FROM orf")
def O1_predict_orfs(spark, sf_dir):
    return orfs.predict_orfs(A.genomes(spark, sf_dir), 10)


@query(f"WITH {A.GENOMES}, {_orf_sql(True)} SELECT {_ORF_CELLS} FROM orf")
def O1_nested_orfs(spark, sf_dir):
    return orfs.predict_orfs(A.genomes(spark, sf_dir), 10, nested=True)


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)}, x AS (SELECT orf.*, substr(CASE WHEN strand = '+' THEN seq || seq ELSE reverse(translate(seq || seq, 'ACGT', 'TGCA')) END, CAST(scan_start + 1 AS INTEGER), CAST(nt_len AS INTEGER)) AS nt_seq FROM orf JOIN g ON g.name = orf.name),
    cd AS (SELECT name, strand, scan_start, nt_len, nt_seq, j, substr(nt_seq, CAST(3 * j + 1 AS INTEGER), 3) AS codon FROM (SELECT *, unnest(range(0, nt_len // 3 - 1)) AS j FROM x))
    SELECT name, strand, CAST(scan_start AS INTEGER) AS scan_start, CAST(nt_len AS INTEGER) AS nt_len, nt_seq, string_agg({_CODE}, '' ORDER BY j) AS aa_seq FROM cd GROUP BY name, strand, scan_start, nt_len, nt_seq""")
def O3_extract_orfs(spark, sf_dir):
    seqs = A.genomes(spark, sf_dir)
    return orfs.extract_orfs(seqs, orfs.predict_orfs(seqs, 10)).select("name", "strand", "scan_start", "nt_len", "nt_seq", "aa_seq")


@query(f"""WITH {A.GENOMES}, {_orf_sql(False)} SELECT name, strand, CAST(start0 AS INTEGER) AS start0, CAST(end0 AS INTEGER) AS end0, CAST(nt_len AS INTEGER) AS nt_len, CAST(aa_len AS INTEGER) AS aa_len, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY aa_len DESC, nt_len DESC, start0, strand, end0) AS rank FROM orf) WHERE rank <= 3""")
def W5_longest_orfs(spark, sf_dir):
    found = orfs.longest_orfs(orfs.predict_orfs(A.genomes(spark, sf_dir), 10), 3)
    return found.select("name", "strand", "start0", "end0", "nt_len", "aa_len", "rank")


@query(f"WITH {A.GENOMES}, {_orf_sql(False)} SELECT count(*) AS n_orfs, count(DISTINCT name) AS n_names, median(aa_len) AS median_aa, CAST(max(aa_len) AS INTEGER) AS max_aa FROM orf")
def A12_orf_summary(spark, sf_dir):
    return orfs.orf_summary(orfs.predict_orfs(A.genomes(spark, sf_dir), 10))


_NEAR = f"""{A.GENOMES}, {_orf_sql(False)}, pt AS (SELECT name, CAST(unnest(range(0, length(seq), 50)) AS INTEGER) AS pos0 FROM g WHERE length(seq) > 0), ln AS (SELECT name, length(seq) AS n FROM g),
    bd AS (SELECT name, start0 AS b FROM orf UNION SELECT name, end0 FROM orf),
    nd AS (SELECT pt.name, pt.pos0, CAST(min(least(abs(pos0 - b), n - abs(pos0 - b))) AS INTEGER) AS dist FROM pt LEFT JOIN bd ON bd.name = pt.name LEFT JOIN ln ON ln.name = pt.name GROUP BY pt.name, pt.pos0)"""


def _near(spark, sf_dir):
    seqs = A.genomes(spark, sf_dir)
    at = seqs.where(F.length("seq") > 0).select("name", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(50))).alias("pos0"))
    return orfs.nearest_boundary(at, orfs.predict_orfs(seqs, 10), seqs.select("name", F.length("seq").alias("genome_len")))


@query(f"WITH {_NEAR} SELECT name, pos0, dist FROM nd")
def J12_nearest_boundary(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"WITH {_NEAR}, th AS (SELECT unnest([25, 50, 100, 200]) AS threshold) SELECT threshold, count(*) AS n, round(avg(CASE WHEN dist <= threshold THEN 1.0 ELSE 0.0 END), 6) AS frac FROM nd, th WHERE dist IS NOT NULL GROUP BY threshold")
def A18_near_fraction(spark, sf_dir):
    return rounded(orfs.near_fraction(_near(spark, sf_dir), [25, 50, 100, 200]))


@query("""WITH h AS (SELECT doc_id, regexp_split_to_array(text, '\\n')[1] AS header FROM documents),
    k AS (SELECT doc_id, header, list_filter(regexp_split_to_array(header, '\\s+'), lambda x: x <> '') AS toks FROM h),
    f AS (SELECT doc_id, coalesce(toks[1], '') AS id, CAST(greatest(len(toks) - 1, 0) AS INTEGER) AS extra_tokens, CAST(regexp_matches(coalesce(toks[1], ''), '^[A-Z]{1,4}\\d{5,10}(\\.\\d+)?$') AS INTEGER) AS accession_like,
          CAST(regexp_matches(header, '(^|[^\\p{L}\\p{N}_])[A-Z][a-z]{2,}\\s+[a-z]{2,}([^\\p{L}\\p{N}_]|$)') AS INTEGER) AS species_like,
          CAST(regexp_matches(lower(header), 'country|strain|isolate|host|location|collected|isolation|geo|region') AS INTEGER) AS has_keywords, CAST(regexp_matches(header, '[|;/\\[\\](){}]') AS INTEGER) AS has_delims FROM k),
    s AS (SELECT *, CAST(extra_tokens + 2 * has_delims + 2 * has_keywords + 2 * species_like + accession_like AS INTEGER) AS score FROM f)
    SELECT *, CASE WHEN score >= 6 THEN 'strong' WHEN score >= 2 THEN 'some' ELSE 'id_only' END AS level FROM s""")
def P15_header_features(spark, sf_dir):
    header = F.get(F.split("text", "\n"), F.lit(0))
    return A.read(spark, sf_dir, "documents").select("doc_id", H.header_score(header).alias("h")).select("doc_id", "h.*")


@query("""WITH h AS (SELECT *, row_number() OVER () AS r FROM (SELECT page_id, regexp_split_to_array(url, '/')[3] AS header FROM pages)) SELECT regexp_split_to_array(header, '\\.')[1] AS token, count(*) AS n FROM h GROUP BY 1""")
def A14_token_summary(spark, sf_dir):
    host = F.get(F.split("url", "/"), F.lit(2))
    return A.read(spark, sf_dir, "pages").groupBy(F.split_part(host, F.lit("."), F.lit(1)).alias("token")).agg(F.count("*").alias("n"))


_XY = "xy AS (SELECT d.doc_id, d.lang AS x, CAST(l.quality AS VARCHAR) || CAST(l.toxic AS VARCHAR) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), ct AS (SELECT x, y, count(*) AS n FROM xy GROUP BY x, y)"


def _labelled(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents").select("doc_id", "lang").join(A.read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.col("lang").alias("x"), F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("y"))


@query(f"WITH {_XY} SELECT * FROM ct")
def A5_contingency(spark, sf_dir):
    return agreement.contingency(_labelled(spark, sf_dir), "x", "y")


@query(f"WITH {_XY} SELECT x, y, n FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS r FROM ct) WHERE r = 1")
def A4_majority_mapping(spark, sf_dir):
    return agreement.majority_mapping(agreement.contingency(_labelled(spark, sf_dir), "x", "y"))


@query(f"""WITH {_XY}, s AS (SELECT sum(n * (n - 1) / 2.0) AS c, sum(n) AS n FROM ct), a AS (SELECT sum(m * (m - 1) / 2.0) AS r FROM (SELECT sum(n) AS m FROM ct GROUP BY x)), b AS (SELECT sum(m * (m - 1) / 2.0) AS k FROM (SELECT sum(n) AS m FROM ct GROUP BY y))
    SELECT round((c - r * k / (n * (n - 1) / 2.0)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2.0)), 6) + 0.0 AS ari FROM s, a, b""")
def M1_adjusted_rand(spark, sf_dir):
    return rounded(agreement.adjusted_rand(agreement.contingency(_labelled(spark, sf_dir), "x", "y")))


@query(f"""WITH {_XY}, e AS (SELECT n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny FROM ct)
    SELECT round(greatest(0.0, sum(n / t * ln(n * t / (nx * ny)))) / ((sum(-n / t * ln(nx / t)) + sum(-n / t * ln(ny / t))) / 2), 6) + 0.0 AS nmi FROM e""")
def M2_mutual_information(spark, sf_dir):
    return rounded(agreement.normalized_mutual_information(agreement.contingency(_labelled(spark, sf_dir), "x", "y")))


_PARTS = f"{A.POINTS}, q AS (SELECT id, label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v)"


@query(f"""WITH {_PARTS}, o AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM q GROUP BY label, i), gr AS (SELECT i, avg(x) AS g FROM q GROUP BY i)
    SELECT round((sum(n * (m - g) * (m - g)) / (count(DISTINCT label) - 1)) / (sum(w) / (sum(n) FILTER (WHERE o.i = 0) - count(DISTINCT label))), 6) + 0.0 AS calinski_harabasz FROM o JOIN gr ON o.i = gr.i""")
def M5_calinski_harabasz(spark, sf_dir):
    return rounded(agreement.calinski_harabasz(A.points(spark, sf_dir)))


@query(f"""WITH {_PARTS}, c AS (SELECT label, i, avg(x) AS m FROM q GROUP BY label, i), dd AS (SELECT id, q.label, sqrt(sum((x - m) * (x - m))) AS d FROM q JOIN c ON c.label = q.label AND c.i = q.i GROUP BY id, q.label),
    s AS (SELECT label, avg(d) AS s FROM dd GROUP BY label), ap AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
    r AS (SELECT la, max((sa.s + sb.s) / d) AS r FROM ap JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la) SELECT round(avg(r), 6) + 0.0 AS davies_bouldin FROM r""")
def M6_davies_bouldin(spark, sf_dir):
    return rounded(agreement.davies_bouldin(A.points(spark, sf_dir)))


@query("""WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS x, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS y FROM documents),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM r""")
def L10_spearman(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents")
    rows = docs.select(F.col("n_chars").cast("double").alias("x"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("y"))
    return rounded(stats.spearman(rows, "x", "y"))


@query("""WITH d AS (SELECT source, CAST(n_chars AS DOUBLE) AS x FROM documents), k AS (SELECT x, avg(r) AS rank FROM (SELECT x, row_number() OVER (ORDER BY x) AS r FROM d) GROUP BY x) SELECT d.x AS n_chars, k.rank, count(*) AS n FROM d JOIN k ON d.x = k.x GROUP BY 1, 2""")
def W8_average_rank(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("n_chars"))
    return stats.average_rank(docs, "n_chars", "rank").groupBy("n_chars", "rank").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS x, toxic = 1 AS f FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    s AS (SELECT count(x) FILTER (WHERE f) AS a, count(x) FILTER (WHERE NOT f) AS b, avg(x) FILTER (WHERE f) AS ma, avg(x) FILTER (WHERE NOT f) AS mb, var_samp(x) FILTER (WHERE f) AS va, var_samp(x) FILTER (WHERE NOT f) AS vb FROM d)
    SELECT a AS n_top, b AS n_other, round(ma, 6) AS mean_top, round(mb, 6) AS mean_other, round(ma - mb, 6) AS diff, round((ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2)), 6) AS cohens_d FROM s""")
def R5_cohens_d(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents").join(A.read(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), (F.col("toxic") == 1).alias("f"))
    return rounded(stats.cohens_d(rows, "f", "x"))
