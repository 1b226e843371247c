"""Registered queries on sequence files, edge tables of trees, spanning forests and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from loopweave.operators import edges, forest, landmarks
from loopweave.plans import adapters as A
from loopweave.plans.queries import query, rounded
from loopweave.sources import flat, staging
from loopweave.sources.places import new_dir, written

_HEADER = "CAST(doc_id AS VARCHAR) || ' ' || coalesce(lang, 'und') || ' ' || coalesce(source, 'none')"


def _records(spark, sf_dir):
    """Documents as sequences ``(name, header, seq, lang, source)``."""
    docs = A.read(spark, sf_dir, "documents")
    lang, source = F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none"))
    name = F.col("doc_id").cast("string")
    return docs.select(name.alias("name"), F.concat_ws(" ", name, lang, source).alias("header"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"), lang.alias("lang"), source.alias("source"))


@query(f"WITH {A.GENOMES} SELECT g.name, {_HEADER} AS header, coalesce(seq, '') AS seq FROM g JOIN documents ON CAST(doc_id AS VARCHAR) = g.name")
def S7_fasta_round_trip(spark, sf_dir):
    flat.register(spark)
    at = new_dir(spark, "fasta")
    _records(spark, sf_dir).select("name", "header", "seq").write.format("fasta").mode("append").save(at)
    return spark.read.format("fasta").load(at).select("name", "header", "seq")


@query(f"WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_HEADER} AS header FROM documents) SELECT lang, count(*) AS n, sum(length(header))::BIGINT AS chars FROM d WHERE starts_with(header, '1') GROUP BY lang")
def S9_K2_partitioned_headers(spark, sf_dir):
    flat.register(spark)
    at = new_dir(spark, "fasta-by-lang")
    _records(spark, sf_dir).select("name", "header", "seq", "lang").write.format("fasta").option("partitionBy", "lang").option("compression", "gzip").mode("append").save(at)
    rows = spark.read.format("fasta").option("columns", "name, header, source_file").load(at).where(F.col("name").startswith("1"))
    return rows.groupBy(F.regexp_extract("source_file", "/lang=([^/]*)/", 1).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("header")).alias("chars"))


@query(f"""WITH {A.GENOMES}, d AS (SELECT 'D' || g.name AS name, coalesce(seq, '') AS seq, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source, doc_id FROM g JOIN documents ON CAST(doc_id AS VARCHAR) = g.name)
    SELECT name, name || '.1' AS id, 'text in ' || lang AS description, source AS organism, CASE WHEN doc_id % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology, name AS accession, seq, CASE WHEN length(seq) > 3 THEN CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END END AS strand,
        CASE WHEN length(seq) > 3 THEN length(seq) // 2 END::INT AS second_start, CASE WHEN length(seq) > 3 THEN length(seq) END::INT AS second_end, CASE WHEN length(seq) > 3 THEN 'a "' || lang || '" gene' END AS gene FROM d""")
def S6_genbank_round_trip(spark, sf_dir):
    flat.register(spark)
    at = new_dir(spark, "genbank")
    even, third, half = F.expr("cast(name as bigint) % 2 = 0"), F.expr("cast(name as bigint) % 3 = 0"), F.floor(F.length("seq") / 2).cast("int")
    title = F.concat(F.lit("D"), "name")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    parts = F.array(span(F.lit(0), half), span(half, F.length("seq")))
    gene = F.create_map(F.lit("gene"), F.array(F.concat(F.lit('a "'), "lang", F.lit('" gene'))))
    feature = F.struct(F.lit("CDS").alias("type"), F.when(third, -1).otherwise(1).alias("strand"), parts.alias("parts"), gene.alias("qualifiers"))
    rows = _records(spark, sf_dir).select(
        F.concat(title, F.lit(".1")).alias("id"), title.alias("name"), F.concat(F.lit("text in "), "lang").alias("description"), F.col("source").alias("organism"), F.when(even, "circular").otherwise("linear").alias("topology"),
        F.array(title).alias("accessions"), "seq", F.when(F.length("seq") > 3, F.array(feature)).alias("features"),
    )
    rows.write.format("genbank").mode("append").save(at)
    back = spark.read.format("genbank").load(at).withColumn("f", F.get("features", F.lit(0)))
    second = F.get("f.parts", F.lit(1))
    return back.select(
        "name", "id", "description", "organism", "topology", F.get("accessions", F.lit(0)).alias("accession"), "seq", F.col("f.strand").alias("strand"), second["start"].alias("second_start"), second["end"].alias("second_end"),
        F.get(F.try_element_at("f.qualifiers", F.lit("gene")), F.lit(0)).alias("gene"),
    )


@query("""WITH c AS (SELECT c_nationkey || '-' || (c_custkey // 100) AS grp, c_mktsegment AS seg, 'O''' || c_custkey AS name, c_acctbal::DOUBLE AS length FROM customer)
    SELECT grp, name, seg AS parent, length FROM c UNION ALL SELECT grp, seg, 'all of ' || grp, count(*)::DOUBLE FROM c GROUP BY grp, seg UNION ALL SELECT DISTINCT grp, 'all of ' || grp, NULL, NULL FROM c""")
def S17_newick_round_trip(spark, sf_dir):
    """Customers as trees written as text, by nation and segment, and read again."""
    rows = A.read(spark, sf_dir, "customer").select(F.concat_ws("-", "c_nationkey", F.expr("c_custkey div 100")).alias("grp"), F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("key"), "c_acctbal")
    tip = F.concat(F.lit("'O''"), F.col("key"), F.lit("':"), F.col("c_acctbal").cast("double"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    parts = rows.groupBy("grp", "seg").agg(F.concat(F.lit("("), joined(tip), F.lit(")"), F.first("seg"), F.lit(":"), F.count("*")).alias("part"))
    texts = parts.groupBy("grp").agg(F.concat(F.lit("("), joined("part"), F.lit(")'all of "), F.first("grp"), F.lit("';")).alias("tree"))
    found = edges.read_newick(texts)
    above = found.select("grp", F.col("node").alias("parent"), F.col("name").alias("above"))
    return found.join(above.hint("merge"), ["grp", "parent"], "left").select("grp", "name", F.col("above").alias("parent"), "length")


_HEAP = "e AS (SELECT c_custkey // 100 AS grp, c_custkey % 100 + 1 AS node, CASE WHEN c_custkey % 100 > 0 THEN (c_custkey % 100 + 1) // 2 END AS parent, c_name AS name, 1.0::DOUBLE + c_nationkey AS length FROM customer)"


def _heaps(spark, sf_dir):
    """Customers as binary trees of up to 100 nodes, by their keys."""
    node = F.expr("cast(c_custkey % 100 + 1 as int)")
    parent = F.when(node > 1, F.floor(node / 2).cast("int"))
    return A.read(spark, sf_dir, "customer").select(F.expr("c_custkey div 100").alias("grp"), node.alias("node"), parent.alias("parent"), F.col("c_name").alias("name"), (F.lit(1.0) + F.col("c_nationkey")).alias("length"))


@query(f"""WITH RECURSIVE {_HEAP}, up AS (SELECT grp, node, node AS anc, 0.0::DOUBLE AS d, 0::BIGINT AS hops FROM e UNION ALL SELECT u.grp, u.node, e.parent, u.d + e.length, u.hops + 1 FROM up u JOIN e ON e.grp = u.grp AND e.node = u.anc WHERE e.parent IS NOT NULL)
    SELECT grp, node, d AS dist, hops FROM up WHERE anc = 1""")
def C7_path_lengths(spark, sf_dir):
    return edges.depths(_heaps(spark, sf_dir)).select("grp", "node", "dist", "hops")


@query(f"""WITH RECURSIVE {_HEAP}, up AS (SELECT grp, node, node AS anc, 0.0::DOUBLE AS d FROM e UNION ALL SELECT u.grp, u.node, e.parent, u.d + e.length FROM up u JOIN e ON e.grp = u.grp AND e.node = u.anc WHERE e.parent IS NOT NULL),
    tip AS (SELECT grp, node, name FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.grp = e.grp AND k.parent = e.node)), ut AS (SELECT up.* FROM up JOIN tip USING (grp, node)),
    pd AS (SELECT a.grp, a.node AS x, b.node AS y, min(a.d + b.d) AS d FROM ut a JOIN ut b ON a.grp = b.grp AND a.anc = b.anc GROUP BY ALL),
    far AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY grp ORDER BY d DESC, x, y) = 1)
    SELECT t.grp, t.name, round(abs((p.d + f.d - q.d) / 2 - f.d / 2) + (p.d + q.d - f.d) / 2, 6) AS dist FROM tip t JOIN far f ON f.grp = t.grp JOIN pd p ON p.grp = t.grp AND p.x = t.node AND p.y = f.x JOIN pd q ON q.grp = t.grp AND q.x = t.node AND q.y = f.y""")
def C7_midpoint_root(spark, sf_dir):
    """How far each tip is from the root that lies between the two that are farthest apart."""
    found = edges.midpoint_root(_heaps(spark, sf_dir))
    return rounded(edges.tips(found).select("grp", "node", "name").join(edges.depths(found).hint("merge"), ["grp", "node"]).select("grp", "name", "dist"))


@query("""WITH r AS (SELECT unnest([1, 2, 3, 4, 5]) AS r), t AS (SELECT r, c_custkey AS c, c_custkey % (2 + r % 3) AS x, c_custkey // 100 AS y FROM customer, r),
    s AS (SELECT r, list_sort(list(c)) AS tips FROM t GROUP BY r, x UNION SELECT r, list_sort(list(c)) FROM t GROUP BY r, x, y), every AS (SELECT list_sort(list(c_custkey)) AS tips FROM customer),
    side AS (SELECT DISTINCT r, CASE WHEN list_contains(s.tips, every.tips[1]) THEN md5(CAST(list_filter(every.tips, lambda v: NOT list_contains(s.tips, v)) AS VARCHAR)) ELSE md5(CAST(s.tips AS VARCHAR)) END AS name, least(len(s.tips), len(every.tips) - len(s.tips)) AS size FROM s, every),
    k AS (SELECT name, size, count(*) AS trees FROM side WHERE size > 1 GROUP BY ALL) SELECT size, trees, count(*) AS splits, round(avg(trees / 5.0), 6) AS support FROM k GROUP BY ALL""")
def U6_split_support(spark, sf_dir):
    """Five trees of all customers, by remainders and ranges of their keys, and in how many of them each bipartition occurs."""
    # Keys are dealt out before trees are made of them, so that no task holds all nodes of a file's customers.
    keys = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.expr("c_custkey div 100").alias("block")).repartition("block").distinct()
    keys = keys.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("grp"), "key")
    x, y = F.expr("key % (2 + grp % 3)"), F.expr("key div 100")
    named = keys.select("grp", F.concat(F.lit("t"), "key").alias("tip"), F.concat(F.lit("x"), x).alias("x"), F.concat(F.lit("y"), x, F.lit("-"), y).alias("y"))
    edge = lambda node, parent, name: named.select("grp", node.alias("node"), parent.alias("parent"), name.cast("string").alias("name"), F.lit(1.0).alias("length"))
    rows = edge(F.col("tip"), F.col("y"), F.col("tip")).unionByName(edge(F.col("y"), F.col("x"), F.lit(None)).distinct()).unionByName(edge(F.col("x"), F.lit("root"), F.lit(None)).distinct())
    rows = written(rows.unionByName(edge(F.lit("root"), F.lit(None).cast("string"), F.lit(None)).distinct()), "edges")
    return rounded(edges.split_support(rows).groupBy("size", "trees").agg(F.count("*").alias("splits"), F.avg("support").alias("support")))


#: Up to which difference of prices neighbouring lines of orders link their parts.
_HEIGHT = 200.0


@query(f"""WITH RECURSIVE l AS (SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, abs(l_extendedprice::DOUBLE - lead(l_extendedprice::DOUBLE) OVER w) AS dist FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
    p AS (SELECT a, b, dist FROM l WHERE b IS NOT NULL), n AS (SELECT a AS name FROM p UNION SELECT b FROM p), e AS (SELECT a, b FROM p WHERE dist <= {_HEIGHT} UNION SELECT b, a FROM p WHERE dist <= {_HEIGHT}),
    r AS (SELECT name, name AS cluster FROM n UNION SELECT e.b, r.cluster FROM r JOIN e ON e.a = r.name WHERE r.cluster < e.b) SELECT name, min(cluster) AS cluster FROM r GROUP BY name""")
def C3_single_linkage(spark, sf_dir):
    """Parts that orders have next to each other, linked where their prices differ little."""
    order = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    price = F.col("l_extendedprice").cast("double")
    rows = A.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), F.abs(price - F.lead(price).over(order)).alias("dist"))
    return forest.single_linkage(rows.where("b is not null"), height=_HEIGHT)


@query(f"""WITH {A.PANEL} SELECT name || '.1' AS accession, CASE WHEN CAST(substr(name, 4) AS BIGINT) % 2 = 0 THEN 0 ELSE 1 END::INT AS place, name || '.1.fasta' AS path, length(seq)::BIGINT AS length, sha256(seq) AS sha256 FROM p""")
def S19_stage_inputs(spark, sf_dir):
    """Benchmark items staged by accession from two places, the first of which has every second one, with versions."""
    items = A.panel(spark, sf_dir)
    even = F.substring("name", 4, 20).cast("bigint") % 2 == 0
    first = items.where(even).select(F.concat("name", F.lit(".1")).alias("name"), "seq", F.lit(0).alias("place"))
    records = first.unionByName(items.select("name", "seq", F.lit(1).alias("place")))
    return staging.stage(items.select(F.concat("name", F.lit(".1")).alias("accession")), records, new_dir(spark, "staged"))


@query()
def C4_landmark_scaling(spark, sf_dir):
    """All embeddings on two axes, by Euclidean distances to a panel of 200."""
    return rounded(landmarks.landmark_scaling(A.points(spark, sf_dir).select(F.col("id").alias("name"), "vec")))
