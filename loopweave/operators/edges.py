"""Trees as edge tables ``(grp, node, parent, name, length)``, a row for each node; a root's parent is null.

Nothing here holds a tree in one task: path lengths come from pointer doubling,
in as many rounds as the depth has binary digits, and what lies below a node
from sums that double their reach in each round.  A round joins and groups by
node; Spark splits the rows of a node with very many children.  Joins by node
are merged, as both sides grow with the table and what is broadcast is built in
the driver; only those by tree are left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.sources.places import written

#: Quoted labels, comments, marks and plain labels of tree texts.
TOKENS = r"'(?:[^']|'')*'|\[[^\]]*\]|[(),;:]|[^\s(),;:'\[\]]+"
MARKS = ["(", ")", ",", ";", ":"]
#: Characters of tree texts that a task is to have.
TASK_CHARS = 1 << 19


def read_newick(texts: DataFrame, text: str = "tree", by: str = "grp") -> DataFrame:
    """The edge table of each tree text; a null text has no nodes, brackets that don't match are an error.

    A tip's ``node`` is its place among the text's tokens, an inner node's that
    of its opening bracket.  An inner node's label is its ``name``; names may be
    quoted, and without one ``name`` is null, as is ``length`` without a number.
    The node around another is the last bracket opened one level further out.
    """
    found = F.filter(F.regexp_extract_all(text, F.lit(TOKENS), 0), lambda x: ~x.startswith("["))
    texts = written(texts.select(F.col(by).alias("grp"), F.col(text).alias(text)), "texts")
    tasks = -(-(texts.agg(F.sum(F.length(text))).first()[0] or 0) // TASK_CHARS)
    # By how much text there is, as tokens take many times its room and stay in one task with those of their tree.
    rows = texts.repartition(max(1, tasks), "grp").select("grp", F.posexplode(found).alias("pos", "tok")).where("tok <> ';'")
    along, all_ = Window.partitionBy("grp").orderBy("pos"), Window.partitionBy("grp")
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    ahead = {f"next{k}": F.lead("tok", k).over(along) for k in (1, 2, 3)}
    rows = rows.withColumns({"depth": F.sum(step).over(along), "sum": F.sum(step).over(all_), "before": F.lag("tok").over(along), **ahead})
    rows = rows.withColumn("depth", F.when((F.col("sum") != 0) | (F.col("depth") < 0), F.raise_error(F.concat(F.lit("brackets don't match in tree "), F.coalesce(F.col("grp").cast("string"), F.lit("null"))))).otherwise(F.col("depth")))
    label = lambda c: c.isNotNull() & ~c.isin(MARKS)
    number = lambda mark, value: F.when(F.col(mark) == ":", F.col(value).cast("double"))
    plain = lambda c: F.when(c.startswith("'"), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))).otherwise(c)
    first = F.coalesce(F.col("before"), F.lit("(")).isin("(", ",")
    tips = rows.where(first & label(F.col("tok"))).select("grp", "pos", F.col("depth").alias("level"), F.col("pos").alias("node"), plain(F.col("tok")).alias("name"), number("next1", "next2").alias("length"))
    # A tip without a name stands between marks; a closing bracket after it closes a node too.
    bare = rows.where(first & F.col("tok").isin(",", ")", ":") & (F.col("before").isNotNull() | (F.col("tok") == ":")))
    tok_depth = F.when(F.col("tok") == ")", F.col("depth") + 1).otherwise(F.col("depth"))
    bare = bare.select("grp", "pos", tok_depth.alias("level"), F.col("pos").alias("node"), F.lit(None).cast("string").alias("name"), F.when(F.col("tok") == ":", F.col("next1").cast("double")).alias("length"))
    inside = F.when(F.col("tok") == ")", F.col("depth") + 1).otherwise(F.col("depth"))
    paired = rows.where(F.col("tok").isin("(", ")")).withColumn("inside", inside)
    paired = paired.withColumn("node", F.lag("pos").over(Window.partitionBy("grp", "inside").orderBy("pos"))).where("tok = ')'")
    named = label(F.col("next1"))
    inner = paired.select(
        "grp", "pos", F.col("depth").alias("level"), "node", F.when(named, plain(F.col("next1"))).alias("name"), F.when(named, number("next2", "next3")).otherwise(number("next1", "next2")).alias("length")
    )
    openers = rows.where("tok = '('").select("grp", "pos", F.col("depth").alias("level"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("length"))
    last = F.last(F.when(F.col("node").isNull(), F.col("pos")), ignorenulls=True).over(Window.partitionBy("grp", "level").orderBy("pos", F.col("node").isNull().desc()))
    placed = tips.unionByName(bare).unionByName(inner).unionByName(openers).withColumn("parent", last)
    return placed.where("node is not null").select("grp", "node", "parent", "name", "length")


def depths(edges: DataFrame) -> DataFrame:
    """``(grp, node, root, dist, hops)``: each node's root, the length of the path to it, and its edges; null lengths are 0.

    A parent that is no node, and edges that go round, are errors.
    """
    anc = edges.select("grp", "node", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("dist"), F.col("parent").isNotNull().cast("long").alias("hops"))
    anc = written(anc.withColumn("root", F.when(F.col("anc").isNull(), F.col("node"))), "depths")
    rounds = anc.count().bit_length() + 1
    while not anc.where("anc is not null").isEmpty():
        if not rounds:
            raise ValueError("edges go round")
        rounds -= 1
        up = anc.select("grp", F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("dist").alias("_dist"), F.col("hops").alias("_hops"), F.col("root").alias("_root"))
        met = anc.where("anc is not null").join(up.hint("merge"), ["grp", "anc"], "left")
        lost = F.when(F.col("_hops").isNull(), F.raise_error(F.concat(F.lit("no node is the parent "), F.col("anc").cast("string")))).otherwise(F.col("_anc"))
        met = met.select("grp", "node", lost.alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_root").alias("root"))
        anc = written(met.unionByName(anc.where("anc is null").select(met.columns)), "depths")
    return anc.select("grp", "node", "root", "dist", "hops")


def below(edges: DataFrame, hops: DataFrame, values: dict[str, tuple[Column, object]]) -> DataFrame:
    """``(grp, node, ...)``: for each node, of each of ``values``, what it aggregates to over the node and all below it.

    ``values`` holds columns of ``edges`` and functions that aggregate a column
    in parts, like ``F.sum`` or ``F.bit_xor``.  After k rounds a node has what
    lies fewer than 2 ** k edges below it, and points 2 ** k edges up.
    """
    cells = list(values)
    rows = edges.select("grp", "node", F.col("parent").alias("anc"), *(v.alias(c) for c, (v, _) in values.items()))
    rows, reach = written(rows.join(hops.select("grp", "node", "hops").hint("merge"), ["grp", "node"]), "below"), 1
    while not rows.where(F.col("hops") >= reach).isEmpty():
        more = rows.where("anc is not null").select("grp", F.col("anc").alias("node"), *cells)
        sums = rows.select("grp", "node", *cells).unionByName(more).groupBy("grp", "node").agg(*(values[c][1](c).alias(c) for c in cells))
        # Only nodes that are deeper have a node so far up.
        up = rows.where(F.col("hops") >= 2 * reach).select("grp", "node", "anc").join(rows.select("grp", F.col("node").alias("anc"), F.col("anc").alias("_anc")).hint("merge"), ["grp", "anc"]).select("grp", "node", F.col("_anc").alias("anc"))
        rows = written(rows.select("grp", "node", "hops").join(sums.hint("merge"), ["grp", "node"]).join(up.hint("merge"), ["grp", "node"], "left").select("grp", "node", "anc", "hops", *cells), "below")
        reach *= 2
    return rows.select("grp", "node", *cells)


def tips(edges: DataFrame) -> DataFrame:
    """The rows of nodes that are no node's parent."""
    return edges.join(edges.select("grp", F.col("parent").alias("node")).where("node is not null").distinct().hint("merge"), ["grp", "node"], "left_anti")


def split_names(edges: DataFrame) -> DataFrame:
    """``(grp, node, split, size)``: a number for the bipartition of tips that each node's edge makes, and its smaller side's size.

    A tip's number is the hash of its name; a side's the XOR of its tips'; the
    two sides of a bipartition XOR to that of all tips, and the lesser of both
    numbers names it, so trees with the same tips agree, wherever their roots
    are.  Edges with fewer than two tips on a side have a null ``split``.
    """
    tip = tips(edges).select("grp", "node", F.xxhash64("name").alias("hash"), F.lit(1).cast("long").alias("one"))
    marked = edges.select("grp", "node", "parent").join(tip.hint("merge"), ["grp", "node"], "left")
    sums = below(marked, depths(edges), {"hash": (F.coalesce("hash", F.lit(0).cast("long")), F.bit_xor), "tips": (F.coalesce("one", F.lit(0).cast("long")), F.sum)})
    whole = sums.join(edges.where("parent is null").select("grp", "node").hint("merge"), ["grp", "node"]).select("grp", F.col("hash").alias("_all"), F.col("tips").alias("_tips"))
    # Written, so that few trees' are known to be small and no tree's rows come together in one task.
    whole = written(whole, "whole")
    size = F.least(F.col("tips"), F.col("_tips") - F.col("tips"))
    name = F.when(size > 1, F.least(F.col("hash"), F.col("hash").bitwiseXOR(F.col("_all"))))
    return sums.join(whole, "grp").select("grp", "node", name.alias("split"), size.alias("size"))


def split_support(edges: DataFrame) -> DataFrame:
    """``(split, size, trees, support)``: in how many of the trees, and in which share of them, each bipartition occurs."""
    n = edges.where("parent is null").select("grp").distinct().count()
    each = split_names(edges).where("split is not null").select("grp", "split", "size").distinct()
    return each.groupBy("split", "size").agg(F.count("*").alias("trees")).withColumn("support", F.col("trees") / F.lit(float(max(1, n))))


def annotated(edges: DataFrame, support: DataFrame) -> DataFrame:
    """``edges`` with ``support``, that of each edge's bipartition in ``(split, support)``; null where that has none."""
    named = split_names(edges).join(support.select("split", "support").hint("merge"), "split", "left").select("grp", "node", "support")
    return edges.join(named.hint("merge"), ["grp", "node"], "left")


def _climb(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """``(grp, node, meet, climb)``: the first of the ``marked`` nodes ``(grp, node)`` at or above each node, and how far up it is."""
    known = edges.join(marked.withColumn("_m", F.lit(True)).hint("merge"), ["grp", "node"], "left")
    stop = F.col("_m").isNotNull() | F.col("parent").isNull()
    anc = known.select("grp", "node", F.when(stop, F.lit(None)).otherwise(F.col("parent")).alias("anc"), F.when(stop, 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("climb"), F.when(F.col("_m").isNotNull(), F.col("node")).alias("meet"))
    anc = written(anc, "climb")
    while not anc.where("anc is not null").isEmpty():
        up = anc.select("grp", F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("climb").alias("_climb"), F.col("meet").alias("_meet"))
        met = anc.where("anc is not null").join(up.hint("merge"), ["grp", "anc"]).select("grp", "node", F.col("_anc").alias("anc"), (F.col("climb") + F.col("_climb")).alias("climb"), F.col("_meet").alias("meet"))
        anc = written(met.unionByName(anc.where("anc is null").select(met.columns)), "climb")
    return anc.select("grp", "node", "meet", "climb")


def _path(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``(grp, node)`` of all nodes from each of ``ends`` ``(grp, node)`` up to the root."""
    on = ends.select("grp", "node", F.lit(1).cast("long").alias("one"))
    marked = edges.select("grp", "node", "parent").join(on.hint("merge"), ["grp", "node"], "left")
    return below(marked, depths(edges), {"ends": (F.coalesce("one", F.lit(0).cast("long")), F.sum)}).where("ends > 0").select("grp", "node")


def farthest_tips(edges: DataFrame) -> DataFrame:
    """``(grp, a, b, meet, a_dist, b_dist)``: each tree's two tips that are farthest apart, where their paths meet, and how far below.

    Two sweeps: the tip farthest from the root is one end of a longest path, the
    tip farthest from that one the other.  Of equal ones the least name counts.
    """
    leaf = tips(edges).select("grp", "node", "name")
    dist = depths(edges)
    best = lambda c: F.min_by(F.struct("node", c), F.struct(-F.col(c), F.col("name"), F.col("node"))).alias("x")
    one = written(leaf.join(dist.hint("merge"), ["grp", "node"]).groupBy("grp").agg(best("dist")).select("grp", F.col("x.node").alias("node"), F.col("x.dist").alias("top")), "end")
    path = written(_path(edges, one), "path")
    met = _climb(edges, path).join(dist.select("grp", F.col("node").alias("meet"), F.col("dist").alias("meet_dist")).hint("merge"), ["grp", "meet"])
    met = met.join(one.select("grp", F.col("node").alias("a"), "top"), "grp").withColumn("a_dist", F.col("top") - F.col("meet_dist"))
    ends = leaf.join(met.hint("merge"), ["grp", "node"]).withColumn("apart", F.col("a_dist") + F.col("climb"))
    far = F.min_by(F.struct("a", F.col("node").alias("b"), "meet", "a_dist", F.col("climb").alias("b_dist")), F.struct(-F.col("apart"), F.col("name"), F.col("node")))
    return ends.groupBy("grp").agg(far.alias("x")).select("grp", "x.*")


def midpoint_root(edges: DataFrame, with_edge: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` rooted half-way between the two tips that are farthest apart.

    The root is a new node, ``-1``, or the node that lies there.  Edges between it
    and the old root turn round, with their lengths and the columns
    ``with_edge``; an old root that would have one child is left out.  A tree
    without lengths, or of one node, stays as it is.
    """
    cells = ["length", *with_edge]
    edges = written(edges, "edges")
    ends = farthest_tips(edges).withColumn("half", (F.col("a_dist") + F.col("b_dist")) / 2).where("half > 0")
    deep = F.col("a_dist") >= F.col("half")
    ends = written(ends.select("grp", F.when(deep, F.col("a")).otherwise(F.col("b")).alias("node"), "half"), "deep-end")
    dist = written(depths(edges).select("grp", "node", "dist"), "dist")
    low = dist.join(ends.hint("merge"), ["grp", "node"]).select("grp", F.col("dist").alias("low"), "half")
    line = _path(edges, ends).join(dist.hint("merge"), ["grp", "node"]).join(low, "grp").withColumn("up", F.col("low") - F.col("dist"))
    # The highest node that isn't beyond the middle, and how much of its edge lies below the middle.
    at = line.where("up <= half").groupBy("grp").agg(F.max_by(F.struct("node", (F.col("half") - F.col("up")).alias("rest")), F.struct("up", -F.col("dist"))).alias("x"))
    at = written(at.select("grp", F.col("x.node").alias("mid"), F.col("x.rest").alias("rest")), "middle")
    # The nodes whose edges turn round: the middle's ancestors, and itself if it becomes the root.
    line = written(_path(edges, at.select("grp", F.col("mid").alias("node"))), "turned")
    own = edges.join(line.withColumn("_on", F.lit(True)).hint("merge"), ["grp", "node"], "left").join(at, "grp", "left")
    own = written(own, "placed")
    becomes, inside = F.col("rest") == 0, F.col("node") == F.col("mid")
    turned = own.where("_on and parent is not null")
    flipped = turned.where(~inside | becomes).select("grp", F.col("parent").alias("node"), F.col("node").alias("_parent"), *(F.col(c).alias(f"_{c}") for c in cells))
    split = turned.where(inside & ~becomes)
    upper = split.select("grp", F.col("parent").alias("node"), F.lit(-1).alias("_parent"), (F.col("length") - F.col("rest")).alias("_length"), *(F.col(c).alias(f"_{c}") for c in with_edge))
    over = flipped.unionByName(upper)
    kept = own.join(over.hint("merge"), ["grp", "node"], "left")
    on = F.coalesce(F.col("_on"), F.lit(False))
    new_parent = F.when(on & inside, F.when(becomes, F.lit(None)).otherwise(F.lit(-1))).when(on, F.col("_parent")).otherwise(F.col("parent"))
    new = {"length": F.when(on & inside, F.when(~becomes, F.col("rest"))).when(on, F.col("_length")).otherwise(F.col("length"))}
    new |= {c: F.when(on & inside, F.when(~becomes, F.col(c))).when(on, F.col(f"_{c}")).otherwise(F.col(c)) for c in with_edge}
    others = [c for c in edges.columns if c not in ("grp", "node", "parent", *cells)]
    rows = kept.select("grp", "node", new_parent.alias("parent"), *others, *(v.alias(c) for c, v in new.items()), F.col("parent").isNull().alias("_root"), F.col("mid").isNotNull().alias("_moved"))
    fresh = split.select("grp", F.lit(-1).alias("node"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), *(F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in (*others, *cells)), F.lit(False).alias("_root"), F.lit(True).alias("_moved"))
    rows = written(rows.unionByName(fresh), "rerooted")
    # An old root with one child is no node any more; its edge is added to the child's.
    kids = rows.groupBy("grp", "parent").agg(F.count("*").alias("kids"))
    gone = rows.where("_root and _moved and parent is not null").join(kids.withColumnRenamed("parent", "node").hint("merge"), ["grp", "node"]).where("kids = 1")
    gone = written(gone.select("grp", F.col("node").alias("parent"), F.col("parent").alias("_above"), F.col("length").alias("_more")), "gone")
    done = rows.join(gone.select("grp", F.col("parent").alias("node")).hint("merge"), ["grp", "node"], "left_anti").join(gone.hint("merge"), ["grp", "parent"], "left")
    longer = F.when(F.col("_above").isNotNull(), F.col("length") + F.coalesce("_more", F.lit(0.0))).otherwise(F.col("length"))
    return done.select("grp", "node", F.coalesce("_above", "parent").alias("parent"), *others, longer.alias("length"), *with_edge).select(*edges.columns)
