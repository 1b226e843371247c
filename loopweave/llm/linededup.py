"""Removal of repeated and nearly repeated lines, in DataFrame functions only.

Lines are compared by edit distance with a segment-partition join (Pass-Join,
Li et al., 2011).  With a threshold of t edits, t + 1 segments are cut from a
line; a line within t edits of it holds one of them unchanged and near the place
where it was.  The segments' width follows from the line's length class, so that
lines of like length meet: each line is posted under its own segments and looked
up by those of its substrings that a shift by t edits allows.  A posting of more
than FEW lines is cut further: what stands left and right of the segment has t
edits between both, so it is cut into segments in turn, until postings are short
or nothing is left to cut.  Lines that merely share a passage thus part before
they meet in pairs.  Pairs that meet are verified by a bit-parallel edit
distance (Hyyro, 2003) on a band of 2t + 1 diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.sieve import sieved
from loopweave.llm.storage import materialize

#: Lines with fewer characters are left alone.
LEAST_CHARS = 20
#: Edits that two lines may be apart, and the characters a line needs for each of them.
EDITS, CHARS_PER_EDIT = 2, 20
#: Lines of a posting that are compared with each other at once; longer postings are cut further.
FEW = 128
#: Pairs of a posting that one task may compare where few are left.
AT_ONCE = 1 << 22
#: Letters whose counts are compared before lines are: common ones in many languages.
LETTERS = "eaintorshludcm "
#: Segments of a pair's longer line that are looked for in the other one before their distance is worked out.
SEGMENTS = 12
#: Parts by whose multiples lines' common beginnings and ends are measured.
SLICES = 48
#: A row's number, a line's place in it and bits of the text's hash make one number: (row * PLACES + place) * TIES + bits.
PLACES, TIES = 1 << 31, 1 << 30
#: The number of a row without an id is its text's hash and this: beyond all ids.
NO_ID = 1 << 64


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(doc, text_hash, place, pos, line, n)`` for each line that may be removed, ``n`` being its length.

    ``text_hash`` tells rows with the same ``doc_id`` apart.  By ``place`` rows
    without an id come after all others, in the order of their texts' hashes;
    lines at one place of rows that share an id come in the order of theirs.
    """
    texts = F.xxhash64("text").cast("decimal(21,0)")
    row = F.coalesce(F.col("doc_id").cast("decimal(21,0)"), texts + F.expr(f"cast({NO_ID}BD AS decimal(21,0))")).cast("decimal(21,0)")
    base = row * F.lit(PLACES * TIES).cast("decimal(19,0)") + F.pmod(F.xxhash64("text"), F.lit(TIES)).cast("decimal(19,0)")
    rows = docs.select(*_row_of(docs), base.cast("decimal(38,0)").alias("base"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("n", F.length("line")).where(F.col("n") >= least_chars)
    place = F.col("base") + (F.col("pos").cast("long") * TIES).cast("decimal(19,0)")
    return rows.select("doc", "text_hash", place.cast("decimal(38,0)").alias("place"), "pos", "line", "n")


def _row_of(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash")]


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["text_hash"] == b["text_hash"])


def pieces(edits: int) -> list[tuple[int, int]]:
    """``(segment, shift)`` of what a line is posted under and looked up by; segment -1 ends with the line.

    If the segments before the i-th hold an edit each, and those after it too,
    at most min(i, t - i) edits can have moved it.
    """
    return [(0, 0), (-1, 0)] + [(i, shift) for i in range(1, edits) for shift in range(-min(i, edits - i), min(i, edits - i) + 1)]


def _start(i: int, shift: int, width: Column, n: Column) -> Column:
    return n - width if i < 0 else width * i + shift


def _fits(i: int, shift: int, budget: Column) -> Column:
    """Whether a rest of so many edits has this segment with this shift."""
    return F.lit(True) if i < 1 else (budget > i) & (budget - i >= abs(shift))


def _class_of(m: Column) -> Column:
    """The smallest length of those that are cut alike."""
    return m - m % F.when(m < 200, 10).otherwise(40)


def _lower_class(n: Column, edits: int) -> Column:
    """The class of lines that are up to ``edits`` shorter, where it is another than the line's own."""
    found = F.lit(None).cast("int")
    for short in range(1, edits + 1):
        found = F.coalesce(found, F.when((_class_of(n - short) < _class_of(n)) & (n - short >= CHARS_PER_EDIT), _class_of(n - short)))
    return found


def keyed_lines(rows: DataFrame, edits: int) -> DataFrame:
    """``rows`` with columns k0, k1, ...: the key of each piece of ``line``, first in its own length class, then in the lower one.

    Null stands for pieces that there aren't.
    """
    budget = lambda c: F.least(F.lit(edits), (F.col(c) / CHARS_PER_EDIT).cast("int"))
    rows = rows.withColumns({"c0": F.when(F.col("n") >= CHARS_PER_EDIT, _class_of(F.col("n"))), "c1": _lower_class(F.col("n"), edits)})
    rows = rows.withColumns({f"t{k}": budget(f"c{k}") for k in range(2)})
    rows = rows.withColumns({f"w{k}": (F.col(f"c{k}") / (F.col(f"t{k}") + 1)).cast("int") for k in range(2)})
    keys = []
    for k in range(2):
        for i, shift in pieces(edits):
            start = _start(i, shift, F.col(f"w{k}"), F.col("n"))
            fits = _fits(i, shift, F.col(f"t{k}")) & (start >= 0) & (start + F.col(f"w{k}") <= F.col("n"))
            keys.append(F.when(fits, F.xxhash64(f"c{k}", F.lit(i), F.substring("line", start + 1, F.col(f"w{k}")))))
    return rows.withColumns({f"k{k}": key for k, key in enumerate(keys)}).drop("c0", "c1", "t0", "t1", "w0", "w1")


def first_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(line, place, doc, text_hash, pos, n, k0, k1, ...)`` of each distinct line: a number, where it stands first, its length and keys.

    Lines are told apart by 128 bits of hash.  The keys go along, so that
    repeated lines are looked up once and no text is moved.
    """
    rows = keyed_lines(lines_of(docs, least_chars), edits)
    keys = [F.max(c).alias(c) for c in rows.columns if c.startswith("k")]
    first = [F.min_by(c, "place").alias(c) for c in ("doc", "text_hash", "pos")]
    found = rows.groupBy(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2")).agg(F.min("place").alias("place"), *first, F.max("n").alias("n"), *keys)
    return materialize(found.drop("id", "id2").withColumn("line", F.monotonically_increasing_id()), "first-lines")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, though ``use`` is a lambda's body or names it often."""
    return F.transform(F.array(value), use)[0]


def band_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two lines whose lengths differ by ``edits`` at most; larger ones come out as more than ``edits``.

    ``a`` is the longer one.  The word's bit k stands for the diagonal k - edits;
    the distance is kept along the diagonal that ends in the table's last cell.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1)
    pad = F.array_repeat(F.lit(""), edits)
    start = F.struct(F.lit((1 << width) - (1 << edits)).alias("vp"), F.lit(0).alias("vn"), (F.length(a) - F.length(b)).alias("d"))

    def row(lines: Column, state: Column, at: Column) -> Column:
        match = F.lit(0)
        for k in range(width):
            match = match + F.when(F.get(lines["a"], at + (k - 1)) == F.get(lines["b"], at - 1), F.lit(1 << k)).otherwise(F.lit(0))
        return _bind(F.struct(match.bitwiseOR(state["vn"]).alias("x"), state.alias("was")), lambda s: _bind(zero_diagonals(s), lambda z: moved(lines, z)))

    def zero_diagonals(s: Column) -> Column:
        x, vp = s["x"], s["was"]["vp"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseAND(full)
        return F.struct(d0.alias("d0"), s["was"].alias("was"))

    def moved(lines: Column, z: Column) -> Column:
        d0, vp, vn = z["d0"], z["was"]["vp"], z["was"]["vn"]
        right = vn.bitwiseOR(full - d0.bitwiseOR(vp))
        down = F.shiftright(d0, 1)
        grown = 1 - F.call_function("shiftright", d0, lines["end"]).bitwiseAND(F.lit(1))
        return F.struct(d0.bitwiseAND(vp).bitwiseOR(full - down.bitwiseOR(right)).alias("vp"), down.bitwiseAND(right).alias("vn"), (z["was"]["d"] + grown).alias("d"))

    chars = F.struct(F.concat(pad, F.split(a, ""), pad).alias("a"), F.split(b, "").alias("b"), (F.length(a) - F.length(b) + edits).alias("end"), start.alias("start"))
    steps = lambda v: F.aggregate(F.sequence(F.lit(1), F.size(v["b"])), v["start"], lambda s, at: row(v, s, at), lambda s: s["d"])
    return _bind(chars, steps)


def _differing(a: Column, b: Column) -> Column:
    """The two lines without what they begin and end with in common, up to a part of SLICES; some of ``b`` is left."""

    def cut(v: Column, whole, rest) -> Column:
        n = F.length(v["b"]) - 1
        sizes = F.transform(F.sequence(F.lit(0), F.lit(SLICES)), lambda i: F.floor(n * i / SLICES).cast("int"))
        return _bind(F.struct(v["a"].alias("a"), v["b"].alias("b"), F.array_max(F.filter(sizes, lambda k: whole(v["a"], k) == whole(v["b"], k))).alias("k")), lambda x: F.struct(rest(x["a"], x["k"]).alias("a"), rest(x["b"], x["k"]).alias("b")))

    head = cut(F.struct(a.alias("a"), b.alias("b")), F.left, lambda c, k: F.substring(c, k + 1, F.length(c)))
    return _bind(head, lambda v: cut(v, F.right, lambda c, k: F.left(c, F.length(c) - k)))


def segments_found(a: Column, b: Column, edits: int, parts: int) -> Column:
    """How many of ``parts`` segments of ``a`` stand in ``b``, moved by ``edits`` characters at most; an edit can spoil one."""
    size = F.length(a)
    found = F.lit(0)
    for i in range(parts):
        start, end = F.floor(size * i / parts).cast("int"), F.floor(size * (i + 1) / parts).cast("int")
        low = F.greatest(F.lit(0), start - edits)
        found = found + F.contains(F.substr(b, low + 1, end + edits - low), F.substr(a, start + 1, end - start)).cast("int")
    return found


def letter_counts(line: Column) -> list[Column]:
    """How often a line has each of LETTERS."""
    return [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x))) for x in LETTERS]


def _apart(a: Column, b: Column) -> Column:
    """How far apart two lines' letter counts are; an edit changes those of one or two letters by one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``line`` of those pairs ``(line, of, limit)`` that are near."""
    pairs = materialize(pairs.distinct(), "line-pairs")
    named = lambda c: texts.select(F.col("line").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(named("line"), "line").join(named("of"), "of")
    longer = F.length("line_text") >= F.length("of_text")
    both = both.select("line", "limit", F.when(longer, F.col("line_text")).otherwise(F.col("of_text")).alias("long"), F.when(longer, F.col("of_text")).otherwise(F.col("line_text")).alias("short"))
    # Segments are looked for first, as that costs little; only then is the distance worked out.
    likely = both.where(segments_found(F.col("long"), F.col("short"), edits, SEGMENTS) >= SEGMENTS - F.col("limit"))
    near = F.transform(F.array(_differing(F.col("long"), F.col("short"))), lambda v: band_distance(v["a"], v["b"], edits))[0] <= F.col("limit")
    return materialize(likely.where(near).select("line").distinct(), "near-lines")


def _rest(start, end, least, budget) -> Column:
    """Part of a line that ``budget`` edits may have changed; on the posted side it has ``least`` characters or more."""
    return F.struct(*(F.lit(x).cast("int").alias(c) if isinstance(x, int) else x.cast("int").alias(c) for c, x in (("a", start), ("b", end), ("least", least), ("budget", budget))))


def _cut(rest: Column, i: int, shift: int) -> tuple[Column, Column, Column]:
    """Start and width of a piece of a rest, and the rests that are left beside it."""
    a, b, least, budget = (rest[c] for c in ("a", "b", "least", "budget"))
    width = F.floor(least / (budget + 1)).cast("int")
    start = a + _start(i, shift, width, b - a)
    right = _rest(start + width, b, least - width * (i + 1), budget - i)
    left = _rest(a, start, width * i, F.lit(i))
    return start, width, F.array(right) if i == 0 else F.array(_rest(a, b - width, least - width, budget)) if i < 0 else F.array(left, right)


def _placed_rests(edits: int) -> Column:
    """The rests of a posted line, by piece, its class ``c`` and each length that the other line may have."""
    made = []
    for k, (i, shift) in enumerate(pieces(edits)):
        for short in range(edits + 1):
            m = F.col("n") - short
            budget = F.least(F.lit(edits), F.floor(F.col("c") / CHARS_PER_EDIT).cast("int"))
            width = F.floor(F.col("c") / (budget + 1)).cast("int")
            start = _start(i, shift, width, F.col("n"))
            right, left = _rest(start + width, F.col("n"), m - width * (i + 1), budget - i), _rest(F.lit(0), start, width * i, F.lit(i))
            rests = F.array(right) if i == 0 else F.array(_rest(F.lit(0), start, m - width, budget)) if i < 0 else F.array(left, right)
            made.append(F.when((F.col("piece") == k) & (_class_of(m) == F.col("c")), F.struct(m.alias("m"), F.lit(short == 0).alias("same"), rests.alias("rests"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _by_length(rows: DataFrame, edits: int) -> DataFrame:
    """Rows of postings parted by the exact length of the posted line."""
    each = rows.select("*", F.explode(_placed_rests(edits)).alias("way"))
    return each.select(F.xxhash64("key", "way.m").alias("key"), "line", (F.col("own") & F.col("way.same")).alias("own"), "place", "n", "counts", F.col("way.rests").alias("rests"))


def _by_rest(rows: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Rows of postings parted by the pieces of the longest rest that can be cut."""
    # How much can be cut is the same for all rows of a posting.
    size = F.transform("rests", lambda r: F.when(r["least"] > r["budget"], r["least"]).otherwise(0))
    at = F.array_position(size, F.array_max(size)).cast("int")
    rows = rows.join(texts.select("line", "text"), "line").withColumn("at", at).withColumn("cut", F.get("rests", F.col("at") - 1))
    others = F.filter("rests", lambda r, k: k != F.col("at") - 1)
    made = []
    for i, shift in pieces(edits):
        start, width, rests = _cut(F.col("cut"), i, shift)
        there = _fits(i, shift, F.col("cut.budget")) & (width > 0) & (start >= F.col("cut.a")) & (start + width <= F.col("cut.b"))
        key = F.xxhash64("key", F.lit(i), F.substring(F.col("text"), start + 1, width))
        made.append(F.when(there, F.struct(key.alias("key"), F.lit(shift == 0).alias("same"), F.concat(rests, others).alias("rests"))))
    each = rows.select("*", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("way"))
    return each.select("way.key", "line", (F.col("own") & F.col("way.same")).alias("own"), "place", "n", "counts", "way.rests")


def _shared(rows: DataFrame) -> DataFrame:
    """``key`` of postings that two lines at least have, one of which is posted there."""
    return rows.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("own").alias("own")).where("low <> high and own").select("key")


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, few: int = FEW) -> DataFrame:
    """``line`` of distinct lines that are near an earlier one.

    Two lines are near if their distance is at most ``edits`` and at most one for
    each CHARS_PER_EDIT characters of the shorter one.  The members of a short
    posting are compared with each other, those of a longer one with its earliest
    line; that settles the lines of a large family with as many pairs as it has
    lines.  Postings that still hold unsettled lines are then cut further, unless
    these and the lines they stand with make no more pairs than short postings
    may: then they are compared, as a round of cutting costs more than that.
    """
    ways = pieces(edits)
    each = [F.struct(F.col(f"k{k}").alias("key"), F.lit(k % len(ways)).alias("piece"), F.lit(k < len(ways)).alias("mine")) for k in range(2 * len(ways))]
    own = F.col("mine") & F.col("piece").isin([k for k, (_, shift) in enumerate(ways) if shift == 0])
    keyed = firsts.select("line", F.explode(F.array(*each)).alias("way")).select("line", "way.*").where("key is not null")
    met = materialize(_shared(keyed.withColumn("own", own)), "met-keys")
    posted = materialize(sieved(keyed, ["key"], met).join(met, "key"), "postings")
    some = posted.select("line").distinct()
    lines = materialize(sieved(firsts.drop(*(c for c in firsts.columns if c.startswith("k"))), ["line"], some).join(some, "line"), "met-lines")
    texts = line_texts(docs, lines)
    mine = F.when(F.col("mine"), _class_of(F.col("n"))).otherwise(_lower_class(F.col("n"), edits))
    rows = posted.join(lines.select("line", "place", "n"), "line").join(texts.select("line", "counts"), "line").withColumns({"own": own, "c": mine})
    rows = materialize(rows, "placed")
    most = few * rows.count()
    final, settled = F.lit(False), None

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.select("key", *(F.col(c).alias(f"l_{c}") for c in ("line", "own", "place", "n", "counts")))
        right = right.select("key", "line", "own", "place", "n", "counts")
        limit = F.least(F.lit(edits), F.floor(F.least("n", "l_n") / CHARS_PER_EDIT)).cast("int")
        after = (F.col("l_place") > F.col("place")) | ((F.col("l_place") == F.col("place")) & (F.col("l_line") > F.col("line")))
        fit = (F.col("own") | F.col("l_own")) & after & (F.abs(F.col("n") - F.col("l_n")) <= limit)
        met = left.join(right, (left["key"] == right["key"]) & fit & (_apart(F.col("counts"), F.col("l_counts")) <= 2 * limit))
        return _verified(met.select(F.col("l_line").alias("line"), F.col("line").alias("of"), limit.alias("limit")), texts, edits)

    while True:
        one = F.struct("place", "line")
        stats = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(one).alias("any"), F.min(F.when(F.col("own"), one)).alias("posted"), F.max(final).alias("final"))
        stats = materialize(stats, "posting-sizes")
        whole = F.col("final") | (F.col("size") <= few)
        found = compared(rows, rows.join(stats, "key").where(whole | F.col("line").isin(F.col("any.line"), F.col("posted.line"))))
        settled = found if settled is None else settled.unionByName(found)
        # Further only with postings that hold a line which is near none yet.
        left_over = rows.join(stats.where(~whole), "key").join(settled.distinct().withColumn("done", F.lit(True)), "line", "left")
        open_ = left_over.where(F.col("done").isNull() & (F.col("line") != F.col("any.line"))).groupBy("key").agg((F.count("*") * F.first("size")).alias("pairs"))
        deeper = materialize(left_over.join(open_, "key").select(*rows.columns, "done", "size", "pairs"), "open-postings")
        pairs = deeper.agg(F.sum(F.col("pairs") / F.col("size"))).first()[0]
        if pairs is None:
            return settled.distinct()
        if pairs <= most:
            few_pairs = F.col("pairs") <= AT_ONCE
            settled = settled.unionByName(compared(deeper.where(few_pairs & F.col("done").isNull()), deeper.where(few_pairs)))
            deeper = deeper.where(~few_pairs)
            if deeper.isEmpty():
                return settled.distinct()
        deeper = deeper.select(rows.columns)
        deeper = _by_length(deeper, edits) if "rests" not in rows.columns else _by_rest(deeper, texts, edits)
        deeper = materialize(deeper, "cut-postings")
        rows = materialize(deeper.join(_shared(deeper), "key"), "cut-postings")
        if rows.isEmpty():
            return settled.distinct()
        final = ~F.exists("rests", lambda r: r["least"] > r["budget"])


def line_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(line, text, counts)`` of ``lines``, taken from where they stand first."""
    # Written first, so that its size is known when the join with the texts is planned.
    wanted = materialize(lines.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("line", "pos")).alias("wanted")), "wanted-lines")
    rows = sieved(docs.select(*_row_of(docs), "text"), ["doc", "text_hash"], wanted)
    rows = rows.join(wanted, _same_row(rows, wanted))
    parts = F.struct(F.split("text", "\n").alias("lines"), F.col("wanted"))
    each = rows.select(F.explode(_bind(parts, lambda v: F.transform(v["wanted"], lambda w: F.struct(w["line"].alias("line"), F.get(v["lines"], w["pos"]).alias("text"))))).alias("x"))
    return materialize(each.select("x.*", F.array(*letter_counts(F.col("x.text"))).alias("counts")).dropDuplicates(["line"]), "line-texts")


def kept_places(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, few: int = FEW) -> DataFrame:
    """``(doc, text_hash, kept)``: the places of those of a document's lines that stand nowhere before."""
    firsts = first_lines(docs, edits, least_chars)
    stay = firsts.join(near_lines(docs, firsts, edits, few), "line", "left_anti")
    return stay.groupBy("doc", "text_hash").agg(F.collect_list("pos").alias("kept"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, few: int = FEW) -> DataFrame:
    """``docs`` with ``text`` rid of lines that stand before, and ``n_chars`` of what is left.

    A line of ``least_chars`` characters or more goes if it, or one within the
    threshold of it, stands earlier: in a document with a smaller ``doc_id``, or
    higher up in this one.  Shorter lines stay.  All rows stay, with an empty
    text if all lines go; a null text stays null.  Rows without an id come last,
    in the order of their texts' hashes.  Of lines at one place of rows that share
    an id but not the text, that of the smaller hash stands first; rows repeated
    with their id and text are treated alike.  Other columns are kept as they
    are, whatever their names.  ``doc_id`` must hold integers.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("doc_id must hold integers")
    kept = kept_places(docs.select("doc_id", "text"), edits, least_chars, few)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row_of(docs))
    rows = rows.join(kept, _same_row(rows, kept), "left")
    parts = F.struct(F.split("row.text", "\n").alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))

    def left(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(v["lines"]) - 1)
        short = F.filter(places, lambda i: F.length(F.get(v["lines"], i)) < least_chars)
        return F.array_join(F.transform(F.array_sort(F.concat(short, v["kept"])), lambda i: F.get(v["lines"], i)), "\n")

    rows = rows.select("row", F.when(F.col("row.text").isNotNull(), _bind(parts, left)).alias("left"))
    text = F.col("left")
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(doc_id, n_lines, n_kept, kept_chars, kept_md5)``, a row for each row of ``docs``.

    Null texts have no lines; what is kept of others is given by its length and
    MD5.  See :func:`dedup_lines` for which lines go.
    """
    lines = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"))) + 1
    done = dedup_lines(docs.select("doc_id", "text", lines(F.col("text")).alias("before")), edits)
    text = F.coalesce(F.col("text"), F.lit(""))
    return done.select(
        "doc_id",
        F.coalesce("before", F.lit(0)).cast("long").alias("n_lines"),
        F.when(text == "", 0).otherwise(lines(text)).cast("long").alias("n_kept"),
        F.length(text).cast("long").alias("kept_chars"),
        F.md5(text.cast("binary")).alias("kept_md5"),
    )
