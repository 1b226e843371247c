"""Column functions on sequence headers and free text about records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns (of headers, countries, isolates and of the record screen: ENDOGENOUS, FLANKS, ASSEMBLY)
# and weights that the results depend on.
KEYWORDS = ("country", "strain", "isolate", "host", "location", "collected", "isolation", "geo", "region")
DELIMITERS = r"[|;/\[\](){}]"
GENUS_SPECIES = r"\b[A-Z][a-z]{2,}\s+[a-z]{2,}\b"
ACCESSION = r"^[A-Z]{1,4}\d{5,10}(\.\d+)?$"
COUNTRIES = (r"\bGhana\b", r"\bTogo\b", r"\bNigeria\b", r"\bSri\s*Lanka\b", r"\bC[ôo]te\s*d['’]Ivoire\b", r"\bIvory\s*Coast\b", r"\bIvoire\b")
ISOLATES = (r"\bisolate\s+([A-Za-z0-9_-]+)\b", r"\b(GH[A-Za-z0-9-]+)\b", r"\b(Gha[A-Za-z0-9-]+)\b", r"\b(CI[A-Za-z0-9-]+)\b", r"\b(NIG[A-Za-z0-9-]+)\b")
ENDOGENOUS = r"\bendogenous\b|\bintegrated\b|integration|endogenous viral element|\beve\b"
FLANKS = r"host[- ]flank|flanking host|theobroma cacao chromosome|host genomic|genomic scaffold"
ASSEMBLY = r"chromosome|scaffold|whole genome shotgun|genomic contig"
STRONG, SOME = 6, 2


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def header_score(header: Column) -> Column:
    """A struct of what tells that a header is informative, the score and its level."""
    toks = tokens(header)
    first = F.coalesce(F.get(toks, F.lit(0)), F.lit(""))
    extra = F.greatest(F.size(toks) - 1, F.lit(0))
    low = F.lower(header)
    delims = F.rlike(header, F.lit(DELIMITERS)).cast("int")
    words = F.rlike(low, F.lit("|".join(KEYWORDS))).cast("int")
    species = F.rlike(header, F.lit(GENUS_SPECIES)).cast("int")
    accession = F.rlike(first, F.lit(ACCESSION)).cast("int")
    score = extra + 2 * delims + 2 * words + 2 * species + accession
    return F.struct(
        first.alias("id"),
        extra.alias("extra_tokens"),
        accession.alias("accession_like"),
        species.alias("species_like"),
        words.alias("has_keywords"),
        delims.alias("has_delims"),
        score.alias("score"),
        F.when(score >= STRONG, "strong").when(score >= SOME, "some").otherwise("id_only").alias("level"),
    )


def id_candidates(value: Column) -> Column:
    """Ids that a value may stand for, in order: whole, first token, its parts between bars, the last and the first of them."""
    whole = F.trim(value)
    parts = F.filter(F.split(whole, r"\|"), lambda x: x != "")
    barred = F.when(F.contains(whole, F.lit("|")) & (F.size(parts) > 0), F.concat(parts, F.array(F.element_at(parts, -1), F.element_at(parts, 1))))
    found = F.concat(F.array(whole), F.slice(tokens(whole), 1, 1), F.coalesce(barred, F.array().cast("array<string>")))
    kept = F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.coalesce(whole, F.lit("")) != "", kept).otherwise(F.array().cast("array<string>"))


def country(text: Column) -> Column:
    """Countries that a text names, in the order of the patterns, joined by semicolons."""
    hits = F.filter(F.array(*(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i){p}", 0) for p in COUNTRIES)), lambda x: x != "")

    def canonical(hit: Column) -> Column:
        low = F.lower(hit)
        return (
            F.when(F.rlike(low, F.lit("ivoire|ivory")), "Cote d'Ivoire")
            .when(F.rlike(low, F.lit(r"sri\s*lanka")), "Sri Lanka")
            .otherwise(F.initcap(low))
        )

    return F.array_join(F.array_distinct(F.transform(hits, canonical)), ";")


def isolate_tags(text: Column) -> Column:
    """Isolate names in a text, by pattern and then by place, each once, joined by semicolons."""
    hits = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}"), F.lit(1)) for p in ISOLATES)))
    return F.array_join(F.array_distinct(F.filter(F.transform(hits, lambda x: F.trim(x)), lambda x: x != "")), ";")


def tip_to_accession(tip: Column) -> Column:
    """What stands before the first bar, and in that before ``__dup``."""
    return F.split_part(F.split_part(tip, F.lit("|"), F.lit(1)), F.lit("__dup"), F.lit(1))


def strand_sign(value: Column) -> Column:
    """1 or -1 for the ways strands are written; null for others."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    return (
        F.when(text.isin("+", "+1", "1"), 1)
        .when(text.isin("-", "-1"), -1)
        .when(number > 0, 1)
        .when(number < 0, -1)
    )


def truthy(value: Column) -> Column:
    """Whether a cell says yes."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def parse_header_fields(header: Column) -> Column:
    """The map of a header's ``k=v`` parts between bars, after its name and label; of repeated keys the last counts."""
    cells = F.split(header, r"\|")
    parts = F.filter(F.slice(cells, 3, F.greatest(F.size(cells), F.lit(1))), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "(?s)^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def screen_flags(description: Column, organism: Column, text: Column, length: Column, least: int = 6500, most: int = 8000) -> Column:
    """A struct of the record screen's flags and what follows from them."""
    virus = F.contains(F.lower(organism), F.lit("virus"))
    complete = F.contains(F.lower(description), F.lit("complete genome"))
    length_ok = length.between(least, most)
    eve, flank = F.rlike(text, F.lit(f"(?i){ENDOGENOUS}")), F.rlike(text, F.lit(f"(?i){FLANKS}"))
    assembly = F.rlike(text, F.lit(f"(?i){ASSEMBLY}")) & ~virus
    review = eve | flank | assembly | ~length_ok | ~complete | ~virus
    return F.struct(
        complete.alias("complete_genome"),
        length_ok.alias("expected_length"),
        virus.alias("viral_organism"),
        eve.alias("eve_flag"),
        flank.alias("flank_flag"),
        assembly.alias("assembly_flag"),
        F.when(review, "manual review required").otherwise("included complete viral record").alias("inclusion_status"),
    )
