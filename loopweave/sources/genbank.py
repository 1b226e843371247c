"""Parsing of the GenBank flat-file format, a record at a time."""

from __future__ import annotations

import re

_SPAN = re.compile(r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?")
_QUALIFIER = re.compile(r'/(\w+)(?:=(?:"((?:[^"]|"")*)"|(\S+)))?', re.S)


def parse_location(text: str) -> tuple[int, list[dict[str, int]]]:
    """Strand and parts (0-based, ends excluded) of a location with ``join``, ``order`` and ``complement``."""
    strand = -1 if "complement" in text else 1
    parts = [{"start": int(a) - 1, "end": int(b or a)} for a, b in _SPAN.findall(re.sub(r"\w+\.\d+:", "", text))]
    return strand, parts


def _features(block: str) -> list[dict]:
    out = []
    for part in re.split(r"\n(?= {5}\S)", "\n" + block)[1:]:
        lines = part.split("\n")
        kind = lines[0][5:21].strip()
        body = [lines[0][21:].strip(), *(x[21:].strip() for x in lines[1:])]
        cut = next((i for i, x in enumerate(body) if x.startswith("/")), len(body))
        strand, parts = parse_location("".join(body[:cut]))
        found: dict[str, list[str]] = {}
        for key, quoted, plain in _QUALIFIER.findall("\n".join(body[cut:])):
            value = (quoted or plain).replace('""', '"').replace("\n", "" if key == "translation" else " ")
            found.setdefault(key, []).append(value)
        out.append({"type": kind, "strand": strand, "parts": parts, "qualifiers": found})
    return out


def _field(record: str, name: str) -> str:
    m = re.search(rf"^ *{name}\s+(.*(?:\n {{12}}.*)*)", record, re.M)
    return re.sub(r"\s*\n\s+", " ", m[1]).strip() if m else ""


def parse_records(text: str) -> list[dict]:
    """The records of a GenBank file."""
    out = []
    for record in re.split(r"^//\s*$", text or "", flags=re.M):
        if not re.search(r"^LOCUS\b", record, re.M):
            continue
        locus = _field(record, "LOCUS")
        head, _, tail = record.partition("\nFEATURES")
        features, _, origin = tail.partition("\nORIGIN")
        version = _field(head, "VERSION").split()[:1]
        accessions = _field(head, "ACCESSION").split()
        out.append(
            {
                "id": (version or accessions or locus.split()[:1] or [""])[0],
                "name": locus.split()[0] if locus else "",
                "description": _field(head, "DEFINITION").rstrip("."),
                "organism": _field(head, "ORGANISM").split(" Viruses")[0].split(";")[0].strip(),
                "topology": "circular" if re.search(r"\bcircular\b", locus) else "linear" if re.search(r"\blinear\b", locus) else "",
                "accessions": accessions,
                "seq": re.sub(r"[^A-Za-z]", "", origin).upper(),
                "features": _features(features.partition("\n")[2]),
            }
        )
    return out


def format_record(row: dict, width: int = 60) -> str:
    """A record of the flat-file format from ``name`` and ``seq`` and, where the row has them, RECORD's other fields.

    ``parse_records`` reads the same fields back, if texts are single lines
    without ends or runs of white space.
    """
    seq, get = row["seq"] or "", lambda k: row.get(k) or ""
    lines = [f"LOCUS       {row['name'] or '':<16} {len(seq):>11} bp    DNA     {get('topology') or 'linear'}"]
    if get("description"):
        lines.append(f"DEFINITION  {get('description')}.")
    if get("accessions"):
        lines.append(f"ACCESSION   {' '.join(row['accessions'])}")
    if get("id"):
        lines.append(f"VERSION     {get('id')}")
    if get("organism"):
        lines.append(f"  ORGANISM  {get('organism')}")
    lines.append("FEATURES             Location/Qualifiers")
    for f in get("features") or []:
        spans = ",".join(f"{p['start'] + 1}..{p['end']}" for p in f["parts"])
        spans = f"join({spans})" if len(f["parts"]) > 1 else spans
        lines.append(f"     {f['type']:<16}{f'complement({spans})' if f['strand'] < 0 else spans}")
        quoted = [(k, v.replace('"', '""')) for k, values in (f["qualifiers"].items() if hasattr(f["qualifiers"], "items") else f["qualifiers"]) for v in values]
        lines += [f'                     /{k}="{v}"' for k, v in quoted]
    lines.append("ORIGIN")
    lower = seq.lower()
    for i in range(0, len(lower), 60):
        lines.append(f"{i + 1:>9} " + " ".join(lower[j : j + 10] for j in range(i, min(i + 60, len(lower)), 10)))
    return "\n".join([*lines, "//"]) + "\n"
