"""Route, district, alert and mode codes as column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Route prefix -> area, the longer prefixes first.
AREA_BY_PREFIX = [
    ("^SIM", "Staten Island"),
    ("^BXM", "Bronx"),
    ("^QM", "Queens"),
    ("^BM", "Brooklyn"),
    ("^BX", "Bronx"),
    ("^M[0-9]", "Manhattan"),
    ("^X[0-9]", "Manhattan"),
    ("^B[0-9]", "Brooklyn"),
    ("^Q[0-9]", "Queens"),
    ("^S[0-9]", "Staten Island"),
]
AREA_OTHER = "Other/MTA Bus Co."

# Alert effect code -> severity tier.
SEVERITY_BY_EFFECT = {
    1: "high", 2: "high", 3: "high",
    4: "medium", 6: "medium", 9: "medium",
    5: "low", 7: "low", 8: "low", 10: "low", 11: "low",
}

# District prefixes.
DISTRICT_BY_NAME = {"MANHATTAN": "MN", "BRONX": "BX", "BROOKLYN": "BK", "QUEENS": "QN", "STATEN ISLAND": "SI"}
DISTRICT_BY_DIGIT = {"1": "MN", "2": "BX", "3": "BK", "4": "QN", "5": "SI"}
DIGIT_BY_LETTER = {"M": "1", "X": "2", "K": "3", "Q": "4", "S": "5"}

# Count-table row label -> travel mode, first match wins.
MODE_BY_PATTERN = [
    (r"(?i)^\s*subway", "subway"),
    (r"(?i)auto", "auto"),
    (r"(?i)^\s*bus\b", "bus"),
    (r"(?i)rail", "rail"),
    (r"(?i)ferry", "ferry"),
    (r"(?i)bicycl", "bike"),
    (r"(?i)tram", "tram"),
]

# Display order of the lines on a status strip.
LINE_ORDER = ["1", "2", "3", "4", "5", "6", "7", "A", "C", "E", "B", "D", "F", "M",
              "G", "J", "Z", "L", "N", "Q", "R", "W", "S", "SI"]


def first_match(col: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first pattern that matches."""
    out = None
    for pattern, label in rules:
        hit = col.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(otherwise))


def lookup(col: Column, table: dict) -> Column:
    """Value of a small constant map, NULL where the key is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def borough_from_route(col: Column) -> Column:
    return F.when(col.isNotNull(), first_match(F.upper(col), AREA_BY_PREFIX, AREA_OTHER)).otherwise(AREA_OTHER)


def route_norm(col: Column) -> Column:
    """Route name without the premium suffix and punctuation, in capitals."""
    return F.upper(F.regexp_replace(F.regexp_replace(col, "-SBS", ""), "[^A-Za-z0-9]", ""))


def is_sbs(route_id: Column, name: Column) -> Column:
    return F.coalesce(route_id.endswith("+"), F.lit(False)) | F.coalesce(F.upper(name).contains("SBS"), F.lit(False))


def alert_severity(effect: Column) -> Column:
    return F.coalesce(lookup(F.coalesce(effect.cast("int"), F.lit(8)), SEVERITY_BY_EFFECT), F.lit("low"))


def district_code(board: Column) -> Column:
    """'01 QUEENS' -> 'QN01'."""
    number = F.regexp_extract(board, r"^(\d+)\s+(.*)$", 1)
    name = F.upper(F.trim(F.regexp_extract(board, r"^(\d+)\s+(.*)$", 2)))
    return F.concat(lookup(name, DISTRICT_BY_NAME), F.when(number != "", F.lpad(number, 2, "0")))


def district_from_street_code(code: Column, contract: Column, cb: Column) -> Column:
    """First digit 1-5 of the street code, else the contract's borough letter; plus the board number."""
    digit = F.substring(code, 1, 1)
    digit = F.when(digit.isin(*DISTRICT_BY_DIGIT), digit)
    letter = F.regexp_extract(contract, r"([MXKQS])(?:CO)?$", 1)
    digit = F.coalesce(digit, lookup(letter, DIGIT_BY_LETTER))
    number = F.regexp_extract(cb, r"(\d+)", 1)
    return F.concat(lookup(digit, DISTRICT_BY_DIGIT), F.when(number != "", F.lpad(number, 2, "0")))


def mode_bucket(label: Column) -> Column:
    return first_match(label, MODE_BY_PATTERN)


def first_count(cells: Column) -> Column:
    """Whole number in the first non-empty cell; '-' and blanks count as 0."""
    cell = F.get(F.filter(cells, lambda c: F.trim(c) != ""), 0)
    text = F.regexp_replace(F.trim(F.coalesce(cell, F.lit(""))), ",", "")
    return F.coalesce(F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def bbl(boro: Column, block: Column, lot: Column) -> Column:
    """Ten-digit lot key."""
    return F.concat(boro, F.lpad(block, 5, "0"), F.lpad(lot, 4, "0"))


def _character(code: Column) -> Column:
    """The character of a numeric reference, by the rules of HTML: Windows-1252 for 128 to 159, nothing for control codes and
    non-characters, U+FFFD for what no character can be."""
    western = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
    control = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code % 65536 >= 0xFFFE)
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(code.between(0x80, 0x9F), F.element_at(F.array(*[F.lit(v) for v in western.values()]), F.greatest(F.lit(1), F.least(F.lit(32), code - 127)).cast("int")))
        .when(control, "")
        .otherwise(text)
    )


def clean_text(col: Column) -> Column:
    """Decode the HTML entities left in feed text, once; NULL becomes ''.

    Column expressions only: the text is cut at its ampersands and each piece begins with a reference or not.  Names are those of
    HTML 5; the old ones among them count without a semicolon too, the longest that fits.
    """
    strict = F.create_map(*[F.lit(x) for k, v in html5.items() if k.endswith(";") for x in (k, v)])
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    loose = F.create_map(*[F.lit(x) for kv in old.items() for x in kv])
    lengths = sorted({len(k) for k in old}, reverse=True)

    def decoded(piece):
        digits, hexes = F.regexp_extract(piece, "^#0*([0-9]+)", 1), F.regexp_extract(piece, "^#[xX]0*([0-9a-fA-F]+)", 1)
        # longer numbers than these are beyond all characters
        number = F.when(F.length(digits).between(1, 9), digits.try_cast("long")).when(F.length(hexes).between(1, 7), F.conv(hexes, 16, 10).try_cast("long"))
        name = F.regexp_extract(piece, "^[^\\t\\n\\f <&#;]{1,31};", 0)
        begins = F.coalesce(*[F.when(F.try_element_at(loose, F.substring(piece, 1, n)).isNotNull() & (F.length(piece) >= n), F.substring(piece, 1, n)) for n in lengths])
        known = F.try_element_at(strict, name)
        return (
            F.when(piece.rlike("^#([0-9]|[xX][0-9a-fA-F])"), F.concat(_character(number), F.regexp_replace(piece, "^#([xX][0-9a-fA-F]+|[0-9]+);?", "")))
            .when(known.isNotNull(), F.concat(known, F.substr(piece, F.length(name) + 1)))
            .when(begins.isNotNull(), F.concat(F.try_element_at(loose, begins), F.substr(piece, F.length(begins) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(F.coalesce(col, F.lit("")), "&")
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.concat(pieces[0], F.array_join(F.transform(rest, decoded), ""))


def null_sentinel(col: Column, bad: Column) -> Column:
    return F.when(~F.coalesce(bad, F.lit(False)), col)
