"""Scalar text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawloom import config

DASHES = "‐‑‒–—"
EDGE_MARKS = ".,;:()[]{}<>\"'"
SPACE = r"(?U)\s+"
#: Words of a file name that say nothing about its content.
NOISE_TOKENS = "rev revision version ver copy final latest new old before after issue".split()
REVISION = r"(?i)(?:^|[\s._-])rev(?:ision)?[\s._-]*([a-z0-9]+)(?:$|[\s._-])"
VERSION = r"(?i)(?:^|[\s._-])v(?:er(?:sion)?)?[\s._-]*([0-9]+)(?:$|[\s._-])"
DATE = r"(?:(20[0-9]{2})[-_]?([01][0-9])[-_]?([0-3][0-9])|([01]?[0-9])[-_]([0-3]?[0-9])[-_](20[0-9]{2}|[0-9]{2}))"


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_token(c: Column) -> Column:
    """Upper case, plain dashes, single blanks, no punctuation at the ends; null is empty."""
    up = F.upper(F.coalesce(c.cast("string"), F.lit("")))
    plain = F.translate(up, DASHES + " \t", "-" * len(DASHES) + "  ")
    return F.trim(squeeze(plain), F.lit(EDGE_MARKS))


def normalize_text(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def compact(c: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "")


def normalized_cell(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def strip_pipe_size(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), rf'^\s*(?:{config.SIZE})\s*"?\s*-\s*', "")
    return F.trim(F.trim(F.trim(bare), F.lit('"')))


def normalize_pipe_size(c: Column) -> Column:
    bare = F.translate(F.trim(F.trim(F.coalesce(c, F.lit(""))), F.lit('"')), " ", " ")
    return squeeze(F.regexp_replace(bare, r"\s*/\s*", "/"))


def alpha_prefix(c: Column) -> Column:
    return F.regexp_extract(c, "^([A-Z]+)", 1)


def sheet_id_in(c: Column) -> Column:
    """The DT#### id in a file name, or null."""
    found = F.upper(F.regexp_extract(c, r"(?i)\b(DT[0-9]{4})\b", 1))
    return F.when(found != "", found)


def normalize_sheet_id(c: Column) -> Column:
    token = normalize_token(c)
    file = F.regexp_extract(token, config.DWG_FILE, 1)
    plain = F.regexp_extract(token, r"\b([A-Z]{1,6}[0-9]{3,7}[A-Z]?)\b", 1)
    return F.when(file != "", F.upper(file)).when(plain != "", plain).otherwise(token)


def tokenize(c: Column) -> Column:
    """Lower-case letter and digit runs without the noise words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(NOISE_TOKENS))


def strip_version_tokens(c: Column) -> Column:
    for pattern in (REVISION, VERSION, DATE):
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(F.regexp_replace(c, r"[_\-.]+", " "))


def clean_sheet_title(stem: Column, sheet_id: Column) -> Column:
    """A file stem without its sheet id, revision, version and date."""
    where = F.instr(F.upper(stem), F.coalesce(F.upper(sheet_id), F.lit("")))
    cut = F.concat(
        F.substring(stem, F.lit(1), where - 1), F.lit(" "), F.substring(stem, where + F.length(sheet_id), F.length(stem))
    )
    c = F.when((F.length(sheet_id) > 0) & (where > 0), cut).otherwise(stem)
    for pattern in (REVISION, VERSION, DATE):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(squeeze(F.regexp_replace(c, r"[_\-]+", " ")), F.lit(" ,.-"))


def date_hints(c: Column) -> Column:
    """ISO dates written year first, or month first with a year of two or four digits."""
    parts = [F.regexp_extract_all(c, F.lit(DATE), F.lit(i)) for i in range(1, 7)]

    def iso(x: Column) -> Column:
        first = x["0"] != ""
        year = F.when(first, x["0"]).when(F.length(x["5"]) == 2, F.concat(F.lit("20"), x["5"])).otherwise(x["5"])
        month, day = (F.lpad(F.when(first, x[a]).otherwise(x[b]), 2, "0") for a, b in (("1", "3"), ("2", "4")))
        return F.concat_ws("-", year, month, day)

    return F.transform(F.arrays_zip(*[p.alias(str(i)) for i, p in enumerate(parts)]), iso)


def revision_value(c: Column) -> Column:
    """Digits as a number, one letter as its place in the alphabet, else null."""
    v = F.lower(F.trim(c))
    letter = F.when(v.rlike("^[a-z]$"), F.ascii(v) - 96)
    return F.coalesce(F.when(v.rlike("^[0-9]+$"), v).try_cast("double"), letter.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 when either side is empty."""
    both = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def hamming_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two hexadecimal hashes of 16 digits; 0 when either is missing."""

    def differing(start: int) -> Column:
        x, y = (F.conv(F.substring(c, start, 8), 16, 10).cast("bigint") for c in (a, b))
        return F.bit_count(x.bitwiseXOR(y))

    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, F.lit(0.0)).otherwise(1 - (differing(1) + differing(9)) / 64)


def row_key(cells: Column, text: Column) -> Column:
    """Twelve digits of the SHA-1 of the first three cells."""
    seed = F.when(F.size(cells) > 0, F.array_join(F.slice(cells, 1, 3), "|")).otherwise(text)
    return F.substring(F.sha1(F.encode(normalize_text(seed), "UTF-8")), 1, 12)


def preview_lines(c: Column, limit: int = 6) -> Column:
    """The first distinct lines of 4 to 120 characters."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), squeeze)
    return F.slice(F.array_distinct(F.filter(lines, lambda x: F.length(x).between(4, 120))), 1, limit)


def safe_cell(c: Column) -> Column:
    """Without control characters, at most 32767 characters."""
    return F.substring(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, 32767)


def safe_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))


def sorted_json(c: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
