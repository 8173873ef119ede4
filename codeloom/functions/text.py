"""Scalar string, path and hash functions (rows F1-F10, L3, L4, W6, S10, Q24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of a file by its lowered extension.
LANGUAGES = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
CODE_EXTENSIONS = tuple(LANGUAGES)
# Labels and relationship types of the property-graph database export.
EXPORT_LABELS = {"function": "Function", "struct": "Struct", "interface": "Interface", "file": "File", "package": "Package", "concept": "Concept", "observation": "Observation", "workspace": "Workspace"}
EXPORT_RELATIONS = {"calls": "CALLS", "imports": "IMPORTS", "implements": "IMPLEMENTS", "references": "REFERENCES", "related_to": "RELATED_TO", "defines": "DEFINES", "belongs_to": "BELONGS_TO"}


def _case(c: Column, table: dict[str, str], other: Column | str) -> Column:
    rule = None
    for k, v in table.items():
        rule = (F if rule is None else rule).when(c == k, F.lit(v))
    return rule.otherwise(other)


def sanitize_label(c: Column) -> Column:
    """printable characters only, at most 256."""
    return F.left(F.regexp_replace(c, r"[\p{Cntrl}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""), F.lit(256))


def safe_file_name(c: Column) -> Column:
    """nine forbidden characters become ``_``; nothing left becomes ``_unnamed``."""
    t = F.translate(c, '/\\:*?"<>|', "_________")
    return F.when(F.coalesce(t, F.lit("")) == "", "_unnamed").otherwise(t)


def safe_path_component(c: Column) -> Column:
    """F2 without dots or spaces at the ends; over 120 bytes, cut and closed by ten digits of its SHA-1."""
    t = F.regexp_replace(safe_file_name(c), r"^[. ]+|[. ]+$", "")
    t = F.when(t == "", "_unnamed").otherwise(t)
    return F.when(F.octet_length(t) <= 120, t).otherwise(F.concat(F.left(t, F.lit(109)), F.lit("-"), F.left(F.sha1(t), F.lit(10))))


def tag(c: Column) -> Column:
    """lowered, blanks to dashes."""
    return F.lower(F.replace(F.replace(F.trim(c), F.lit(" "), F.lit("-")), F.lit("/"), F.lit("-")))


def slug(c: Column) -> Column:
    """lowered runs of letters and digits joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def language_of(path: Column) -> Column:
    """By extension; another extension names itself."""
    return _case(extension(path), LANGUAGES, extension(path))


def is_code_file(path: Column) -> Column:
    """S8."""
    return extension(path).isin(*CODE_EXTENSIONS)


def looks_path_like(c: Column) -> Column:
    """F7."""
    return c.contains("/") | c.contains(".")


def normal_path(c: Column) -> Column:
    """F8."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def graph_path(c: Column) -> Column:
    """Trimmed, one leading ``./`` removed."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\./", "")


def path_suffix(c: Column) -> Column:
    """L4: the last two segments."""
    return F.substring_index(F.trim(F.coalesce(c, F.lit(""))), "/", -2)


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def path_parts(c: Column) -> Column:
    """lowered segments, none for an empty path."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "/"))


def shared_suffix(a: Column, b: Column) -> Column:
    """Number of equal segments from the end."""
    pa, pb = F.reverse(path_parts(a)), F.reverse(path_parts(b))
    same = F.zip_with(pa, pb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")


def lookup_tokens(c: Column) -> Column:
    """L3: distinct runs of letters, digits and ``/ . _ -``, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}/._-]+"), 0))


def route_tokens(c: Column) -> Column:
    """W6."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def search_term(c: Column) -> Column:
    """Q24: trimmed, closing ``?.!`` and blanks removed, one pair of quotes removed."""
    t = F.regexp_replace(F.trim(c), r"[?.! ]+$", "")
    return F.trim(F.regexp_replace(t, r"(?s)^([\"'`])(.*)\1$", "$2"))


def export_label(kind: Column) -> Column:
    """F10."""
    return _case(kind, EXPORT_LABELS, F.lit("Node"))


def export_relation(relation: Column) -> Column:
    """F10."""
    return _case(relation, EXPORT_RELATIONS, F.lit("RELATED_TO"))
