"""Text functions, Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def marked_letters() -> tuple[str, str]:
    """Letters of all scripts that are one letter and marks, and these letters, from the Unicode tables."""
    apart = {c: d for c in map(chr, range(0x80, 0x10000)) if c.isalpha() and len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])}
    return "".join(apart), "".join(d[0] for d in apart.values())


MARKED, PLAIN = marked_letters()

#: Substrings of errors that are worth another attempt.
RETRYABLE = (
    "timed out", "timeout", "connection", "temporarily", "temporary", "network", "read operation", "write operation",
    "server disconnected", "connection reset", "remote protocol", "broken pipe", "502", "503", "504",
)

#: Labels of a delivery note's number.
NOTE_LABELS = ("albaran", "albarán", "albarà")

#: Prefixes of key columns, in the order they are tried.
KEY_PREFIXES = ("id", "oid", "codigo", "cod", "fk")


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f uses it: nested functions would else repeat each other's trees."""
    return F.transform(F.array(c), f)[0]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def identifier(c: Column) -> Column:
    """An identifier as text: leading zeros stay, blanks go, nothing left is null."""
    return blank_to_null(c)


def fold_marks(c: Column) -> Column:
    """Letters of any script without their marks; combining marks go too."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), MARKED, PLAIN)


def upper_plain(c: Column) -> Column:
    return F.trim(F.upper(fold_marks(c)))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def simplified(c: Column) -> Column:
    """Without marks, double spaces and case: for comparing what people wrote."""
    low = F.lower(collapse_spaces(fold_marks(c)))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ς", "σ")


def same_text(a: Column, b: Column) -> Column:
    """Equality regardless of case, marks and spacing, by collation."""
    ci = "UNICODE_CI_AI"
    return F.collate(collapse_spaces(a), ci) == F.collate(collapse_spaces(b), ci)


def canonical_name(c: Column, aliases: dict[str, list[str]]) -> Column:
    """The canonical name where the text is one of its aliases (spacing and case apart), else the trimmed text."""
    seen: set[str] = set()
    text = blank_to_null(c)
    key = F.lower(collapse_spaces(c))
    out = text
    for name, others in aliases.items():
        keys = [" ".join(x.split()).casefold() for x in (name, *others)]
        if not all(keys) or len(set(keys)) < len(keys) or seen & set(keys):
            raise ValueError(f"empty or repeated aliases of {name!r}")
        seen |= set(keys)
        out = F.when(key.isin(keys), F.lit(name)).otherwise(out)
    return F.when(text.isNotNull(), out)


def storage_name(c: Column) -> Column:
    """A name with letters, digits, dot, dash and underscore only; 'archivo' if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(fold_marks(c), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("archivo"))


def storage_path(site: str, path: Column, content_hash: Column, root: str = "") -> Column:
    """site/folders/stem_hash12.pdf, every part made safe."""
    relative = F.regexp_replace(path, f"^{root}/?", "") if root else path
    parts = F.split(relative, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), storage_name)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    name = F.concat(storage_name(stem), F.lit("_"), F.substring(content_hash, 1, 12), F.lit(".pdf"))
    return F.array_join(F.concat(F.array(F.lit(site)), folders, F.array(name)), "/")


def relation_meaning(c: Column) -> Column:
    """What a column or table name is about: its last part, without a key prefix, letters and digits only."""
    low = F.lower(F.trim(c))
    parts = F.filter(F.split(low, "_"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), low)
    short = last
    for prefix in reversed(KEY_PREFIXES):
        short = F.when(F.startswith(last, F.lit(prefix)) & (F.length(last) > len(prefix)), F.substring(last, len(prefix) + 1, 2**31 - 1)).otherwise(short)
    return F.regexp_replace(short, r"[^\p{L}\p{N}]", "")


def spanish_tax_id(c: Column) -> Column:
    """ES before a letter and eight digits goes, in any case and with blanks inside; anything else stays as it is."""
    return F.when(has_country_prefix(c), F.substring(F.upper(F.replace(c.cast("string"), F.lit(" "), F.lit(""))), 3, 9)).otherwise(blank_to_null(c))


def has_country_prefix(c: Column) -> Column:
    return F.upper(F.replace(c.cast("string"), F.lit(" "), F.lit(""))).rlike(r"^ES[A-Z]\d{8}$")


def dashed_tax_id(c: Column) -> Column:
    """A-99-999999 in any case without dashes, in capitals; anything else stays as it is."""
    return F.when(has_dashes(c), F.upper(F.replace(blank_to_null(c), F.lit("-"), F.lit("")))).otherwise(blank_to_null(c))


def has_dashes(c: Column) -> Column:
    return F.upper(blank_to_null(c)).rlike(r"^[A-Z]-\d{2}-\d{6}$")


def note_number(c: Column) -> Column:
    """What stands behind the first colon, if before it there is only a delivery note's label; else the whole text."""
    text = blank_to_null(c)
    colon = F.instr(text, ":")
    label = F.regexp_replace(F.lower(F.trim(F.substring(text, F.lit(1), colon - 1))), r"^n[ºo]\s*", "")
    number = F.nullif(F.trim(F.substring(text, colon + 1, F.length(text))), F.lit(""))
    return F.when((colon > 0) & label.isin(*NOTE_LABELS) & number.isNotNull(), number).otherwise(text)


def shown(c: Column, most: int = 300) -> Column:
    """A value for display: NULL, a mark for the empty text, cut with dots beyond ``most`` characters."""
    text = c.cast("string")
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
    return F.when(text.isNull(), "NULL").when(text == "", "<VACÍO>").otherwise(cut)


def shown_binary(c: Column) -> Column:
    return F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("<BINARIO: "), F.octet_length(c).cast("string"), F.lit(" bytes>")))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))


def diagram_id(c: Column) -> Column:
    """An identifier for diagrams: other characters become underscores, and it begins with a letter."""
    safe = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("T_"), safe)).otherwise(safe)


def is_retryable(message: Column) -> Column:
    return F.lower(message).rlike("|".join(x.replace(".", r"\.") for x in RETRYABLE))


def redacted(json: Column, keys: tuple[str, ...] = ("api_key", "token", "authorization", "password", "secret")) -> Column:
    """JSON text with the string values of sensitive keys masked, at any depth."""
    return F.regexp_replace(json, rf'(?i)("(?:{"|".join(keys)})"\s*:\s*)"(?:[^"\\]|\\.)*"', '$1"***"')


def yes_no(c: Column) -> Column:
    return F.when(c, "SI").otherwise("NO")


def rendered_type(kind: Column, length: Column, precision: Column, scale: Column) -> Column:
    """varchar(80), varchar(MAX), decimal(14,2) and the like."""
    low = F.lower(kind)
    size = F.when(low.isin("nvarchar", "nchar") & (length > 0), (length / 2).cast("int")).otherwise(length)
    sized = F.when(size == -1, F.concat(kind, F.lit("(MAX)"))).otherwise(F.concat(kind, F.lit("("), size.cast("string"), F.lit(")")))
    exact = F.concat(kind, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    return F.when(low.isin("varchar", "nvarchar", "char", "nchar", "varbinary", "binary"), sized).when(low.isin("decimal", "numeric"), exact).otherwise(kind)
