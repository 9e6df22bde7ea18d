"""White-space, preview and JSON text functions: Column to Column, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 29 code points that Python's str.strip() and str.split() take as white space, as a regex class.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: The same code points as a text.
_WHITE_CHARS = "".join(chr(c) for low, high in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(low, high + 1))


def strip(text: Column) -> Column:
    """Without white space at both ends; in linear time, however much of it there is inside."""
    return F.btrim(text, F.lit(_WHITE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_WHITE_CHARS))


def collapse(text: Column) -> Column:
    """Stripped, with each run of white space as one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(strip(text), f"{WHITE}+", " "), F.lit(""))


def preview(text: Column, size: int = 80) -> Column:
    return F.substring(collapse(text), 1, size)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def json_string(text: Column) -> Column:
    """A text as a JSON string with its quotes; control characters are escaped, others stay."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, 6, F.length(whole) - 6)


def sorted_json(pairs: list[tuple[str, Column]]) -> Column:
    """The non-empty pairs as a JSON object with sorted keys, ", " and ": " between; empty without pairs."""
    items = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'"{k}": '), json_string(v))) for k, v in sorted(pairs, key=lambda p: p[0])]))
    return F.when(F.size(items) > 0, F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))).otherwise("")


def safe_stem(name: Column) -> Column:
    """A file stem with anything but letters, digits, _ and - as _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def gib(size: Column) -> Column:
    """Bytes as GiB with four decimals and a G."""
    return F.format_string("%.4fG", size.cast("double") / float(1 << 30))


def lemma(text: Column) -> Column:
    """In small letters, without apostrophes and with spaces for hyphens; the words that are left, single-spaced."""
    plain = F.replace(F.replace(F.lower(text), F.lit("'"), F.lit("")), F.lit("-"), F.lit(" "))
    return F.array_join(F.regexp_extract_all(plain, F.lit("[A-Za-z]+(?:[-'][A-Za-z]+)*|[0-9]+"), F.lit(0)), " ")


def clean_value(value: Column) -> Column:
    """A JSON value (variant) as clean text: a list's items as lines, anything else as collapsed text; null and absent: empty."""
    items = F.try_variant_get(value, "$", "array<string>")
    lines = F.array_join(F.filter(F.transform(items, collapse), lambda x: x != ""), "\n")
    return F.coalesce(lines, collapse(F.try_variant_get(value, "$", "string")))


def stringify(value: Column) -> Column:
    """A JSON value (variant) as text: null: empty; a list: its items, stripped, as lines without blank ones; an object: JSON; else the stripped text."""
    kind = F.schema_of_variant(value)
    items = F.array_join(F.filter(F.transform(F.try_variant_get(value, "$", "array<string>"), strip), lambda x: x != ""), "\n")
    whole = F.when(kind.startswith("ARRAY"), items).when(kind.startswith("OBJECT"), F.to_json(value)).otherwise(strip(F.try_variant_get(value, "$", "string")))
    return F.coalesce(whole, F.lit(""))


def shard_prefix(path: Column) -> Column:
    """The name of a source file's shard: its folder's name (none for a file at the top), two underscores and its safe stem."""
    parts = F.split(path, "/")
    stem = safe_stem(F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", ""))
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.size(parts) - 2), F.lit("__"), stem)).otherwise(stem)


def shard_folder(base: str, context: int) -> str:
    """Where the shards of a context length stand by default."""
    return f"{base.rstrip('/')}/preprocess{context}"


def bullet_lists(entities: Column, predicates: Column) -> Column:
    """Symbols as two lists under their headings, a line each."""
    lines = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    return F.array_join(F.concat(F.array(F.lit("entities:")), lines(entities), F.array(F.lit(""), F.lit("predicates:")), lines(predicates)), "\n")
