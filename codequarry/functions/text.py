"""Text functions on columns: what the parts of a knowledge unit are made of."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: All white space of Unicode, and line ends.
_SPACE, _LINE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def first_line(text: Column) -> Column:
    return F.split(text, _LINE, 2).getItem(0)


def embedding_text(summary: Column, *parts: Column) -> Column:
    """The summary if there is one, else the parts joined by spaces, null parts as empty ones."""
    return F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def cleaned_comment(text: Column) -> Column:
    """A comment without the marks at its two ends, the mark that a line begins with, and blank lines."""
    text = F.regexp_replace(F.regexp_replace(text, r"\A/\*", ""), r"\*/\z", "")
    lines = F.transform(F.split(text, _LINE), lambda x: stripped(F.regexp_replace(stripped(x), r"\A(///|//|/\*\*|\*|#)", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def signature_stub(text: Column, at: Column, after: Column, stub: str) -> Column:
    """text up to its body, the stub, and what follows the body; the whole text where `at` is null."""
    return F.when(at.isNull(), text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), at)), F.lit(stub), F.substring(text, after + 1, F.length(text))))


def prefix_rewritten(value: Column, old: str, new: str) -> Column:
    """value with the prefix old replaced by new, other values as they are."""
    return F.when(F.startswith(value, F.lit(old)), F.concat(F.lit(new), F.substring(value, F.lit(len(old) + 1), F.length(value)))).otherwise(value)


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^([A-Za-z]:)?[/\\]")


def output_path(path: Column, root: str) -> Column:
    """Absolute paths stay, relative ones are joined to the root."""
    return F.when(is_absolute(path), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def library_name(stem: Column) -> Column:
    """A file stem without a trailing version."""
    return F.regexp_replace(stem, r"-[0-9][^-]*$", "")


def version_key(name: Column) -> Column:
    """All runs of digits of a name, of any length, as numbers (length, digits); arrays compare in order."""
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.struct(F.length(plain(x)).alias("length"), plain(x).alias("digits")))


def metadata_field(metadata: Column | str, name: str) -> Column:
    """One field of a unit's metadata, which is a JSON object; null where there is none, or no such object."""
    return F.get_json_object(metadata, f"$.{name}")


def class_name(entry: Column) -> Column:
    return F.regexp_replace(F.replace(entry, F.lit("/"), F.lit(".")), r"\.class$", "")


def extension(path: Column) -> Column:
    """The lower-case suffix after the last dot of the last part, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([A-Za-z0-9]+)$", 1))


def mapped(value: Column, mapping: Mapping[str, str], default: str) -> Column:
    """value through a small mapping, the default for all others."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(known, value), F.lit(default))
