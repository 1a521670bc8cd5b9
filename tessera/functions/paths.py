"""Path arithmetic on slash-separated, repository-relative paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def dirname(path) -> Column:
    """'.' for a path without a slash."""
    return F.when(F.instr(_col(path), "/") > 0, F.regexp_replace(_col(path), "/[^/]*$", "")).otherwise(F.lit("."))


def ext(path) -> Column:
    """From the last dot of the last part on, or ''."""
    return F.regexp_extract(_col(path), r"(\.[^./]*)$", 1)


def lower_ext(path) -> Column:
    return F.lower(ext(path))


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def without_ext(path) -> Column:
    return F.regexp_replace(_col(path), r"\.[^./]*$", "")


def clean(path) -> Column:
    """Without '.', doubled slashes and 'x/..'; '..' stays where nothing is left to drop; '.' if empty."""
    parts = F.filter(F.split(_col(path), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(x != "..", F.concat(done, F.array(x))).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(F.lit(".."))))

    joined = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def join(a, b) -> Column:
    return clean(F.concat_ws("/", _col(a), _col(b)))


def resolve_link(source, target) -> Column:
    """A link's target: from the root if it starts with a slash, else from the source's directory."""
    return F.when(_col(target).startswith("/"), clean(F.substring(_col(target), 2, 1 << 30))).otherwise(join(dirname(source), target))


def ancestors(path) -> Column:
    """All directories above a path, '' (the root) first."""
    parts = F.split(_col(path), "/")
    steps = F.sequence(F.lit(0), F.size(parts) - 1)
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def slugify(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cut_bytes(text, most: int) -> Column:
    """At most ``most`` bytes: the first ``most - 1`` and an ellipsis. A letter cut in two becomes U+FFFD."""
    b = F.encode(_col(text), "UTF-8")
    head = F.make_valid_utf8(F.substring(b, 1, most - 1).cast("string"))
    return F.when(F.octet_length(b) <= most, _col(text)).otherwise(F.concat(head, F.lit("…")))
