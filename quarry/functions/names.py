"""File-name parsing as Column expressions: ids with dropped zeros, originals, composites and their masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = "^[a-z]{3}[0-9]{1,5}$"
LONG_ID = "^[a-z]{3}[0-9]+$"


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def normal_id(token: Column, cut: bool = False) -> Column:
    """Three letters and a number, padded to five digits; anything else is NULL. cut: of longer numbers the first five digits, else they are NULL too."""
    return F.when(token.rlike(LONG_ID if cut else ID), F.concat(F.substring(token, 1, 3), F.lpad(F.substring(token, 4, 5), 5, "0")))


def parsed(path: Column, cut: bool = False) -> Column:
    """A struct of what a name says: kind, category, ids, type, flags, and `error` where it follows neither pattern.

    Originals: Au_<category>_<number>. Composites: Tp_<S or D>_<three flags>_<host>_<donor>_<number>.
    cut: ids of more than five digits are cut to five (normal_id) instead of being errors.
    """
    parts = F.split(stem(path), "_")
    at = lambda i: F.get(parts, F.lit(i))
    own, host, donor = normal_id(F.concat(at(1), at(2)), cut), normal_id(at(5), cut), normal_id(at(6), cut)
    original = (F.size(parts) == 3) & (at(0) == "Au") & own.isNotNull()
    composite = (F.size(parts) == 8) & (at(0) == "Tp") & at(1).isin("S", "D") & host.isNotNull() & donor.isNotNull()
    of = lambda a, b: F.when(original, a).when(composite, b)
    return F.struct(
        of(F.lit("original"), F.lit("composite")).alias("kind"), of(at(1), F.substring(host, 1, 3)).alias("category"), of(own, host).alias("host_id"),
        F.when(composite, donor).alias("donor_id"), F.when(composite, F.when(at(1) == "S", "copy-move").otherwise("splicing")).alias("type"),
        F.when(composite, F.concat_ws("_", at(2), at(3), at(4))).alias("flags"), F.when(composite, at(7)).alias("number"),
        F.when(~F.coalesce(original | composite, F.lit(False)), F.concat(F.lit("not a known name: "), path)).alias("error"),
    )


def strict(struct: Column) -> Column:
    """The struct, failing the job at a row that has an error."""
    return F.when(struct["error"].isNull(), struct).otherwise(F.raise_error(struct["error"]))


def mask_number(path: Column) -> Column:
    """The last non-empty token before _gt and its digits, if any; a name without _gt fails."""
    body = F.regexp_extract(stem(path), r"^(.+?)_gt[0-9]*$", 1)
    found = F.element_at(F.filter(F.split(body, "_"), lambda t: t != ""), -1)
    return F.when(body != "", found).otherwise(F.raise_error(F.concat(F.lit("not a mask name: "), path)))


def mask_relation(image_stem: Column, mask_path: Column) -> Column:
    """How a mask's name differs from its image's: identical, letter_only, ids, odd_suffix or other."""
    mask = stem(mask_path)
    a, b = F.split(image_stem, "_"), F.split(F.regexp_replace(mask, "_gt[0-9]*$", ""), "_")
    differ = F.filter(F.transform(F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(False)).otherwise(F.lit(True))), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    only = lambda *places: F.size(F.array_except(differ, F.array(*[F.lit(p) for p in places]))) == 0
    return (
        F.when(~mask.endswith("_gt"), "odd_suffix").when(F.size(a) != F.size(b), "other").when(F.size(differ) == 0, "identical")
        .when(only(1), "letter_only").when(only(5, 6), "ids").otherwise("other")
    )


def verdict_sentence(p: Column, low: float, high: float) -> Column:
    """One sentence on a probability and the band of no verdict around one half."""
    return (
        F.when(p >= high, F.format_string(f"Judged tampered: probability %.3f is {high:.2f} or more.", p))
        .when(p <= low, F.format_string(f"Judged authentic: probability %.3f is {low:.2f} or less.", p))
        .otherwise(F.format_string(f"No verdict: probability %.3f lies between {low:.2f} and {high:.2f}.", p))
    )


def join_sentences(sentences: list[Column]) -> Column:
    """The sentences that are not NULL, one after the other."""
    return F.array_join(F.array_compact(F.array(*sentences)), " ")
