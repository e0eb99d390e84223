"""Identifiers and types of LSVs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSV_ID = r"^(.*):([st]):(na|-?\d+)-(na|-?\d+)$"  # the gene id may hold colons itself


def gene_of(lsv_id: Column) -> Column:
    return F.regexp_extract(lsv_id, LSV_ID, 1)


def kind_of(lsv_id: Column) -> Column:
    return F.regexp_extract(lsv_id, LSV_ID, 2)


def reference_exon(lsv_id: Column) -> tuple[Column, Column]:
    """Start and end; null where `na`."""
    side = lambda k: F.regexp_extract(lsv_id, LSV_ID, k).try_cast("int")
    return side(3), side(4)


def exon_text(start: Column, end: Column) -> Column:
    side = lambda c: F.when(c == -1, "na").otherwise(c.cast("string"))
    return F.concat(side(start), F.lit("-"), side(end))


def type_parts(lsv_type: Column) -> Column:
    """Connections of a type s|1e1.1o1|2e2.1o1|i without the side."""
    return F.slice(F.split(lsv_type, r"\|"), 2, 10_000)


def junction_parts(lsv_type: Column) -> Column:
    return F.filter(type_parts(lsv_type), lambda x: x != "i")


def has_intron(lsv_type: Column) -> Column:
    return F.endswith(lsv_type, F.lit("|i"))


def is_binary(lsv_type: Column) -> Column:
    return F.size(type_parts(lsv_type)) == 2


def exons_met(lsv_type: Column) -> Column:
    """Distinct numbers of the other exons; a part that ends nowhere (e0) is none."""
    number = lambda x: F.regexp_extract(x, r"e(\d+)", 1)
    return F.array_distinct(F.filter(F.transform(junction_parts(lsv_type), number), lambda x: (x != "") & (x != "0")))


def exon_count(lsv_type: Column) -> Column:
    return F.size(exons_met(lsv_type)) + 1


def skips_exon(lsv_type: Column) -> Column:
    return exon_count(lsv_type) > 2


def reference_sites(lsv_type: Column) -> Column:
    """Number of different splice sites of the reference exon."""
    return F.size(F.array_distinct(F.transform(junction_parts(lsv_type), lambda x: F.regexp_extract(x, r"^(\d+)e", 1))))


def other_sites(lsv_type: Column) -> Column:
    """Whether some other exon is met at more than one of its sites."""
    sites = F.array_distinct(F.transform(junction_parts(lsv_type), lambda x: F.regexp_extract(x, r"e(\d+\.\d+)", 1)))
    return F.size(F.filter(sites, lambda x: x != "")) > F.size(exons_met(lsv_type))


def alternative_sites(lsv_type: Column) -> tuple[Column, Column]:
    """(A5SS, A3SS): sites of the reference exon are 5' ones for a source and 3' ones for a target; the others' reversed."""
    source = F.startswith(lsv_type, F.lit("s"))
    own, other = reference_sites(lsv_type) > 1, other_sites(lsv_type)
    return F.when(source, own).otherwise(other), F.when(source, other).otherwise(own)


def joined(values: Column, form: str) -> Column:
    """Per-connection values as one text with semicolons."""
    return F.array_join(F.transform(values, lambda x: F.format_string(form, x)), ";")
