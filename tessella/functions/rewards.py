"""Scores of answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_factor(deleted: Column, lost: Column, lost_weight: float = 0.0, free: int = 25, span: int = 125) -> Column:
    """1 up to ``free`` deleted characters, 0 from ``free + span``; times what lost structure leaves."""
    d = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (deleted - free) / F.lit(float(span))))
    return d * F.greatest(F.lit(0.0), 1 - F.lit(lost_weight) * lost)


def reward(applied: Column, compiled: Column, strict: Column, deleted: Column, sim: Column, lost: Column, *, mode: str = "strict", keep: bool = False, lost_weight: float = 0.0, floor: float = 0.95, power: float = 2.0) -> Column:
    """-0.2 for an answer that does not apply, 0 for one that does not compile, else by mode ``strict``, ``sim``, ``gate`` or ``ke``."""
    strict_ = F.coalesce(strict, F.lit(False)).cast("double")
    kept = keep_factor(deleted, lost, lost_weight)
    plain = (1 + 0.5 * strict_) * kept
    if mode == "ke":
        value = (deleted <= 40).cast("double") + strict_
    elif mode == "gate":
        value = F.when(sim.isNotNull(), (sim >= floor).cast("double")).otherwise(plain)
    elif mode == "sim":
        graded = 1 + F.pow(sim, F.lit(power))
        value = F.when(sim.isNotNull(), graded * kept if keep else graded).otherwise(plain)
    else:
        value = plain
    return F.when(~F.coalesce(applied, F.lit(False)), -0.2).when(~F.coalesce(compiled, F.lit(False)), 0.0).otherwise(value)


def composite(pages_ok: Column, text_sim: Column, image_sim: Column, pdf_sim: Column, sim_min: Column) -> tuple[Column, Column]:
    """(strict, sim) of a rendered answer against its reference: strict by pages and word similarity, sim the mean of what there is."""
    have = F.filter(F.array(text_sim, image_sim), lambda x: x.isNotNull())
    sim = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have))
    return F.coalesce(pages_ok & (pdf_sim >= F.coalesce(sim_min, F.lit(0.985))), F.lit(False)), sim


def intact(compiled: Column, deleted: Column, lost: Column) -> Column:
    return F.coalesce(compiled & (lost == 0) & (deleted <= 40), F.lit(False))


def small_enough(ok: Column, deleted: Column, diff_lines: Column, most_deleted: int = 40, most_lines: int = 30) -> Column:
    """Whether a fix works and is small: 60 deleted characters for a teacher's rows, 40 for fixes that are learnt from."""
    return F.coalesce(ok & (deleted <= most_deleted) & (diff_lines <= most_lines), F.lit(False))


def image_similarity(a: Column, b: Column, side: int = 12, block: int = 4) -> Column:
    """Mean over pages of 1 minus the normalised difference of ink in blocks; arrays of arrays of ink densities per page.

    A page that one side lacks counts 0; no pages on either side count 1.
    """
    pages = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def page(p):
        diff = F.aggregate(F.zip_with(p["x"], p["y"], lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v)
        total = F.aggregate(F.zip_with(p["x"], p["y"], lambda u, v: u + v), F.lit(0.0), lambda s, v: s + v)
        return F.when(p["x"].isNull() | p["y"].isNull(), 0.0).when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - diff / total))

    return F.when(F.size(pages) == 0, 1.0).otherwise(F.aggregate(F.transform(pages, page), F.lit(0.0), lambda s, v: s + v) / F.size(pages))
