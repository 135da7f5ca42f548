"""Scoring answers: parse, apply, compile by contract, compare with the reference; a second pass over the failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import edits as E
from tessella.functions import python_text as P
from tessella.functions import rewards as R
from tessella.functions.text import strip_thought
from tessella.schemas import REFERENCE, conform

from .effects import CompileBackend


def score(rows: DataFrame, refs: DataFrame, backend: CompileBackend) -> DataFrame:
    """rows(id, doc, files, root, broken map as ``files``, fixed map or null, response) with the columns of a result.

    An answer that recreates the fixed files exactly is right without compiling; one that changes nothing does not compile.
    """
    said = strip_thought(F.coalesce("response", F.lit("")))
    plain, named = E.parse_edits(said), E.parse_file_edits(said)
    own = F.transform(plain, lambda e: F.struct(F.col("root").alias("file"), e["search"].alias("search"), e["replace"].alias("replace")))
    edits = F.when(said.contains("<edit file=") | (F.size(plain) == 0), named).otherwise(own)
    r = rows.withColumn("edits_", edits).withColumn("done_", E.apply_file_edits(F.col("files"), F.col("edits_")))
    r = r.withColumns({"parsed": F.size("edits_") > 0, "applied": F.col("done_.error").isNull(), "apply_error": F.col("done_.error"), "deleted": E.deleted_chars(said)})
    entries = lambda c: F.array_sort(F.map_entries(c))
    r = r.withColumn("exact", F.coalesce(F.col("applied") & (entries(F.col("done_.files")) == entries(F.col("fixed"))), F.lit(False)))
    r = r.withColumn("same_", F.col("applied") & (entries(F.col("done_.files")) == entries(F.col("files"))))
    ask = F.col("applied") & ~F.col("exact") & ~F.col("same_")
    jobs = backend.compile(r.filter(ask).select("id", F.col("done_.files").alias("files"), "root")).select("id", "result")
    r = r.join(jobs, "id", "left").join(conform(refs, REFERENCE).select("doc", F.col("text").alias("ref_text"), F.col("pages").alias("ref_pages"), F.col("img").alias("ref_img"), F.coalesce("ascii", F.lit(False)).alias("ref_ascii"), "sim_min"), "doc", "left")
    r = r.withColumn("compiled", F.col("exact") | F.coalesce("result.ok", F.lit(False)))
    r = r.withColumn("pdf_sim_", P.words_similarity_udf(F.when(F.col("compiled"), F.col("result.pdf_text")), "ref_text", "ref_ascii")).withColumn("text_sim_", P.text_similarity_udf(F.when(F.col("compiled"), F.col("result.pdf_text")), "ref_text", "ref_ascii"))
    # Both sides' pages as ink densities; without pages on either side there is no image similarity.
    r = r.withColumns({"ink_": P.page_inks_udf(F.when(F.col("compiled"), F.col("result.pdf_img"))), "ref_ink_": P.page_inks_udf("ref_img")})
    r = r.withColumn("img_sim_", F.when((F.size("ink_") > 0) & (F.size("ref_ink_") > 0), R.image_similarity(F.col("ink_"), F.col("ref_ink_"))))
    pages_ok = F.col("result.pdf_pages") == F.col("ref_pages")
    strict, sim = R.composite(pages_ok, F.col("text_sim_"), F.col("img_sim_"), F.col("pdf_sim_"), F.col("sim_min"))
    exact = F.col("exact")
    return r.withColumns({
        "timed_out": F.coalesce("result.timed_out", F.lit(False)),
        "pages_ok": F.when(exact, True).otherwise(pages_ok),
        "pdf_sim": F.when(exact, 1.0).otherwise(F.col("pdf_sim_")),
        "text_sim": F.when(exact, 1.0).otherwise(F.col("text_sim_")),
        "img_sim": F.when(exact, 1.0).otherwise(F.col("img_sim_")),
        "sim": F.when(exact, 1.0).otherwise(sim),
        "strict": exact | (F.col("compiled") & strict),
        "has_ref": F.col("ref_text").isNotNull(),
    }).drop("edits_", "done_", "same_", "result", "pdf_sim_", "text_sim_", "img_sim_", "ink_", "ref_ink_", "ref_img", "ref_ascii", "ref_text", "ref_pages", "sim_min")


def with_retry(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results with the second pass over the failures merged: ``pass1`` keeps what the first said."""
    again = second.select("id", *[F.col(c).alias(f"r_{c}") for c in ("compiled", "strict", "sim", "applied", "response")])
    out = first.join(again, "id", "left").withColumn("pass1", F.col("compiled"))
    use = ~F.col("compiled") & F.coalesce("r_compiled", F.lit(False))
    merged = {c: F.when(use, F.col(f"r_{c}")).otherwise(F.col(c)) for c in ("compiled", "strict", "sim")}
    return out.withColumns(merged).withColumnsRenamed({"r_response": "retry_response", "r_applied": "retry_applied"}).drop("r_compiled", "r_strict", "r_sim")


def retry_prompts(results: DataFrame) -> DataFrame:
    """Prompts of the failures: rebuilt ones where the answer applied, else the old one with a note."""
    note = "\n\nYour previous edits could not be applied: "
    return results.filter(~F.col("compiled")).withColumn("prompt", F.when(F.col("applied") & F.col("new_prompt").isNotNull(), F.col("new_prompt")).otherwise(F.concat("prompt", F.lit(note), F.coalesce("apply_error", F.lit("no edit blocks parsed")))))


def unanswered(samples: DataFrame) -> DataFrame:
    return samples.filter(F.trim(F.coalesce("response", F.lit(""))) == "")


def calibration(rows: DataFrame, results: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, kind) of what a judge is calibrated on: ``human`` fixes that are small and have a reference, and ``hack``: answers that
    compile without being strict and delete much where the human fix does not. rows(id, doc, target), results(id, response, compiled,
    strict)."""
    deleted = E.deleted_chars(F.col("target"))
    added = F.aggregate(E.parse_any(F.col("target")), F.lit(0), lambda s, e: s + F.greatest(F.lit(0), E.content_chars(e["replace"]) - E.content_chars(e["search"])))
    human = rows.filter((deleted <= 25) & (added <= 60)).join(refs.select("doc"), "doc", "left_semi").select("id", F.lit("human").alias("kind"))
    bad = results.filter(F.col("compiled") & ~F.coalesce("strict", F.lit(False)) & (E.deleted_chars(F.col("response")) > 40))
    hacks = bad.join(rows.filter(deleted <= 25).select("id"), "id", "left_semi").select("id", F.lit("hack").alias("kind"))
    return human.unionByName(hacks)


def pseudo_references(rows: DataFrame, builds: DataFrame) -> DataFrame:
    """(doc, text, pages): what a document's fixed version looks like, for documents that have no reference of their own.

    rows(doc, broken, fix): ``fix`` is an answer's edit blocks; one that does not apply gives none. builds(key, ok, pdf_text, pages) are
    recorded by the SHA-256 of the built text; a build that failed, or was never recorded, gives none.
    """
    applied = E.apply_edits(F.col("broken"), E.parse_edits(F.col("fix")))
    patched = rows.select("doc", applied.alias("a")).filter("a.error is null").select("doc", F.sha2("a.doc", 256).alias("key"))
    good = builds.filter(F.coalesce("ok", F.lit(False))).select("key", F.col("pdf_text").alias("text"), "pages").dropDuplicates(["key"])
    return patched.join(good, "key").select("doc", "text", "pages")


def references_to_build(rows: DataFrame, have: DataFrame, failed: DataFrame, doc: str = "doc", order: str = "id") -> DataFrame:
    """One row of each document, the first, that has no reference yet and is not listed as failed; ``how``: rendered as of its own time
    where a row names a year, else built as it is."""
    from .selection import first_wins

    first = first_wins(rows, [doc], order)
    todo = first.join(have.select(doc), doc, "left_anti").join(failed.select(doc), doc, "left_anti")
    return todo.withColumn("how", F.when((F.col("mutation") == "organic") & F.col("hist_year").isNotNull(), "historic").otherwise("as_is"))


def probe(results: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A probe run: (keys, n, n_fixed, n_applied), and (keys, id, compiled) with one row an id, compiled if any of its rows did."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    summary = results.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(yes("compiled")).alias("n_fixed"), F.count_if(yes("applied")).alias("n_applied"))
    return summary, results.groupBy(*keys, "id").agg(F.bool_or(yes("compiled")).alias("compiled"))


def guarded(f, ddl: str):
    """``f`` as an expression that never ends a job: struct<value, error>, the error's kind and message instead of a raised one."""
    from pyspark.sql.types import StructType

    def safe(*args):
        try:
            return f(*args), None
        except Exception as e:  # whatever a row does to f is that row's result
            return None, f"{type(e).__name__}: {e}"[:200]

    return F.udf(safe, StructType.fromDDL(f"value {ddl}, error string"), useArrow=True)
