"""The miners from posts to rows: questions meet their answers, answers become edits, builds decide, and every candidate ends in a stage.

Builds come from a backend, so a lane is one plan over recorded results. Each distinct tree is built once; the plans of a question are all
built before the first good one is taken, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import edits as E
from tessella.functions import logs as L
from tessella.functions import prompts as M
from tessella.functions import python_text as P
from tessella.functions import text as X
from tessella.operators import joins, mining, stats
from tessella.operators.closure import kept
from tessella.operators.effects import CompileBackend, project_hash

ROOT = "main.tex"
STAGES = ["no_accepted_answer", "no_answer_code", *mining.FIX_STAGES, *mining.STAGES, "broken_no_located_error", "local_file_missing"]
NO_BLOCKS = "array<string>"


def _build(texts: DataFrame, backend: CompileBackend) -> DataFrame:
    """(key, result) of each distinct root text; ``texts(key, text)``. A backend that goes by keys moves no text."""
    jobs = texts.groupBy("key").agg(F.first("text").alias("text"))
    jobs = jobs.select(F.create_map(F.lit(ROOT), F.col("text")).alias("files"), F.lit(ROOT).alias("root"), F.col("key").alias("project_key"))
    return kept(backend.compile(jobs).select(F.col("project_key").alias("key"), "result"))


def _key(text: Column) -> Column:
    return project_hash(F.create_map(F.lit(ROOT), text), F.lit(ROOT))


def plans_of(rows: DataFrame, blocks: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``plans``, in order: array<struct<at, fixed, key, edits, reason, kind>> of the fixed versions that each column of blocks,
    with its kind, gives; a plan that needs files that nobody has, or that no edits lead to, says why. Plans are made within their row."""
    fixes = {f"fixes_{kind}": P.fix_candidates_udf("broken", F.coalesce(column, F.array().cast(NO_BLOCKS))) for column, kind in blocks}
    each = F.concat(*[F.transform(F.coalesce(f"fixes_{kind}", F.array().cast(NO_BLOCKS)), _of_kind(kind)) for _, kind in blocks])
    made = rows.withColumns(fixes).withColumn("each_", each).withColumn("derived_", P.derive_each_udf("each_.fixed", "broken"))

    def plan(p, at):
        d = F.get("derived_", at)
        edits = F.transform(d["edits"], lambda e: F.struct(F.lit(ROOT).alias("file"), e["search"].alias("search"), e["replace"].alias("replace")))
        reason = F.when(mining.needs_external(p["fixed"]), "external_files").otherwise(d["reason"])
        return F.struct(at.alias("at"), p["fixed"].alias("fixed"), _key(p["fixed"]).alias("key"), edits.alias("edits"), reason.alias("reason"), p["kind"].alias("kind"))

    return made.withColumn("plans", F.transform("each_", plan)).drop(*fixes, *(column for column, _ in blocks), "each_", "derived_")


def _of_kind(kind: str):
    return lambda x: F.struct(x.alias("fixed"), F.lit(kind).alias("kind"))


def tried(rows: DataFrame, backend: CompileBackend) -> DataFrame:
    """``rows(question_id, broken, plans)`` with the broken build's errors and prompt, ``taken``, the first plan that works, and ``last``, what
    became of the last one tried: kept, sites_hidden, fixed_timeout or fixed_compile_fail; null without a plan.

    Rows are written once; builds are found by keys and gathered by question, so of the texts only the broken one is shuffled, once."""
    rows = kept(rows.withColumn("key", _key(F.col("broken"))))
    good = lambda field: F.transform(F.filter("plans", lambda p: p["reason"] == "ok"), lambda p: F.struct(p["at"].alias("at"), p["key"].alias("key"), p[field].alias("text")))
    each = rows.select(F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("at"), "key", F.col("broken").alias("text"))), good("fixed"))).alias("p"))
    built = _build(each.select("p.key", "p.text"), backend)
    asked = rows.select("question_id", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("at"), "key", F.col("key").alias("text"))), good("key"))).alias("p")).select("question_id", "p.at", "p.key")
    own = F.col("at") < 0
    # At most a few plans a question.
    results = asked.join(built, "key", "left").groupBy("question_id").agg(
        F.first(F.when(own, F.col("result")), ignorenulls=True).alias("result"),
        F.collect_list(F.when(~own, F.struct("at", "result.timed_out", "result.ok"))).alias("builds_"),
    )
    light = F.transform("plans", lambda p: F.struct(*[p[c].alias(c) for c in ("at", "edits", "reason", "kind")]))
    rows = rows.drop("key").withColumn("plans", light).join(results, "question_id", "left")
    rows = rows.withColumn("errors", L.error_lines(F.coalesce("result.items", F.array().cast(built.schema["result"].dataType["items"].dataType)), F.lit(ROOT), F.array(F.lit(ROOT))))
    rows = rows.withColumn("prompt", M.fix_prompt(F.lit(ROOT), F.col("broken"), F.col("errors"), F.col("result.log")))

    def became(p, prompt):
        build = F.get(F.filter("builds_", lambda x: x["at"] == p["at"]), F.lit(0))
        stage = (
            F.when(~E.breaks_visible(p["edits"], prompt), "sites_hidden")
            .when(F.coalesce(build["timed_out"], F.lit(True)), "fixed_timeout")
            .when(~F.coalesce(build["ok"], F.lit(False)), "fixed_compile_fail")
            .otherwise("kept")
        )
        return F.struct(p.alias("p"), stage.alias("became"))

    # The prompt as a variable: it is made once for all plans.
    ends = F.flatten(F.transform(F.array("prompt"), lambda prompt: F.transform(F.filter("plans", lambda p: p["reason"] == "ok"), lambda p: became(p, prompt))))
    rows = rows.withColumn("ends_", ends).withColumn("taken", F.get(F.filter("ends_", lambda x: x["became"] == "kept"), F.lit(0))["p"])
    last = F.get("ends_", F.size("ends_") - 1)["became"]
    return rows.withColumn("last", F.when(F.col("taken").isNotNull(), "kept").otherwise(last)).drop("ends_", "builds_")


def _row(c) -> list[Column]:
    """A kept row's columns."""
    target = E.format_edits(E.reverse_edits(F.col("taken.edits")))
    first = F.get("errors", F.lit(0))["text"]
    return [
        "question_id", "stage", F.col("errors").alias("error_lines"), "prompt", F.col("taken.edits").alias("break_edits"), F.when(F.col("taken").isNotNull(), target).alias("target"),
        E.diff_lines_of(F.col("taken.edits")).alias("diff_lines"), F.col("taken.kind").alias("fix_answer"), first.alias("compiled_error"), X.normalize_error(first).alias("error_category"), X.license_of(F.col("created")).alias("license"), *c,
    ]


def strict_lane(posts: DataFrame, backend: CompileBackend) -> DataFrame:
    """One row a question that shows an error line and a whole document: its stage, and if it was kept what a training row holds.

    posts(id, post_type, parent_id, accepted_answer_id, score, created, title, tags, body, blocks). Only the accepted answer counts.
    """
    q = mining.questions(posts).filter("error_message is not null")
    answers = posts.filter("post_type = 2").select("id", "blocks")
    met = joins.matched_once(q, answers, "accepted_answer_id", "id", "id", F.size(F.coalesce("blocks", F.array().cast(NO_BLOCKS))) > 0)
    rows = kept(met.withColumn("answer", F.when(F.col("match") == "matched", F.col("found.blocks"))).drop("found"))
    open_ = rows.filter("match = 'matched'").withColumn("external", mining.needs_external(F.col("broken")))
    done = tried(plans_of(open_.filter("not external"), [("answer", "accepted")]), backend)
    located = F.size("errors") > 0
    message = F.get("errors", F.lit(0))["text"]
    stage = mining.strict_stage(F.lit(False), F.col("plans.reason"), F.coalesce("result.timed_out", F.lit(True)), F.coalesce("result.ok", F.lit(False)), located, message, F.col("last"))
    ended = done.withColumn("stage", stage).select(*_row(["title", "tags", "score", "created"]))
    early = rows.filter("match <> 'matched'").select("question_id", F.when(F.col("match") == "unmatched", "no_accepted_answer").otherwise("no_answer_code").alias("stage"))
    return ended.unionByName(early.unionByName(open_.filter("external").select("question_id", F.lit("external_files").alias("stage"))), allowMissingColumns=True)


def relaxed_lane(posts: DataFrame, backend: CompileBackend, least_score: int = 2) -> DataFrame:
    """One row a question with a whole document and any sign of an error: kept with a fix by the accepted or the best other answer, or a
    row of the pool without one (``fix_stage`` says why); else the stage at which its own build rules it out."""
    q = mining.questions(posts)
    answers = posts.filter("post_type = 2").select(F.col("id").alias("answer_id"), F.col("parent_id").alias("of"), F.col("score").alias("answer_score"), "blocks")
    usable = F.size(F.coalesce("blocks", F.array().cast(NO_BLOCKS))) > 0
    best = joins.accepted_and_best(q.select("question_id", "accepted_answer_id"), answers, "question_id", "accepted_answer_id", "of", "answer_id", "answer_score", usable, least_score)
    # Each text is shuffled once, by its question.
    ids = best.select("question_id", "accepted", "top").filter("accepted is not null or top is not null")
    taken = ids.join(answers, (F.col("of") == F.col("question_id")) & ((F.col("answer_id") == F.col("accepted")) | (F.col("answer_id") == F.col("top"))))
    blocks = lambda name: F.first(F.when(F.col("answer_id") == F.col(name), F.col("blocks")), ignorenulls=True).alias(f"{name}_blocks")
    rows = q.join(taken.groupBy("question_id").agg(blocks("accepted"), blocks("top")), "question_id", "left")
    done = tried(plans_of(rows, [("accepted_blocks", "accepted"), ("top_blocks", "top")]), backend)
    reasons = F.filter("plans.reason", lambda r: r != "ok")
    common = F.array_max(F.transform(F.array_distinct(reasons), lambda r, i: F.struct(F.size(F.filter(reasons, lambda x: x == r)).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    message = F.get("errors", F.lit(0))
    stage = mining.relaxed_stage(F.coalesce("result.timed_out", F.lit(True)), F.coalesce("result.ok", F.lit(False)), message["file"] == ROOT, message["text"], F.col("taken").isNotNull())
    fix_stage = F.when(F.col("taken").isNull(), F.coalesce("last", common, F.lit("no_fix_candidate")))
    return done.withColumn("stage", stage).select(*_row(["title", "tags", "score", "created", F.when(F.col("stage") == "pool", fix_stage).alias("fix_stage"), F.col("accepted_answer_id").isNotNull().alias("has_accepted")]))


def lane_funnel(rows: DataFrame) -> DataFrame:
    return stats.funnel(rows, STAGES)
