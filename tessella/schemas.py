"""Row shapes as Spark DDL; absent columns are typed nulls."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EDIT = "struct<file:string,search:string,replace:string,type:string>"
ERROR_LINE = "struct<line:int,text:string,file:string,fileLabel:string>"
LOG_ITEM = "struct<severity:string,file:string,fileFromLog:boolean,line:int,message:string,rawExcerpt:string>"

EXAMPLE = f"""
id string, doc string, src_dir string, bundles array<string>, lane string, source string, synthetic boolean, mutation string, seed int,
break_edits array<{EDIT}>, break_edit {EDIT}, n_breaks int, file_edits array<{EDIT}>, engine string, compile_seconds double, bib boolean,
error_lines array<{ERROR_LINE}>, log_tail string, prompt string, prompt_v1 string, ctx_chars int, single_shot_visible boolean, target string,
question_id bigint, accepted_answer_id bigint, answer_id bigint, answer_score int, has_accepted boolean, fix_answer string, fix_source string,
fix_stage string, title string, tags array<string>, score int, created string, error_message string, error_mention string, compiled_error string,
error_category string, diff_lines int, url string, license string, reported_file string, fix_files array<string>, changed_files array<string>,
companions array<string>, original_root string, n_files int, single_file_build boolean, cause_elsewhere boolean, repo string, sha string,
parent_sha string, stars int, commit_message string, query string, upstream string, upstream_license string, ahead_by int, arxiv_id string,
year int, hist_year int, ref_pages int, signature string, first_error string, missing_file string, n_errors int"""
COMPILE_RESULT = f"ok boolean, log string, items array<{LOG_ITEM}>, error_items array<{LOG_ITEM}>, seconds double, engine string, timed_out boolean, texlive string, pdf_text string, pdf_pages int, pdf_img array<binary>"
REFERENCE = "doc string, text string, pages int, img array<binary>, tl string, ascii boolean, sim_min double, pseudo boolean, teacher string, how string, response string, reason string"
EVAL_RESULT = """id string, mutation string, response string, wall_s double, out_tokens int, sample_error string, parsed boolean, applied boolean,
apply_error string, compiled boolean, timed_out boolean, texlive string, exact boolean, diff_lines int, pdf_sim double, text_sim double, img_sim double,
sim double, pages_ok boolean, strict boolean, pdf_pages int, pdf_text string, pass1 boolean, retry_response string, retry_applied boolean,
refilled boolean, has_ref boolean"""
CANDIDATE = "id string, i int, compiled boolean, strict boolean, deleted int, retry boolean, diff_lines int, pages int, votes int, len int, n_edits int, greedy boolean, p_yes double, text string, pdf_key struct<pages:int,text:string>"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a shape, in order; absent ones as nulls, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl).fields])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def keep_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def scrub(df: DataFrame, literal: Column, by: str, pattern: str, by_pattern: str) -> DataFrame:
    """Every text of a row with a literal and a pattern replaced, through its JSON form."""
    row = F.to_json(F.struct(*df.columns))
    clean = F.regexp_replace(F.replace(row, literal, F.lit(by)), pattern, by_pattern)
    return df.select(F.from_json(clean, df.schema).alias("r")).select("r.*")
