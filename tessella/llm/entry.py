"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from .ann import op10_ann
from .decontamination import OP12_SQL, op12_decontamination
from .fingerprints import op4_fingerprints
from .importance import op13_importance
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op3_mixing
from .pii import op2_pii
from .quality import op7_quality
from .sentencepiece_codec import op9_sentencepiece
from .simhash import op5_simhash
from .token_counts import op8_token_counts
from .url_filter import OP6_SQL, op6_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_ann": op10_ann,
    "op11_vector_codes": op11_vector_codes,
    "op12_decontamination": op12_decontamination,
    "op13_importance": op13_importance,
}
ORACLE = {"op1_line_dedup": OP1_SQL, "op6_url_filter": OP6_SQL, "op11_vector_codes": OP11_SQL, "op12_decontamination": OP12_SQL}
