"""The registered queries of this subpackage and their DuckDB SQL."""

from .decontamination import op2_decontamination
from .fingerprints import op3_document_fingerprints
from .html_text import op8_html_extraction
from .language_model import op5_lm_scoring
from .licenses import op6_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .near_dedup import op4_minhash_near_dedup
from .packing import op1_best_fit_packing
from .quality import op9_quality_classifier
from .token_output import op7_token_output

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_license_scan": op6_license_scan,
    "op7_token_output": op7_token_output,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL = {"op10_line_dedup": OP10_SQL}
