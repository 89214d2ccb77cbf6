"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_collocations
from .decontaminate import OP6_SQL, op6_decontaminate
from .html_extract import op4_html_extract
from .language_id import op3_language_id
from .license_scan import OP2_SQL, op2_license_scan
from .mixing import OP9_SQL, op9_mix_sources
from .near_dedup import op8_near_dedup
from .packing import op11_best_fit_packing
from .quality_outliers import op7_quality_outliers
from .secret_scan import op10_secret_scan
from .substring_dedup import op5_substring_dedup
from .token_alignment import op12_token_alignment
from .url_graph import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_html_extract": op4_html_extract,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_outliers": op7_quality_outliers,
    "op8_near_dedup": op8_near_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_scan": op10_secret_scan,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op2_license_scan": OP2_SQL, "op6_decontaminate": OP6_SQL, "op9_mix_sources": OP9_SQL, "op13_collocations": OP13_SQL}
