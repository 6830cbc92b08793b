"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from kickmill.llm.decontaminate import OP7_SQL, op7_decontaminate
from kickmill.llm.jaccard_join import op10_jaccard_join
from kickmill.llm.language_id import op6_language_id
from kickmill.llm.license_scan import op5_license_scan
from kickmill.llm.oracles import OP2_SQL, OP8_SQL, OP10_SQL
from kickmill.llm.packing import op4_packing
from kickmill.llm.periodic_runs import op11_periodic_runs
from kickmill.llm.sessions import OP12_SQL, op12_gap_sessions
from kickmill.llm.substring_dedup import op2_substring_dedup
from kickmill.llm.suffix_dedup import op3_suffix_dedup
from kickmill.llm.token_files import op13_token_files
from kickmill.llm.topk import OP9_SQL, op9_topk
from kickmill.llm.url_filter import OP1_SQL, op1_url_filter
from kickmill.llm.warc import op8_warc

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_topk": op9_topk,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_gap_sessions": op12_gap_sessions,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_topk": OP9_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op12_gap_sessions": OP12_SQL,
}
