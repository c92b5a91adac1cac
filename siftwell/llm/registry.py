"""The corpus queries by name, and SQL for those that SQL can state."""

from __future__ import annotations

from siftwell.llm.decontaminate import OP3_SQL, op3_decontaminate
from siftwell.llm.html_text import op10_html_text
from siftwell.llm.language_id import op7_language_id
from siftwell.llm.near_vectors import op2_near_vectors
from siftwell.llm.packing import op9_packing
from siftwell.llm.pfor import op6_token_files
from siftwell.llm.ranked_search import OP12_SQL, op12_ranked_search
from siftwell.llm.repeated_windows import OP13_SQL, op13_substring_dedup
from siftwell.llm.sharding import op5_sharding
from siftwell.llm.simhash import op8_simhash
from siftwell.llm.suffix_dedup import op4_suffix_dedup
from siftwell.llm.token_alignment import op11_token_alignment
from siftwell.llm.warc import OP1_SQL, op1_warc


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_near_vectors": op2_near_vectors,
        "op3_decontaminate": op3_decontaminate,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_sharding": op5_sharding,
        "op6_token_files": op6_token_files,
        "op7_language_id": op7_language_id,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_html_text": op10_html_text,
        "op11_token_alignment": op11_token_alignment,
        "op12_ranked_search": op12_ranked_search,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_decontaminate": OP3_SQL, "op12_ranked_search": OP12_SQL, "op13_substring_dedup": OP13_SQL}
