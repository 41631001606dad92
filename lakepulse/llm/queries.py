"""The operators as queries on the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakepulse.llm.byte_bpe import op5_byte_bpe
from lakepulse.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from lakepulse.llm.language_id import op2_language_id
from lakepulse.llm.license_scan import op3_license_scan
from lakepulse.llm.line_dedup import OP1_SQL, op1_line_dedup
from lakepulse.llm.mixing import op8_mixing
from lakepulse.llm.personal_data import op13_personal_data
from lakepulse.llm.quality_rules import op4_quality_rules
from lakepulse.llm.simhash import op10_simhash
from lakepulse.llm.token_alignment import op11_token_alignment
from lakepulse.llm.token_files import op6_token_files
from lakepulse.llm.url_filter import OP7_SQL, op7_url_filter
from lakepulse.llm.vector_codes import OP12_SQL, op12_vector_codes

_ALL = [
    op1_line_dedup,
    op2_language_id,
    op3_license_scan,
    op4_quality_rules,
    op5_byte_bpe,
    op6_token_files,
    op7_url_filter,
    op8_mixing,
    op9_exact_dedup,
    op10_simhash,
    op11_token_alignment,
    op12_vector_codes,
    op13_personal_data,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op7_url_filter": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
}
