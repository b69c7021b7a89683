"""The registered queries of this package."""

from __future__ import annotations

from vane.llm.decontam import op9_decontamination
from vane.llm.divergence import OP12_SQL, op12_source_divergence
from vane.llm.langid import op2_language
from vane.llm.lexical import OP11_SQL, op11_lexical_search
from vane.llm.licenses import op10_licenses
from vane.llm.line_dedup import OP4_SQL, op4_line_dedup
from vane.llm.near_dup import op8_near_dup
from vane.llm.packing import op6_packing
from vane.llm.pii import op1_pii
from vane.llm.quality import op3_quality
from vane.llm.url_filter import op5_url_filter
from vane.llm.warc import OP7_SQL, op7_warc
from vane.llm.winnowing import op13_fingerprints

QUERIES = {f.__name__: f for f in (op1_pii, op2_language, op3_quality, op4_line_dedup, op5_url_filter, op6_packing, op7_warc, op8_near_dup, op9_decontamination, op10_licenses, op11_lexical_search, op12_source_divergence, op13_fingerprints)}


#: The queries not listed are learned or iterative. Tests hold them against brute force.
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op7_warc": OP7_SQL, "op11_lexical_search": OP11_SQL, "op12_source_divergence": OP12_SQL}
