"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyrow.llm.decontaminate import op5_decontaminate
from tallyrow.llm.jaccard_join import op4_jaccard_join
from tallyrow.llm.language_id import op1_language_id
from tallyrow.llm.language_model import op8_language_model
from tallyrow.llm.licenses import op6_licenses
from tallyrow.llm.oracles import ORACLE
from tallyrow.llm.packing import op3_packing
from tallyrow.llm.quality_classifier import op9_quality_classifier
from tallyrow.llm.quality_rules import op2_quality_rules
from tallyrow.llm.sharding import op7_sharding
from tallyrow.llm.token_files import op10_token_files

QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_packing, op4_jaccard_join, op5_decontaminate, op6_licenses, op7_sharding, op8_language_model, op9_quality_classifier, op10_token_files)}

__all__ = ["ORACLE", "QUERIES"]
