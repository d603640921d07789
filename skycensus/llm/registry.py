"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from skycensus.llm.chat_format import op2_chat_format
from skycensus.llm.collocations import OP12_SQL, op12_collocations
from skycensus.llm.conversation_repair import op13_conversation_repair
from skycensus.llm.decontamination import OP11_SQL, op11_decontamination
from skycensus.llm.embedding_dedup import op6_embedding_dedup
from skycensus.llm.license_scan import op4_license_scan
from skycensus.llm.mixing import OP7_SQL, op7_source_mixing
from skycensus.llm.quality import op3_quality_classifier
from skycensus.llm.quality_rules import op9_quality_rules
from skycensus.llm.sentencepiece_dropout import op1_sentencepiece_dropout
from skycensus.llm.sharding import op8_sharding
from skycensus.llm.simhash import op10_simhash
from skycensus.llm.toxicity import op5_toxicity

_ALL = [op1_sentencepiece_dropout, op2_chat_format, op3_quality_classifier, op4_license_scan, op5_toxicity, op6_embedding_dedup, op7_source_mixing, op8_sharding, op9_quality_rules, op10_simhash, op11_decontamination, op12_collocations, op13_conversation_repair]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op7_source_mixing": OP7_SQL, "op11_decontamination": OP11_SQL, "op12_collocations": OP12_SQL}
