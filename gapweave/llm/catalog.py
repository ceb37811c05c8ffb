"""Registered queries of the training-data operators and their SQL counterparts."""

from gapweave.llm.blocks import op8_main_text
from gapweave.llm.caps import op4_near_vectors
from gapweave.llm.language import op3_language
from gapweave.llm.line_filter import OP11_SQL, op11_line_dedup
from gapweave.llm.manifest import OP12_SQL, op12_manifest
from gapweave.llm.mixing import OP1_SQL, op1_mix_sources
from gapweave.llm.neighbours import op10_nearest
from gapweave.llm.pieces import op9_sentencepiece
from gapweave.llm.quality import op5_quality
from gapweave.llm.secret_scan import OP7_SQL, op7_secrets
from gapweave.llm.simhash import op2_simhash
from gapweave.llm.spelling import OP13_SQL, op13_spelling
from gapweave.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_simhash, op3_language, op4_near_vectors, op5_quality, op6_toxicity, op7_secrets, op8_main_text, op9_sentencepiece, op10_nearest, op11_line_dedup, op12_manifest, op13_spelling)}
ORACLES = {"op1_mix_sources": OP1_SQL, "op7_secrets": OP7_SQL, "op11_line_dedup": OP11_SQL, "op12_manifest": OP12_SQL, "op13_spelling": OP13_SQL}
