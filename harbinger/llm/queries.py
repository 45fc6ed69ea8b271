"""The queries of this package, by name, and the SQL of those that have one."""

from __future__ import annotations

from harbinger.llm.codes import OP13_SQL, op13_vector_codes
from harbinger.llm.embed_dedup import op4_embed_dedup
from harbinger.llm.exponion import OP12_SQL, op12_exponion
from harbinger.llm.media import op3_media
from harbinger.llm.mixing import op6_mixing
from harbinger.llm.ngram_join import op7_ngram_join
from harbinger.llm.packing import op8_packing
from harbinger.llm.pii import op9_pii
from harbinger.llm.secrets import op2_secrets
from harbinger.llm.token_blocks import op1_token_blocks
from harbinger.llm.topk import OP11_SQL, op11_exact_topk
from harbinger.llm.toxicity import op5_toxicity
from harbinger.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    f.__name__: f for f in (op1_token_blocks, op2_secrets, op3_media, op4_embed_dedup, op5_toxicity, op6_mixing, op7_ngram_join, op8_packing, op9_pii, op10_url_filter, op11_exact_topk, op12_exponion, op13_vector_codes)
}
SQL = {"op10_url_filter": OP10_SQL, "op11_exact_topk": OP11_SQL, "op12_exponion": OP12_SQL, "op13_vector_codes": OP13_SQL}
