"""The subpackage's queries and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from strandline.llm.decontaminate import op8_decontaminate
from strandline.llm.fingerprints import OP13_SQL, op13_fingerprints
from strandline.llm.html_text import op1_html
from strandline.llm.interactions import OP12_SQL, op12_interactions
from strandline.llm.jaccard import op4_jaccard
from strandline.llm.manifest import OP11_SQL, op11_manifest
from strandline.llm.oracles import OP4_SQL, OP7_SQL, OP8_SQL
from strandline.llm.pii import op9_pii
from strandline.llm.pieces import op2_sentencepiece
from strandline.llm.quality import op5_quality
from strandline.llm.sharding import op10_shards
from strandline.llm.substrings import op7_substrings
from strandline.llm.toxicity import op6_toxicity
from strandline.llm.warc import OP3_SQL, op3_warc_fixity

QUERIES = {
    "op1_html": op1_html,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_jaccard": op4_jaccard,
    "op2_sentencepiece": op2_sentencepiece,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_substrings": op7_substrings,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_shards": op10_shards,
    "op11_manifest": op11_manifest,
    "op12_interactions": op12_interactions,
    "op13_fingerprints": op13_fingerprints,
}
SQL: dict[str, str] = {
    "op3_warc_fixity": OP3_SQL,
    "op4_jaccard": OP4_SQL,
    "op7_substrings": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_manifest": OP11_SQL,
    "op12_interactions": OP12_SQL,
    "op13_fingerprints": OP13_SQL,
}
