"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from codexflow.llm.decontaminate import op5_decontam_qgram
from codexflow.llm.html_text import op4_html_template
from codexflow.llm.licenses import OP9_SQL, op9_license_tfidf
from codexflow.llm.media import op10_mpeg_audio
from codexflow.llm.near_dedup import OP2_SQL, op2_minhash_tensor
from codexflow.llm.packing import op6_pack_dominance
from codexflow.llm.quality import op3_quality_bt
from codexflow.llm.secrets import op7_secret_worklist
from codexflow.llm.token_counts import op8_token_histogram
from codexflow.llm.token_output import op1_token_binary

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_binary, op2_minhash_tensor, op3_quality_bt, op4_html_template, op5_decontam_qgram,
        op6_pack_dominance, op7_secret_worklist, op8_token_histogram, op9_license_tfidf, op10_mpeg_audio,
    )
}
ORACLE_SQL = {"op2_minhash_tensor": OP2_SQL, "op9_license_tfidf": OP9_SQL}
