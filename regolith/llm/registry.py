"""The corpus queries by name, and their SQL where there is one."""

from regolith.llm.bpe import op3_bpe
from regolith.llm.embedding import op2_embedding
from regolith.llm.language import op7_language
from regolith.llm.licences import op1_licences
from regolith.llm.lines import OP9_PAGES_SQL, OP9_SQL, op9_lines, op9_pages
from regolith.llm.media import op6_media
from regolith.llm.mixing import OP4_SQL, op4_mixing
from regolith.llm.negatives import OP12_SQL, op12_negatives
from regolith.llm.resample import OP13_SQL, op13_resample
from regolith.llm.secrets import op11_secrets
from regolith.llm.simhash import op5_simhash
from regolith.llm.toxicity import op8_toxicity
from regolith.llm.wavelet import op10_wavelet

QUERIES = {
    f.__name__: f
    for f in (op1_licences, op2_embedding, op3_bpe, op4_mixing, op5_simhash, op6_media, op7_language, op8_toxicity, op9_lines, op9_pages, op10_wavelet, op11_secrets, op12_negatives, op13_resample)
}
ORACLE: dict[str, str] = {"op4_mixing": OP4_SQL, "op9_lines": OP9_SQL, "op9_pages": OP9_PAGES_SQL, "op12_negatives": OP12_SQL, "op13_resample": OP13_SQL}
