"""Queries of the subpackage on the supplied tables, each with its oracle SQL where SQL can express it."""

from .ann import op4_nearest
from .bpe import op5_bpe
from .chat import OP10_SQL, op10_quotes
from .exact import OP13_SQL, op13_exact
from .jaccard import OP1_SQL, op1_jaccard
from .langid import op2_language_id
from .mixing import OP3_SQL, op3_mixing
from .neardup import op7_near_vectors
from .quality import op9_quality
from .repair import OP11_SQL, op11_repair
from .shared_text import OP6_SQL, op6_substring_dedup
from .spelling import OP12_SQL, op12_spelling
from .toxicity import op8_toxicity

Q = {
    "op1_jaccard": (op1_jaccard, OP1_SQL),
    "op2_language_id": (op2_language_id, None),
    "op3_mixing": (op3_mixing, OP3_SQL),
    "op4_nearest": (op4_nearest, None),
    "op5_bpe": (op5_bpe, None),
    "op6_substring_dedup": (op6_substring_dedup, OP6_SQL),
    "op7_near_vectors": (op7_near_vectors, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_quality": (op9_quality, None),
    "op10_quotes": (op10_quotes, OP10_SQL),
    "op11_repair": (op11_repair, OP11_SQL),
    "op12_spelling": (op12_spelling, OP12_SQL),
    "op13_exact": (op13_exact, OP13_SQL),
}
