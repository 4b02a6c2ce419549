"""The queries of this subpackage, as __spark_entry__ registers them."""

from .ann import op2_nearest_neighbours
from .conversation_repair import ORACLE as CONVERSATION_ORACLE
from .conversation_repair import op11_conversation_repair
from .embedding_dedup import ORACLE as EMBEDDING_ORACLE
from .embedding_dedup import op1_embedding_near_dedup
from .html_extract import op4_html_main_text
from .importance_resampling import ORACLE as RESAMPLING_ORACLE
from .importance_resampling import op13_importance_resampling
from .jaccard_join import ORACLE as JACCARD_ORACLE
from .jaccard_join import op5_jaccard_join
from .line_dedup import ORACLE as LINE_DEDUP_ORACLE
from .line_dedup import op3_line_dedup
from .packing import op8_packing
from .pii import op9_personal_data
from .sentencepiece_viterbi import op7_sentencepiece
from .sharding import op6_sharding
from .topk_products import ORACLE as PRODUCTS_ORACLE
from .topk_products import op12_topk_products
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_nearest_neighbours, op3_line_dedup, op4_html_main_text, op5_jaccard_join, op6_sharding, op7_sentencepiece, op8_packing, op9_personal_data, op10_toxicity, op11_conversation_repair, op12_topk_products, op13_importance_resampling)}
ORACLES: dict[str, str] = {"op1_embedding_near_dedup": EMBEDDING_ORACLE, "op3_line_dedup": LINE_DEDUP_ORACLE, "op5_jaccard_join": JACCARD_ORACLE,
                          "op11_conversation_repair": CONVERSATION_ORACLE, "op12_topk_products": PRODUCTS_ORACLE, "op13_importance_resampling": RESAMPLING_ORACLE}
