"""All registered queries of the subpackage."""

from hourwatt.llm import q_bpe, q_conversations, q_line_dedup, q_ngram, q_packing, q_phrases, q_pii, q_quality, q_substring, q_suffix, q_tokens, q_topk, q_vector_dedup  # noqa: F401
from hourwatt.llm.registry import ORACLES, QUERIES  # noqa: F401
