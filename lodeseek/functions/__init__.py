"""Column expressions: tokens, scores, distances. All stay in the JVM."""

from lodeseek.functions.scoring import bm25, dot, l2_squared, normalized, rrf_score, similarity, vector
from lodeseek.functions.text import tokens

__all__ = ["bm25", "dot", "l2_squared", "normalized", "rrf_score", "similarity", "tokens", "vector"]
