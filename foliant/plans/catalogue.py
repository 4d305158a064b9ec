"""All named queries: importing the operator modules registers them."""

from ..operators import answers, checks, corpus, curiosity, cycle, digests, generations, indexes, language, ledger, linguistics, moves, operations, retrieval, subwords, terms, training, vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
