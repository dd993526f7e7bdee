"""All queries of the library, by name, with their SQL; importing the modules registers them."""

from . import answers, chunks, memory, records, reranking, retrieval, studies, trials, vectors  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
