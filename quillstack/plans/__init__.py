"""Named query plans and their SQL twins."""

from quillstack.plans import corpus, interpretation, retrieval

QUERIES = corpus.QUERIES | retrieval.QUERIES | interpretation.QUERIES
ORACLES = corpus.ORACLES | retrieval.ORACLES | interpretation.ORACLES
