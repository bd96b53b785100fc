"""All queries of this subpackage and their SQL, where SQL can express them."""

from agoramill.llm import abuse, capping, components, formatting, overlap, packing, pairs, personal, subjects, tokenizing

_MODULES = (packing, abuse, pairs, subjects, personal, overlap, formatting, capping, components, tokenizing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE", {}).items()}
