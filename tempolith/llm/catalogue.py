"""The queries of this subpackage."""

from . import bpe, codebooks, contamination, digests, jaccard, language, licenses, pseudonyms, records, search, secrets, shards, urls

_MODULES = (bpe, codebooks, contamination, digests, jaccard, language, licenses, pseudonyms, records, search, secrets, shards, urls)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
