"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .op1_language import op1_language
from .op2_secrets import op2_secrets
from .op3_quality import op3_quality
from .op4_matroska import op4_matroska
from .op5_urls import SQL as OP5_SQL
from .op5_urls import op5_urls
from .op6_suffixes import op6_suffixes
from .op7_pieces import op7_pieces
from .op8_embeddings import op8_embeddings
from .op9_simhash import op9_simhash
from .op10_mixing import op10_mixing
from .op11_minhash import op11_minhash
from .op12_sources import SQL as OP12_SQL
from .op12_sources import op12_sources
from .op13_prefixes import SQL as OP13_SQL
from .op13_prefixes import op13_prefixes

QUERIES = {f.__name__: f for f in (op1_language, op2_secrets, op3_quality, op4_matroska, op5_urls, op6_suffixes, op7_pieces, op8_embeddings, op9_simhash, op10_mixing, op11_minhash, op12_sources, op13_prefixes)}
ORACLE_SQL: dict[str, str] = {"op5_urls": OP5_SQL, "op12_sources": OP12_SQL, "op13_prefixes": OP13_SQL}
