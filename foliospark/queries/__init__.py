"""The registered queries of the document operators with their SQL. Each runs over whole tables.

Layout operators need boxes and type, which the tables lack: queries that use ``grid`` give each line of documents the made-up layout of
:func:`foliospark.sources.text.grid_elements`, and those that use ``boxes`` take boxes from the first numbers of embeddings.
"""

from foliospark.queries.layout import LAYOUT
from foliospark.queries.scores import SCORES
from foliospark.queries.stages import STAGE_QUERIES
from foliospark.queries.texts import TEXTS

ALL = {**TEXTS, **LAYOUT, **SCORES, **STAGE_QUERIES}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLES = {k: sql for k, (_, sql) in ALL.items() if sql}
