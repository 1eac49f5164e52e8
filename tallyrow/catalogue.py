"""All queries of the engine by name, with their SQL where SQL can express them."""

from tallyrow.functions import codecs, colour, handlers, values, width
from tallyrow.operators import aggregates, folds, lookups, ordered, ranking, text
from tallyrow.sources import ssh_config
from tallyrow.streaming import agents, frames

_MODULES = (aggregates, text, ordered, lookups, folds, ranking, colour, values, width, codecs, handlers, ssh_config, agents, frames)
QUERIES = {name: q for module in _MODULES for name, q in module.QUERIES.items()}
ORACLE = {name: q.oracle for name, q in QUERIES.items() if q.oracle}
