"""Column builders (scalar functions and predicates) shared by all operators."""
from satledger.functions.columns import *  # noqa: F401,F403
from satledger.functions.predicates import *  # noqa: F401,F403
