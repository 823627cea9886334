"""phenospark: computable phenotypes as Spark plans.

A phenotype is an ordered list of criteria over a table of potential cases
(one row per patient).  Every criterion here is a DataFrame transformation, so
a whole definition compiles to one Catalyst plan.
"""

from phenospark.session import get_session

__all__ = ["get_session"]
