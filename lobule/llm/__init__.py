"""Operators for training-data work: neighbours, clusters, digests, splits, packing, leakage, personal information.

Nothing outside this subpackage imports it.
"""

from lobule.llm import queries as _queries

QUERIES = {name: f for name, f in vars(_queries).items() if name[0] == "p" and name[1:2].isdigit()}
