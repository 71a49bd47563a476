"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows of
the next stage, with the columns of ``documents`` for all but the last. ``run`` applies them to
``documents``, writing and rereading every stage. The stages decide on edit distances, components
and a global packing, which SQL cannot express: tests hold the rows against a brute-force version.
"""

from runledger.llm.pipeline import STAGES, run  # noqa: F401

ORACLE_SQL = None
