"""Training-data operators: search, fingerprints, token counts, dedup, packing, scans, archives, mixing, classifiers.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames; the thin
``opN_*`` queries in :mod:`loomgraph.llm.queries` apply them with production parameters.
"""
