"""Query plans over the standard tables; importing a module registers its queries."""

from loomgraph.plans import graphs, hygiene, inference, ledger, matching, paths, relational, resolution, rules, splitting, streams, temporal, texts, vectors  # noqa: F401
