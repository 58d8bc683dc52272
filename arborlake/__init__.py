"""arborlake: DataFrame-native analytics over source-repository structure.

Repository trees become a DataFrame of files; rule tables are joined to names,
paths and contents; results are nested rows per repository.  Everything is a
declarative plan, so Catalyst and adaptive execution choose the physical
strategy.
"""

__version__ = "0.1.0"
