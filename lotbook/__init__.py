"""lotbook: land-parcel ownership data as Spark DataFrames.

Standardize county parcel layers, merge addresses and assessor records, search
parcels, extract saved property pages, cover parcels with map tiles and publish
dated snapshots. Every public function takes DataFrames and returns a lazy
DataFrame, so Catalyst sees one plan from scan to sink.
"""

__version__ = "0.1.0"
