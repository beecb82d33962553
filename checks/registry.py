"""All registered queries: name to (Spark function, SQL or None)."""

from checks import assessor_checks, layer_checks, page_checks, parcel_checks, search_checks, tile_checks

QUERIES = {
    **parcel_checks.QUERIES,
    **assessor_checks.QUERIES,
    **search_checks.QUERIES,
    **page_checks.QUERIES,
    **tile_checks.QUERIES,
    **layer_checks.QUERIES,
}
