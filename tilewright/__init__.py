"""Analytics over catalogs of geospatial image tiles, as Spark DataFrame operators."""
