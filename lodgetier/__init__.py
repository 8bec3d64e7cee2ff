"""Price-tier analytics for tables of rental listings, as Spark DataFrame transforms."""
