"""Jobs made of several queries: named queries, scan reports, profiles, scripts."""
