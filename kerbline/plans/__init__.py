"""Star schema, dashboard views, query catalogue and its SQL oracles."""
