"""Where rows come from and go to: the catalog, the versioned store, services."""
