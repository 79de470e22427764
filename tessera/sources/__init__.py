"""Where rows come from and go to: versioned tables, and a generated dataset."""
