"""DataFrame -> DataFrame operators over outcomes, suites, selections, caches and reports."""
