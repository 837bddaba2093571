"""Multi-operator jobs: the insight feed, the comprehensive report and the query catalogue."""
