"""DataFrame-to-DataFrame operators over the ledger and the task log."""
