"""Personal-finance ledger analytics as Spark DataFrame jobs.

Every public function takes whole tables and returns a DataFrame keyed by user; nothing is looped or
collected on the driver.
"""
