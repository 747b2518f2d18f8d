"""loomledger: event-ledger analytics on Spark DataFrames."""
