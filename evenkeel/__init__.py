"""evenkeel: table reconciliation, result history and warehouse-function coverage as Spark plans."""
