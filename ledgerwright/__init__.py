"""A Spark-native engine for analysing filings: passages, facts, ranking, formulas, ledgers."""
