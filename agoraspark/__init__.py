"""Analytics over events, documents, conversations and ledgers as Spark DataFrame queries."""
