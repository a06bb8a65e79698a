"""Analytics over documents, events and conversations, declared as Spark DataFrames."""
