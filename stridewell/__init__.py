"""Analytics over ordered observation sequences, as Spark plans."""
