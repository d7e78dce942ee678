"""From syntax trees to Spark plans."""
