"""Rules, evidence and corpus operators expressed as Spark plans."""
