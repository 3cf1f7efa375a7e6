"""perron: transit analytics, journey planning and corpus preparation as Spark plans."""
