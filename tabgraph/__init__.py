"""Tables, ordered pipelines and property graphs as lazy Spark plans."""
