"""An entity-resolution and analytics engine on PySpark."""
