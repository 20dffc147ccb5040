"""Query texts and the registry that the driver reads."""
