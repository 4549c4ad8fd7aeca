"""auditloom: a document-compliance analytics engine expressed as Spark plans."""
