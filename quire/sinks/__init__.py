"""Writers: JATS documents, packages and reports."""
