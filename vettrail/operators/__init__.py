"""DataFrame operators: employers, postings, documents, attestations, limits."""
